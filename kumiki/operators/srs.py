"""SRS1-SRS8: spaced repetition as a fold over each card's events in order.

A card's events are collected, sorted and folded by Spark's own higher-order functions; a card has as many events as a learner
gave it, so no group follows the data. Event kinds: again, hard, good, easy (reviews), wrong (a missed answer), flag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days until a card of each box is due, boxes from 0.
DAYS = [1, 3, 7, 14, 30, 60]
KNOWN = 4
CARD = "struct<box:int,due:date,reps:int,lapses:int,added:timestamp_ntz,last:timestamp_ntz,reason:string,flagged:boolean>"


def _new(e: Column, reason: str) -> Column:
    """SRS1: a new card is due on the day it was made."""
    none = F.lit(None).cast("timestamp_ntz")
    return F.struct(
        F.lit(0).alias("box"), F.to_date(e["ts"]).alias("due"), F.lit(0).alias("reps"), F.lit(0).alias("lapses"), e["ts"].alias("added"),
        none.alias("last"), F.lit(reason).alias("reason"), F.lit(reason == "flag").alias("flagged"),
    ).cast(CARD)


def _reviewed(c: Column, e: Column) -> Column:
    """SRS2: again goes to box 0 and is a lapse; hard stays, due in 2 days; good and easy go up 1 and 2 boxes, 5 at most."""
    again, hard, easy = e["kind"].isin("again", "wrong"), e["kind"] == "hard", e["kind"] == "easy"
    box = F.when(again, 0).when(hard, c["box"]).otherwise(F.least(F.lit(5), c["box"] + F.when(easy, 2).otherwise(1)))
    wait = F.when(again, 1).when(hard, 2).otherwise(F.element_at(F.array(*map(F.lit, DAYS)), (box + 1).cast("int")))
    return F.struct(
        box.alias("box"), F.date_add(F.to_date(e["ts"]), wait).alias("due"), (c["reps"] + 1).alias("reps"), (c["lapses"] + again.cast("int")).alias("lapses"),
        c["added"].alias("added"), e["ts"].alias("last"), c["reason"].alias("reason"), c["flagged"].alias("flagged"),
    ).cast(CARD)


def _flagged(c: Column) -> Column:
    return F.struct(*(c[f].alias(f) for f in ("box", "due", "reps", "lapses", "added", "last", "reason")), (~c["flagged"]).alias("flagged")).cast(CARD)


def step(c: Column, e: Column) -> Column:
    """One event on a card (null: no card yet). SRS3: a missed answer makes a card, or counts as again above box 0. SRS4: a flag
    makes a card, removes one that is only flagged, or flips the mark."""
    none = F.lit(None).cast(CARD)
    flag = F.when(c.isNull(), _new(e, "flag")).when((c["reps"] == 0) & (c["reason"] == "flag"), none).otherwise(_flagged(c))
    wrong = F.when(c.isNull(), _new(e, "wrong")).when(c["box"] > 0, _reviewed(c, e)).otherwise(c)
    review = F.when(c.isNull(), _reviewed(_new(e, "review"), e)).otherwise(_reviewed(c, e))
    return F.when(e["kind"] == "flag", flag).when(e["kind"] == "wrong", wrong).otherwise(review)


def cards(events: DataFrame, keys: list[str]) -> DataFrame:
    """SRS2-SRS5: the card of each key after all its events (keys, ts, id, kind); cards removed by a flag have no row."""
    order = F.array_sort(F.collect_list(F.struct("ts", "id", "kind")))
    g = events.groupBy(*keys).agg(order.alias("events"))
    c = F.aggregate("events", F.lit(None).cast(CARD), step)
    return g.select(*keys, c.alias("card")).where("card IS NOT NULL").select(*keys, "card.*")


def due(cards_: DataFrame, day: Column, limit: int = 50, by: list[str] = ()) -> DataFrame:
    """SRS5, TOP4: cards due by `day`, earliest first, at most `limit` of each owner; the limit is the queue's length."""
    d = cards_.where(F.col("due") <= day)
    keys = [c for c in cards_.columns if c not in ("box", "due", "reps", "lapses", "added", "last", "reason", "flagged") and c not in by]
    w = Window.partitionBy(*by).orderBy("due", *keys)
    return d.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def status(reps: Column, box: Column) -> Column:
    """SRS7."""
    return F.when(F.coalesce(reps, F.lit(0)) == 0, "new").when(box >= KNOWN, "known").otherwise("learning")


def first_outcomes(reviews: DataFrame) -> DataFrame:
    """SRS6: only the first outcome of a card in a session counts."""
    w = Window.partitionBy("session", "card").orderBy("ts", "id")
    return reviews.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def migrated(stats: DataFrame, aliases: DataFrame) -> DataFrame:
    """SRS8: statistics of dropped ids go to the ids that stand for them: counts add up, the last moment is the latest."""
    a = aliases.where("old_id IS NOT NULL AND kept_id IS NOT NULL").groupBy(F.col("old_id").alias("o")).agg(F.min("kept_id").alias("kept"))
    m = stats.join(a, F.expr("id = o"), "left").withColumn("id", F.coalesce("kept", "id"))
    return m.groupBy("id").agg(F.sum("n").alias("n"), F.sum("c").alias("c"), F.sum("w").alias("w"), F.max("last").alias("last"))
