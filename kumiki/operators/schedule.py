"""CAL1-CAL6, AGG19, AGG20, WIN10: study calendars: units in order become weeks of lessons, practices and a test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slot of the week, kind (lesson, practice, test), first and last unit of the week's four that it covers.
SLOTS = [(0, "L", 0, 0), (1, "L", 1, 1), (2, "P", 0, 1), (3, "L", 2, 2), (4, "L", 3, 3), (5, "P", 2, 3), (6, "M", 0, 3)]


def activities(units: DataFrame) -> DataFrame:
    """CAL1, WIN10: (track, week, slot, kind, units, ready, seq, practice) from units (track, unit, pos from 0, ready).

    A slot whose units are all missing is left out; one with some takes those; it is ready if all its units are.
    """
    slots = F.array(*(F.struct(F.lit(s).alias("slot"), F.lit(k).alias("kind"), F.lit(a).alias("a"), F.lit(b).alias("b")) for s, k, a, b in SLOTS))
    u = units.select("track", "unit", "ready", F.floor(F.col("pos") / 4).cast("int").alias("week"), (F.col("pos") % 4).cast("int").alias("i"), F.explode(slots).alias("s"))
    u = u.where("i BETWEEN s.a AND s.b").select("track", "week", "s.slot", "s.kind", "i", "unit", "ready")
    g = u.groupBy("track", "week", "slot", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "unit"))), lambda x: x["unit"]), "+").alias("units"), F.min("ready").alias("ready"))
    w = Window.partitionBy("track").orderBy("week", "slot")  # a track has seven rows for four units
    return g.withColumn("seq", F.row_number().over(w) - 1).withColumn("practice", F.when(F.col("kind") == "P", F.sum((F.col("kind") == "P").cast("int")).over(w)))


def dated(acts: DataFrame, start: Column) -> DataFrame:
    """CAL2, CAL3: with the date of each activity of a plan begun on `start`."""
    return acts.withColumn("day", F.date_add(start, F.col("week") * 7 + F.col("slot")))


def progress(acts: DataFrame, done: DataFrame, today: Column) -> DataFrame:
    """AGG19, JN17: of each track the activities done, all, overdue ones, the one of today and the next one to do."""
    j = acts.join(done.select("track", "seq", F.lit(True).alias("done")), ["track", "seq"], "left").withColumn("done", F.coalesce("done", F.lit(False)))
    open_ = ~F.col("done")
    return j.groupBy("track").agg(
        F.count_if("done").alias("done"), F.count("*").alias("total"), F.count_if(open_ & (F.col("day") < today)).alias("behind"),
        F.min_by("units", F.when(F.col("day") == today, F.col("seq"))).alias("today"), F.min_by("units", F.when(open_, F.col("seq"))).alias("next"),
    )


def activity_items(acts: DataFrame, lessons: DataFrame, seed: str) -> DataFrame:
    """CAL4: items of each activity: quiz for lessons, practice for practices, test for tests; passages whole, in drawn order.

    `lessons` has track, unit, part (quiz, practice, test), qid, grp (passage or item).
    """
    part = F.when(F.col("kind") == "P", "practice").when(F.col("kind") == "M", "test").otherwise("quiz")
    a = acts.select("track", "seq", part.alias("part"), F.explode(F.split("units", r"\+")).alias("unit"))
    j = a.join(lessons, ["track", "part", "unit"])
    h = F.md5(F.concat(F.lit(seed + "|"), F.col("grp").cast("string")))
    return j.select("track", "seq", "qid", "grp", F.row_number().over(Window.partitionBy("track", "seq").orderBy(h, "grp", "qid")).alias("place"))


def results(rows: DataFrame) -> DataFrame:
    """CAL5: the best share, the tries and the last full result of each activity; retries of misses only don't replace it."""
    full = F.col("mode") != "wrong"
    p = F.floor(F.col("c") / F.col("n") * 1000 + 0.5) / 1000
    return rows.groupBy("activity").agg(F.max(F.when(full, p)).alias("best"), F.count("*").alias("tries"), F.max_by(F.struct("c", "n"), F.when(full, F.col("ts"))).alias("last"))


def countdown(exam: Column, today: Column, answered: Column, goal: Column, due: Column) -> Column:
    """CAL6: days to the exam, percent of the daily goal (100 at most), minutes for the due cards."""
    return F.struct(
        F.datediff(exam, today).alias("days"), F.least(F.lit(100), F.floor(answered / F.greatest(F.least(goal, F.lit(200)), F.lit(5)) * 100 + 0.5)).cast("int").alias("pct"),
        F.ceil(0.75 * due).cast("int").alias("minutes"),
    )


def index(units: DataFrame, sets: DataFrame) -> DataFrame:
    """AGG20: of each unit its items by set and whether it is ready (has a quiz)."""
    s = sets.groupBy("unit").pivot("part", ["quiz", "practice", "test"]).agg(F.count(F.lit(1)))
    j = units.select("unit").distinct().join(s, "unit", "left")
    return j.select("unit", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("quiz", "practice", "test"))).withColumn("ready", F.col("quiz") > 0)
