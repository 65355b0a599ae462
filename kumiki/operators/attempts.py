"""Folds of the attempt log: item statistics, accuracy, daily counters, calendars, streaks, session grading.

The log is append-only: (attempt, ts, device, qid, mode, ok, secs). Every fold is a plain aggregation with map-side combine;
dimensions of fixed size (types, sections) are broadcast, item tables are joined by Spark's own choice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kumiki.functions.scalars import pct


def item_stats(attempts: DataFrame) -> DataFrame:
    """AGG1: attempts, right and wrong answers and last moment of each item."""
    ok = F.col("ok")
    return attempts.groupBy("qid").agg(F.count("*").alias("n"), F.count_if(ok).alias("c"), F.count_if(~ok).alias("w"), F.max("ts").alias("last"))


def accuracy(stats: DataFrame, items: DataFrame) -> DataFrame:
    """AGG2, JN1: seen items, attempts and percent right by type, by section and over all; unknown items are skipped."""
    s = stats.join(items, "qid")
    by = s.groupingSets([["type"], ["section"], []], "type", "section").agg(F.count("*").alias("seen"), F.sum("n").alias("n"), F.sum("c").alias("c"))
    return by.withColumn("pct", pct(F.col("c"), F.col("n")))


def weakest(stats: DataFrame, items: DataFrame, k: int, least: int = 5) -> DataFrame:
    """TOP1: the k types of least percent among those with enough attempts; ties by type."""
    t = stats.join(items, "qid").groupBy("type").agg(F.sum("n").alias("n"), F.sum("c").alias("c")).where(F.col("n") >= least)
    return t.withColumn("pct", pct(F.col("c"), F.col("n"))).orderBy("pct", "type").limit(k)


def daily(attempts: DataFrame) -> DataFrame:
    """AGG3: answers, right ones and whole seconds of each day and device."""
    return attempts.groupBy(F.to_date("ts").alias("day"), "device").agg(
        F.count("*").alias("a"), F.count_if("ok").alias("c"), F.sum(F.floor(F.col("secs") + 0.5)).cast("long").alias("s")
    )


def by_day(counters: DataFrame) -> DataFrame:
    """AGG3: day totals over devices."""
    return counters.groupBy("day").agg(F.sum("a").alias("answered"), F.sum("c").alias("correct"), F.sum("s").alias("secs"))


def last_days(days: DataFrame, today: Column, n: int = 7) -> DataFrame:
    """AGG4: sums of the last n days."""
    d = days.where((F.col("day") > F.date_sub(today, n)) & (F.col("day") <= today))
    return d.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("answered", "correct", "secs")))


def calendar(days: DataFrame, today: DataFrame, n: int = 30) -> DataFrame:
    """AGG5: the last n days, days without answers as 0. `today` has one row with the column `today`."""
    spine = today.select(F.explode(F.sequence(F.date_sub("today", n - 1), F.col("today"))).alias("day"))
    return spine.join(days, "day", "left").select("day", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("answered", "correct")))


def streaks(attempts: DataFrame, today: Column) -> DataFrame:
    """WIN2: of each device the run of active days that ends today or yesterday; 0 if none does."""
    days = attempts.select("device", F.to_date("ts").alias("day")).distinct()
    w = Window.partitionBy("device").orderBy("day")  # a device has one row a day
    runs = days.withColumn("run", F.date_sub("day", F.row_number().over(w))).groupBy("device", "run").agg(F.count("*").alias("n"), F.max("day").alias("end"))
    live = F.max(F.when(F.col("end") >= F.date_sub(today, 1), F.col("n")))
    return runs.groupBy("device").agg(F.coalesce(live, F.lit(0)).alias("streak"))


def grade(answers: DataFrame, key: DataFrame) -> DataFrame:
    """AGG6, JN2: every answer with `ok`; unanswered ones are wrong, answers to unknown items are dropped."""
    return answers.join(key, "qid").withColumn("ok", F.coalesce(F.col("given") == F.col("answer"), F.lit(False)))


def review(graded: DataFrame, flagged: DataFrame) -> DataFrame:
    """FLT12: graded answers with `shown`, one row for each list that shows them: all, wrong, right and flag (`flagged` has qid)."""
    f = flagged.select(F.col("qid").alias("_q")).distinct()
    lists = F.array(F.lit("all"), F.when(F.col("ok"), "right").otherwise("wrong"), F.when(F.col("_q").isNotNull(), F.lit("flag")))
    j = graded.join(f, F.expr("qid = _q"), "left")
    return j.withColumn("shown", F.explode(F.filter(lists, lambda x: x.isNotNull()))).drop("_q")


def session_scores(graded: DataFrame, elapsed: DataFrame) -> DataFrame:
    """AGG6: score of each session, its counts by section and by type, and seconds for each question (elapsed time over questions)."""
    s = graded.groupBy("session", "section", "type").agg(F.count("*").alias("n"), F.count_if("ok").alias("c"))
    types = F.array_sort(F.collect_list(F.struct("type", "section", "c", "n")))  # at most one entry a type and section
    t = s.groupBy("session").agg(F.sum("n").alias("total"), F.sum("c").alias("correct"), types.alias("x"))

    def summed(key: str) -> Column:
        names = F.array_sort(F.array_distinct(F.transform("x", lambda e: e[key])))

        def total(k: Column, f: str) -> Column:
            return F.aggregate(F.filter("x", lambda e: e[key] == k), F.lit(0).cast("long"), lambda a, e: a + e[f])

        return F.transform(names, lambda k: F.struct(k.alias(key), total(k, "c").alias("c"), total(k, "n").alias("n")))

    t = t.select("session", "total", "correct", summed("section").alias("sections"), summed("type").alias("types"))
    return t.join(elapsed, "session").withColumn("secs_each", F.floor(F.col("elapsed") / F.col("total") * 1000 + 0.5) / 1000)


def estimates(graded: DataFrame) -> DataFrame:
    """AGG7: three part scores of 60, passed iff all parts are there, their sum is at least 95 and each at least 19."""
    part = F.when(F.col("section").isin("moji", "bunpo"), "language").when(F.col("section") == "dokkai", "reading").otherwise("listening")
    p = graded.withColumn("part", part).groupBy("session").pivot("part", ["language", "reading", "listening"])
    p = p.agg(F.floor(60 * F.count_if("ok") / F.nullif(F.count(F.lit(1)), F.lit(0)) + 0.5).cast("int"))
    all3 = F.col("language") + F.col("reading") + F.col("listening")
    ok = all3.isNotNull() & (all3 >= 95) & (F.least("language", "reading", "listening") >= 19)
    return p.withColumn("passed", F.coalesce(ok, F.lit(False)))


def time_spent(attempts: DataFrame, most: int = 300) -> DataFrame:
    """WIN11: seconds since the device's previous answer, at most `most`; 0 for the first."""
    w = Window.partitionBy("device").orderBy("ts", "attempt")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    return attempts.select("attempt", F.least(F.lit(float(most)), F.coalesce(gap / 1e6, F.lit(0.0))).alias("spent"))


def recent(history: DataFrame, by: list[str], order: list[Column], cap: int = 300) -> DataFrame:
    """TOP3: the newest `cap` sessions of each owner with `place` (1 is the newest) and the places in the lists shown: home (3),
    chart (12, oldest first) and list (60); null where a list doesn't show the session."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    h = history.withColumn("place", place).where(F.col("place") <= cap)
    shown = h.groupBy(*(F.col(c).alias(f"_{c}") for c in by)).agg(F.least(F.count("*"), F.lit(12)).cast("int").alias("_n"))
    h = h.join(shown, F.expr(" AND ".join(f"`{c}` <=> `_{c}`" for c in by)))
    return h.select(
        *history.columns, "place", F.when(F.col("place") <= 3, F.col("place")).alias("home"), F.when(F.col("place") <= 12, F.col("_n") + 1 - F.col("place")).alias("chart"), F.when(F.col("place") <= 60, F.col("place")).alias("list")
    )


def lockouts(failures: DataFrame, gap_s: int, most: int) -> DataFrame:
    """STR4: runs of failures of one key less than `gap_s` seconds apart with at least `most` failures; locked from that one on."""
    w = Window.partitionBy("key").orderBy("ts", "id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    f = failures.withColumn("new", F.coalesce(gap >= gap_s * 1_000_000, F.lit(True)).cast("int"))
    f = f.withColumn("run", F.sum("new").over(w)).withColumn("n", F.row_number().over(Window.partitionBy("key", "run").orderBy("ts", "id")))
    return f.groupBy("key", "run").agg(F.count("*").alias("fails"), F.min(F.when(F.col("n") == most, F.col("ts"))).alias("locked_at")).where(F.col("fails") >= most)
