"""MRG1-MRG8: reconciling the states of two devices; states are one row a key, so every rule is a full join.

A collection row is (coll, id, t, v): t the time of its last change. Equal times go to the remote side, so that both sides end
alike. Tombstones are (coll, id, t).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TTL_DAYS, HISTORY = 180, 300


def tombstones(a: DataFrame, b: DataFrame, now: Column) -> DataFrame:
    """MRG2: the latest deletion of each key; those of 180 days or more are forgotten."""
    return a.unionByName(b).groupBy("coll", "id").agg(F.max("t").alias("t")).where(F.col("t") > now - F.expr(f"INTERVAL {TTL_DAYS} DAYS"))


def last_writer(local: DataFrame, remote: DataFrame, dead: DataFrame) -> DataFrame:
    """MRG1, JN18: the later row of each key, the remote one of equals, unless a deletion is not earlier."""
    x = local.select("coll", "id", F.col("t").alias("tx"), F.col("v").alias("vx"))
    y = remote.select("coll", "id", F.col("t").alias("ty"), F.col("v").alias("vy"))
    j = x.join(y, ["coll", "id"], "full")
    mine = F.col("ty").isNull() | (F.col("tx").isNotNull() & (F.col("tx") > F.col("ty")))
    w = j.select("coll", "id", F.when(mine, F.col("tx")).otherwise(F.col("ty")).alias("t"), F.when(mine, F.col("vx")).otherwise(F.col("vy")).alias("v"))
    return w.join(dead.select("coll", "id", F.col("t").alias("d")), ["coll", "id"], "left").where("d IS NULL OR t > d").drop("d")


def owned(counters: DataFrame, owner: Column) -> DataFrame:
    """MRG7: daily counters of old records, which name no device, belong to the side's own device."""
    return counters.withColumn("device", F.coalesce("device", owner))


def daily(local: DataFrame, remote: DataFrame) -> DataFrame:
    """MRG4, JN19: of each day and device the greater counter (answers, then seconds, then remote), then day totals."""
    x = local.select("day", "device", "a", "c", "s", F.lit(0).alias("r"))
    y = remote.select("day", "device", "a", "c", "s", F.lit(1).alias("r"))
    best = x.unionByName(y).groupBy("day", "device").agg(F.max(F.struct("a", F.coalesce("s", F.lit(0)).alias("k"), "r", "c", "s")).alias("m"))
    return best.groupBy("day").agg(F.sum("m.a").alias("answered"), F.sum("m.c").alias("correct"), F.sum("m.s").alias("secs"))


def keys(local: DataFrame, remote: DataFrame) -> DataFrame:
    """SET2: the keys of both sides, each once, and which side has it."""
    x = local.select("coll", "id", F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(remote.select("coll", "id", F.lit(0).alias("x"), F.lit(1).alias("y")))
    return x.groupBy("coll", "id").agg((F.max("x") == 1).alias("local"), (F.max("y") == 1).alias("remote"))


def history(local: DataFrame, remote: DataFrame, dead: DataFrame, cap: int = HISTORY, by: list[str] = ()) -> DataFrame:
    """MRG3: sessions of both sides once (the remote copy), deleted ids never, the newest `cap` of each owner."""
    from pyspark.sql import Window

    both = local.withColumn("r", F.lit(1)).unionByName(remote.withColumn("r", F.lit(0)))
    one = both.groupBy(*by, "id").agg(F.min_by(F.struct("t", "v"), "r").alias("x")).select(*by, "id", "x.t", "x.v")
    one = one.join(dead.where("coll = 'history'").select("id"), "id", "left_anti")
    return one.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("t"), "id"))).where(F.col("k") <= cap).drop("k")


def fenced(rows: DataFrame, cut: Column) -> DataFrame:
    """MRG6: what stays of the older side after the other side began a new epoch at `cut`: rows changed later; no daily rows."""
    return rows.where((F.col("t") > cut) & (F.col("coll") != "daily"))


def newer_epoch(a_id: Column, a_at: Column, b_id: Column, b_at: Column) -> Column:
    """MRG6: whether b's epoch is the newer one: later, or of equal moment and the greater id."""
    return (a_id != b_id) & ((b_at > a_at) | ((b_at == a_at) & (b_id > a_id)))


def merged(local: DataFrame, remote: DataFrame, dead: DataFrame, local_epoch: tuple[str, object], remote_epoch: tuple[str, object]) -> DataFrame:
    """MRG1, MRG6: the state of both sides; an epoch is (id, moment). Of different epochs the older side keeps only what it changed
    after the newer one began."""
    (a, at), (b, bt) = local_epoch, remote_epoch
    if a != b:
        if (bt, b) > (at, a):
            local = fenced(local, F.lit(bt))
        else:
            remote = fenced(remote, F.lit(at))
    return last_writer(local, remote, dead)


def imported(local: DataFrame, file: DataFrame, dead: DataFrame, mode: str) -> DataFrame:
    """MRG8: a state after an import: 'merge' takes the file as the other side of the same epoch, 'replace' takes the file alone,
    'reset' takes nothing. The last two begin a new epoch: `new_epoch`."""
    if mode == "merge":
        return last_writer(local, file, dead)
    return file.select("coll", "id", "t", "v") if mode == "replace" else local.where("false").select("coll", "id", "t", "v")


def new_epoch(mode: str, epoch: tuple[str, object], fresh: tuple[str, object]) -> tuple[str, object]:
    """MRG8: the epoch after an import: a merge keeps the local one."""
    return epoch if mode == "merge" else fresh


def settings(local: DataFrame, remote: DataFrame) -> DataFrame:
    """MRG5: settings by the later change (remote of equals); the theme stays the local one."""
    x = local.select("owner", F.col("at").alias("ax"), F.col("body").alias("bx"), F.col("theme").alias("tx"))
    y = remote.select("owner", F.col("at").alias("ay"), F.col("body").alias("by"), F.col("theme").alias("ty"))
    j = x.join(y, "owner", "full")
    mine = F.col("ay").isNull() | (F.col("ax").isNotNull() & (F.col("ax") > F.col("ay")))
    return j.select("owner", F.when(mine, F.col("bx")).otherwise(F.col("by")).alias("body"), F.coalesce("tx", "ty").alias("theme"), F.greatest("ax", "ay").alias("at"))


def same_state(a: DataFrame, b: DataFrame) -> bool:
    """SCL2: whether two states hold the same rows, as often, in any order and column order; by one hash a side."""

    def total(df: DataFrame):
        cols = sorted(df.columns)
        h = F.xxhash64(*[F.col(c).cast("string") for c in cols], *[F.col(c).isNull() for c in cols])
        return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).alias("h")).first()

    return sorted(a.columns) == sorted(b.columns) and total(a) == total(b)
