"""References to records that do not exist, decided as of the moment of each reference.

Targets are present in half-open intervals [begin, end). A reference (key, at) is an orphan unless an interval of its key
holds `at`. Both sides may have a key with a third of all rows, so the work is split by key weight:

1. References are pre-aggregated per (key, at) with their count (map-side combine), targets per (key, moment) with the net
   change of open intervals; repeated rows collapse before any shuffle of whole rows.
2. Keys whose pre-aggregated rows are at least a fixed share of the total are heavy. There can be no more than 1 / share of
   them per side, whatever the data, so the list of heavy keys is broadcast.
3. Light keys are few rows each: their intervals come from a window over the key, and a shuffled left anti join decides.
4. Heavy keys: running sums in two levels (parts of a key, then rows of a part) give the moments at which presence begins or
   ends. If these are at most `broadcast_rows`, their intervals are broadcast to a left anti join; else references and changes
   are swept together by the same running sums, so that no task gets more than a part of a key.
5. The orphans of both ways are united; they go back to the referring rows by the same split, heavy moments broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kumiki.operators.quality import running
from kumiki.session import checkpointed

HEAVY_SHARE = 0.02
BROADCAST_ROWS = 100_000
#: A key that holds more than white space.
WRITTEN = r"[^\s\u00a0\u3000]"


def _changes(targets: DataFrame) -> DataFrame:
    """(key, at, d): net change of the number of open intervals. Intervals without a begin or of no length are none."""
    t = targets.where("key IS NOT NULL AND begin IS NOT NULL AND (end IS NULL OR end > begin)").select("key", "begin", "end")
    steps = F.array(
        F.struct(F.col("begin").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("d"))
    )
    return (
        t.select("key", F.explode(steps).alias("s"))
        .where("s.at IS NOT NULL")
        .groupBy("key", F.col("s.at").alias("at"))
        .agg(F.sum("s.d").cast("long").alias("d"))
        .where("d <> 0")
    )


def _edges(n: DataFrame) -> DataFrame:
    """Of changes with their running sum `n` those at which presence begins or ends."""
    return n.where((F.col("n") > 0) != (F.col("n") - F.col("d") > 0))


def _intervals(edges: DataFrame) -> DataFrame:
    """Disjoint (key, begin, end) in which the number of open intervals is positive."""
    k = Window.partitionBy("key").orderBy("at")
    return edges.select("key", F.col("at").alias("begin"), F.lead("at").over(k).alias("end"), "n").where("n > 0").drop("n")


def _absent(refs: DataFrame, intervals: DataFrame) -> DataFrame:
    inside = (F.col("r.key") == F.col("i.key")) & (F.col("r.at") >= F.col("i.begin")) & (
        F.col("i.end").isNull() | (F.col("r.at") < F.col("i.end"))
    )
    return refs.alias("r").join(intervals.alias("i"), inside, "left_anti")


def _swept(refs: DataFrame, changes: DataFrame) -> DataFrame:
    """Orphans among `refs` (none with a null moment) by running sums; at one moment changes come first."""
    both = refs.select("key", "at", F.lit(0).cast("long").alias("d"), "n", F.lit(1).alias("ref")).unionByName(
        changes.select("key", "at", "d", F.lit(0).cast("long").alias("n"), F.lit(0).alias("ref"))
    )
    return running(both, ["key"], [F.col("at"), F.col("ref")], "d", "open").where("ref = 1 AND open <= 0").select("key", "at", "n")


def orphan_moments(refs: DataFrame, targets: DataFrame, heavy_share: float = HEAVY_SHARE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Distinct (key, at) of `refs` (key, at) for which no interval of `targets` (key, begin, end) holds `at`, and `n`, their rows.

    Null or blank keys are no references. A null `at` is no moment at which anything could be present: it is an orphan.
    Intervals that overlap, repeat or have no length are allowed. Empty targets make every reference an orphan.
    """
    refs = checkpointed(refs.where(F.col("key").rlike(WRITTEN)).groupBy("key", "at").agg(F.count("*").alias("n")))
    changes = checkpointed(_changes(targets))
    sized = refs.select("key", F.lit(1).alias("w"), F.lit(0).alias("v")).unionByName(
        changes.select("key", F.lit(0).alias("w"), F.lit(1).alias("v"))
    )
    weight = sized.groupBy("key").agg(F.sum("w").alias("w"), F.sum("v").alias("v"))
    least = {k: max(2, int(x.count() * heavy_share)) for k, x in (("w", refs), ("v", changes))}
    heavy = checkpointed(weight.where((F.col("w") >= least["w"]) | (F.col("v") >= least["v"])).select("key"))
    on = F.broadcast(heavy)  # at most 2 / heavy_share rows: each holds that share of one side
    light = changes.join(on, "key", "left_anti").withColumn("n", F.sum("d").over(Window.partitionBy("key").orderBy("at")))
    found = _absent(refs.join(on, "key", "left_anti"), _intervals(_edges(light))).select("key", "at", "n")
    if heavy.isEmpty():
        return found
    hot_refs, hot_changes = refs.join(on, "key", "left_semi"), changes.join(on, "key", "left_semi")
    edges = checkpointed(_edges(running(hot_changes, ["key"], [F.col("at")], "d", "n")))
    if edges.count() <= broadcast_rows:
        return found.unionByName(_absent(hot_refs, F.broadcast(_intervals(edges))).select("key", "at", "n"))
    return found.unionByName(_swept(hot_refs.where("at IS NOT NULL"), hot_changes)).unionByName(hot_refs.where("at IS NULL").select("key", "at", "n"))


def _referring(rows: DataFrame, lost: DataFrame, heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """The rows (with key and at) whose moment is in `lost`; moments of a fixed share of all rows are broadcast, others shuffled."""
    lost = checkpointed(lost.select(F.col("key").alias("k"), F.col("at").alias("t"), "n"))
    least = max(2, int(rows.count() * heavy_share))
    heavy, light = F.broadcast(lost.where(F.col("n") >= least).drop("n")), lost.where(F.col("n") < least).drop("n")  # heavy: at most 1 / heavy_share
    on = F.expr("key = k AND at <=> t")
    return rows.join(heavy, on, "left_semi").unionByName(rows.join(heavy, on, "left_anti").join(light, on, "left_semi"))


def bank_references(bank: DataFrame, exams: DataFrame) -> DataFrame:
    """(tab, rec_id, key, at): what bank rows say of passages and exams of questions. Blank keys are no references."""
    b = bank.select(
        F.lit("bank").alias("tab"), F.col("id").alias("rec_id"), F.col("passage_id").alias("key"), F.col("built_at").alias("at")
    )
    x = exams.select(
        F.lit("exams").alias("tab"), F.col("id").alias("rec_id"), F.explode("parts").alias("part", "ids"), F.col("built_at").alias("at")
    ).select("tab", "rec_id", F.explode("ids").alias("key"), "at")
    return b.unionByName(x).where(F.col("key").rlike(WRITTEN))


def bank_orphans(bank: DataFrame, passages: DataFrame, exams: DataFrame, aliases: DataFrame, **how) -> DataFrame:
    """(tab, rec_id, key, at, n): orphan references of the item bank, `n` rows each.

    A passage is present while a row of its pid is; a question while a bank row of its id is, or of the id an alias gives for
    it in one step. Repeated exams, aliases and deliveries count once for presence and each for `n`.
    """
    refs = bank_references(bank, exams)
    refs = checkpointed(refs.groupBy("tab", "rec_id", "key", "at").agg(F.count("*").alias("n")))
    shown = passages.select(F.col("pid").alias("key"), F.col("added_at").alias("begin"), F.col("deleted_at").alias("end"))
    kept = bank.select(F.col("id").alias("key"), F.col("built_at").alias("begin"), F.col("removed_at").alias("end")).distinct()
    steps = aliases.select("old_id", "kept_id").where("old_id IS NOT NULL AND kept_id IS NOT NULL").distinct()
    through = kept.join(steps, kept.key == steps.kept_id).select(F.col("old_id").alias("key"), "begin", "end")
    out = None
    for tab, targets in (("bank", shown), ("exams", kept.unionByName(through))):
        own = refs.where(F.col("tab") == tab)
        lost = orphan_moments(own.select("key", "at"), targets, **how)
        found = _referring(own, lost)
        out = found if out is None else out.unionByName(found)
    return out
