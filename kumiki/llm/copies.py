"""Rows that are the same but for white space, case, punctuation and the order of list parts.

1. Each row's fields stream through the skip-and-fold table into rolling polynomial hashes (two of 64 bits); the hashes of a
   list's parts are added, so their order is without effect. Only (id, fingerprint) rows are shuffled to count groups, with
   map-side combine.
2. Groups of a bounded number (each at least a fixed share of all rows) are hot; their rows are salted before any shuffle of
   whole rows, and the group's first row is copied to every salt.
3. Rows of groups are hashed to tasks by (fingerprint, salt) and sorted there; each row is compared with its group's first row by two
   skipping pointers, one row at a time. Rows that differ in spite of equal fingerprints are grouped by a 256-bit digest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kumiki.llm import fold
from kumiki.session import checkpointed, partitions_for, spread

HOT_SHARE = 0.02
HOT_LEAST = 50_000
#: Rows of groups that a task compares.
PER_TASK = 100_000


def _fingerprints(fields: list[str], lists: tuple[bool, ...], counts: list[str], bits: int):
    """A mapInArrow function that appends f1, f2 (fingerprint) and n_<c> (letters and digits) of each of `counts`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.uint64((1 << bits) - 1)
        for b in batches:
            n = b.num_rows
            f1, f2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            size: dict[str, np.ndarray] = {}
            for k, (name, many) in enumerate(zip(fields, lists)):
                col = b.column(name).to_pylist()
                if many:
                    at = np.fromiter((len(x or ()) for x in col), np.int64, n)
                    g1, g2, _ = fold.hashes([o for x in col for o in (x or ())])
                    of = np.repeat(np.arange(n), at)
                    h1, h2 = at.astype(np.uint64), at.astype(np.uint64)
                    np.add.at(h1, of, fold.mix(g1))
                    np.add.at(h2, of, fold.mix(g2))
                else:
                    h1, h2, size[name] = fold.hashes(col)
                f1 = fold.mix(f1 * np.uint64(31) + h1 + np.uint64(k))
                f2 = fold.mix(f2 * np.uint64(37) + h2 + np.uint64(k))
            for c in counts:
                if c not in size:
                    size[c] = fold.hashes(b.column(c).to_pylist())[2]
            more = {"f1": (f1 & mask).view(np.int64), "f2": (f2 & mask).view(np.int64)} | {f"n_{c}": size[c] for c in counts}
            yield pa.RecordBatch.from_arrays(
                [*b.columns, *(pa.array(v, pa.int64()) for v in more.values())], [*b.schema.names, *more]
            )

    return run


def _compare(fields: list[str], lists: tuple[bool, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = first = head = None
        for b in batches:
            out: dict[str, list] = {"first": [], "rid": [], "digest": []}
            cols = [b.column(c).to_pylist() for c in fields]
            keys = zip(*(b.column(c).to_pylist() for c in ("f1", "f2", "salt")))
            for k, rid, row in zip(keys, b.column("rid").to_pylist(), zip(*cols)):
                if k != key:
                    key, first, head = k, rid, row
                elif rid != first:
                    ok = fold.same_row(head, row, lists)
                    out["first"].append(first if ok else None)
                    out["rid"].append(rid)
                    out["digest"].append(None if ok else fold.row_digest(row, lists))
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["first"], pa.int64()), pa.array(out["rid"], pa.int64()), pa.array(out["digest"], pa.binary())],
                ["first", "rid", "digest"],
            )

    return run


def copy_pairs(
    rows: DataFrame,
    fields: list[str],
    list_fields: tuple[str, ...] = (),
    hot_share: float = HOT_SHARE,
    hot_least: int = HOT_LEAST,
    bits: int = 64,
) -> DataFrame:
    """(rid_a, rid_b): each row `rid_b` that repeats an earlier row, with the smallest rid of its group.

    `rows` has a unique long `rid`; other columns are ignored. Null, empty and blank fields are equal; a null list is as an
    empty one. Rows without any letter or digit in any field are copies of one another. A null rid takes no part. `bits`
    narrows the fingerprints in tests.
    """
    lists = tuple(f in list_fields for f in fields)
    text = rows.where("rid IS NOT NULL").select("rid", *fields)
    schema = ", ".join(f"{f} {t}" for f, t in text.dtypes) + ", f1 long, f2 long"
    marked = spread(text, "rid").mapInArrow(_fingerprints(fields, lists, [], bits), schema)
    groups = marked.groupBy("f1", "f2").agg(F.min("rid").alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = checkpointed(groups)
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    least = max(hot_least, int(total * hot_share))
    # at most 1 / hot_share groups, each of that share of all rows in groups
    hot = F.broadcast(groups.where(F.col("n") >= least).select("f1", "f2", "first", F.ceil(F.col("n") / least).alias("salts")))
    zero = F.lit(0).cast("long")
    every = F.sequence(zero, F.col("salts") - 1)
    salt = F.when(F.col("salts").isNull(), F.array(zero)).when(F.col("rid") == F.col("first"), every).otherwise(F.array(F.pmod(F.xxhash64("rid"), F.col("salts"))))
    salted = marked.join(hot, ["f1", "f2"], "left").withColumn("salt", F.explode(salt))
    salts = F.when(F.col("n") >= least, F.sequence(zero, F.ceil(F.col("n") / least) - 1)).otherwise(F.array(zero))
    wanted = groups.select("f1", "f2", F.explode(salts).alias("salt"))
    n = partitions_for(total, PER_TASK, rows.sparkSession)
    sorted_ = (
        salted.join(wanted, ["f1", "f2", "salt"], "left_semi")
        .select("rid", *fields, "f1", "f2", "salt")
        .repartition(n, "f1", "f2", "salt")
        .sortWithinPartitions("f1", "f2", "salt", "rid")
    )
    seen = checkpointed(sorted_.mapInArrow(_compare(fields, lists), "first long, rid long, digest binary"))
    pairs = seen.where("digest IS NULL").select(F.col("first").alias("rid_a"), F.col("rid").alias("rid_b"))
    odd = seen.where("digest IS NOT NULL")
    own = odd.groupBy("digest").agg(F.min("rid").alias("rid_a"))
    return pairs.unionByName(
        odd.join(own, "digest").where("rid <> rid_a").select("rid_a", F.col("rid").alias("rid_b"))
    )


def collapsed(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per record: `rows` without further copies, with `copies` (1 for a record that occurs once)."""
    more = pairs.groupBy(F.col("rid_a").alias("k")).agg(F.count("*").alias("more"))
    kept = rows.join(pairs.select(F.col("rid_b").alias("k")), F.expr("rid = k"), "left_anti")
    return kept.join(more, F.expr("rid = k"), "left").withColumn("copies", F.coalesce("more", F.lit(0)) + 1).drop("k", "more")
