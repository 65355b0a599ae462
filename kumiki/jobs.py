"""API2: the pipeline's jobs on files: `python -m kumiki.jobs build --raw 'raw/*.json' --out bank`, `batches`, `validate`."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from kumiki.operators import bank as B
from kumiki.operators import quality as Q
from kumiki.session import checkpointed
from kumiki.sources import readers, writers


def build(spark: SparkSession, raw: str, out: str, tier_b: list[str], official: list[str], excluded: list[str]) -> None:
    """Raw files to the bank: admitted, validated, linked, merged; written with aliases, exams and the manifest."""
    rows = readers.raw_files(spark, raw, tier_b, official)
    # ranks are numbers: rows are numbered by range partition and place in it, without sorting all in one task
    ranged = checkpointed(rows.repartitionByRange("rank").sortWithinPartitions("rank").withColumn("n", F.monotonically_increasing_id()))
    rows = B.admitted(ranged, excluded).withColumn("rid", F.col("n")).withColumn("crawled_at", F.lit(None).cast("timestamp_ntz"))
    tiers = rows.select("source").distinct().withColumn("tier", F.when(F.col("source").isin(*tier_b, ""), "B").otherwise("A"))
    v = B.validated(rows, tiers).withColumn("rank", F.col("rid"))
    good = checkpointed(B.with_keys(v.where("reason IS NULL")))
    links = checkpointed(B.linked(good))
    kept = checkpointed(B.survivors(good, links))
    writers.bank(kept.drop("k", "lk", "norm_options"), f"{out}/bank")
    ids = good.select("rank", "id")
    alias = links.where("NOT kept").join(ids.withColumnRenamed("id", "old_id"), "rank").join(ids.select(F.col("rank").alias("survivor"), F.col("id").alias("kept_id")), "survivor")
    alias.select("old_id", "kept_id").write.mode("overwrite").parquet(f"{out}/aliases")
    sources = tiers.select("source", F.col("source").isin(*official, "").alias("official"))
    sizes = rows.groupBy("exam").agg(F.count("*").alias("size"))
    B.exams_of(kept, sizes, sources).write.mode("overwrite").parquet(f"{out}/exams")
    writers.json_lines(B.manifest(kept).unionByName(v.where("reason IS NOT NULL").groupBy(F.lit("dropped").alias("kind"), F.col("reason").alias("key")).agg(F.count("*").alias("n"))), f"{out}/manifest")


def batches(spark: SparkSession, bank: str, done: str, out: str, size: int) -> None:
    """Bank items that no annotation file holds, in numbered batches of each section and tier."""
    b = readers.bank_sections(spark, bank).join(readers.annotations(spark, done).select("id"), "id", "left_anti")
    order = [F.col("passage_id").isNull(), F.col("id")]
    writers.batches(Q.batches(b, ["section", "tier"], order, size), out)


def validate(spark: SparkSession, bank: str) -> int:
    """Broken item rules by rule; the number of broken rules is the exit code's sign."""
    broken = Q.item_rules(readers.bank_sections(spark, bank)).groupBy("rule").agg(F.count("*").alias("n")).collect()  # one row a rule
    for r in broken:
        print(r["rule"], r["n"])
    return int(bool(broken))


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="kumiki")
    sub = p.add_subparsers(dest="job", required=True)
    b = sub.add_parser("build")
    b.add_argument("--raw", required=True)
    b.add_argument("--out", required=True)
    for x in ("--tier-b", "--official", "--excluded"):
        b.add_argument(x, nargs="*", default=[])
    t = sub.add_parser("batches")
    for x in ("--bank", "--done", "--out"):
        t.add_argument(x, required=True)
    t.add_argument("--size", type=int, default=40)
    sub.add_parser("validate").add_argument("--bank", required=True)
    a = p.parse_args(args)
    spark = SparkSession.builder.appName(f"kumiki {a.job}").getOrCreate()
    if a.job == "build":
        build(spark, a.raw, a.out, a.tier_b, a.official, a.excluded)
    elif a.job == "batches":
        batches(spark, a.bank, a.done, a.out, a.size)
    else:
        return validate(spark, a.bank)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
