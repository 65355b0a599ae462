"""SNK1-SNK8: writers of banks, exams, batches and exported states, and the codec of synced blobs."""

from __future__ import annotations

import base64
import gzip

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def bank(df: DataFrame, path: str) -> None:
    """SNK1: one partition a section, so that readers of a section read only its files."""
    df.repartition("section", F.pmod(F.xxhash64("id"), F.lit(16))).write.mode("overwrite").partitionBy("section").parquet(path)


def used_passages(bank_: DataFrame, passages: DataFrame) -> DataFrame:
    """SNK1: the passages that bank rows use."""
    return passages.join(bank_.select(F.col("passage_id").alias("pid")).where("pid IS NOT NULL"), "pid", "left_semi")


def json_lines(df: DataFrame, path: str) -> None:
    """SNK2, SNK4: rows as JSON objects."""
    df.write.mode("overwrite").json(path)


def finished(df: DataFrame, reason, dimensions: tuple[str, ...] = ("section", "type", "mondai", "exam")) -> tuple[DataFrame, DataFrame]:
    """SNK3: valid rows of distinct id (the first by rank), and their counts by each dimension (dimension, value, n)."""
    w = Window.partitionBy("id").orderBy("rank")
    ok = df.where(reason.isNull()).withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in dimensions)))
    return ok, ok.select(each.alias("x")).groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"))


def batches(df: DataFrame, path: str) -> None:
    """SNK5: annotation batches, a folder each."""
    df.write.mode("overwrite").partitionBy("section", "tier", "batch").json(path)


def exported(state: DataFrame, app: str, at: str, device: str) -> DataFrame:
    """SNK7: a state as one JSON text with its marks."""
    marks = [F.lit(app).alias("app"), F.lit(at).alias("exportedAt"), F.lit(device).alias("exportedFrom")]
    return state.select(F.to_json(F.struct(*marks, *[F.col(c) for c in state.columns])).alias("value"))


def pack(text: str, least: int = 0) -> str:
    """SNK8: gz: and the compressed text in base 64; js: and the text where compression doesn't pay."""
    packed = "gz:" + base64.b64encode(gzip.compress(text.encode(), 6, mtime=0)).decode()
    return packed if len(packed) < len(text) + 3 or least else "js:" + text


def unpack(blob: str) -> str | None:
    if blob.startswith("gz:"):
        return gzip.decompress(base64.b64decode(blob[3:])).decode()
    return blob[3:] if blob.startswith("js:") else None


@F.pandas_udf(StringType())
def encoded(s: pd.Series) -> pd.Series:
    return s.map(pack, na_action="ignore")


@F.pandas_udf(StringType())
def decoded(s: pd.Series) -> pd.Series:
    return s.map(unpack, na_action="ignore")
