"""Queries of encoding and packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from kumiki.llm.encode import encoded
from kumiki.llm.packing import CAPACITY, DOCUMENTS, packed, sized
from kumiki.session import table


def p7_ids(spark, d):
    return encoded(table(spark, d, "documents"))


def p8_rows(spark, d):
    """Each text's container."""
    return packed(sized(table(spark, d, "documents")))


def p8_fill(spark, d):
    """Containers, tokens and unused tokens of the packing."""
    c = p8_rows(spark, d).where("container IS NOT NULL").groupBy("container").agg(F.sum("n").alias("n"))
    return c.agg(F.count("*").alias("containers"), F.sum("n").alias("tokens"), F.sum(F.lit(CAPACITY) - F.col("n")).alias("unused"))


def p8_attention_rows(spark, d):
    """Containers whose attention capacity binds: a quarter of the capacity squared, so a text above half the capacity is split."""
    return packed(sized(table(spark, d, "documents")), attention=CAPACITY * CAPACITY // 4)


def p8_invariants(spark, d):
    """What any right packing gives: documents, those without a container, and containers over a capacity."""
    rows = p8_rows(spark, d)
    docs = rows.groupBy("doc_id").agg(F.max(F.col("container").isNotNull()).alias("placed"))
    c = rows.where("container IS NOT NULL").groupBy("container").agg(F.sum("n").alias("n"), F.count("*").alias("k"))
    over = c.agg(F.count_if((F.col("n") > CAPACITY) | (F.col("k") > DOCUMENTS)).alias("over"))
    return docs.agg(F.count("*").alias("documents"), F.count_if(~F.col("placed")).alias("without")).crossJoin(over)  # a row each


QUERIES = {"p7_ids": p7_ids, "p8_rows": p8_rows, "p8_fill": p8_fill, "p8_attention_rows": p8_attention_rows, "p8_invariants": p8_invariants}
ORACLES = {"p8_invariants": "SELECT count(*) AS documents, count_if(coalesce(text, '') = '') AS without, 0 AS over FROM documents"}
