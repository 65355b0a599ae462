"""Queries of visually identical text."""

from __future__ import annotations

from pyspark.sql import functions as F

from kumiki.llm.visual import normalized
from kumiki.session import table

FIELDS = ["question", "options", "passage"]


def p3_rows(spark, d):
    """Every row with its fields in one consistent form."""
    return normalized(table(spark, d, "raw").select("rid", *FIELDS), FIELDS, ("options",))


def p3_found(spark, d):
    return p3_rows(spark, d).select("rid", F.explode("affected").alias("field"))


QUERIES = {"p3_found": p3_found, "p3_rows": p3_rows}
ORACLES = {}
