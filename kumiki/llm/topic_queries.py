"""Queries of subject areas."""

from __future__ import annotations

from pyspark.sql import functions as F

from kumiki.llm.topics import subject_areas
from kumiki.session import table


def p9_found(spark, d):
    subjects = sorted(r["subject"] for r in table(spark, d, "subjects").select("subject").distinct().collect())  # a fixed list
    return subject_areas(table(spark, d, "documents"), table(spark, d, "subject_labels"), subjects)


def p9_composition(spark, d):
    """Documents of each subject."""
    return p9_found(spark, d).groupBy("subject").agg(F.count("*").alias("documents"))


QUERIES = {"p9_found": p9_found, "p9_composition": p9_composition}
ORACLES = {}
