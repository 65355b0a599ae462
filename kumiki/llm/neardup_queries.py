"""Queries of near-duplicates with small edits."""

from __future__ import annotations

from kumiki.llm.neardup import groups, row_pairs, versions
from kumiki.session import table


def p2_found(spark, d):
    return row_pairs(*versions(table(spark, d, "raw")))


def p2_groups(spark, d):
    return groups(table(spark, d, "raw"))


QUERIES = {"p2_found": p2_found, "p2_groups": p2_groups}
ORACLES = {}
