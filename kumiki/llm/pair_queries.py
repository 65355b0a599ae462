"""Queries of broken prompt and response pairs."""

from __future__ import annotations

from kumiki.llm.pairs import defects
from kumiki.session import table


def p4_found(spark, d):
    return defects(table(spark, d, "explain_out"), table(spark, d, "bank"))


QUERIES = {"p4_found": p4_found}
ORACLES = {}
