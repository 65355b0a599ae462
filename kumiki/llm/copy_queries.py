"""Queries of copies hidden by formatting."""

from __future__ import annotations

from kumiki.llm.copies import collapsed, copy_pairs
from kumiki.session import table

FIELDS = ["passage", "question", "transcript", "options"]


def p5_found(spark, d):
    return copy_pairs(table(spark, d, "raw"), FIELDS, ("options",))


def p5_records(spark, d):
    """One row per record with its number of copies."""
    raw = table(spark, d, "raw")
    return collapsed(raw.select("rid"), copy_pairs(raw, FIELDS, ("options",))).selectExpr("rid", "copies")


_FOLD = r"regexp_replace(lower(coalesce({}, '')), '[\p{{Z}}\p{{P}}\p{{S}}\p{{C}}\s]', '', 'g')"
_KEYS = (
    "WITH k AS (SELECT rid, "
    + ", ".join(f"{_FOLD.format(f)} AS k{i}" for i, f in enumerate(FIELDS[:3]))
    + ", list_sort(list_transform(coalesce(options, []), lambda o: " + _FOLD.format("o") + ")) AS k3 FROM raw), "
    "g AS (SELECT rid, min(rid) OVER w AS first, count(*) OVER w AS n FROM k WINDOW w AS (PARTITION BY k0, k1, k2, k3))"
)
QUERIES = {"p5_found": p5_found, "p5_records": p5_records}
ORACLES = {
    "p5_found": _KEYS + " SELECT first AS rid_a, rid AS rid_b FROM g WHERE rid <> first",
    "p5_records": _KEYS + " SELECT rid, n AS copies FROM g WHERE rid = first",
}
