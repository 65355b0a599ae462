"""Queries of the best representative of each group of copies."""

from __future__ import annotations

from kumiki.llm.survivors import best_rows, fused, true_values
from kumiki.session import table

FIELDS = ["passage", "question", "options"]


def p6_found(spark, d):
    return best_rows(table(spark, d, "raw"), table(spark, d, "sources"), FIELDS, ("options",))


def p6_records(spark, d):
    return fused(table(spark, d, "raw"), table(spark, d, "sources"), FIELDS, ("options",))


def p6_values(spark, d):
    """Every value judged true, not only the one that the built record shows."""
    return true_values(table(spark, d, "raw"), FIELDS, ("options",))


_F = r"regexp_replace(lower(coalesce({}, '')), '[\p{{Z}}\p{{P}}\p{{S}}\p{{C}}\s]', '', 'g')"
_NONE = "none null nil nan na nocontent noexplanation notavailable tbd tba todo pending trống không khôngcó chưacó なし 無し 説明なし 解説なし 準備中".split()
QUERIES = {"p6_found": p6_found, "p6_records": p6_records, "p6_values": p6_values}
ORACLES = {
    "p6_found": "WITH k AS (SELECT rid, crawled_at AS seen, -trust AS t, "
    + f"{_F.format('passage')} AS k0, {_F.format('question')} AS k1, list_sort(list_transform(coalesce(options, []), lambda o: {_F.format('o')})) AS k2, "
    + ", ".join(
        f"CASE WHEN {_F.format(f)} IN ({', '.join(repr(x) for x in _NONE)}) THEN 0 ELSE length({_F.format(f)}) END AS n{i}"
        for i, f in enumerate(("explanation", "transcript"))
    )
    + " FROM raw LEFT JOIN sources USING (source)), g AS (SELECT *, min(rid) OVER w AS group_rid, count(*) OVER w AS n, max(n0) OVER w AS m0, "
    "max(n1) OVER w AS m1, max(seen) OVER w AS m2, max(t) OVER w AS m3 FROM k WINDOW w AS (PARTITION BY k0, k1, k2)) "
    "SELECT group_rid, min(rid) AS best_rid FROM g WHERE n > 1 AND n0 = m0 AND n1 = m1 AND seen = m2 AND t = m3 GROUP BY group_rid"
}
