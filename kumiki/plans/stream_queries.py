"""Queries that run streams to their end over the event table, and the codec of synced blobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from kumiki.functions.markup import embedded_json, flight_data, hydrated, table_grid, table_structure, walked
from kumiki.plans.attempt_queries import ATT, STATS
from kumiki.plans.learner_queries import KIND, LAST
from kumiki.plans.registry import Registry
from kumiki.session import new_folder, table
from kumiki.sources import writers as W
from kumiki.streaming import folds as S

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


def _events(spark, d):
    return S.source(spark, f"{d}/events.parquet*", table(spark, d, "events").schema)


@R.add("str2_stats_stream", f"WITH {ATT}, {STATS} SELECT qid, n, c FROM s")
def str2(spark, d):
    a = _events(spark, d).select(F.get_json_object("props", "$.k").cast("long").alias("qid"), (F.col("value") < 50).alias("ok"))
    return S.drained(S.running_stats(a), "complete")


@R.add("str2_cards_stream", LAST + " SELECT user_id, k, box, due, reps, lapses FROM l")
def str2_cards(spark, d):
    e = _events(spark, d).select("user_id", F.get_json_object("props", "$.k").cast("long").alias("k"), "ts", F.col("event_id").alias("id"), F.expr(KIND).alias("kind"))
    return S.running_cards(e)


@R.add("str4_daily_windows", "SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY ALL")
def str4_windows(spark, d):
    e = _events(spark, d).where("event_type = 'error'").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return S.drained(e, "complete")


@R.add("str5_merge_stream", "SELECT event_type AS coll, user_id AS id, max(ts) AS t, arg_max(value, (ts, event_id)) AS v FROM events GROUP BY ALL HAVING coalesce(max(ts) FILTER (value < 3), TIMESTAMP '1970-01-01') < max(ts) FILTER (value >= 3)".replace("max(ts) AS t, arg_max(value, (ts, event_id)) AS v", "max(ts) FILTER (value >= 3) AS t, arg_max(value, (ts, event_id)) FILTER (value >= 3) AS v"))
def str5(spark, d):
    """Changes and deletions (values below 3) in any order, late or again: the last change of each key, if no deletion is later."""
    e = _events(spark, d).select(F.col("event_type").alias("coll"), F.col("user_id").alias("id"), "ts", "event_id", F.when(F.col("value") >= 3, F.col("value")).alias("v"))
    return S.drained(S.running_writes(e), "complete").select("coll", "id", "t", F.col("value").alias("v"))


@R.add("str3_synced", "SELECT event_type AS coll, count(*) AS n, 2 AS revisions FROM events GROUP BY event_type")
def str3(spark, d):
    """Two devices put their counts (one number a kind) into a store, the second one after a conflict."""
    where = new_folder(spark, "store")
    counts = table(spark, d, "events").groupBy("event_type", F.expr("event_id % 2").alias("side")).count().collect()  # ten rows
    sides = [{r["event_type"]: r["count"] for r in counts if r["side"] == k} for k in (0, 1)]
    add = lambda a, b: {k: a.get(k, 0) + b.get(k, 0) for k in {*a, *b}}
    S.synced(spark, where, sides[0], add)
    assert S.put_if(spark, where, 0, "{}") == (False, 1)
    merged = S.synced(spark, where, sides[1], add)
    return spark.createDataFrame([(k, n, S.put_if(spark, where, 0, "{}")[1]) for k, n in merged.items()], "coll string, n long, revisions int")


@R.add("snk8_codec", "SELECT rid, question || chr(10) || coalesce(passage, '') AS text, true AS tagged FROM raw")
def snk8(spark, d):
    j = table(spark, d, "raw").select("rid", W.encoded(F.concat_ws("\n", "question", F.coalesce("passage", F.lit("")))).alias("b"))
    return j.select("rid", W.decoded("b").alias("text"), F.col("b").rlike("^(gz|js):").alias("tagged"))


_INNER = '\'{"id": "\' || id || \'", "n": {"a": {"b": "}{ \\" }"}}, "s": {}}\''
R.add("arr4_embedded_json", f"SELECT rid, {_INNER} AS v FROM raw")(
    # braces in strings, an escaped quotation mark, entities, and a second object behind it
    lambda spark, d: table(spark, d, "raw").select("rid", embedded_json(F.concat(F.lit("<html><script>window.data = {&quot;id&quot;: &quot;"), "id", F.lit('&quot;, "n": {"a": {"b": "}{ \\" }"}}, &#34;s&#34;: {}};</script><script>{"other": 1}</script>'))).alias("v"))
)
R.add("arr4_flight_data", "SELECT rid, question || '|' || id AS v FROM raw")(
    lambda spark, d: table(spark, d, "raw").select("rid", flight_data(F.concat(F.lit("<script>self.f.push([0])</script><script>self.f.push([1,"), F.get_json_object(F.to_json(F.struct(F.to_json(F.array("question")).alias("a"))), "$.a").substr(F.lit(2), F.length(F.to_json(F.array("question"))) - 2), F.lit(']);</script><p>x</p><script>self.f.push([1, "|"])\nself.f.push([1,"'), "id", F.lit('"])</script>'))).alias("v"))
)
R.add("arr5_hydrated", """SELECT rid, '{"id": "' || id || '", "list": ["a", "' || source || '", true], "loop": null, "plain": "x"}' AS v FROM raw""")(
    lambda spark, d: table(spark, d, "raw").select("rid", hydrated(F.concat(F.lit('[["ShallowReactive", 1], {"id": 2, "list": 3, "loop": 0, "plain": "x"}, "'), "id", F.lit('", ["Set", 4, 5, true], "a", ["Ref", 6], "'), "source", F.lit('"]'))).alias("v"))
)
R.add("arr7_nested_paths", "WITH o AS (SELECT rid, unnest(options) AS o, generate_subscripts(options, 1) - 1 AS i FROM raw) SELECT rid, '$.id' AS path, id AS text FROM raw UNION ALL SELECT rid, '$.x.answer', CAST(answer AS VARCHAR) FROM raw WHERE answer IS NOT NULL UNION ALL SELECT rid, '$.x.o[' || i || '].t', o FROM o WHERE o IS NOT NULL")(
    lambda spark, d: table(spark, d, "raw").select("rid", F.to_json(F.struct("id", F.struct("answer", F.transform("options", lambda o: F.struct(o.alias("t"))).alias("o")).alias("x"))).alias("j")).select("rid", F.explode(walked("j")).alias("p")).select("rid", "p.path", "p.text")
)


def _cells():
    """Rows of a table: the id spans all of them, each has an option."""
    first = F.concat(F.lit("<tr><td rowspan="), F.size("options").cast("string"), F.lit(">"), "id", F.lit("</td>"))
    return F.array_join(F.transform("options", lambda o, i: F.concat(F.when(i == 0, first).otherwise("<tr>"), F.lit("<td>"), F.md5(o), F.lit("</td></tr>"))), "")


R.add("win12_table_grid", "SELECT rid, list_transform(options, lambda o: [id, md5(o)]) AS v FROM raw WHERE len(options) > 0")(
    lambda spark, d: table(spark, d, "raw").where("size(options) > 0").select("rid", table_grid(F.concat(F.lit("<table class=usage>"), _cells(), F.lit("</table>"))).alias("v"))
)
R.add("win12_structures", "SELECT rid, array_to_string(list_distinct_in_order, ' / ') AS v FROM (SELECT rid, list_transform(list_filter(list_transform(options, lambda o, i: CASE WHEN i = 1 THEN id || ' + ' || md5(o) ELSE md5(o) || ' + ' || id END), lambda x, i: list_position(list_transform(options, lambda o, j: CASE WHEN j = 1 THEN id || ' + ' || md5(o) ELSE md5(o) || ' + ' || id END), x) = i), lambda x: x) AS list_distinct_in_order FROM raw WHERE len(options) > 0)")(
    lambda spark, d: table(spark, d, "raw").where("size(options) > 0").select("rid", table_structure(F.concat(F.lit("<p>x</p><table class=usage>"), _cells(), F.lit("</table><table><tr><td>y</td></tr></table>"))).alias("v"))
)
