"""Queries of the attempt log: events are attempts, parts are items, orders are sessions with line items as answers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kumiki.functions import scalars as S
from kumiki.operators import attempts as A
from kumiki.plans.registry import Registry
from kumiki.session import table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
SECTION = "CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'moji' WHEN p_type IN ('MEDIUM', 'PROMO') THEN 'bunpo' WHEN p_type = 'STANDARD' THEN 'dokkai' ELSE 'choukai' END"
ATT = "a AS (SELECT event_id AS attempt, ts, user_id AS device, CAST(json_extract_string(props, '$.k') AS BIGINT) AS qid, event_type AS mode, value < 50 AS ok, value AS secs FROM events)"
ITEMS = f"i AS (SELECT p_partkey AS qid, p_type AS type, {SECTION} AS section FROM part)"
STATS = "s AS (SELECT qid, count(*) AS n, count_if(ok) AS c, count_if(NOT ok) AS w, max(ts) AS last FROM a GROUP BY qid)"
PCT = "CASE WHEN {n} = 0 THEN 0 ELSE CAST(floor({c} / {n} * 100 + 0.5) AS INT) END"
GRADED = f"g AS (SELECT l_orderkey AS session, l_linenumber AS pos, p_type AS type, {SECTION} AS section, coalesce(CASE WHEN l_returnflag <> 'R' THEN l_linenumber % 4 END = p_size % 4, false) AS ok FROM lineitem JOIN part ON p_partkey = l_partkey)"
TODAY = "(SELECT CAST(max(ts) AS DATE) FROM events)"


def attempts(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").select(F.col("event_id").alias("attempt"), "ts", F.col("user_id").alias("device"), k.alias("qid"), F.col("event_type").alias("mode"), (F.col("value") < 50).alias("ok"), F.col("value").alias("secs"))


def items(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("qid"), F.col("p_type").alias("type"), F.expr(SECTION).alias("section"), (F.col("p_size") % 4).alias("answer"))


def answers(spark, d):
    given = F.when(F.col("l_returnflag") != "R", F.col("l_linenumber") % 4)
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("session"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("qid"), given.alias("given"))


def graded(spark, d):
    return A.grade(answers(spark, d), items(spark, d))


def today(spark, d):
    return table(spark, d, "events").agg(F.to_date(F.max("ts")).alias("today"))


def _with_today(df, spark, d):
    return df.crossJoin(F.broadcast(today(spark, d)))  # one row


@R.add("weakest_types", f"WITH {ATT}, {ITEMS}, {STATS}, t AS (SELECT type, sum(n) AS n, sum(c) AS c FROM s JOIN i USING (qid) GROUP BY type HAVING sum(n) >= 5) SELECT type, n, c, {PCT.format(n='n', c='c')} AS pct FROM t ORDER BY pct, type LIMIT 3")
def weakest_types(spark, d):
    return A.weakest(A.item_stats(attempts(spark, d)), items(spark, d), 3)


R.add("agg1_item_stats", f"WITH {ATT}, {STATS} SELECT * FROM s")(lambda spark, d: A.item_stats(attempts(spark, d)))
R.add("agg2_accuracy", f"WITH {ATT}, {ITEMS}, {STATS}, t AS (SELECT type, section, count(*) AS seen, sum(n) AS n, sum(c) AS c FROM s JOIN i USING (qid) GROUP BY GROUPING SETS ((type), (section), ())) SELECT *, {PCT.format(n='n', c='c')} AS pct FROM t")(
    lambda spark, d: A.accuracy(A.item_stats(attempts(spark, d)), items(spark, d))
)
DAILY = "d AS (SELECT CAST(ts AS DATE) AS day, device, count(*) AS a, count_if(ok) AS c, CAST(sum(floor(secs + 0.5)) AS BIGINT) AS s FROM a GROUP BY ALL)"
DAYS = "y AS (SELECT day, sum(a) AS answered, sum(c) AS correct, sum(s) AS secs FROM d GROUP BY day)"
R.add("agg3_daily_devices", f"WITH {ATT}, {DAILY} SELECT * FROM d")(lambda spark, d: A.daily(attempts(spark, d)))
R.add("agg3_daily", f"WITH {ATT}, {DAILY}, {DAYS} SELECT * FROM y")(lambda spark, d: A.by_day(A.daily(attempts(spark, d))))


@R.add("agg4_last7", f"WITH {ATT}, {DAILY}, {DAYS} SELECT coalesce(sum(answered), 0) AS answered, coalesce(sum(correct), 0) AS correct, coalesce(sum(secs), 0) AS secs FROM y WHERE day > {TODAY} - 7 AND day <= {TODAY}")
def agg4(spark, d):
    return A.last_days(_with_today(A.by_day(A.daily(attempts(spark, d))), spark, d), F.col("today"))


@R.add("agg5_calendar30", f"WITH {ATT}, {DAILY}, {DAYS}, c AS (SELECT CAST(unnest(generate_series({TODAY} - 29, {TODAY}, INTERVAL 1 DAY)) AS DATE) AS day) SELECT day, coalesce(answered, 0) AS answered, coalesce(correct, 0) AS correct FROM c LEFT JOIN y USING (day)")
def agg5(spark, d):
    return A.calendar(A.by_day(A.daily(attempts(spark, d))), today(spark, d))


@R.add("win2_streaks", f"WITH {ATT}, x AS (SELECT DISTINCT device, CAST(ts AS DATE) AS day FROM a), r AS (SELECT device, day, day - CAST(row_number() OVER (PARTITION BY device ORDER BY day) AS INT) AS run FROM x), z AS (SELECT device, run, count(*) AS n, max(day) AS e FROM r GROUP BY ALL) SELECT device, coalesce(max(CASE WHEN e >= {TODAY} - 1 THEN n END), 0) AS streak FROM z GROUP BY device")
def win2(spark, d):
    t = today(spark, d).first()["today"]
    return A.streaks(attempts(spark, d), F.lit(t))


@R.add("agg6_sessions", f"WITH {GRADED}, x AS (SELECT session, section, count(*) AS n, count_if(ok) AS c FROM g GROUP BY ALL), y AS (SELECT session, type, count(*) AS n, count_if(ok) AS c FROM g GROUP BY ALL), t AS (SELECT session, sum(n) AS total, sum(c) AS correct, string_agg(section || ':' || c || '/' || n, ' ' ORDER BY section) AS sections FROM x GROUP BY session), u AS (SELECT session, string_agg(type || ':' || c || '/' || n, ' ' ORDER BY type) AS types FROM y GROUP BY session) SELECT session, total, correct, sections, types, floor(o_totalprice / total * 1000 + 0.5) / 1000 AS secs_each FROM t JOIN u USING (session) JOIN orders ON o_orderkey = session")
def agg6(spark, d):
    e = table(spark, d, "orders").select(F.col("o_orderkey").alias("session"), F.col("o_totalprice").alias("elapsed"))
    s = A.session_scores(graded(spark, d), e)

    def text(c: str):
        return F.array_join(F.transform(c + "s", lambda x: F.concat(x[c], F.lit(":"), x["c"].cast("string"), F.lit("/"), x["n"].cast("string"))), " ").alias(c + "s")

    return s.select("session", "total", "correct", text("section"), text("type"), "secs_each")


EST = f"{GRADED}, p AS (SELECT session, CASE WHEN section IN ('moji', 'bunpo') THEN 'language' WHEN section = 'dokkai' THEN 'reading' ELSE 'listening' END AS part, ok FROM g), e AS (SELECT session, " + ", ".join(f"CAST(floor(60 * count_if(ok AND part = '{p}') / nullif(count_if(part = '{p}'), 0) + 0.5) AS INT) AS {p}" for p in ("language", "reading", "listening")) + " FROM p GROUP BY session)"
R.add("agg7_estimates", f"WITH {EST} SELECT *, coalesce(language + reading + listening >= 95 AND least(language, reading, listening) >= 19, false) AS passed FROM e")(lambda spark, d: A.estimates(graded(spark, d)))
R.add("agg8_drills", f"WITH {GRADED} SELECT session, type, section, count(*) AS n, count_if(ok) AS c FROM g GROUP BY ALL")(
    lambda spark, d: graded(spark, d).groupBy("session", "type", "section").agg(F.count("*").alias("n"), F.count_if("ok").alias("c"))
)
R.add("agg9_type_attempts", f"WITH {ATT}, {ITEMS}, {STATS} SELECT type, coalesce(sum(n), 0) AS n, coalesce(sum(c), 0) AS c, count(s.qid) AS seen, count(*) AS items FROM i LEFT JOIN s USING (qid) GROUP BY type")(
    lambda spark, d: items(spark, d).join(A.item_stats(attempts(spark, d)).withColumn("hit", F.lit(1)), "qid", "left").groupBy("type").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("c"), F.lit(0)).alias("c"), F.count("hit").alias("seen"), F.count("*").alias("items"))
)
R.add("jn2_answers", f"WITH {GRADED} SELECT session, pos, ok FROM g")(lambda spark, d: graded(spark, d).select("session", "pos", "ok"))
R.add("agg24_progress", "SELECT l_orderkey AS session, count_if(l_returnflag <> 'R') AS done, count(*) AS total FROM lineitem GROUP BY ALL")(
    lambda spark, d: answers(spark, d).groupBy("session").agg(F.count("given").alias("done"), F.count("*").alias("total"))
)
R.add("top2_recommended", f"WITH {GRADED}, t AS (SELECT session, type, count(*) AS n, count_if(ok) AS c FROM g GROUP BY ALL) SELECT session, type, n, {PCT.format(n='n', c='c')} AS pct FROM t WHERE n >= 3 AND {PCT.format(n='n', c='c')} < 60")(
    lambda spark, d: graded(spark, d).groupBy("session", "type").agg(F.count("*").alias("n"), F.count_if("ok").alias("c")).withColumn("pct", S.pct(F.col("c"), F.col("n"))).where("n >= 3 AND pct < 60").drop("c")
)
R.add("top3_history", "WITH h AS (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM orders), n AS (SELECT o_custkey, least(count(*), 12) AS shown FROM h GROUP BY ALL) SELECT h.*, CASE WHEN place <= 3 THEN place END AS home, CASE WHEN place <= 12 THEN shown + 1 - place END AS chart, CASE WHEN place <= 60 THEN place END AS list FROM h JOIN n USING (o_custkey) WHERE place <= 300")(
    lambda spark, d: A.recent(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
)
R.add("win11_time_spent", f"WITH {ATT}, g AS (SELECT attempt, epoch_us(ts) AS t, epoch_us(lag(ts) OVER (PARTITION BY device ORDER BY ts, attempt)) AS before FROM a) SELECT attempt, CASE WHEN before IS NULL THEN 0.0 WHEN t - before > 300000000 THEN 300.0 ELSE (t - before) / 1e6 END AS spent FROM g")(
    lambda spark, d: A.time_spent(attempts(spark, d))
)
R.add("win4_number_before", "SELECT l_orderkey, l_linenumber, coalesce(CAST(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS before FROM lineitem")(
    lambda spark, d: table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.coalesce(F.sum("l_quantity").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, -1)).cast("long"), F.lit(0)).alias("before"))
)
R.add("api5_score_pivot", f"WITH {GRADED}, t AS (SELECT session, section, {PCT.format(n='count(*)', c='count_if(ok)')} AS pct FROM g GROUP BY ALL) SELECT session, max(pct) FILTER (section = 'moji') AS moji, max(pct) FILTER (section = 'bunpo') AS bunpo, max(pct) FILTER (section = 'dokkai') AS dokkai, max(pct) FILTER (section = 'choukai') AS choukai FROM t GROUP BY session")(
    lambda spark, d: graded(spark, d).groupBy("session").pivot("section", ["moji", "bunpo", "dokkai", "choukai"]).agg(S.pct(F.count_if("ok"), F.count(F.lit(1))))
)
R.add("api5_series", f"WITH {GRADED} SELECT section, count(DISTINCT session) AS points FROM g GROUP BY section")(
    # sections without a score have no series
    lambda spark, d: graded(spark, d).groupBy("session").pivot("section", ["moji", "bunpo", "dokkai", "choukai"]).agg(S.pct(F.count_if("ok"), F.count(F.lit(1)))).unpivot("session", ["moji", "bunpo", "dokkai", "choukai"], "section", "pct").where("pct IS NOT NULL").groupBy("section").agg(F.count("*").alias("points"))
)
R.add("api4_rings", f"WITH {GRADED}, t AS (SELECT section, {PCT.format(n='count(*)', c='count_if(ok)')} AS pct FROM g GROUP BY section) SELECT section, pct, CASE WHEN pct >= 75 THEN 'good' WHEN pct >= 55 THEN 'warn' ELSE 'bad' END AS tone FROM t")(
    lambda spark, d: graded(spark, d).groupBy("section").agg(S.pct(F.count_if("ok"), F.count("*")).alias("pct")).withColumn("tone", F.when(F.col("pct") >= 75, "good").when(F.col("pct") >= 55, "warn").otherwise("bad"))
)
FAILS = "f AS (SELECT user_id AS key, ts, event_id AS id FROM events WHERE event_type = 'error'), l AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 43200000000 THEN 0 ELSE 1 END AS n FROM f WINDOW w AS (PARTITION BY key ORDER BY ts, id)), r AS (SELECT *, sum(n) OVER (PARTITION BY key ORDER BY ts, id) AS run FROM l), x AS (SELECT *, row_number() OVER (PARTITION BY key, run ORDER BY ts, id) AS k FROM r)"


@R.add("str4_lockouts", f"WITH {FAILS} SELECT key, CAST(run AS BIGINT) AS run, count(*) AS fails, min(CASE WHEN k = 3 THEN ts END) AS locked_at FROM x GROUP BY ALL HAVING count(*) >= 3")
def str4(spark, d):
    f = table(spark, d, "events").where("event_type = 'error'").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"))
    return A.lockouts(f, 43_200, 3)


R.add("scl1_ids", "SELECT rid, substr(sha1(concat_ws('|', source, question)), 1, 12) AS v FROM raw")(lambda spark, d: table(spark, d, "raw").select("rid", S.stable_id(F.col("source"), F.col("question")).alias("v")))
R.add("scl4_nice_max", "SELECT o_orderkey, greatest(CASE WHEN r <= 1 THEN p WHEN r <= 2 THEN 2 * p WHEN r <= 5 THEN 5 * p ELSE 10 * p END, 5.0) AS v FROM (SELECT o_orderkey, o_totalprice / p AS r, p FROM (SELECT *, pow(10.0, floor(log10(greatest(o_totalprice, 1)))) AS p FROM orders))")(
    lambda spark, d: table(spark, d, "orders").select("o_orderkey", S.nice_max(F.col("o_totalprice")).alias("v"))
)
R.add("scl6_durations", "SELECT o_orderkey, CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END AS v, CASE WHEN n < 0 THEN 'overdue' WHEN n = 0 THEN 'today' WHEN n = 1 THEN 'tomorrow' ELSE 'in ' || n END AS due FROM (SELECT o_orderkey, CAST(floor(o_totalprice / 50 + 0.5) AS INT) AS s, CAST(o_orderdate AS DATE) - DATE '1997-06-01' AS n FROM orders)")(
    lambda spark, d: table(spark, d, "orders").select("o_orderkey", S.duration(F.col("o_totalprice") / 50).alias("v"), S.rel_day(F.to_date("o_orderdate"), F.lit("1997-06-01").cast("date")).alias("due"))
)
R.add("scl5_days", "SELECT event_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, strftime(ts, '%Y-%m-%d') AS key, CAST(floor((epoch_us(TIMESTAMP '2024-02-01 18:00:00') - epoch_us(ts)) / 86400e6 + 0.5) AS INT) AS days FROM events")(
    lambda spark, d: table(spark, d, "events").select("event_id", S.start_of_day(F.col("ts")).cast("timestamp_ntz").alias("start"), S.day_key(F.col("ts")).alias("key"), S.days_between(F.col("ts"), F.expr("timestamp_ntz'2024-02-01 18:00:00'")).alias("days"))
)
R.add("scl11_uids", "SELECT event_id, lower(to_base(epoch_us(ts) // 1000, 36) || to_base(CAST(('0x' || substr(md5('u|' || event_id), 1, 8)) AS BIGINT), 36)) AS uid FROM events")(
    lambda spark, d: table(spark, d, "events").select("event_id", S.uid(F.col("ts"), F.col("event_id"), "u").alias("uid"))
)
R.add("scl7_mondays", "SELECT o_orderkey, CAST(date_trunc('week', o_orderdate) AS DATE) AS monday, CAST(date_trunc('week', o_orderdate) AS DATE) + 7 AS following FROM orders")(
    lambda spark, d: table(spark, d, "orders").select("o_orderkey", S.monday_of(F.to_date("o_orderdate")).alias("monday"), S.monday_of(F.to_date("o_orderdate"), True).alias("following"))
)
R.add("scl8_exam_labels", "SELECT rid, CASE WHEN regexp_matches(exam, '[0-9]{4}年[0-9]+月') THEN regexp_extract(exam, '([0-9]{4})年([0-9]+)月', 1) || '/' || lpad(regexp_extract(exam, '([0-9]{4})年([0-9]+)月', 2), 2, '0') END AS label, coalesce(regexp_matches(exam, '[0-9]{4}年[0-9]+月'), false) OR coalesce(official, false) AS official FROM raw LEFT JOIN sources USING (source)")(
    lambda spark, d: table(spark, d, "raw").join(F.broadcast(table(spark, d, "sources").select("source", "official")), "source", "left").select("rid", S.exam_label(F.col("exam")).alias("label"), S.official(F.col("exam"), F.col("official")).alias("official"))
)


@R.add("scl10_shuffled", "WITH a AS (SELECT rid, answer, list_sort(list_transform(options, lambda x, i: {'h': md5(rid || '|' || (i - 1)), 'i': i - 1, 'x': x})) AS o FROM raw) SELECT rid, array_to_string(list_transform(o, lambda s: s.x), '|') AS options, CAST(list_position(list_transform(o, lambda s: s.i), answer) - 1 AS INT) AS answer FROM a")
def scl10(spark, d):
    o = table(spark, d, "raw").select("rid", "answer", S.shuffled(F.col("options"), F.col("rid")).alias("o"))
    return o.select("rid", F.array_join(F.transform("o", lambda s: s["x"]), "|").alias("options"), S.new_answer(F.col("o"), F.col("answer")).alias("answer"))
