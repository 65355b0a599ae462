"""Queries of learner state: spaced repetition, merges of device states, composed papers and drills."""

from __future__ import annotations

import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from kumiki import dims
from kumiki.operators import attempts as A
from kumiki.operators import compose as C
from kumiki.operators import merge as M
from kumiki.operators import srs as S
from kumiki.plans.attempt_queries import ATT, STATS, attempts
from kumiki.plans.registry import Registry
from kumiki.session import table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

# events as card events: errors are again, views hard, clicks and signups good, purchases easy; a user and a key make a card
KIND = "CASE event_type WHEN 'error' THEN 'again' WHEN 'view' THEN 'hard' WHEN 'purchase' THEN 'easy' ELSE 'good' END"
FOLD = f"""e AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, ts, event_id, {KIND} AS kind FROM events),
  n AS (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY ts, event_id) AS i FROM e)"""
CARDS = """c(user_id, k, i, ts, box, due, reps, lapses) AS (
  SELECT user_id, k, i, ts, CASE kind WHEN 'again' THEN 0 WHEN 'hard' THEN 0 WHEN 'good' THEN 1 ELSE 2 END,
    CAST(ts AS DATE) + CASE kind WHEN 'again' THEN 1 WHEN 'hard' THEN 2 WHEN 'good' THEN 3 ELSE 7 END, 1, CAST(kind = 'again' AS INT) FROM n WHERE i = 1
  UNION ALL
  SELECT n.user_id, n.k, n.i, n.ts, b, CAST(n.ts AS DATE) + CASE WHEN kind = 'again' THEN 1 WHEN kind = 'hard' THEN 2 ELSE [1, 3, 7, 14, 30, 60][b + 1] END, reps + 1, lapses + CAST(kind = 'again' AS INT)
  FROM (SELECT c.user_id, c.k, c.i, c.reps, c.lapses, n.kind, n.ts AS ts, CASE kind WHEN 'again' THEN 0 WHEN 'hard' THEN c.box WHEN 'good' THEN least(5, c.box + 1) ELSE least(5, c.box + 2) END AS b
    FROM c JOIN n ON n.user_id = c.user_id AND n.k = c.k AND n.i = c.i + 1) x JOIN n ON n.user_id = x.user_id AND n.k = x.k AND n.i = x.i + 1)"""
LAST = f"WITH RECURSIVE {FOLD}, {CARDS.replace('SELECT n.user_id, n.k, n.i, n.ts, b,', 'SELECT n.user_id, n.k, n.i, n.ts, b,').replace('CASE WHEN kind', 'CASE WHEN x.kind').replace('WHEN kind = ', 'WHEN x.kind = ').replace('CAST(kind = ' + chr(39) + 'again' + chr(39) + ' AS INT)' + chr(10) + '  FROM (', 'CAST(x.kind = ' + chr(39) + 'again' + chr(39) + ' AS INT)' + chr(10) + '  FROM (')}, l AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY user_id, k ORDER BY i DESC) = 1)"


def card_events(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").select("user_id", k.alias("k"), "ts", F.col("event_id").alias("id"), F.expr(KIND).alias("kind"))


def cards(spark, d):
    return S.cards(card_events(spark, d), ["user_id", "k"])


#: One learner's cards: of each key the card of the last user.
ONE_CARD = "cx AS (SELECT k AS id, arg_max({'box': box, 'due': due, 'reps': reps, 'lapses': lapses}, user_id) AS x FROM l GROUP BY k), cd AS (SELECT id, x.box AS box, x.due AS due, x.reps AS reps, x.lapses AS lapses FROM cx)"


def one_learner(spark, d):
    return cards(spark, d).groupBy(F.col("k").alias("id")).agg(F.max_by(F.struct("box", "due", "reps", "lapses"), "user_id").alias("x")).select("id", "x.*")


R.add("srs2_cards", LAST + " SELECT user_id, k, box, due, reps, lapses FROM l")(lambda spark, d: cards(spark, d).select("user_id", "k", "box", "due", "reps", "lapses"))
DUE = "DATE '2024-01-25'"
R.add("srs5_due", LAST + f" SELECT user_id, k, due, row_number() OVER (PARTITION BY user_id ORDER BY due, k) AS place FROM l WHERE due <= {DUE} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY due, k) <= 50")(
    lambda spark, d: S.due(cards(spark, d), F.lit("2024-01-25").cast("date"), 50, ["user_id"]).select("user_id", "k", "due", "place")
)
R.add("top4_due_queue", LAST + f" SELECT user_id, k, due FROM l WHERE due <= {DUE} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY due, k) <= 5")(
    lambda spark, d: S.due(cards(spark, d), F.lit("2024-01-25").cast("date"), 5, ["user_id"]).select("user_id", "k", "due")
)
R.add("agg13_deck_counts", LAST + f" SELECT user_id, CASE WHEN reps = 0 THEN 'new' WHEN box >= 4 THEN 'known' ELSE 'learning' END AS status, count(*) AS n, count_if(due <= {DUE}) AS due, count_if(lapses > 0) AS lapsed FROM l GROUP BY ALL")(
    lambda spark, d: cards(spark, d).groupBy("user_id", S.status(F.col("reps"), F.col("box")).alias("status")).agg(F.count("*").alias("n"), F.count_if(F.col("due") <= F.lit("2024-01-25").cast("date")).alias("due"), F.count_if(F.expr("lapses > 0")).alias("lapsed"))
)
R.add("srs6_first_outcomes", f"WITH {FOLD} SELECT user_id, CAST(ts AS DATE) AS session, k, arg_min(kind, (ts, event_id)) AS kind FROM n GROUP BY ALL")(
    lambda spark, d: S.first_outcomes(card_events(spark, d).select(F.concat_ws("|", "user_id", F.to_date("ts")).alias("session"), F.col("k").alias("card"), "ts", "id", "kind", "user_id")).select("user_id", F.to_date(F.split("session", r"\|")[1]).alias("session"), F.col("card").alias("k"), "kind")
)


_OP = """CASE WHEN e.kind = 'flag' AND NOT a.alive THEN 'newflag' WHEN e.kind = 'flag' AND a.reps = 0 AND a.reason = 'flag' THEN 'drop' WHEN e.kind = 'flag' THEN 'flip'
  WHEN e.kind = 'wrong' AND NOT a.alive THEN 'newwrong' WHEN e.kind = 'wrong' AND a.box = 0 THEN 'same' WHEN e.kind = 'wrong' THEN 'again' ELSE e.kind END"""
_KEEP, _NEW = "('flip', 'same', 'drop')", "('newflag', 'newwrong')"


def _field(name: str, fresh: str, none: str, review: str) -> str:
    """One field of a card after an event: of a new card, of one that stays, of a reviewed one (`none`: its value before, of no card)."""
    return f"'{name}': CASE WHEN {_OP} IN {_NEW} THEN {fresh} WHEN {_OP} IN {_KEEP} THEN a.{name} ELSE {review.replace('@', f'(CASE WHEN a.alive THEN a.{name} ELSE {none} END)')} END"


_B0 = "(CASE WHEN a.alive THEN a.box ELSE 0 END)"
_UP = f"least(5, {_B0} + CASE {_OP} WHEN 'easy' THEN 2 ELSE 1 END)"
_STEP = "{'kind': e.kind, 'ts': e.ts, " + ", ".join([
    f"'alive': CASE WHEN {_OP} = 'drop' THEN false WHEN {_OP} IN {_KEEP} THEN a.alive ELSE true END",
    _field("box", "0", "0", f"CASE {_OP} WHEN 'again' THEN 0 WHEN 'hard' THEN @ ELSE {_UP} END"),
    _field("due", "CAST(e.ts AS DATE)", "NULL", f"CAST(e.ts AS DATE) + CASE {_OP} WHEN 'again' THEN 1 WHEN 'hard' THEN 2 ELSE [1, 3, 7, 14, 30, 60][{_UP} + 1] END"),
    _field("reps", "0", "0", "@ + 1"), _field("lapses", "0", "0", f"@ + CASE {_OP} WHEN 'again' THEN 1 ELSE 0 END"),
    _field("reason", "e.kind", "'review'", "@"), _field("flagged", "e.kind = 'flag'", "false", "@"),
]).replace("THEN a.flagged ELSE", f"THEN (CASE WHEN {_OP} = 'flip' THEN NOT a.flagged ELSE a.flagged END) ELSE", 1) + "}"


@R.add(
    "srs3_enrolled",
    f"""WITH e AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, ts, event_id, CASE event_type WHEN 'error' THEN 'wrong' WHEN 'signup' THEN 'flag' WHEN 'view' THEN 'hard' WHEN 'purchase' THEN 'easy' ELSE 'good' END AS kind FROM events),
    l AS (SELECT user_id, k, list({{'kind': kind, 'ts': ts, 'alive': false, 'box': 0, 'due': NULL::DATE, 'reps': 0, 'lapses': 0, 'reason': '', 'flagged': false}} ORDER BY ts, event_id) AS l FROM e GROUP BY ALL),
    r AS (SELECT user_id, k, list_reduce(list_concat([l[1]], l), lambda a, e: {_STEP}) AS c FROM l)
    SELECT user_id, k, c.box AS box, c.due AS due, c.reps AS reps, c.lapses AS lapses, c.reason AS reason, c.flagged AS flagged FROM r WHERE c.alive""",
)
def srs3(spark, d):
    """Missed answers and flags: errors are missed answers, signups flags, the rest reviews."""
    kind = F.expr("CASE event_type WHEN 'error' THEN 'wrong' WHEN 'signup' THEN 'flag' WHEN 'view' THEN 'hard' WHEN 'purchase' THEN 'easy' ELSE 'good' END")
    e = table(spark, d, "events").select("user_id", F.get_json_object("props", "$.k").cast("long").alias("k"), "ts", F.col("event_id").alias("id"), kind.alias("kind"))
    return S.cards(e, ["user_id", "k"]).select("user_id", "k", "box", "due", "reps", "lapses", "reason", "flagged")


@R.add("srs8_migrated", "WITH s AS (SELECT id, count(*) AS n, count(*) FILTER (answer = 0) AS c, count_if(coalesce(answer, 1) <> 0) AS w, max(crawled_at) AS last FROM raw GROUP BY id), l AS (SELECT old_id, min(kept_id) AS kept FROM aliases WHERE old_id IS NOT NULL AND kept_id IS NOT NULL GROUP BY old_id) SELECT coalesce(kept, id) AS id, sum(n) AS n, sum(c) AS c, sum(w) AS w, max(last) AS last FROM s LEFT JOIN l ON id = old_id GROUP BY 1")
def srs8(spark, d):
    s = table(spark, d, "raw").groupBy("id").agg(F.count("*").alias("n"), F.count_if(F.expr("answer = 0")).alias("c"), F.count_if(F.expr("coalesce(answer, 1) <> 0")).alias("w"), F.max("crawled_at").alias("last"))
    return S.migrated(s, table(spark, d, "aliases"))


# two sides of one state: even events are the local side, odd ones the remote side; errors delete
SIDES = """o AS (SELECT event_id % 2 AS side, event_type AS coll, user_id AS id, max(ts) AS t, max_by(value, ts) AS v FROM events WHERE event_type <> 'error' GROUP BY ALL),
  x AS (SELECT * FROM o WHERE side = 0), y AS (SELECT * FROM o WHERE side = 1),
  dead AS (SELECT 'click' AS coll, user_id AS id, max(ts) AS t FROM events WHERE event_type = 'error' GROUP BY user_id)"""


def _side(spark, d, side):
    e = table(spark, d, "events").where(f"event_id % 2 = {side} AND event_type <> 'error'")
    return e.groupBy(F.col("event_type").alias("coll"), F.col("user_id").alias("id")).agg(F.max("ts").alias("t"), F.max_by("value", "ts").alias("v"))


def _dead(spark, d):
    e = table(spark, d, "events").where("event_type = 'error'")
    return e.groupBy(F.lit("click").alias("coll"), F.col("user_id").alias("id")).agg(F.max("ts").alias("t"))


R.add("mrg1_last_writer", f"WITH {SIDES}, j AS (SELECT coalesce(x.coll, y.coll) AS coll, coalesce(x.id, y.id) AS id, CASE WHEN y.t IS NULL OR x.t > y.t THEN x.t ELSE y.t END AS t, CASE WHEN y.t IS NULL OR x.t > y.t THEN x.v ELSE y.v END AS v FROM x FULL JOIN y ON x.coll = y.coll AND x.id = y.id) SELECT j.* FROM j LEFT JOIN dead USING (coll, id) WHERE dead.t IS NULL OR j.t > dead.t")(
    lambda spark, d: M.last_writer(_side(spark, d, 0), _side(spark, d, 1), _dead(spark, d))
)
R.add("mrg2_tombstones", "SELECT 'x' AS coll, user_id AS id, max(ts) AS t FROM events WHERE event_type = 'error' GROUP BY user_id HAVING max(ts) > TIMESTAMP '2024-07-20' - INTERVAL 180 DAYS")(
    lambda spark, d: M.tombstones(*(table(spark, d, "events").where(f"event_type = 'error' AND event_id % 2 = {k}").select(F.lit("x").alias("coll"), F.col("user_id").alias("id"), F.col("ts").alias("t")) for k in (0, 1)), F.expr("timestamp_ntz'2024-07-20'"))
)
R.add("mrg3_history", "WITH h AS (SELECT o_custkey AS owner, o_orderkey AS id, o_orderdate AS t, o_totalprice AS v FROM orders WHERE o_orderstatus <> 'F') SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY owner ORDER BY t DESC, id) <= 10")(
    lambda spark, d: M.history(*(table(spark, d, "orders").where(f"o_orderkey % 3 <> {k}").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("t"), F.col("o_totalprice").alias("v")) for k in (0, 1)), table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.lit("history").alias("coll"), F.col("o_orderkey").alias("id")), 10, ["owner"])
)
DAILY2 = "d AS (SELECT event_id % 2 AS r, CAST(ts AS DATE) AS day, user_id % 7 AS device, count(*) AS a, count_if(value < 50) AS c, CAST(sum(floor(value)) AS BIGINT) AS s FROM events GROUP BY ALL)"
R.add("mrg4_daily", f"WITH {DAILY2}, m AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY day, device ORDER BY a DESC, s DESC, r DESC) = 1) SELECT day, sum(a) AS answered, sum(c) AS correct, sum(s) AS secs FROM m GROUP BY day")(
    lambda spark, d: M.daily(*(table(spark, d, "events").where(f"event_id % 2 = {k}").groupBy(F.to_date("ts").alias("day"), (F.col("user_id") % 7).alias("device")).agg(F.count("*").alias("a"), F.count_if(F.expr("value < 50")).alias("c"), F.sum(F.floor("value")).cast("long").alias("s")) for k in (0, 1)))
)
R.add("mrg5_settings", "WITH o AS (SELECT event_id % 2 AS side, user_id AS owner, max(ts) AS at_, max_by(value, ts) AS body, max_by(event_type, ts) AS theme FROM events GROUP BY ALL), x AS (SELECT * FROM o WHERE side = 0), y AS (SELECT * FROM o WHERE side = 1) SELECT coalesce(x.owner, y.owner) AS owner, CASE WHEN y.at_ IS NULL OR x.at_ > y.at_ THEN x.body ELSE y.body END AS body, coalesce(x.theme, y.theme) AS theme, greatest(x.at_, y.at_) AS \"at\" FROM x FULL JOIN y ON x.owner = y.owner")(
    lambda spark, d: M.settings(*(table(spark, d, "events").where(f"event_id % 2 = {k}").groupBy(F.col("user_id").alias("owner")).agg(F.max("ts").alias("at"), F.max_by("value", "ts").alias("body"), F.max_by("event_type", "ts").alias("theme")) for k in (0, 1)))
)
_CUT = "TIMESTAMP '2024-01-15'"
_WON = "CASE WHEN y.t IS NULL OR x.t > y.t THEN x.{0} ELSE y.{0} END AS {0}"
_MERGED = "SELECT coalesce(x.coll, y.coll) AS coll, coalesce(x.id, y.id) AS id, " + ", ".join(_WON.format(c) for c in ("t", "v")) + " FROM {x} x FULL JOIN {y} y ON x.coll = y.coll AND x.id = y.id"
_ALIVE = "SELECT m.coll, m.id, m.t, m.v FROM ({m}) m LEFT JOIN dead USING (coll, id) WHERE dead.t IS NULL OR m.t > dead.t"


@R.add("mrg6_fenced", f"WITH {SIDES} " + _ALIVE.format(m=_MERGED.format(x=f"(SELECT * FROM x WHERE t > {_CUT} AND coll <> 'daily')", y="y")))
def mrg6(spark, d):
    """The remote side has begun a new epoch."""
    at = datetime.datetime(2024, 1, 15)
    return M.merged(_side(spark, d, 0), _side(spark, d, 1), _dead(spark, d), ("a", datetime.datetime(2024, 1, 1)), ("b", at))


def _daily(spark, d, side, device):
    e = table(spark, d, "events").where(f"event_id % 2 = {side}").groupBy(F.to_date("ts").alias("day"), device.alias("device"))
    return e.agg(F.count("*").alias("a"), F.count_if(F.expr("value < 50")).alias("c"), F.sum(F.floor("value")).cast("long").alias("s"))


@R.add("mrg7_legacy_daily", "WITH d AS (SELECT event_id % 2 AS r, CAST(ts AS DATE) AS day, CASE WHEN user_id % 7 <> 3 THEN user_id % 7 END AS dev, count(*) AS a, count_if(value < 50) AS c, CAST(sum(floor(value)) AS BIGINT) AS s FROM events GROUP BY ALL), o AS (SELECT r, day, coalesce(dev, CASE r WHEN 0 THEN 100 ELSE 200 END) AS device, a, c, s FROM d), m AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY day, device ORDER BY a DESC, s DESC, r DESC) = 1) SELECT day, sum(a) AS answered, sum(c) AS correct, sum(s) AS secs FROM m GROUP BY day")
def mrg7(spark, d):
    """Counters of device 3 are from before devices were named."""
    device = F.when(F.col("user_id") % 7 != 3, F.col("user_id") % 7)
    return M.daily(M.owned(_daily(spark, d, 0, device), F.lit(100)), M.owned(_daily(spark, d, 1, device), F.lit(200)))


@R.add("mrg8_imports", f"WITH {SIDES} SELECT 'merge' AS mode, * FROM (" + _ALIVE.format(m=_MERGED.format(x="x", y="y")) + ") UNION ALL SELECT 'replace', coll, id, t, v FROM y")
def mrg8(spark, d):
    out = None
    for mode in ("merge", "replace", "reset"):
        got = M.imported(_side(spark, d, 0), _side(spark, d, 1), _dead(spark, d), mode).select(F.lit(mode).alias("mode"), "coll", "id", "t", "v")
        out = got if out is None else out.unionByName(got)
    return out


R.add("set2_keys", f"WITH {SIDES} SELECT coalesce(x.coll, y.coll) AS coll, coalesce(x.id, y.id) AS id, x.id IS NOT NULL AS local, y.id IS NOT NULL AS remote FROM x FULL JOIN y ON x.coll = y.coll AND x.id = y.id")(lambda spark, d: M.keys(_side(spark, d, 0), _side(spark, d, 1)))
R.add("set4_intersect", "SELECT source, section FROM raw INTERSECT SELECT source, section FROM bank")(lambda spark, d: table(spark, d, "raw").select("source", "section").intersect(table(spark, d, "bank").select("source", "section")))
R.add("set4_except_all", "SELECT source, section FROM raw EXCEPT ALL SELECT source, section FROM bank")(lambda spark, d: table(spark, d, "raw").select("source", "section").exceptAll(table(spark, d, "bank").select("source", "section")))
R.add("agg14_state_summary", f"WITH {SIDES} SELECT side, coll, count(*) AS keys, count(DISTINCT CAST(t AS DATE)) AS days FROM (SELECT * FROM x UNION ALL SELECT * FROM y) GROUP BY ALL")(
    lambda spark, d: _side(spark, d, 0).withColumn("side", F.lit(0)).unionByName(_side(spark, d, 1).withColumn("side", F.lit(1))).groupBy("side", "coll").agg(F.count("*").alias("keys"), F.countDistinct(F.to_date("t")).alias("days"))
)

DRAW = "CAST(('0x' || substr(md5('{seed}|' || {key}), 1, 8)) AS BIGINT) / 4294967296.0"
BP = "bp(type, want, passage) AS (VALUES " + ", ".join(f"('{t}', {w}, {str(p).lower()})" for t, _, _, w, p in dims.TYPES if w) + ")"
ST = "st AS (SELECT id AS qid, count(*) AS n, count(*) FILTER (answer = 0) AS c, count_if(coalesce(answer, 1) <> 0) AS w FROM raw GROUP BY id)"
ITEM = "it AS (SELECT id AS qid, min(type) AS type, min(tier) AS tier, bool_or(coalesce(suspect, false)) AS suspect, min(passage_id) AS passage_id FROM bank GROUP BY id)"
SCORE = "CASE WHEN st.qid IS NULL THEN 0 WHEN w > 0 AND c = 0 THEN 1 ELSE 2 + c END"


def _items(spark, d):
    return table(spark, d, "bank").groupBy(F.col("id").alias("qid")).agg(F.min("type").alias("type"), F.min("tier").alias("tier"), F.max(F.coalesce("suspect", F.lit(False))).alias("suspect"), F.min("passage_id").alias("passage_id"))


def _stats(spark, d):
    r = table(spark, d, "raw")  # deliveries play the part of a learner's attempts
    return r.groupBy(F.col("id").alias("qid")).agg(F.count("*").alias("n"), F.count_if(F.expr("answer = 0")).alias("c"), F.count_if(F.expr("coalesce(answer, 1) <> 0")).alias("w"))


@R.add(
    "top6_paper",
    f"""WITH {BP}, {ST}, {ITEM}, g0 AS (SELECT it.*, bp.want, bp.passage, count_if(tier <> 'B') OVER (PARTITION BY type) AS good FROM it JOIN bp USING (type) WHERE NOT suspect),
    p AS (SELECT g0.qid, g0.type, want, CASE WHEN passage THEN coalesce(passage_id, g0.qid) ELSE g0.qid END AS grp, {SCORE} AS score FROM g0 LEFT JOIN st ON st.qid = g0.qid WHERE tier <> 'B' OR good < 2 * want),
    g AS (SELECT type, want, grp, avg(score) + {DRAW.format(seed='paper', key='grp')} * 0.5 AS place, count(*) AS n FROM p GROUP BY type, want, grp),
    k AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY type ORDER BY place, grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (PARTITION BY type ORDER BY place, grp) AS k FROM g)
    SELECT p.type, p.qid, p.grp, k.k FROM p JOIN k ON p.type = k.type AND p.grp = k.grp WHERE before < k.want""",
)
def top6(spark, d):
    return C.paper(_items(spark, d), _stats(spark, d), dims.types(spark).select("type", "want", "passage"), "paper")


@R.add(
    "top9_drill",
    f"""WITH {ST}, {ITEM}, p AS (SELECT it.qid, type, {SCORE} AS score FROM it LEFT JOIN st ON st.qid = it.qid WHERE NOT suspect AND passage_id IS NULL),
    b AS (SELECT * FROM p ORDER BY score + {DRAW.format(seed='drill', key='qid')} * 0.5, qid LIMIT 60) SELECT qid, type, score FROM b ORDER BY {DRAW.format(seed='drill/pick', key='qid')}, qid LIMIT 20""",
)
def top9(spark, d):
    return C.drill(_items(spark, d), _stats(spark, d), "drill", 20)


@R.add("top10_passage_drill", f"WITH {ST}, {ITEM}, p AS (SELECT it.qid, passage_id, {SCORE} AS score FROM it LEFT JOIN st ON st.qid = it.qid WHERE passage_id IS NOT NULL), g AS (SELECT passage_id, avg(score) + {DRAW.format(seed='passages', key='passage_id')} * 0.5 AS place FROM p GROUP BY passage_id ORDER BY place, passage_id LIMIT 5) SELECT passage_id, qid FROM p JOIN g USING (passage_id)")
def top10(spark, d):
    return C.passage_drill(_items(spark, d), _stats(spark, d), "passages", 5)


R.add("top8_staleness", f"WITH {ST}, {ITEM} SELECT it.qid, {SCORE} AS score FROM it LEFT JOIN st ON st.qid = it.qid")(lambda spark, d: C.fresh(_items(spark, d), _stats(spark, d)).select("qid", "score"))
R.add("top11_shuffle", "SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY md5('s|' || p_partkey), p_partkey) AS place FROM part")(
    lambda spark, d: table(spark, d, "part").select("p_brand", "p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.md5(F.concat(F.lit("s|"), F.col("p_partkey").cast("string"))), "p_partkey")).alias("place"))
)
ONE = "o AS (SELECT grp, text, min(id) AS id FROM p GROUP BY ALL), h AS (SELECT *, md5('d|' || id) AS h FROM o)"


@R.add(
    "top12_distractors",
    f"""WITH p AS (SELECT p_partkey AS id, p_brand AS grp, p_name AS text FROM part), {ONE},
    c AS (SELECT p.id, h.text AS t, min((CASE WHEN h.grp = p.grp THEN 0 ELSE 1 END, h.h)) AS f FROM p JOIN h ON h.text <> p.text GROUP BY ALL)
    SELECT id, row_number() OVER (PARTITION BY id ORDER BY f, t) AS k, t FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY f, t) <= 3""",
)
def top12(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("grp"), F.col("p_name").alias("text"))
    return C.distractors(p, "d")


POINTS = "pz AS (SELECT p_partkey AS id, p_brand AS grp, p_size AS n, length(p_name) AS exams, length(p_name) - length(replace(p_name, 'e', '')) AS examples FROM part)"


def points(spark, d):
    e = F.length("p_name") - F.length(F.replace("p_name", F.lit("e"), F.lit("")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("grp"), F.col("p_size").alias("n"), F.length("p_name").alias("exams"), e.alias("examples"))


_NUMBER = DRAW.format(seed="quiz", key="CAST(id AS VARCHAR)")


@R.add("top13_quiz_scope", LAST + f", {ONE_CARD}, {POINTS}, k AS (SELECT *, CASE WHEN examples > 0 THEN ['p2m', 'm2p', 'ex2p', 'ex2p'] ELSE ['p2m', 'm2p'] END AS ks FROM pz), q AS (SELECT id, exams, ks[CAST(floor({_NUMBER} * len(ks)) AS INT) + 1] AS kind FROM k) SELECT 'all' AS scope, id, kind FROM q UNION ALL SELECT 'weak', id, kind FROM q WHERE id NOT IN (SELECT id FROM cd WHERE reps > 0 AND box >= 4) UNION ALL SELECT 'freq', id, kind FROM q WHERE exams >= 10")
def top13(spark, d):
    p, c, out = points(spark, d), one_learner(spark, d), None
    for scope in ("all", "weak", "freq"):
        got = C.quiz(p, c, scope, "quiz").select(F.lit(scope).alias("scope"), "id", "kind")
        out = got if out is None else out.unionByName(got)
    return out


@R.add("top14_matching", "WITH p AS (SELECT p_partkey AS id, p_name AS text, p_size AS weak FROM part), o AS (SELECT text, min((-weak, id)) AS x FROM p GROUP BY text) SELECT x[2] AS id, text FROM (SELECT {'o': min_by(-weak, (-weak, id)), 'i': min_by(id, (-weak, id))} AS s, text FROM p GROUP BY text) t, LATERAL (SELECT [s.o, s.i] AS x) ORDER BY x[1], md5('m|' || x[2]) LIMIT 6")
def top14(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"), "p_size")
    return C.matching(p, F.col("p_size"), "m")


@R.add("top5_decks", LAST + f", {ONE_CARD}, {POINTS} SELECT 'due' AS deck, id, row_number() OVER (ORDER BY due, id) AS place FROM pz JOIN cd USING (id) WHERE due <= {DUE} UNION ALL SELECT 'new', id, row_number() OVER (ORDER BY n DESC, id) FROM pz WHERE id NOT IN (SELECT id FROM cd) UNION ALL SELECT 'official', id, row_number() OVER (ORDER BY exams DESC, n DESC, id) FROM pz WHERE id NOT IN (SELECT id FROM cd) AND exams > 0 "
    f"UNION ALL SELECT 'weak', id, row_number() OVER (ORDER BY lapses DESC, id) FROM pz JOIN cd USING (id) WHERE lapses > 0 AND box < 4 UNION ALL SELECT 'all', id, row_number() OVER (ORDER BY {DRAW.format(seed='deck', key='CAST(id AS VARCHAR)')}, id) FROM pz QUALIFY row_number() OVER (ORDER BY {DRAW.format(seed='deck', key='CAST(id AS VARCHAR)')}, id) <= 20")
def top5(spark, d):
    """All decks whole, the shuffled one with the limit of a session."""
    p, c, out = points(spark, d), one_learner(spark, d), None
    for name, how in (("due", {}), ("new", {}), ("official", {"official": True}), ("weak", {}), ("all", {"limit": 20, "seed": "deck"})):
        got = C.deck(p, c, "new" if name == "official" else name, F.lit("2024-01-25").cast("date"), **how).select(F.lit(name).alias("deck"), "id", "place")
        out = got if out is None else out.unionByName(got)
    return out


R.add("top21_spot_check", "SELECT rid FROM raw ORDER BY md5('spot|' || rid), rid LIMIT 8")(lambda spark, d: table(spark, d, "raw").select("rid").orderBy(F.md5(F.concat(F.lit("spot|"), F.col("rid").cast("string"))), "rid").limit(8))
R.add("agg21_study_results", f"WITH {ATT} SELECT device, qid, count(*) AS tries, max(floor(secs / 500 * 1000 + 0.5) / 1000) AS best, arg_max(ok, (ts, attempt)) AS last_ok FROM a GROUP BY ALL")(
    lambda spark, d: attempts(spark, d).groupBy("device", "qid").agg(F.count("*").alias("tries"), F.max(F.floor(F.col("secs") / 500 * 1000 + 0.5) / 1000).alias("best"), F.max_by("ok", F.struct("ts", "attempt")).alias("last_ok"))
)
R.add("str2_stats_batch", f"WITH {ATT}, {STATS} SELECT qid, n, c FROM s")(lambda spark, d: A.item_stats(attempts(spark, d)).select("qid", "n", "c"))
