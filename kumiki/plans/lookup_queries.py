"""Queries of lookups, catalogs and calendars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kumiki import dims
from kumiki.functions import text as T
from kumiki.operators import attempts as A
from kumiki.operators import lookup as L
from kumiki.operators import quality as Q
from kumiki.operators import schedule as C
from kumiki.plans.attempt_queries import GRADED, graded
from kumiki.plans.learner_queries import LAST, ONE_CARD, one_learner
from kumiki.plans.registry import Registry
from kumiki.session import table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
NJ = "translate({}, '" + T.IGNORED_JA.replace("'", "''") + "', '')"
PATTERNS = "pt AS (SELECT DISTINCT unnest(options) AS pattern FROM bank WHERE type = 'grammar_form')"
BQ = "q AS (SELECT id, min(question) AS question, arg_min(options, question) AS options, min(section) AS section FROM bank GROUP BY id)"
WORDS = "wd AS (SELECT regexp_extract(question, '＿([^＿★\\s]+)＿', 1) AS word, options[answer + 1] AS reading, min(id) AS ord FROM bank WHERE type = 'kanji_reading' AND answer IS NOT NULL GROUP BY ALL)"
ALL_TEXT = "array_to_string(list_filter(list_concat([question], coalesce(options, [])), lambda x: x IS NOT NULL AND x <> ''), chr(10))"


def patterns(spark, d):
    return table(spark, d, "bank").where("type = 'grammar_form'").select(F.explode("options").alias("pattern")).distinct()


def questions(spark, d):
    return table(spark, d, "bank").groupBy("id").agg(F.min("question").alias("question"), F.min_by("options", "question").alias("options"), F.min("section").alias("section"))


def words(spark, d):
    w = F.regexp_extract("question", r"＿([^＿★\s]+)＿", 1)
    return table(spark, d, "bank").where("type = 'kanji_reading' AND answer IS NOT NULL").groupBy(w.alias("word"), F.get("options", F.col("answer")).alias("reading")).agg(F.min("id").alias("ord"))


CORE = "regexp_replace(" + NJ.format("regexp_split_to_array(regexp_split_to_array(pattern, '[（(]')[1], '[／/]|、|\\s/\\s')[1]") + ", '^(" + L.CLASSES + ")+', '')"


@R.add("jn11_related_patterns", f"WITH {PATTERNS}, {BQ}, c AS (SELECT pattern, {CORE} AS core FROM pt) SELECT id, pattern, row_number() OVER (PARTITION BY id ORDER BY length(core) DESC, pattern) AS k FROM q JOIN c ON section IN ('bunpo', 'dokkai') AND length(core) >= 2 AND contains({ALL_TEXT}, core) QUALIFY k <= 5")
def jn11(spark, d):
    return L.related_patterns(questions(spark, d), patterns(spark, d))


@R.add(
    "jn12_related_words",
    f"""WITH {BQ}, {WORDS}, y AS (SELECT word, reading, ord, 0 AS side, {NJ.format('word')} AS key FROM wd UNION ALL SELECT word, reading, ord, 1, {NJ.format('reading')} FROM wd),
    o AS (SELECT id, generate_subscripts(options, 1) - 1 AS pos, unnest(options) AS x FROM q), s AS (SELECT id, word, reading, {{'far': 0, 'pos': pos, 'by': side, 'ord': ord}} AS at_ FROM o JOIN y ON y.key = {NJ.format('o.x')} AND y.key <> ''),
    n AS (SELECT id, count(DISTINCT (word, reading)) AS n FROM s GROUP BY id),
    t AS (SELECT q.id, word, reading, {{'far': 1, 'pos': 0, 'by': 0, 'ord': ord}} AS at_ FROM q LEFT JOIN n USING (id) JOIN wd ON length({NJ.format('word')}) >= 2 AND regexp_matches({NJ.format('word')}, '[一-龯]') AND contains({NJ.format('question')}, {NJ.format('word')}) WHERE section <> 'dokkai' AND coalesce(n, 0) < 6),
    b AS (SELECT id, word, reading, min(at_) AS at_ FROM (SELECT * FROM s UNION ALL SELECT * FROM t) GROUP BY ALL) SELECT id, word, reading, row_number() OVER (PARTITION BY id ORDER BY at_, word, reading) AS k FROM b QUALIFY k <= 6""",
)
def jn12(spark, d):
    return L.related_words(questions(spark, d), words(spark, d))


KD = "kd AS (SELECT DISTINCT unnest(regexp_extract_all(word, '[一-龯㐀-䶿]')) AS kanji FROM wd)"


@R.add("jn13_related_kanji", f"WITH {BQ}, {WORDS}, {KD}, c AS (SELECT id, kanji, min(pos) AS pos FROM (SELECT id, unnest(l) AS kanji, generate_subscripts(l, 1) AS pos FROM (SELECT id, regexp_extract_all(CASE WHEN section = 'dokkai' THEN array_to_string(coalesce(options, []), '') ELSE {ALL_TEXT} END, '[一-龯㐀-䶿]') AS l FROM q)) GROUP BY ALL) SELECT id, kanji, row_number() OVER (PARTITION BY id ORDER BY pos) AS k FROM c JOIN kd USING (kanji) QUALIFY k <= 10")
def jn13(spark, d):
    k = words(spark, d).select(F.explode(T.kanji_chars(F.col("word"))).alias("kanji")).distinct()
    return L.related_kanji(questions(spark, d), k)


MORE = "mw AS (SELECT options[answer + 1] AS word, min(length(question)) AS ord FROM bank WHERE type = 'orthography' AND answer IS NOT NULL GROUP BY ALL)"


@R.add("jn14_kanji_words", f"WITH {WORDS}, {MORE}, b AS (SELECT word, 0 AS l, length(word) AS o FROM wd UNION ALL SELECT word, 1, ord FROM mw WHERE word <> ''), w AS (SELECT word, min({{'l': l, 'o': o}}) AS at_ FROM b GROUP BY word), c AS (SELECT DISTINCT word, at_, unnest(regexp_extract_all(word, '[一-龯㐀-䶿]')) AS kanji FROM w) SELECT kanji, word, row_number() OVER (PARTITION BY kanji ORDER BY at_, word) AS k FROM c QUALIFY k <= 4")
def jn14(spark, d):
    """Words of readings first, topped up from the words of spelling items."""
    more = table(spark, d, "bank").where("type = 'orthography' AND answer IS NOT NULL").groupBy(F.get("options", F.col("answer")).alias("word")).agg(F.min(F.length("question")).alias("ord"))
    return L.kanji_words(words(spark, d), more)


R.add("agg15_readings", "WITH w AS (SELECT p_name AS word, p_type AS meaning, p_brand AS reading, p_partkey AS ord, CASE WHEN p_size > 10 THEN p_name END AS vi FROM part), r AS (SELECT word, meaning, reading, min(ord) AS o FROM w GROUP BY ALL) SELECT word, meaning, string_agg(reading, '・' ORDER BY o, reading) AS readings, (SELECT arg_min(vi, ord) FROM w x WHERE x.word = r.word AND x.meaning = r.meaning AND vi IS NOT NULL) AS vi FROM r GROUP BY word, meaning")(
    lambda spark, d: L.readings(table(spark, d, "part").select(F.col("p_name").alias("word"), F.col("p_type").alias("meaning"), F.col("p_brand").alias("reading"), F.col("p_partkey").alias("ord"), F.when(F.col("p_size") > 10, F.col("p_name")).alias("vi")))
)
R.add("jn16_homographs", "WITH w AS (SELECT p_name AS word, p_brand AS reading, p_type AS meaning, p_partkey AS ord FROM part), q AS (SELECT DISTINCT word, 'Brand#' || (1 + length(word) % 5) AS reading FROM w) SELECT q.word, q.reading, arg_min(w.meaning, (CASE WHEN w.reading = q.reading THEN 0 ELSE 1 END, w.ord)) AS meaning FROM q LEFT JOIN w ON w.word = q.word GROUP BY ALL")(
    lambda spark, d: L.by_priority(table(spark, d, "part").select(F.col("p_name").alias("word"), F.concat(F.lit("Brand#"), (1 + F.length("p_name") % 5).cast("string")).alias("reading")).distinct(), table(spark, d, "part").select(F.col("p_name").alias("word"), F.col("p_brand").alias("reading"), F.col("p_type").alias("meaning"), F.col("p_partkey").alias("ord")))
)
PT = "pz AS (SELECT p_partkey AS id, p_brand AS grp, p_name AS pattern, lower(p_brand) AS reading, p_type AS meaning_vi, p_type || ' ' || p_size AS formula FROM part)"


def grammar_points(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("grp"), F.col("p_name").alias("pattern"), F.lower("p_brand").alias("reading"), F.col("p_type").alias("meaning_vi"), F.concat_ws(" ", "p_type", F.col("p_size").cast("string")).alias("formula"))


MEANT = "mv AS (SELECT options[answer + 1] AS pattern, min(trans) AS meaning_vi FROM bank JOIN explain_out USING (id) WHERE type = 'grammar_form' AND answer IS NOT NULL AND trans IS NOT NULL GROUP BY 1)"


def meanings(spark, d):
    e = table(spark, d, "explain_out").where("trans IS NOT NULL").select(F.col("id").alias("_e"), "trans")
    b = table(spark, d, "bank").where("type = 'grammar_form' AND answer IS NOT NULL").select("id", F.get("options", F.col("answer")).alias("pattern"))
    return b.join(e, F.expr("id = _e")).groupBy("pattern").agg(F.min("trans").alias("meaning_vi"))


R.add("flt9_patterns", f"WITH {MEANT} SELECT pattern, meaning_vi FROM mv WHERE contains({NJ.format('pattern')}, 'ので') OR contains(lower(meaning_vi), 'ので')")(
    lambda spark, d: L.search_patterns(meanings(spark, d).withColumn("meaning_en", F.lit(None).cast("string")), " ので").select("pattern", "meaning_vi")
)
R.add("flt9_meanings", f"WITH {MEANT} SELECT pattern, meaning_vi FROM mv WHERE contains(lower(meaning_vi), 'không') OR contains({NJ.format('pattern')}, 'KHÔNG')")(
    lambda spark, d: L.search_patterns(meanings(spark, d).withColumn("meaning_en", F.lit(None).cast("string")), "KHÔNG").select("pattern", "meaning_vi")
)
R.add("flt9_words", f"WITH {WORDS} SELECT word, reading FROM wd WHERE contains(word, '換') OR contains(reading, '換')")(
    lambda spark, d: L.search_words(words(spark, d).withColumns({"meaning_vi": F.lit(None).cast("string"), "meaning_en": F.col("ord")}), "換 ").select("word", "reading")
)
R.add("flt9_kanji", f"WITH {WORDS}, k AS (SELECT kanji, list(DISTINCT reading ORDER BY reading) AS readings FROM (SELECT reading, unnest(regexp_extract_all(word, '[一-龯㐀-䶿]')) AS kanji FROM wd) GROUP BY kanji) SELECT kanji FROM k WHERE kanji = 'せつ' OR len(list_filter(readings, lambda r: contains(r, 'せつ'))) > 0")(
    lambda spark, d: L.search_kanji(
        words(spark, d).select("reading", F.explode(T.kanji_chars(F.col("word"))).alias("kanji")).groupBy("kanji").agg(F.collect_set("reading").alias("on")).withColumns({"kun": F.lit(None).cast("array<string>"), "hanviet": F.lit(None).cast("string"), "meaning_vi": F.lit(None).cast("string"), "meaning_en": F.lit(None).cast("string")}), "せつ"
    ).select("kanji")
)
R.add("flt10_filtered", LAST + f", {ONE_CARD}, {PT} SELECT id, status FROM (SELECT pz.*, CASE WHEN cd.id IS NULL OR reps = 0 THEN 'new' WHEN box >= 4 THEN 'known' ELSE 'learning' END AS status FROM pz LEFT JOIN cd USING (id) WHERE contains({NJ.format('pattern')}, 'red') OR contains(reading, 'red') OR contains(lower(meaning_vi), 'red') OR contains(lower(formula), 'red'))")(
    lambda spark, d: _by_status(spark, d, "red ")
)
R.add("flt10_due", LAST + f", {ONE_CARD}, {PT} SELECT id FROM pz JOIN cd USING (id) WHERE grp = 'Brand#2' AND due <= DATE '2024-02-15'")(
    lambda spark, d: L.filter_points(grammar_points(spark, d), one_learner(spark, d), group="Brand#2", status="due", today=F.lit("2024-02-15").cast("date")).select("id")
)


def _by_status(spark, d, query):
    """The lists of all three statuses together are all points that hold the query."""
    p, c = grammar_points(spark, d), one_learner(spark, d)
    out = None
    for s in ("new", "learning", "known"):
        got = L.filter_points(p, c, query, status=s).select("id", F.lit(s).alias("status"))
        out = got if out is None else out.unionByName(got)
    return out


R.add("flt11_hits", "SELECT rid FROM raw WHERE contains(lower(coalesce(question, '')), '図書館') OR contains(lower(coalesce(passage, '')), '図書館') ORDER BY rid LIMIT 20")(lambda spark, d: L.search(table(spark, d, "raw"), "図書館", ["question", "passage"], 20, ["rid"]).select("rid"))
FLAGGED = "fl AS (SELECT DISTINCT CAST(json_extract_string(props, '$.k') AS BIGINT) AS qid FROM events WHERE event_type = 'signup')"
R.add("flt12_review_filter", f"WITH {GRADED.replace('p_type AS type', 'p_type AS type, p_partkey AS qid')}, {FLAGGED} SELECT session, pos, unnest(list_filter(['all', CASE WHEN ok THEN 'right' ELSE 'wrong' END, CASE WHEN qid IN (SELECT qid FROM fl) THEN 'flag' END], lambda x: x IS NOT NULL)) AS shown FROM g")(
    lambda spark, d: A.review(graded(spark, d), table(spark, d, "events").where("event_type = 'signup'").select(F.get_json_object("props", "$.k").cast("long").alias("qid"))).select("session", "pos", "shown")
)
PAIRS = "pr AS (SELECT DISTINCT options[answer + 1] AS pattern, id AS qid FROM bank WHERE type = 'grammar_form' AND answer IS NOT NULL)"
OFF = "ofx AS (SELECT id AS qid, max(exam) AS label FROM bank WHERE exam IN (SELECT name FROM exams WHERE official) GROUP BY id)"


def pairs(spark, d):
    return table(spark, d, "bank").where("type = 'grammar_form' AND answer IS NOT NULL").select(F.get("options", F.col("answer")).alias("pattern"), F.col("id").alias("qid")).distinct()


def official(spark, d):
    e = table(spark, d, "exams").where("official").select(F.col("name").alias("exam")).distinct()
    return table(spark, d, "bank").join(e, "exam", "left_semi").groupBy(F.col("id").alias("qid")).agg(F.max("exam").alias("label"))


R.add("agg22_points", f"WITH {PAIRS}, {OFF} SELECT pattern, count(DISTINCT pr.qid) AS n, count(DISTINCT ofx.qid) AS official, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels FROM pr LEFT JOIN ofx USING (qid) GROUP BY pattern".replace("count(DISTINCT ofx.qid)", "count(DISTINCT CASE WHEN ofx.label IS NOT NULL THEN pr.qid END)"))(lambda spark, d: L.point_rollup(pairs(spark, d), official(spark, d)))
R.add("top16_catalog", f"WITH {PAIRS}, {OFF}, r AS (SELECT pattern, count(DISTINCT pr.qid) AS n, count(DISTINCT CASE WHEN ofx.label IS NOT NULL THEN pr.qid END) AS official FROM pr LEFT JOIN ofx USING (qid) GROUP BY pattern) SELECT pattern, row_number() OVER (ORDER BY official DESC, n DESC, pattern) AS place FROM r ")(
    lambda spark, d: Q.numbered(L.point_rollup(pairs(spark, d), official(spark, d)), [], [-F.col("official"), -F.col("n"), F.col("pattern")]).select("pattern", "place")
)
SENT = "se AS (SELECT id AS qid, min(regexp_replace(question, '[（(][\\s\\x{3000}]*[)）]', '＿', 'g')) AS sentence FROM bank GROUP BY id)"


@R.add("top15_examples", f"WITH {PAIRS}, {OFF}, {SENT}, j AS (SELECT pattern, sentence, min((CASE WHEN ofx.label IS NULL THEN 1 ELSE 0 END, pr.qid)) AS x FROM pr JOIN se USING (qid) LEFT JOIN ofx ON ofx.qid = pr.qid WHERE length(sentence) >= 6 GROUP BY ALL) SELECT pattern, sentence, row_number() OVER (PARTITION BY pattern ORDER BY x, sentence) AS k FROM j QUALIFY k <= 6")
def top15(spark, d):
    s = table(spark, d, "bank").groupBy(F.col("id").alias("qid")).agg(F.min(F.regexp_replace("question", r"[（(][\s　]*[)）]", "＿")).alias("sentence"))
    return L.examples(pairs(spark, d), s, official(spark, d))


R.add("top17_batch_order", "SELECT id, row_number() OVER (PARTITION BY section ORDER BY p IS NULL, CASE WHEN p IS NULL THEN id ELSE regexp_replace(id, '-[0-9]+$', '') END, id) AS place FROM (SELECT id, min(section) AS section, min(passage_id) AS p FROM bank GROUP BY id)")(
    lambda spark, d: Q.numbered(table(spark, d, "bank").groupBy("id").agg(F.min("section").alias("section"), F.min("passage_id").alias("p")), ["section"], [F.col("p").isNull(), F.when(F.col("p").isNull(), F.col("id")).otherwise(F.regexp_replace("id", "-[0-9]+$", "")), F.col("id")]).select("id", "place")
)
R.add("top18_kanji_order", f"WITH {WORDS}, c AS (SELECT unnest(regexp_extract_all(word, '[一-龯㐀-䶿]')) AS kanji FROM wd), n AS (SELECT kanji, count(*) AS n FROM c GROUP BY kanji), f AS (SELECT kanji, CASE WHEN n > 1 THEN 1000 // n END AS freq FROM n) SELECT kanji, row_number() OVER (ORDER BY coalesce(freq, 9999), kanji) AS place FROM f")(
    # the rank of a kanji seen once is unknown
    lambda spark, d: Q.numbered(words(spark, d).select(F.explode(F.regexp_extract_all("word", F.lit(T.KANJI), F.lit(0))).alias("kanji")).groupBy("kanji").agg(F.count("*").alias("n")).select("kanji", F.when(F.col("n") > 1, F.floor(F.lit(1000) / F.col("n"))).alias("freq")), [], [F.coalesce("freq", F.lit(9999)), F.col("kanji")]).select("kanji", "place")
)
R.add("top19_types_by_task", "SELECT type, coalesce(min(mondai), 99) AS task, count(*) AS n FROM bank GROUP BY type")(lambda spark, d: table(spark, d, "bank").groupBy("type").agg(F.coalesce(F.min("mondai"), F.lit(99)).alias("task"), F.count("*").alias("n")).orderBy("task", "type"))
WANT = "w(type, section, want, minutes) AS (VALUES " + ", ".join(f"('{t}', '{s}', {w}, {dims.MINUTES[s]})" for t, s, _, w, _ in dims.TYPES) + ")"
R.add("agg23_scope", f"WITH {WANT}, h AS (SELECT type, count(DISTINCT id) AS n FROM bank GROUP BY type) SELECT w.section, sum(least(want, coalesce(n, 0))) AS items, any_value(minutes) AS minutes, coalesce(sum(n), 0) AS available FROM w LEFT JOIN h USING (type) GROUP BY w.section")(
    lambda spark, d: dims.types(spark).join(table(spark, d, "bank").groupBy(F.col("type").alias("t")).agg(F.countDistinct("id").alias("n")), F.expr("type = t"), "left").groupBy("section").agg(F.sum(F.least("want", F.coalesce("n", F.lit(0)))).alias("items"), F.first(dims.chosen(F.col("section"), dims.MINUTES)).alias("minutes"), F.coalesce(F.sum("n"), F.lit(0)).alias("available"))
)

UNITS = "u AS (SELECT p_brand AS track, CAST(p_partkey AS VARCHAR) AS unit, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS pos, p_size > 5 AS ready FROM part)"
ACTS = (
    "sl(slot, kind, a, b) AS (VALUES " + ", ".join(f"({s}, '{k}', {a}, {b})" for s, k, a, b in C.SLOTS) + "), "
    "ac AS (SELECT track, CAST(pos // 4 AS INT) AS week, slot, kind, string_agg(unit, '+' ORDER BY pos) AS units, bool_and(ready) AS ready FROM u JOIN sl ON pos % 4 BETWEEN a AND b GROUP BY track, pos // 4, slot, kind), "
    "sc AS (SELECT *, row_number() OVER w - 1 AS seq, CASE WHEN kind = 'P' THEN CAST(sum(CAST(kind = 'P' AS INT)) OVER w AS BIGINT) END AS practice FROM ac WINDOW w AS (PARTITION BY track ORDER BY week, slot))"
)
START = "DATE '2024-01-01'"


def units(spark, d):
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    return table(spark, d, "part").select(F.col("p_brand").alias("track"), F.col("p_partkey").cast("string").alias("unit"), (F.row_number().over(w) - 1).alias("pos"), (F.col("p_size") > 5).alias("ready"))


def acts(spark, d):
    return C.dated(C.activities(units(spark, d)), F.lit("2024-01-01").cast("date"))


R.add("cal1_schedule", f"WITH {UNITS}, {ACTS} SELECT track, week, slot, kind, units, ready, seq, practice FROM sc")(lambda spark, d: C.activities(units(spark, d)))
R.add("cal2_dates", f"WITH {UNITS}, {ACTS} SELECT track, seq, {START} + week * 7 + slot AS day FROM sc")(lambda spark, d: acts(spark, d).select("track", "seq", "day"))


@R.add("agg19_progress", f"WITH {UNITS}, {ACTS}, dn AS (SELECT DISTINCT 'Brand#' || (1 + user_id % 25) AS track, CAST(json_extract_string(props, '$.k') AS BIGINT) AS seq, true AS done FROM events), j AS (SELECT sc.*, {START} + week * 7 + slot AS day, coalesce(done, false) AS done FROM sc LEFT JOIN dn USING (track, seq)) SELECT track, count_if(done) AS done, count(*) AS total, count_if(NOT done AND day < DATE '2024-02-15') AS behind, arg_min(units, seq) FILTER (day = DATE '2024-02-15') AS today, arg_min(units, seq) FILTER (NOT done) AS next FROM j GROUP BY track")
def agg19(spark, d):
    done = table(spark, d, "events").select(F.concat(F.lit("Brand#"), (1 + F.col("user_id") % 25).cast("string")).alias("track"), F.get_json_object("props", "$.k").cast("long").alias("seq")).distinct()
    return C.progress(acts(spark, d), done, F.lit("2024-02-15").cast("date"))


LESSONS = "ls AS (SELECT p_brand AS track, CAST(l_partkey AS VARCHAR) AS unit, CASE l_linenumber % 3 WHEN 0 THEN 'quiz' WHEN 1 THEN 'practice' ELSE 'test' END AS part, l_orderkey * 10 + l_linenumber AS qid, l_suppkey AS grp FROM lineitem JOIN part ON p_partkey = l_partkey)"


def lessons(spark, d):
    part = F.when(F.col("l_linenumber") % 3 == 0, "quiz").when(F.col("l_linenumber") % 3 == 1, "practice").otherwise("test")
    return table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_brand"), F.expr("p_partkey = l_partkey")).select(F.col("p_brand").alias("track"), F.col("l_partkey").cast("string").alias("unit"), part.alias("part"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("qid"), F.col("l_suppkey").alias("grp"))


R.add("cal4_activity_items", f"WITH {UNITS}, {ACTS}, {LESSONS}, a AS (SELECT track, seq, CASE kind WHEN 'P' THEN 'practice' WHEN 'M' THEN 'test' ELSE 'quiz' END AS part, unnest(string_split(units, '+')) AS unit FROM sc) SELECT track, seq, qid, grp, row_number() OVER (PARTITION BY track, seq ORDER BY md5('s|' || grp), grp, qid) AS place FROM a JOIN ls USING (track, part, unit)")(lambda spark, d: C.activity_items(acts(spark, d), lessons(spark, d), "s"))
R.add("agg20_index", f"WITH {UNITS}, {LESSONS} SELECT unit, count_if(part = 'quiz') AS quiz, count_if(part = 'practice') AS practice, count_if(part = 'test') AS test, count_if(part = 'quiz') > 0 AS ready FROM (SELECT DISTINCT unit FROM u) LEFT JOIN ls USING (unit) GROUP BY unit")(lambda spark, d: C.index(units(spark, d), lessons(spark, d)))
R.add("cal5_results", "WITH r AS (SELECT user_id AS activity, event_type AS mode, floor(value) AS c, 500 AS n, ts FROM events) SELECT activity, max(CASE WHEN mode <> 'error' THEN floor(c / n * 1000 + 0.5) / 1000 END) AS best, count(*) AS tries, arg_max(c, ts) FILTER (mode <> 'error') AS last_c FROM r GROUP BY activity")(
    lambda spark, d: C.results(table(spark, d, "events").select(F.col("user_id").alias("activity"), F.when(F.col("event_type") == "error", "wrong").otherwise(F.col("event_type")).alias("mode"), F.floor("value").alias("c"), F.lit(500).alias("n"), "ts")).select("activity", "best", "tries", F.col("last.c").alias("last_c"))
)
R.add("cal6_countdown", "SELECT o_orderkey, CAST(o_orderdate AS DATE) - DATE '1996-01-01' AS days, CAST(least(100, floor(o_custkey / greatest(least(o_orderkey % 300, 200), 5) * 100 + 0.5)) AS INT) AS pct, CAST(ceil(0.75 * (o_custkey % 40)) AS INT) AS minutes FROM orders")(
    lambda spark, d: table(spark, d, "orders").select("o_orderkey", C.countdown(F.to_date("o_orderdate"), F.lit("1996-01-01").cast("date"), F.col("o_custkey"), F.col("o_orderkey") % 300, F.col("o_custkey") % 40).alias("x")).select("o_orderkey", "x.*")
)


SENTENCES = f"{PAIRS}, {OFF}, {SENT}, ex AS (SELECT pattern, sentence, min((CASE WHEN ofx.label IS NULL THEN 1 ELSE 0 END, pr.qid)) AS x FROM pr JOIN se USING (qid) LEFT JOIN ofx ON ofx.qid = pr.qid WHERE length(sentence) >= 6 GROUP BY ALL), k6 AS (SELECT pattern, sentence FROM ex QUALIFY row_number() OVER (PARTITION BY pattern ORDER BY x, sentence) <= 6)"


@R.add(
    "jn15_translations",
    f"""WITH {SENTENCES}, {MEANT}, p AS (SELECT pattern, CASE WHEN length(pattern) > 2 THEN list(sentence ORDER BY sentence) END AS e FROM k6 GROUP BY pattern), f AS (SELECT *, coalesce(e, [pattern || 'の例', '例']) AS ex FROM p),
    tr AS (SELECT sentence AS ja, min(trans) AS vi FROM se JOIN explain_out ON explain_out.id = se.qid WHERE trans IS NOT NULL GROUP BY 1), x AS (SELECT pattern, e IS NULL AS fallback, unnest(ex) AS ja, generate_subscripts(ex, 1) - 1 AS pos FROM f)
    SELECT pattern, mv.meaning_vi, fallback, pos, ja, vi FROM x LEFT JOIN mv USING (pattern) LEFT JOIN tr USING (ja)""",
)
def jn15(spark, d):
    """Short patterns have lost their examples and take the fallback's."""
    k6 = top15(spark, d).groupBy("pattern").agg(F.array_sort(F.collect_list("sentence")).alias("e"))  # at most six of a pattern
    e = table(spark, d, "explain_out").where("trans IS NOT NULL").select("id", F.col("trans").alias("vi"))
    s = table(spark, d, "bank").groupBy("id").agg(F.min(F.regexp_replace("question", r"[（(][\s　]*[)）]", "＿")).alias("ja"))
    fallback = k6.select("pattern", F.array(F.concat("pattern", F.lit("の例")), F.lit("例")).alias("examples"))
    points = k6.select("pattern", F.when(F.length("pattern") > 2, F.col("e")).alias("examples"))
    return L.translated(points, meanings(spark, d).withColumnRenamed("meaning_vi", "vi"), s.join(e, "id").select("ja", "vi"), fallback)
