"""Queries of lesson rules: bank rows play the questions of lessons; a unit is an exam and section."""

from __future__ import annotations

from pyspark.sql import functions as F

from kumiki.operators import lessons as L
from kumiki.plans.registry import Registry
from kumiki.session import table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
TRACK = "CASE section WHEN 'bunpo' THEN 'bunpo' WHEN 'moji' THEN 'goi' WHEN 'dokkai' THEN 'dokkai' END"
PART = "CASE answer WHEN 0 THEN 'quiz' WHEN 1 THEN 'practice' ELSE 'test' END"
KIND = "CASE type WHEN 'sentence_order' THEN 'order' WHEN 'grammar_form' THEN 'form' WHEN 'text_grammar' THEN 'passage' WHEN 'kanji_reading' THEN 'read' WHEN 'orthography' THEN 'write' WHEN 'context' THEN 'context' WHEN 'paraphrase' THEN 'paraphrase' WHEN 'usage' THEN 'usage' WHEN 'grammar_misc' THEN '' ELSE if(section = 'dokkai', 'passage', type) END"
ROTATED = "CASE WHEN type = 'sentence_order' AND answer IS NOT NULL THEN {} END"
_Q = (
    f"SELECT coalesce(exam, '') || '/' || section AS unit, {TRACK} AS track, {PART} AS part, source AS pos, id, {KIND} AS kind, question AS q, options, answer, "
    + ROTATED.format("[0, (answer + 2) % 4, 2, 3]")
    + " AS ord, explanation AS why, exam AS vi, passage_id AS pass, type AS ref, built_at FROM bank WHERE section <> 'choukai'"
)


def questions(spark, d):
    b = table(spark, d, "bank").where("section <> 'choukai'")
    order = F.expr(ROTATED.format("array(0, (answer + 2) % 4, 2, 3)"))
    return b.select(
        F.concat(F.coalesce("exam", F.lit("")), F.lit("/"), "section").alias("unit"), F.expr(TRACK).alias("track"), F.expr(PART).alias("part"), F.col("source").alias("pos"), "id", F.expr(KIND).alias("kind"),
        F.col("question").alias("q"), "options", "answer", order.alias("order"), F.col("explanation").alias("why"), F.col("exam").alias("vi"), F.col("passage_id").alias("pass"), F.col("type").alias("ref"),
    )


def passages(spark, d):
    """A unit may use the passages that there are."""
    p = table(spark, d, "passages").select(F.col("pid").alias("_k"), "text", F.col("vi").alias("ja_vi")).groupBy("_k").agg(F.min("text").alias("ja"), F.min("ja_vi").alias("vi"))
    q = questions(spark, d).where("`pass` <> ''").select("unit", "pass").distinct()
    return q.join(p, F.expr("`pass` = _k")).select("unit", F.col("pass").alias("pid"), "ja", "vi")


def counted(df):
    return df.groupBy("unit", "path", "severity", "rule").agg(F.count("*").alias("n"))


_RULES = """[CASE WHEN coalesce(id, '') = '' THEN 'error/no id' END, CASE WHEN coalesce(kind, '') = '' THEN 'error/no kind' END, CASE WHEN coalesce(q, '') = '' THEN 'error/no q' END, CASE WHEN coalesce(why, '') = '' THEN 'error/no why' END,
  CASE WHEN coalesce(len(options), 0) = 0 THEN 'error/no options' END, CASE WHEN answer IS NULL THEN 'error/no answer' END,
  CASE WHEN coalesce(kind, '') <> '' AND NOT coalesce(CASE track WHEN 'bunpo' THEN kind IN ('form', 'order', 'usage', 'passage') WHEN 'goi' THEN kind IN ('read', 'write', 'formation', 'context', 'paraphrase', 'usage', 'form', 'order') WHEN 'dokkai' THEN kind = 'passage' END, false) THEN 'error/kind of another track' END,
  CASE WHEN coalesce(len(options), 0) <> 4 THEN 'error/four options' END, CASE WHEN len(list_distinct(options)) < len(options) THEN 'error/distinct options' END,
  CASE WHEN len(list_filter(options, lambda o: regexp_matches(coalesce(o, ''), '^[ \\x{3000}\\n\\t]*$'))) > 0 THEN 'error/empty option' END, CASE WHEN answer IS NULL OR answer < 0 OR answer >= greatest(coalesce(len(options), 0), 1) THEN 'error/answer in range' END,
  CASE WHEN kind = 'order' AND NOT coalesce(list_sort(ord) = [0, 1, 2, 3], false) THEN 'error/order is a permutation' END,
  CASE WHEN kind = 'order' AND list_sort(ord) = [0, 1, 2, 3] AND NOT ok THEN 'error/one star and three slots' END, CASE WHEN kind = 'order' AND list_sort(ord) = [0, 1, 2, 3] AND ok AND coalesce(answer <> ord[list_position(slots, '★')], true) THEN 'error/answer at the star' END,
  CASE WHEN coalesce(ref, '') <> '' AND NOT EXISTS (SELECT 1 FROM q r WHERE r.unit = q.unit AND r.ref = q.ref AND r.answer = 0) THEN 'warning/unknown ref' END,
  CASE WHEN coalesce(pass, '') <> '' AND pass NOT IN (SELECT pid FROM passages WHERE pid IS NOT NULL) THEN 'error/unknown passage' END, CASE WHEN kind = 'passage' AND coalesce(pass, '') = '' THEN 'error/passage question without passage' END,
  CASE WHEN track <> 'dokkai' AND coalesce(vi, '') = '' AND coalesce(kind, '') <> 'usage' THEN 'warning/no translation' END]"""


@R.add(
    "flt13_question_rules",
    f"WITH q0 AS ({_Q}), q AS (SELECT *, regexp_extract_all(q, '＿＿＿|★') AS slots, len(regexp_extract_all(q, '＿＿＿|★')) = 4 AND len(regexp_extract_all(q, '★')) = 1 AS ok FROM q0), x AS (SELECT unit, part || '[' || pos || ']' AS path, unnest(list_filter({_RULES}, lambda r: r IS NOT NULL)) AS r FROM q) "
    "SELECT unit, path, string_split(r, '/')[1] AS severity, string_split(r, '/')[2] AS rule, count(*) AS n FROM x GROUP BY ALL",
)
def question_rules(spark, d):
    """A unit's references are the types of its first answers."""
    q = questions(spark, d)
    return counted(L.question_rules(q, q.where("answer = 0").select("unit", "ref"), passages(spark, d)))


_SIZES = "sz(track, part, least) AS (VALUES " + ", ".join(f"('{t}', '{p}', {n})" for t, s in L.SIZES.items() for p, n in s.items()) + ")"


@R.add(
    "flt13_set_rules",
    f"""WITH q AS ({_Q}), {_SIZES}, u AS (SELECT DISTINCT unit, track FROM q), a AS (SELECT unit, part, answer, count(*) AS n, count_if(kind = 'order') AS o FROM q GROUP BY ALL), s AS (SELECT unit, part, sum(n) AS n, max(n) AS top, sum(o) AS o FROM a GROUP BY ALL),
    j AS (SELECT u.unit, u.track, sz.part, sz.least, coalesce(s.n, 0) AS n, s.top, coalesce(s.o, 0) AS o FROM u JOIN sz USING (track) LEFT JOIN s ON s.unit = u.unit AND s.part = sz.part)
    SELECT unit, part AS path, 'error' AS severity, 'too few questions' AS rule FROM j WHERE n < least UNION ALL SELECT unit, part, 'warning', 'answers crowd one place' FROM j WHERE n >= 8 AND top / n > 0.45
    UNION ALL SELECT unit, part, 'warning', 'no order question' FROM j WHERE track = 'bunpo' AND part IN ('practice', 'test') AND o = 0 UNION ALL SELECT unit, id, 'error', 'repeated id' FROM q GROUP BY unit, id HAVING count(*) > 1
    UNION ALL SELECT unit, pass, 'warning', 'passage in several sets' FROM q WHERE pass <> '' GROUP BY unit, pass HAVING count(DISTINCT part) > 1""",
)
def set_rules(spark, d):
    q = questions(spark, d)
    return L.set_rules(q.select("unit", "track").distinct(), q)


@R.add("flt13_text_rules", "WITH t AS (SELECT rid, CASE rid % 5 WHEN 0 THEN question || '<u>' WHEN 1 THEN question || '{漢|かん}' WHEN 2 THEN question || '{漢' WHEN 3 THEN question || '[[u:x]' ELSE question END AS t FROM raw) SELECT CAST(rid AS VARCHAR) AS unit, 'q' AS path, 'error' AS severity, unnest(list_filter([CASE WHEN regexp_matches(regexp_replace(t, '\\{[^{}|]+\\|[^{}|]+\\}', '', 'g'), '[{}|]') THEN 'ruby' END, CASE WHEN regexp_matches(t, '<[a-zA-Z/]') THEN 'tag' END, CASE WHEN length(t) - length(replace(t, '[[', '')) <> length(t) - length(replace(t, ']]', '')) THEN 'underline' END], lambda x: x IS NOT NULL)) AS rule FROM t")
def text_rules(spark, d):
    """All questions, most with something put behind them."""
    more = F.expr("CASE rid % 5 WHEN 0 THEN '<u>' WHEN 1 THEN '{漢|かん}' WHEN 2 THEN '{漢' WHEN 3 THEN '[[u:x]' ELSE '' END")
    return L.text_rules(table(spark, d, "raw").select(F.col("rid").cast("string").alias("unit"), F.lit("q").alias("path"), F.concat("question", more).alias("text")))


_U = f"u AS (SELECT unit, min(track) AS track, min(why) AS intro, min(vi) AS focus, min(pass) AS strategy, min(nullif(pass, 'x')) AS signals, CASE WHEN length(unit) > 12 THEN unit ELSE '' END AS file FROM q GROUP BY unit)"


@R.add(
    "flt13_unit_rules",
    f"""WITH q AS ({_Q}), {_U}, p AS (SELECT DISTINCT q.unit, q.pass AS pid, t.ja, t.vi FROM q JOIN (SELECT pid, min(text) AS ja, min(vi) AS vi FROM passages GROUP BY pid) t ON t.pid = q.pass WHERE q.pass <> ''),
    pt AS (SELECT unit, id, ref AS pattern, why AS meaning, vi AS structure, why AS explain, options AS ex, pass AS compare, pass AS tip FROM q WHERE track = 'bunpo'), w AS (SELECT unit, id, q AS w, options[1] AS r, why AS vi, answer = 0 AS k, CASE WHEN answer = 1 THEN options[2] END AS ja, answer = 1 AS has FROM q WHERE track = 'goi'),
    wk AS (SELECT unit, pos, why AS t FROM q WHERE track = 'dokkai'), n AS (SELECT u.*, (SELECT count(*) FROM p WHERE p.unit = u.unit) AS np, (SELECT count(*) FROM pt WHERE pt.unit = u.unit) AS npt, (SELECT count(*) FROM w WHERE w.unit = u.unit) AS nw, (SELECT count(*) FROM wk WHERE wk.unit = u.unit) AS nwk FROM u),
    x AS (SELECT unit, 'unit' AS path, unnest([CASE WHEN unit <> file THEN 'error/id is the file''s name' END, CASE WHEN track IS NULL THEN 'error/unknown track' END, CASE WHEN coalesce(intro, '') = '' THEN 'error/no intro' END, CASE WHEN track = 'bunpo' AND npt = 0 THEN 'error/no points' END, CASE WHEN track = 'goi' AND nw = 0 THEN 'error/no words' END,
      CASE WHEN track = 'goi' AND nw < 15 THEN 'warning/few words' END, CASE WHEN track = 'goi' AND coalesce(focus, '') = '' THEN 'warning/no focus' END, CASE WHEN track = 'dokkai' AND coalesce(strategy, '') = '' THEN 'error/no strategy' END, CASE WHEN track = 'dokkai' AND coalesce(signals, '') = '' THEN 'warning/no signals' END,
      CASE WHEN track = 'dokkai' AND np = 0 THEN 'error/no passages' END, CASE WHEN track = 'dokkai' AND nwk = 0 THEN 'error/no worked questions' END]) AS r FROM n
    UNION ALL SELECT unit, 'points/' || coalesce(id, '?'), unnest([CASE WHEN coalesce(id, '') = '' THEN 'error/no id' END, CASE WHEN coalesce(pattern, '') = '' THEN 'error/no pattern' END, CASE WHEN coalesce(meaning, '') = '' THEN 'error/no meaning' END, CASE WHEN coalesce(structure, '') = '' THEN 'error/no structure' END, CASE WHEN coalesce(explain, '') = '' THEN 'error/no explain' END,
      CASE WHEN coalesce(len(ex), 0) < 3 THEN 'error/few examples' END, CASE WHEN len(ex) = 3 THEN 'warning/one example more' END, CASE WHEN len(list_filter(ex, lambda e: coalesce(e, '') = '' OR length(e) <= 2)) > 0 THEN 'error/example without text or translation' END, CASE WHEN coalesce(compare, '') = '' THEN 'warning/no compare' END, CASE WHEN coalesce(tip, '') = '' THEN 'warning/no tip' END, CASE WHEN length(coalesce(explain, '')) < 150 THEN 'warning/short explanation' END]) FROM pt
    UNION ALL SELECT unit, 'passages/' || pid, unnest([CASE WHEN coalesce(ja, '') = '' THEN 'error/no ja' END, CASE WHEN coalesce(vi, '') = '' THEN 'error/no vi' END]) FROM p
    UNION ALL SELECT unit, 'words/' || coalesce(id, '?'), unnest([CASE WHEN coalesce(id, '') = '' THEN 'error/no id' END, CASE WHEN coalesce(w, '') = '' THEN 'error/no w' END, CASE WHEN coalesce(r, '') = '' THEN 'error/no r' END, CASE WHEN coalesce(vi, '') = '' THEN 'error/no vi' END, CASE WHEN coalesce(k, false) AND NOT coalesce(has, false) THEN 'error/key word without example' END,
      CASE WHEN coalesce(has, false) AND (coalesce(ja, '') = '' OR coalesce(vi, '') = '') THEN 'error/example without text or translation' END]) FROM w
    UNION ALL SELECT unit, 'words/' || coalesce(id, '?'), 'error/repeated id' FROM w GROUP BY unit, id HAVING count(*) > 1 UNION ALL SELECT unit, 'worked[' || pos || ']', 'error/no walkthrough' FROM wk WHERE coalesce(t, '') = '')
    SELECT unit, path, string_split(r, '/')[1] AS severity, string_split(r, '/')[2] AS rule, count(*) AS n FROM x WHERE r IS NOT NULL GROUP BY ALL""",
)
def unit_rules(spark, d):
    """Points, words and worked questions are made of bank rows; an option is an example, with a translation if it is long enough."""
    q = questions(spark, d)
    units = q.groupBy("unit").agg(F.min("track").alias("track"), F.min("why").alias("intro"), F.min("vi").alias("focus"), F.min("pass").alias("strategy"), F.min(F.nullif("pass", F.lit("x"))).alias("signals"))
    units = units.withColumn("file", F.when(F.length("unit") > 12, F.col("unit")).otherwise(""))
    example = lambda o: F.struct(o.alias("ja"), F.when(F.length(o) > 2, o).alias("vi"))
    points = q.where("track = 'bunpo'").select("unit", "id", F.col("ref").alias("pattern"), F.col("why").alias("meaning"), F.col("vi").alias("structure"), F.col("why").alias("explain"), F.transform("options", example).alias("examples"), F.col("pass").alias("compare"), F.col("pass").alias("tip"))
    has = F.when(F.col("answer") == 1, F.struct(F.get("options", F.lit(1)).alias("ja"), F.col("why").alias("vi")))
    words = q.where("track = 'goi'").select("unit", "id", F.col("q").alias("w"), F.get("options", F.lit(0)).alias("r"), F.col("why").alias("vi"), (F.col("answer") == 0).alias("key"), has.alias("ex"), F.lit("").alias("senses"))
    worked = q.where("track = 'dokkai'").select("unit", "pos", F.col("why").alias("walkthrough"))
    return counted(L.unit_rules(units, passages(spark, d), points, words, worked))
