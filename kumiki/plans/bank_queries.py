"""Queries of bank building: filters, validation, linkage, exams, manifest, batches and data quality."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kumiki import dims
from kumiki.functions import text as T
from kumiki.functions.markup import walked
from kumiki.operators import bank as B
from kumiki.operators import quality as Q
from kumiki.plans.nfkc import norm
from kumiki.plans.registry import Registry
from kumiki.session import table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
BLANK = r"regexp_replace(coalesce({}, ''), '^[\s\x{{3000}}\x{{a0}}]+|[\s\x{{3000}}\x{{a0}}]+$', '', 'g') = ''"
TYPES_SQL = "ty(type, section, mondai, want, passage) AS (VALUES " + ", ".join(f"('{t}', '{s}', {m or 'NULL'}, {w}, {str(p).lower()})" for t, s, m, w, p in dims.TYPES) + ")"
SECTIONS_SQL = ", ".join(f"'{s}'" for s in dims.SECTIONS)


def raw(spark, d):
    return table(spark, d, "raw")


def valid(spark, d):
    return B.validated(raw(spark, d), table(spark, d, "sources"))


def ranked(spark, d):
    """Valid rows with their rank: tier A before B, official sources first, then order of arrival."""
    s = table(spark, d, "sources").select(F.col("source").alias("so"), "official")
    v = valid(spark, d).where("reason IS NULL").join(s, F.expr("source = so"), "left")
    grade = F.when(F.col("tier") == "B", 2).otherwise(0) + F.when(F.coalesce("official", F.lit(False)), 0).otherwise(1)
    return v.withColumn("rank", F.shiftleft(grade.cast("long"), 48) + F.col("rid")).drop("so", "official")


REASON = f"""CASE WHEN coalesce(len(options), 0) < 2 OR len(options) > 4 THEN 'options'
  WHEN len(list_filter(options, lambda o: {BLANK.format('o')})) > 0 THEN 'empty option'
  WHEN len(list_filter(options, lambda o: regexp_matches(o, '{B.ALL_OF_ABOVE}'))) > 0 THEN 'all of the above'
  WHEN answer IS NULL OR answer < 0 OR answer >= len(options) THEN 'answer'
  WHEN section IS NULL OR section NOT IN ({SECTIONS_SQL}) THEN 'section'
  WHEN {BLANK.format('question')} AND section <> 'choukai' THEN 'stem'
  WHEN passage_needed AND {BLANK.format('passage')} THEN 'passage'
  WHEN type = 'listening' AND {BLANK.format('audio')} THEN 'audio' END"""
VALID = f"{TYPES_SQL}, r AS (SELECT raw.* EXCLUDE (section), coalesce(ty.section, raw.section) AS section, coalesce(ty.passage, false) AS passage_needed FROM raw LEFT JOIN ty USING (type)), v AS (SELECT *, {REASON} AS reason FROM r)"

R.add("flt1_admitted", "SELECT rid FROM raw WHERE source <> 'hatobox' AND coalesce(trim(level), '') IN ('', 'N3', '3') AND NOT (source = 'mimilab' AND type = 'listening')")(lambda spark, d: B.admitted(raw(spark, d), ["hatobox"], ["mimilab"]).select("rid"))
R.add("flt2_reasons", f"WITH {VALID} SELECT rid, section, reason FROM v")(lambda spark, d: valid(spark, d).select("rid", "section", "reason"))
R.add("agg17_drop_reasons", f"WITH {VALID} SELECT reason, count(*) AS n, min(rid) AS example FROM v WHERE reason IS NOT NULL GROUP BY reason")(
    lambda spark, d: valid(spark, d).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"), F.min("rid").alias("example"))
)
R.add("flt3_types", "SELECT rid, type, CASE WHEN type IN ('grammar_form', 'sentence_order', 'text_grammar', 'grammar_misc') THEN 'bunpo' WHEN type LIKE 'reading_%' OR type = 'info_retrieval' THEN 'dokkai' WHEN type = 'listening' THEN 'choukai' ELSE 'moji' END AS section FROM raw")(lambda spark, d: B.reconciled(raw(spark, d)).select("rid", "type", "section"))
QUERIES["flt4_derived"] = lambda spark, d: valid(spark, d).where("reason IS NULL").drop("reason")
R.add("flt5_suspect", r"SELECT oid, coalesce(contains(note, '(?)') AND NOT regexp_matches(note, '\(\?\)\s*Đề gắn nhãn'), false) AS suspect FROM explain_out")(lambda spark, d: table(spark, d, "explain_out").select("oid", B.suspect(F.col("note")).alias("suspect")))
QUERIES["ded1_keys"] = lambda spark, d: B.with_keys(ranked(spark, d)).select("rid", F.md5("k").alias("k"), F.md5("lk").alias("lk"))
QUERIES["ded3_linked"] = lambda spark, d: B.linked(B.with_keys(ranked(spark, d)))


@R.add("ded1_exact_documents", "SELECT doc_id, min(doc_id) OVER (PARTITION BY substr(lower(coalesce(text, '')), 1, 160)) AS first FROM documents")
def ded1_documents(spark, d):
    k = F.substring(F.lower(F.coalesce("text", F.lit(""))), 1, 160)
    x = table(spark, d, "documents").select("doc_id", F.md5(k).alias("k"))
    return x.join(x.groupBy("k").agg(F.min("doc_id").alias("first")), "k").select("doc_id", "first")


@R.add("win3_keep_first", "SELECT id, rid FROM raw QUALIFY row_number() OVER (PARTITION BY id ORDER BY rid) = 1")
def win3(spark, d):
    return raw(spark, d).groupBy("id").agg(F.min("rid").alias("rid"))


@R.add(
    "ded3_documents",
    "WITH x AS (SELECT doc_id, md5(substr(lower(coalesce(text, '')), 1, 160)) AS k, md5(right(lower(coalesce(text, '')), 160)) AS l FROM documents), "
    "r AS (SELECT list_reduce(list({'ks': [k], 'ls': [l], 'ids': [doc_id]} ORDER BY doc_id), lambda a, b: CASE WHEN list_contains(a.ks, b.ks[1]) OR list_contains(a.ls, b.ls[1]) THEN a "
    "ELSE {'ks': list_concat(a.ks, b.ks), 'ls': list_concat(a.ls, b.ls), 'ids': list_concat(a.ids, b.ids)} END) AS a FROM x) SELECT unnest(a.ids) AS doc_id FROM r",
)
def ded3_documents(spark, d):
    t = F.lower(F.coalesce("text", F.lit("")))
    x = table(spark, d, "documents").select(F.col("doc_id").alias("rank"), F.md5(F.substring(t, 1, 160)).alias("k"), F.md5(F.expr("right(lower(coalesce(text, '')), 160)")).alias("lk"))
    return B.linked(x).where("kept").select(F.col("rank").alias("doc_id"))


def ded4(spark, d):
    r = B.with_keys(ranked(spark, d))
    return B.survivors(r, B.linked(r), annotations(spark, d)).select("rid", "id", "explanation", "exam", "donors", "ex", "suspect")


QUERIES["ded4_survivors"] = ded4


_H = f"p AS (SELECT pid, vi, md5(substr({norm('text')}, 1, 200)) AS h, {{'a': added_at, 'p': pid}} AS r FROM passages)"


@R.add("ded5_passages", f"WITH {_H}, f AS (SELECT h, arg_min(pid, r) AS canonical FROM p GROUP BY h), t AS (SELECT h, arg_min(vi, (pid <> canonical, r)) AS vi FROM p JOIN f USING (h) WHERE vi <> '' GROUP BY h) SELECT DISTINCT pid, canonical, t.vi FROM p JOIN f USING (h) LEFT JOIN t USING (h)")
def ded5(spark, d):
    p = table(spark, d, "passages").withColumn("rank", F.struct("added_at", "pid"))
    return B.canonical_passages(p)


def answered(spark, d):
    """Raw rows with a right option, as they were crawled, with their keys; `rank` is the order of arrival."""
    r = raw(spark, d).where("size(options) BETWEEN 2 AND 4 AND answer >= 0 AND answer < size(options)").withColumn("rank", F.col("rid"))
    return B.with_keys(r)


_KEYS = (
    f"x AS (SELECT rid, id, exam, explanation, {norm('question')} AS s, list_transform(options, lambda x: {norm('x')}) AS o, answer, "
    "CASE WHEN type = 'listening' OR coalesce(image, '') <> '' THEN '|' || coalesce(audio, '') || '|' || coalesce(image, '') || '|' || substr(coalesce(transcript, ''), 1, 80) ELSE '' END AS m FROM raw WHERE len(options) BETWEEN 2 AND 4 AND answer >= 0 AND answer < len(options)), "
    "y AS (SELECT *, md5(substr(s, 1, 160) || '|' || array_to_string(list_sort(o), '|') || m) AS k, md5(s || '|' || o[answer + 1] || m) AS l FROM x)"
)
#: The linkage by its definition: one row after the other.
_LINKED = (
    f"WITH {_KEYS}, r AS (SELECT list_reduce(list({{'ks': [k], 'ls': [l], 'ids': [rid]}} ORDER BY rid), lambda a, b: CASE WHEN list_contains(a.ks, b.ks[1]) OR list_contains(a.ls, b.ls[1]) THEN a "
    "ELSE {'ks': list_concat(a.ks, b.ks), 'ls': list_concat(a.ls, b.ls), 'ids': list_concat(a.ids, b.ids)} END) AS a FROM y), kp AS (SELECT unnest(a.ids) AS rid FROM r), kk AS (SELECT y.* FROM y JOIN kp USING (rid)), "
    "ln AS (SELECT y.rid, y.rid IN (SELECT rid FROM kp) AS kept, coalesce(CASE WHEN a.rid <= y.rid THEN a.rid END, CASE WHEN b.rid <= y.rid THEN b.rid END) AS survivor FROM y LEFT JOIN kk a ON a.k = y.k LEFT JOIN kk b ON b.l = y.l)"
)
R.add("ded1_raw_keys", f"WITH {_KEYS} SELECT rid, k, l AS lk FROM y")(lambda spark, d: answered(spark, d).select("rid", F.md5("k").alias("k"), F.md5("lk").alias("lk")))
R.add("ded3_raw_linked", _LINKED + " SELECT rid AS rank, kept, survivor FROM ln")(lambda spark, d: B.linked(answered(spark, d)))


def annotations(spark, d):
    return table(spark, d, "explain_out").groupBy("id").agg(F.max_by(F.struct("opts", "trans", "note"), "oid").alias("x")).select("id", "x.*")


@R.add(
    "ded4_raw_survivors",
    _LINKED
    + r""", a AS (SELECT id, arg_max({'o': CASE WHEN len(opts) > 0 THEN opts END, 't': nullif(trans, ''), 'n': nullif(note, '')}, oid) AS e FROM explain_out GROUP BY id),
    g0 AS (SELECT ln.survivor, ln.rid, y.explanation, y.exam, a.e, y.o = sv.o AS same FROM ln JOIN y USING (rid) JOIN y sv ON sv.rid = ln.survivor LEFT JOIN a ON a.id = y.id WHERE NOT kept),
    g1 AS (SELECT *, CASE WHEN e IS NOT NULL THEN {'o': CASE WHEN same THEN e.o END, 't': e.t, 'n': e.n} END AS f FROM g0),
    g AS (SELECT survivor, count(*) AS donors, arg_min(explanation, rid) FILTER (explanation <> '') AS ge, arg_min(exam, rid) FILTER (exam <> '') AS gx, arg_min(f, rid) FILTER (f.o IS NOT NULL OR f.t IS NOT NULL OR f.n IS NOT NULL) AS f FROM g1 GROUP BY survivor)
    SELECT y.rid, coalesce(nullif(explanation, ''), ge) AS explanation, coalesce(nullif(exam, ''), gx) AS exam, coalesce(donors, 0) AS donors, ex.o AS opts, ex.t AS trans, ex.n AS note, coalesce(contains(ex.n, '(?)') AND NOT regexp_matches(ex.n, '\(\?\)\s*Đề gắn nhãn'), false) AS suspect
    FROM (SELECT y.*, g.*, CASE WHEN a.id IS NOT NULL THEN a.e ELSE g.f END AS ex FROM y JOIN kp USING (rid) LEFT JOIN g ON g.survivor = y.rid LEFT JOIN a ON a.id = y.id) y""",
)
def ded4_raw(spark, d):
    r = answered(spark, d)
    s = B.survivors(r, B.linked(r), annotations(spark, d))
    return s.select("rid", "explanation", "exam", "donors", "ex.opts", "ex.trans", "ex.note", "suspect")


@R.add(
    "agg11_exams",
    "WITH b AS (SELECT * FROM bank WHERE coalesce(exam, '') <> ''), p AS (SELECT exam, section, string_agg(id, '|' ORDER BY coalesce(mondai, 99), regexp_replace(regexp_replace(id, '([0-9]+)', '000000000000\\1', 'g'), '0*([0-9]{12})([^0-9]|$)', '\\1\\2', 'g'), id) AS ids, count(*) AS n FROM b GROUP BY ALL), "
    "l AS (SELECT exam, arg_max(source, (built_at, id, source)) AS source FROM b GROUP BY exam), s AS (SELECT exam, count(*) AS size FROM raw GROUP BY exam), t AS (SELECT exam, string_agg(section || '=' || ids, ' ' ORDER BY section) AS parts, sum(n) AS total FROM p GROUP BY exam) "
    "SELECT exam, l.source, parts, total, regexp_matches(exam, '[0-9]{4}年[0-9]+月') OR coalesce(official, false) AS official FROM t JOIN l USING (exam) LEFT JOIN s USING (exam) LEFT JOIN sources ON sources.source = l.source WHERE total >= 10 AND total >= 0.6 * coalesce(size, total)",
)
def agg11(spark, d):
    b = table(spark, d, "bank").withColumn("rank", F.struct("built_at", "id"))
    sizes = raw(spark, d).groupBy("exam").agg(F.count("*").alias("size"))
    e = B.exams_of(b, sizes, table(spark, d, "sources"))
    text = F.array_join(F.array_sort(F.transform(F.map_entries("parts"), lambda x: F.concat(x["key"], F.lit("="), F.array_join(x["value"], "|")))), " ")
    return e.select("exam", "source", text.alias("parts"), "total", "official")


R.add(
    "agg10_manifest",
    f"WITH {TYPES_SQL}, b AS (SELECT section, type, source, count(*) AS n FROM bank GROUP BY ALL) SELECT 'total' AS kind, '' AS key, coalesce(sum(n), 0) AS n FROM b UNION ALL SELECT 'section', s.section, coalesce(sum(n), 0) FROM (SELECT DISTINCT section FROM ty) s LEFT JOIN b USING (section) GROUP BY 2 UNION ALL SELECT 'type', ty.type, coalesce(sum(n), 0) FROM ty LEFT JOIN b USING (type) GROUP BY 2 UNION ALL SELECT 'source', source, sum(n) FROM b GROUP BY 2",
)(lambda spark, d: B.manifest(table(spark, d, "bank")))
R.add("agg18_coverage", "SELECT section, count(*) AS n, count_if(coalesce(explanation, '') <> '') AS explained, count_if(coalesce(audio, '') <> '') AS with_audio, count_if(coalesce(suspect, false)) AS suspects, count(DISTINCT passage_id) AS passages FROM bank GROUP BY section")(
    lambda spark, d: table(spark, d, "bank").groupBy("section").agg(F.count("*").alias("n"), F.count_if(F.coalesce("explanation", F.lit("")) != "").alias("explained"), F.count_if(F.coalesce("audio", F.lit("")) != "").alias("with_audio"), F.count_if(F.coalesce("suspect", F.lit(False))).alias("suspects"), F.countDistinct("passage_id").alias("passages"))
)
R.add("top20_sources", "SELECT source, count(*) AS n FROM bank GROUP BY source")(lambda spark, d: table(spark, d, "bank").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source"))
R.add("agg16_answer_positions", "SELECT type, answer, n, floor(n / sum(n) OVER (PARTITION BY type) * 1000 + 0.5) / 1000 AS share FROM (SELECT type, answer, count(*) AS n FROM raw GROUP BY ALL)")(lambda spark, d: Q.answer_positions(raw(spark, d)))
R.add("flt7_repeated_ids", "SELECT id, count(*) AS n FROM raw GROUP BY id HAVING count(*) > 1")(lambda spark, d: Q.repeated(raw(spark, d), "id"))
R.add("flt7_passage_texts", "SELECT passage_id, count(DISTINCT passage) AS texts FROM raw WHERE passage_id IS NOT NULL GROUP BY passage_id HAVING count(DISTINCT passage) > 1")(lambda spark, d: Q.dependency(raw(spark, d), "passage_id", "passage"))
R.add(
    "flt13_item_rules",
    "WITH b AS (SELECT id, options, answer, passage_id, question, explanation FROM bank) SELECT id, rule, count(*) AS n FROM (SELECT id, unnest(list_filter([CASE WHEN coalesce(len(options), 0) <> 4 THEN 'four options' END, CASE WHEN len(list_distinct(options)) < len(options) THEN 'distinct options' END, CASE WHEN answer IS NULL OR answer >= len(options) THEN 'answer in range' END, CASE WHEN coalesce(trim(question), '') = '' THEN 'question' END, CASE WHEN coalesce(trim(explanation), '') = '' THEN 'explanation' END, CASE WHEN (length(question) - length(replace(question, '{', ''))) <> (length(question) - length(replace(question, '}', ''))) THEN 'ruby' END], lambda x: x IS NOT NULL)) AS rule FROM b) GROUP BY ALL",
)(lambda spark, d: Q.item_rules(table(spark, d, "bank")).groupBy("id", "rule").agg(F.count("*").alias("n")))
R.add("flt13_position_skew", "WITH a AS (SELECT exam, answer, count(*) AS n FROM bank WHERE exam IS NOT NULL AND answer IS NOT NULL GROUP BY ALL), t AS (SELECT exam, sum(n) AS total, max(n) AS top FROM a GROUP BY exam) SELECT exam, total, top FROM t WHERE total >= 8 AND top > 0.45 * total")(lambda spark, d: Q.position_skew(table(spark, d, "bank"), "exam"))
R.add(
    "flt14_annotations",
    "WITH b AS (SELECT id, max(len(options)) AS n FROM bank GROUP BY id) SELECT oid, CASE WHEN b.id IS NULL THEN 'UNKNOWN' WHEN coalesce(trim(trans), '') = '' THEN 'PARTIAL' WHEN opts IS NOT NULL AND len(opts) <> n THEN 'OPTIONS' WHEN opts IS NOT NULL AND len(list_filter(opts, lambda o: coalesce(trim(o), '') = '')) > 0 THEN 'EMPTY OPTION' ELSE 'OK' END AS status FROM explain_out LEFT JOIN b USING (id)",
)(lambda spark, d: Q.annotation_status(table(spark, d, "explain_out"), table(spark, d, "bank")))
R.add("flt15_blobs", "SELECT event_id, coalesce(user_id >= 0 AND regexp_matches(props, '^\\{') AND length(props) <= 3500000, false) AS ok FROM events")(
    lambda spark, d: table(spark, d, "events").select("event_id", Q.blob_ok(F.col("user_id"), F.col("props"), r"^\{").alias("ok"))
)
R.add("jn3_passages", "WITH p AS (SELECT pid, min(text) AS text FROM passages GROUP BY pid) SELECT id, built_at, text FROM bank LEFT JOIN p ON pid = passage_id")(
    lambda spark, d: table(spark, d, "bank").join(table(spark, d, "passages").groupBy("pid").agg(F.min("text").alias("text")), F.expr("pid = passage_id"), "left").select("id", "built_at", "text")
)
R.add("jn4_explained", "WITH e AS (SELECT id, arg_max({'trans': trans, 'note': note}, oid) AS x FROM explain_out GROUP BY id) SELECT b.id, b.built_at, x.trans AS trans, x.note AS note FROM bank b LEFT JOIN e USING (id)")(
    lambda spark, d: table(spark, d, "bank").join(table(spark, d, "explain_out").groupBy("id").agg(F.max_by(F.struct("trans", "note"), "oid").alias("x")), "id", "left").select("id", "built_at", "x.trans", "x.note")
)


@R.add("jn5_aliases", "WITH b AS (SELECT DISTINCT id FROM bank), l AS (SELECT old_id, min(kept_id) AS kept FROM aliases GROUP BY old_id), q AS (SELECT DISTINCT id FROM raw) SELECT q.id, coalesce(b.id, b2.id) AS found FROM q LEFT JOIN b ON b.id = q.id LEFT JOIN l ON l.old_id = q.id LEFT JOIN b b2 ON b2.id = l.kept")
def jn5(spark, d):
    b = table(spark, d, "bank").select(F.col("id").alias("b")).distinct()
    al = table(spark, d, "aliases").groupBy(F.col("old_id").alias("o")).agg(F.min("kept_id").alias("kept"))
    q = raw(spark, d).select("id").distinct().join(b, F.expr("id = b"), "left").join(al, F.expr("id = o"), "left")
    return q.join(b.withColumnRenamed("b", "b2"), F.expr("kept = b2"), "left").select("id", F.coalesce("b", "b2").alias("found"))


R.add("jn9_to_annotate", "SELECT id, min(built_at) AS built_at FROM bank WHERE NOT EXISTS (SELECT 1 FROM explain_out e WHERE e.id = bank.id) GROUP BY id")(
    lambda spark, d: table(spark, d, "bank").join(table(spark, d, "explain_out").select("id"), "id", "left_anti").groupBy("id").agg(F.min("built_at").alias("built_at"))
)
R.add("jn10_to_translate", "SELECT DISTINCT pid FROM passages p WHERE NOT EXISTS (SELECT 1 FROM passages t WHERE t.pid = p.pid AND coalesce(trim(t.vi), '') <> '')")(
    lambda spark, d: table(spark, d, "passages").groupBy("pid").agg(F.max(F.coalesce(F.trim("vi"), F.lit("")) != "").alias("has")).where("NOT has").select("pid")
)


@R.add("win5_batches", "WITH b AS (SELECT id, section, tier, min(passage_id) AS p FROM bank GROUP BY ALL) SELECT id, section, tier, CAST(floor((row_number() OVER (PARTITION BY section, tier ORDER BY p IS NULL, CASE WHEN p IS NULL THEN id ELSE regexp_replace(id, '-[0-9]+$', '') END, id) - 1) / 40) + 1 AS INT) AS batch FROM b")
def win5(spark, d):
    b = table(spark, d, "bank").groupBy("id", "section", "tier").agg(F.min("passage_id").alias("p"))
    return Q.batches(b, ["section", "tier"], [F.col("p").isNull(), F.when(F.col("p").isNull(), F.col("id")).otherwise(F.regexp_replace("id", "-[0-9]+$", "")), F.col("id")], 40).select("id", "section", "tier", "batch")


@R.add("win1_passage_items", "WITH q AS (SELECT exam, id, passage_id AS pid, row_number() OVER (PARTITION BY exam ORDER BY built_at, id, question) AS pos FROM bank WHERE exam IS NOT NULL), f AS (SELECT *, CASE WHEN pid IS NOT NULL AND pid = lag(pid) OVER (PARTITION BY exam ORDER BY pos) THEN 0 ELSE 1 END AS s FROM q), g AS (SELECT *, sum(s) OVER (PARTITION BY exam ORDER BY pos) AS item FROM f) SELECT exam, CAST(item AS BIGINT) AS item, min(pid) AS pid, count(*) AS n, min(pos) AS pos FROM g GROUP BY exam, item")
def win1(spark, d):
    return Q.passage_items(table(spark, d, "bank").where("exam IS NOT NULL"), "exam", ["built_at", "id", "question"])


R.add("win6_carry_forward", "SELECT rid, last_value(mondai IGNORE NULLS) OVER (PARTITION BY source ORDER BY rid) AS mondai FROM raw")(
    lambda spark, d: Q.carry_forward(raw(spark, d), "source", "rid", "mondai").select("rid", "mondai")
)
R.add("win7_back_fill", "SELECT rid, first_value(passage_id IGNORE NULLS) OVER (PARTITION BY source, exam, section, mondai ORDER BY rid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS passage_id FROM raw WHERE exam IS NOT NULL")(
    lambda spark, d: Q.back_fill(raw(spark, d).where("exam IS NOT NULL").select("rid", "source", "exam", "section", "mondai", "passage_id"), ["source", "exam", "section", "mondai"], "rid", "passage_id").select("rid", "passage_id")
)
R.add("win8_positions", "WITH q AS (SELECT rid, exam, mondai, passage, CASE mondai WHEN 4 THEN 4 WHEN 5 THEN 2 ELSE 1 END AS e FROM raw WHERE exam IS NOT NULL AND section = 'dokkai'), g AS (SELECT exam, mondai, count(*) AS n, count(DISTINCT passage) AS t FROM q GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY exam, mondai ORDER BY rid) - 1 AS i FROM q) SELECT rid, CAST(CASE WHEN e > 1 AND t = e AND n % e = 0 THEN i // (n // e) ELSE 0 END AS INT) AS part FROM p JOIN g ON p.exam = g.exam AND p.mondai IS NOT DISTINCT FROM g.mondai")(
    lambda spark, d: Q.sub_passages(raw(spark, d).where("exam IS NOT NULL AND section = 'dokkai'").select("rid", "exam", "mondai", "passage"), ["exam", "mondai"], "rid", F.when(F.col("mondai") == 4, 4).when(F.col("mondai") == 5, 2).otherwise(1), "passage").select("rid", "part")
)
R.add("win9_neighbours", "SELECT subject, lag(subject) OVER (ORDER BY subject) AS before, lead(subject) OVER (ORDER BY subject) AS after FROM subjects")(
    lambda spark, d: Q.neighbours(table(spark, d, "subjects"), "subject")
)
R.add("jn21_exams_ready", "SELECT id, built_at, len(list_filter(['moji', 'bunpo'], lambda s: coalesce(len(parts[s]), 0) = 0)) = 0 AS ready, coalesce(name IN (SELECT exam FROM raw WHERE exam IS NOT NULL), false) AS done FROM exams")(
    # exams of which there are crawled rows play the part of those in the learner's history
    lambda spark, d: Q.exams_ready(table(spark, d, "exams"), raw(spark, d).select("exam"), ["moji", "bunpo"]).select("id", "built_at", "ready", "done")
)
R.add("jn22_references", "SELECT DISTINCT 'source' AS kind, source AS key FROM documents WHERE source IS NOT NULL AND source NOT IN (SELECT source FROM sources) UNION ALL SELECT DISTINCT 'pass', passage_id FROM bank WHERE passage_id <> '' AND passage_id NOT IN (SELECT pid FROM passages WHERE pid IS NOT NULL) UNION ALL SELECT DISTINCT 'ref', kept_id FROM aliases WHERE kept_id <> '' AND kept_id NOT IN (SELECT id FROM bank WHERE id IS NOT NULL)")(
    lambda spark, d: Q.missing([
        ("source", table(spark, d, "documents").select("source"), table(spark, d, "sources").select("source")),
        ("pass", table(spark, d, "bank").select("passage_id"), table(spark, d, "passages").select("pid")),
        ("ref", table(spark, d, "aliases").select("kept_id"), table(spark, d, "bank").select("id")),
    ])
)
R.add("jn23_answer_cardinality", "SELECT rid, len(list_filter(options, lambda o: o = options[answer + 1])) = 1 AS single FROM raw WHERE answer IS NOT NULL")(
    lambda spark, d: raw(spark, d).where("answer IS NOT NULL").select("rid", (F.size(F.filter("options", lambda o: o == F.get("options", F.col("answer")))) == 1).alias("single"))
)
R.add("arr1_parts", "SELECT id, built_at, unnest(map_keys(parts)) AS section, unnest(map_values(parts)) AS ids FROM exams".replace("unnest(map_values(parts)) AS ids", "len(unnest(map_values(parts))) AS n"))(
    lambda spark, d: table(spark, d, "exams").select("id", "built_at", F.explode("parts").alias("section", "ids")).select("id", "built_at", "section", F.size("ids").alias("n"))
)
R.add("arr2_inverted", "WITH x AS (SELECT id AS exam, unnest(ids) AS qid FROM (SELECT id, unnest(map_values(parts)) AS ids FROM exams)) SELECT qid, string_agg(DISTINCT exam, '|' ORDER BY exam) AS exams FROM x WHERE qid IS NOT NULL GROUP BY qid")(
    lambda spark, d: table(spark, d, "exams").select(F.col("id").alias("exam"), F.explode("parts").alias("s", "ids")).select("exam", F.explode("ids").alias("qid")).where("qid IS NOT NULL").groupBy("qid").agg(F.nullif(F.array_join(F.sort_array(F.collect_set("exam")), "|"), F.lit("")).alias("exams"))
)
R.add("arr3_patched", "SELECT rid, list_transform(options, lambda x, i: CASE WHEN i = 2 THEN 'patched' ELSE x END) AS options FROM raw")(
    lambda spark, d: raw(spark, d).select("rid", Q.patched(F.col("options"), F.create_map(F.lit(1), F.lit("patched"))).alias("options"))
)
R.add("arr6_keyed_answers", "SELECT event_id, regexp_extract_all(props, '\"([a-z]+)\": *[0-9]+', 1) AS keys, list_transform(regexp_extract_all(props, '\"[a-z]+\": *([0-9]+)', 1), lambda x: CAST(x AS INT)) AS vals FROM events")(
    lambda spark, d: table(spark, d, "events").select("event_id", Q.keyed(F.col("props")).alias("m")).select("event_id", F.map_keys("m").alias("keys"), F.map_values("m").alias("vals"))
)
R.add("arr8_flattened", "SELECT oid, concat_ws(chr(10), nullif(trans, ''), nullif(note, ''), array_to_string(opts, chr(10))) AS v FROM explain_out")(
    lambda spark, d: table(spark, d, "explain_out").select("oid", F.concat_ws("\n", F.nullif("trans", F.lit("")), F.nullif("note", F.lit("")), F.when(F.col("opts").isNotNull(), F.array_join("opts", "\n"))).alias("v"))
)
R.add("set1_union", "SELECT source, count(*) AS n FROM (SELECT source FROM raw UNION ALL SELECT source FROM bank UNION ALL SELECT source FROM passages) GROUP BY source")(
    lambda spark, d: raw(spark, d).select("source").unionByName(table(spark, d, "bank").select("source"), allowMissingColumns=True).unionByName(table(spark, d, "passages").select("source"), allowMissingColumns=True).groupBy("source").agg(F.count("*").alias("n"))
)
R.add("set3_difference", "SELECT id FROM raw EXCEPT SELECT id FROM bank")(lambda spark, d: raw(spark, d).select("id").distinct().join(table(spark, d, "bank").select("id"), "id", "left_anti"))
R.add("cls7_script_mix", "SELECT rid, CASE WHEN k = len(options) THEN 'reading' WHEN h = len(options) THEN 'orthography' ELSE 'meaning' END AS kind FROM (SELECT rid, options, len(list_filter(options, lambda o: regexp_matches(o, '^[ぁ-ゖァ-ヺー・　 ]+\\n?$'))) AS k, len(list_filter(options, lambda o: regexp_matches(o, '[一-龯㐀-䶿]'))) AS h FROM raw)")(
    lambda spark, d: raw(spark, d).select("rid", Q.script_kind(F.col("options")).alias("kind"))
)
R.add("txt10_is_kana", "SELECT rid, regexp_matches(question, '^[ぁ-ゖァ-ヺー・　 ]+\\n?$') AS v FROM raw")(lambda spark, d: raw(spark, d).select("rid", T.is_kana(F.col("question")).alias("v")))
R.add("arr7_paths", "SELECT event_id, '$.k' AS path, json_extract_string(props, '$.k') AS text FROM events")(
    lambda spark, d: table(spark, d, "events").select("event_id", F.explode(walked("props")).alias("x")).select("event_id", "x.path", "x.text")
)
R.add("arr9_reasons", "SELECT rid, CASE WHEN answer IS NULL THEN list_transform(options, lambda o: NULL) ELSE list_transform(options, lambda o, i: CASE WHEN i - 1 <> answer THEN options[1:len(options) - 1][CASE WHEN i - 1 > answer THEN i - 1 ELSE i END] END) END AS reasons FROM raw WHERE answer IS NOT NULL")(
    lambda spark, d: raw(spark, d).where("answer IS NOT NULL").select("rid", Q.aligned(F.slice("options", F.lit(1), F.size("options") - 1), F.col("options"), F.col("answer")).alias("reasons"))
)
R.add("jn6_fixed", "SELECT rid, replace(question, '下線', '＿') AS question, list_transform(options, lambda x, i: CASE WHEN i = 1 AND source = 'asagiri' THEN upper(x) ELSE x END) AS options FROM raw")(
    lambda spark, d: B.fixed(raw(spark, d), raw(spark, d).where("source = 'asagiri'").select(F.col("rid").alias("key"), F.create_map(F.lit(0), F.upper(F.get("options", F.lit(0)))).alias("fixes")), [("下線", "＿")]).select("rid", "question", "options")
)
