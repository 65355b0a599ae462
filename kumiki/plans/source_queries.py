"""Queries of readers and writers: each writes tables to the shared folder and reads them back through the package's own readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from kumiki.operators import quality as Q
from kumiki.plans.learner_queries import LAST, ONE_CARD, one_learner
from kumiki.plans.registry import Registry
from kumiki.session import new_folder, setting, table
from kumiki.sources import readers, writers

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
RAW = ["id", "source", "source_url", "exam", "section", "mondai", "type", "passage", "passage_id", "question", "options", "answer", "explanation", "audio", "image", "transcript", "furigana", "level", "level_hint"]


def _arrays(df, names: list[str], by: str, size: int, path: str) -> None:
    """JSON arrays of about `size` rows a file, in folders by `by`."""
    parts = F.pmod(F.xxhash64(*names), F.greatest(F.lit(1), F.ceil(F.col("_n") / size))).alias("_b")
    n = df.groupBy(F.col(by).alias("_k")).agg(F.count("*").alias("_n"))
    x = df.join(n, F.expr(f"`{by}` <=> _k")).select(F.struct(*names).alias("x"), F.col(by).alias("p"), parts)
    x.groupBy("p", "_b").agg(F.to_json(F.collect_list("x")).alias("value")).write.partitionBy("p", "_b").text(path)


@R.add("src1_raw_files", "SELECT id, source, CAST(source IN ('hatobox', 'tsukiquiz') AS INT) AS b, CAST(source <> 'asagiri' AS INT) AS o, count(*) AS n FROM raw WHERE id IS NOT NULL GROUP BY ALL")
def src1(spark, d):
    """Files of reference lists and files that are no question arrays lie beside them."""
    where = new_folder(spark, "raw")
    r = table(spark, d, "raw")
    _arrays(r, RAW, "source", 500, f"{where}/questions")
    spark.createDataFrame([("no json",)], "value string").write.text(f"{where}/questions/p=broken/_b=0")
    got = readers.raw_files(spark, f"{where}/questions/*/*", ["hatobox", "tsukiquiz"], ["asagiri"])
    return got.groupBy("id", "source", F.col("rank.b").alias("b"), F.col("rank.o").alias("o")).agg(F.count("*").alias("n"))


@R.add("src2_optional_files", "SELECT 'absent' AS file, 0 AS n UNION ALL SELECT 'present', count(*) FROM aliases")
def src2(spark, d):
    where = new_folder(spark, "fixes")
    table(spark, d, "aliases").write.json(f"{where}/present")
    parts = [readers.or_empty(spark, f"{where}/{f}", "old_id string, kept_id string").agg(F.count("*").alias("n")).select(F.lit(f).alias("file"), "n") for f in ("absent", "present")]
    return parts[0].unionByName(parts[1])


def _maps(df, key: str, value, by: str, path: str) -> None:
    df.groupBy(by).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col(key), value)))).alias("value")).write.mode("append").partitionBy(by).text(path)


@R.add("src3_annotations", "WITH one AS (SELECT *, batch > 'w4' AS o FROM explain_out WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY batch, id ORDER BY oid DESC) = 1) SELECT id, arg_max({'t': trans}, (o, batch)).t AS trans, arg_max({'n': note}, (o, batch)).n AS note FROM one GROUP BY id")
def src3(spark, d):
    """Batches after w4 are in out/, which comes after the other files. A batch holds an id once."""
    where = new_folder(spark, "annotations")
    x = F.max_by(F.struct("opts", "trans", "note"), "oid")
    e = table(spark, d, "explain_out").where("id IS NOT NULL").groupBy("batch", "id").agg(x.alias("x")).withColumn("b", F.col("batch"))
    _maps(e.where("b <= 'w4'").drop("batch"), "id", F.col("x"), "b", f"{where}/root")
    _maps(e.where("b > 'w4'").drop("batch"), "id", F.col("x"), "b", f"{where}/out")
    return readers.annotations(spark, f"{where}/*/*").select("id", "trans", "note")


@R.add("src3_passage_translations", "SELECT pid, max(vi) AS vi FROM passages WHERE pid IS NOT NULL AND vi IS NOT NULL GROUP BY pid")
def src3_passages(spark, d):
    """Values are plain texts in some files and objects in others."""
    where = new_folder(spark, "translations")
    p = table(spark, d, "passages").where("pid IS NOT NULL AND vi IS NOT NULL").groupBy("pid").agg(F.max("vi").alias("vi")).withColumn("b", F.substring("pid", 1, 6))
    plain = F.contains("pid", F.lit("p1"))
    _maps(p.where(plain), "pid", F.col("vi"), "b", f"{where}/passages-a")
    _maps(p.where(~plain), "pid", F.struct("vi"), "b", f"{where}/passages-b")
    return readers.passage_translations(spark, f"{where}/*/*")


@R.add("src4_word_list", "SELECT DISTINCT word, coalesce(nullif(trim(reading), ''), word) AS reading FROM (SELECT regexp_extract(question, '＿([^＿★\\s]+)＿', 1) AS word, CASE WHEN answer = 0 THEN '' ELSE options[answer + 1] END AS reading FROM bank WHERE type = 'kanji_reading' AND answer IS NOT NULL) WHERE trim(word) <> ''")
def src4(spark, d):
    where = new_folder(spark, "words")
    b = table(spark, d, "bank").where("type = 'kanji_reading' AND answer IS NOT NULL")
    reading = F.when(F.col("answer") == 0, "").otherwise(F.get("options", F.col("answer")))
    b.select(F.regexp_extract("question", r"＿([^＿★\s]+)＿", 1).alias("word"), reading.alias("reading"), F.lit("").alias("meaning"), F.lit("N3").alias("tags")).write.option("header", True).csv(where + "/csv")
    return readers.word_list(spark, where + "/csv").select("word", "reading")


@R.add("src7_cached_answers", "WITH c AS (SELECT event_type AS url, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, min(value) AS v FROM events GROUP BY ALL) SELECT event_id, v AS value FROM events JOIN c ON url = event_type AND k = CAST(json_extract_string(props, '$.k') AS BIGINT)")
def src7(spark, d):
    """Bodies with their fields in another order have the same cached answer."""
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k")
    cache = e.select(F.col("event_type").alias("url"), F.concat(F.lit('{"lang": "vi", "k": '), k, F.lit("}")).alias("body"), F.col("value").alias("answer"))
    asked = e.select("event_id", F.col("event_type").alias("url"), F.concat(F.lit('{"k":'), k, F.lit(', "lang":"vi"}')).alias("body"))
    return readers.posted(asked, cache).select("event_id", F.col("answer").alias("value"))


@R.add("src8_pages", "WITH p AS (SELECT source, rid // 500 AS page, count(*) AS n FROM raw GROUP BY ALL), s AS (SELECT source, min(page) AS last FROM p WHERE n < 20 GROUP BY source) SELECT p.source, p.page, p.n FROM p LEFT JOIN s USING (source) WHERE last IS NULL OR page <= last")
def src8(spark, d):
    p = table(spark, d, "raw").groupBy("source", F.floor(F.col("rid") / 500).alias("page")).agg(F.count("*").alias("n"))
    return readers.until_short(p, ["source"], 20)


@R.add("src9_reachable", "WITH RECURSIVE l AS (SELECT old_id AS src, kept_id AS dst FROM aliases UNION SELECT id, passage_id FROM bank WHERE passage_id IS NOT NULL), r(node, depth) AS (SELECT DISTINCT old_id, 0 FROM aliases WHERE old_id IS NOT NULL UNION SELECT dst, depth + 1 FROM r JOIN l ON src = node WHERE depth < 6 AND dst IS NOT NULL) SELECT node, min(depth) AS depth FROM r GROUP BY node")
def src9(spark, d):
    links = table(spark, d, "aliases").toDF("src", "dst").unionByName(table(spark, d, "bank").select(F.col("id").alias("src"), F.col("passage_id").alias("dst"))).where("src IS NOT NULL AND dst IS NOT NULL").distinct()
    return readers.reachable(links, table(spark, d, "aliases").select(F.col("old_id").alias("node")).where("node IS NOT NULL"))


@R.add(
    "src10_harvest",
    "WITH e AS (SELECT CAST(date_part('day', ts) AS BIGINT) AS round, json_extract_string(props, '$.k') || event_type AS id FROM events), f AS (SELECT id, min(round) AS round FROM e GROUP BY id), n AS (SELECT r.round, count(f.id) AS new FROM (SELECT DISTINCT round FROM e) r LEFT JOIN f USING (round) GROUP BY r.round), "
    "c AS (SELECT round, sum(new) OVER (ORDER BY round) AS total, CASE WHEN row_number() OVER (ORDER BY round) >= 3 THEN sum(new) OVER (ORDER BY round ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END AS late FROM n), s AS (SELECT min(round) AS stop FROM c WHERE total >= 5000 OR late = 0) SELECT id, f.round FROM f, s WHERE stop IS NULL OR f.round <= stop",
)
def src10(spark, d):
    e = table(spark, d, "events").select(F.dayofmonth("ts").cast("long").alias("round"), F.concat(F.get_json_object("props", "$.k"), "event_type").alias("id"))
    return readers.harvested(e, 5000, 3)


@R.add("src12_bank_counts", "SELECT section, type, source, count(*) AS n, count(DISTINCT id) AS ids FROM bank WHERE section IN ('moji', 'bunpo') GROUP BY ALL")
def src12(spark, d):
    where = new_folder(spark, "bank")
    writers.bank(table(spark, d, "bank"), where + "/bank")
    return readers.bank_counts(readers.bank_sections(spark, where + "/bank", ["moji", "bunpo"]))


def _state(spark, d):
    """The state of one learner, as one row: bounded by what a learner has."""
    c = one_learner(spark, d)
    when = F.unix_millis(F.col("due").cast("timestamp"))
    card = F.struct("box", when.alias("due"), "reps", "lapses", when.alias("added"), when.alias("last"), F.lit("review").alias("reason"), F.lit(False).alias("flagged"), F.lit(0).cast("long").alias("u"))
    stat = F.struct(F.col("reps").alias("n"), (F.col("reps") - F.col("lapses")).alias("c"), when.alias("last"), F.col("lapses").alias("w"), F.lit(0).cast("long").alias("u"))
    entries = [F.map_from_entries(F.collect_list(F.struct(F.col("id").cast("string"), x))).alias(n) for n, x in (("srs", card), ("stats", stat))]
    return c.agg(*entries).select(F.lit(3).alias("version"), "srs", "stats")


@R.add("src14_import", LAST + f", {ONE_CARD} SELECT coll, CAST(id AS VARCHAR) AS id, epoch_ms(CAST(due AS TIMESTAMP)) AS t FROM cd, (VALUES ('srs'), ('stats')) c(coll)")
def src14(spark, d):
    """A learner's state is exported (SNK7) and read again (SRC13, SRC14), its collections as rows (ARR1)."""
    where = new_folder(spark, "state")
    writers.exported(_state(spark, d), "kumiki", "2024-02-01", "tablet").write.text(where + "/state")
    return readers.collections(readers.state(spark, where + "/state")).select("coll", "id", "t")


@R.add("src15_lessons", "SELECT passage_id AS id, count(*) AS items, count(DISTINCT id) AS ids FROM bank WHERE passage_id IS NOT NULL AND passage_id <> '' GROUP BY passage_id")
def src15(spark, d):
    """One lesson for each passage, written as documents and read lazily by their schema."""
    where = new_folder(spark, "lessons")
    q = F.struct("id", F.lit("").alias("pass"), F.col("question").alias("q"), "options", "answer")
    b = table(spark, d, "bank").where("passage_id IS NOT NULL AND passage_id <> ''")
    b.groupBy("passage_id").agg(F.collect_list(q).alias("quiz")).select(F.col("passage_id").alias("id"), F.lit("dokkai").alias("track"), "quiz").write.json(where + "/lessons")
    return readers.lessons(spark, where + "/lessons", lines=True).select("id", F.size("quiz").alias("items"), F.size(F.array_distinct(F.transform("quiz", lambda x: x["id"]))).alias("ids"))


PLAIN = "regexp_matches(question, '^[ぁ-ゖァ-ヺー、。（）　★＿0-9]+$')"


@R.add("src16_pages", f"SELECT question, count(*) AS n FROM raw WHERE {PLAIN} GROUP BY question")
def src16(spark, d):
    where = new_folder(spark, "pages")
    r = table(spark, d, "raw").where("question rlike '^[ぁ-ゖァ-ヺー、。（）　★＿0-9]+$'").select("question")
    with setting(spark, "spark.sql.legacy.javaCharsets", "true"):  # the CSV writer knows that encoding by it
        r.write.option("encoding", "MS932").option("quote", "").csv(where + "/pages")
    lines = readers.pages(spark, where + "/pages/*.csv", "cp932").select(F.explode(F.split("html", "\n")).alias("question")).where("question <> ''")
    return lines.groupBy("question").agg(F.count("*").alias("n"))


@R.add("snk1_used_passages", "SELECT pid, added_at FROM passages WHERE pid IN (SELECT passage_id FROM bank WHERE section IN ('dokkai', 'bunpo'))")
def snk1(spark, d):
    where = new_folder(spark, "bank")
    writers.bank(table(spark, d, "bank"), where + "/bank")
    b = readers.bank_sections(spark, where + "/bank", ["dokkai", "bunpo"])
    return writers.used_passages(b, table(spark, d, "passages")).select("pid", "added_at")


@R.add("snk2_exams", "SELECT id, name, total, official, built_at FROM exams")
def snk2(spark, d):
    where = new_folder(spark, "exams")
    e = table(spark, d, "exams")
    writers.json_lines(e, where + "/exams")
    return spark.read.schema(e.schema).json(where + "/exams").select("id", "name", "total", "official", "built_at")


FINISHED = "WITH v AS (SELECT * FROM raw WHERE answer IS NOT NULL AND len(options) BETWEEN 2 AND 4 QUALIFY row_number() OVER (PARTITION BY id ORDER BY rid) = 1)"


@R.add("snk3_finish", FINISHED + " SELECT 'section' AS dimension, section AS value, count(*) AS n FROM v GROUP BY ALL UNION ALL SELECT 'type', type, count(*) FROM v GROUP BY ALL UNION ALL SELECT 'mondai', CAST(mondai AS VARCHAR), count(*) FROM v GROUP BY ALL UNION ALL SELECT 'exam', exam, count(*) FROM v GROUP BY ALL")
def snk3(spark, d):
    r = table(spark, d, "raw").withColumn("rank", F.col("rid"))
    ok = F.coalesce(F.col("answer").isNotNull() & F.size("options").between(2, 4), F.lit(False))
    return writers.finished(r, F.when(~ok, "invalid"))[1]


@R.add("snk5_batches", "WITH b AS (SELECT DISTINCT id, section, tier FROM bank) SELECT section, tier, CAST(floor((row_number() OVER (PARTITION BY section, tier ORDER BY id) - 1) / 40) + 1 AS INT) AS batch, id FROM b")
def snk5(spark, d):
    where = new_folder(spark, "batches")
    b = table(spark, d, "bank").select("id", "section", "tier").distinct()
    writers.batches(Q.batches(b, ["section", "tier"], [F.col("id")], 40), where + "/batches")
    return spark.read.schema("id string, section string, tier string, batch int").json(where + "/batches").select("section", "tier", "batch", "id")
