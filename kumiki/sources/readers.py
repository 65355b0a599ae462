"""SRC1-SRC16: readers of question files, annotations, lists, cached pages, learner states and lessons.

Fetching, crawl delays and robots rules (SRC5, SRC6) are outside the engine: it reads the pages that a crawler has cached.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from kumiki import schemas
from kumiki.functions.scalars import draw
from kumiki.session import checkpointed


def raw_files(spark: SparkSession, glob: str, tier_b: list[str] = (), official: list[str] = ()) -> DataFrame:
    """SRC1: questions of all JSON array files but reference lists, with `rank`: tier A first, official first, then file and place.

    Files that are no JSON array of questions give rows without an id and are left out.
    """
    r = spark.read.schema(schemas.RAW).option("multiLine", True).option("mode", "PERMISSIVE").json(glob)
    name = F.element_at(F.split(F.col("_metadata.file_name"), "/"), -1)
    r = r.select("*", name.alias("file"), F.monotonically_increasing_id().alias("at")).where("id IS NOT NULL AND NOT startswith(file, 'ref_')")
    b, o = F.col("source").isin(*tier_b, ""), F.col("source").isin(*official, "")
    return r.withColumn("rank", F.struct(b.cast("int").alias("b"), (~o).cast("int").alias("o"), "file", "at")).drop("at")


def or_empty(spark: SparkSession, path: str, schema: str, form: str = "json", **options) -> DataFrame:
    """SRC2: the file's rows, or none if there is no file."""
    try:
        return spark.read.schema(schema).options(**options).format(form).load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def annotations(spark: SparkSession, glob: str) -> DataFrame:
    """SRC3: (id, opts, trans, note), one row an id: of several files the last by name counts, files of `out/` after the others."""
    t = spark.read.option("wholetext", True).text(glob).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", schemas.ANNOTATION).alias("m"))
    e = t.where("NOT contains(path, 'passages')").select("path", F.explode("m").alias("id", "x"))
    return e.groupBy("id").agg(F.max_by("x", F.struct(F.contains("path", F.lit("/out/")), "path")).alias("x")).select("id", "x.*")


def passage_translations(spark: SparkSession, glob: str) -> DataFrame:
    """SRC3: (pid, vi); a value may be the text or an object with vi."""
    t = spark.read.option("wholetext", True).text(glob).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", "map<string, string>").alias("m"))
    e = t.where("contains(path, 'passages')").select("path", F.explode("m").alias("pid", "v"))
    vi = F.when(F.col("v").startswith("{"), F.get_json_object("v", "$.vi")).otherwise(F.col("v"))
    return e.groupBy("pid").agg(F.max_by(vi, F.struct(F.contains("path", F.lit("/out/")), "path")).alias("vi"))


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """SRC4: words of a CSV file with header: rows with a word, the reading defaults to it, each (word, reading) once."""
    w = spark.read.csv(path, header=True, schema="word string, reading string, meaning string, tags string")
    w = w.withColumn("ord", F.monotonically_increasing_id()).where("trim(word) <> ''")
    w = w.withColumn("reading", F.coalesce(F.nullif(F.trim("reading"), F.lit("")), "word"))
    first = Window.partitionBy("word", "reading").orderBy("ord")
    return w.withColumn("k", F.row_number().over(first)).where("k = 1").drop("k")


def canonical_body(body: Column) -> Column:
    """SRC7: a JSON object with its fields in order, so that equal requests have equal texts."""
    fields = F.array_sort(F.map_entries(F.from_json(body, "map<string, string>")))
    return F.to_json(fields)


def posted(asked: DataFrame, cache: DataFrame) -> DataFrame:
    """SRC7: requests (url, body) with the cached answer of the same url and body, the least where there are several; null if none.

    `cache` has url, body and answer.
    """
    c = cache.select(F.col("url").alias("_u"), canonical_body(F.col("body")).alias("_b"), "answer").groupBy("_u", "_b").agg(F.min("answer").alias("answer"))
    return asked.withColumn("_k", canonical_body(F.col("body"))).join(c, F.expr("url = _u AND _k = _b"), "left").drop("_u", "_b", "_k")


def until_short(pages_: DataFrame, by: list[str], size: int) -> DataFrame:
    """SRC8: the pages of each list up to its first short one. `pages_` has page and n, the number of rows a page gave."""
    short = pages_.where(F.col("n") < size).groupBy(*(F.col(c).alias(f"_{c}") for c in by)).agg(F.min("page").alias("_last"))
    on = F.expr(" AND ".join(f"`{c}` <=> `_{c}`" for c in by))
    return pages_.join(short, on, "left").where("_last IS NULL OR page <= _last").drop("_last", *(f"_{c}" for c in by))


def harvested(responses: DataFrame, advertised: int, stale: int = 8) -> DataFrame:
    """SRC10: (id, round): each id with the first round that gave it, up to the round at which `stale` rounds in turn gave no new
    id, or `advertised` ids were there. `responses` has round and id; only the table of rounds is ordered."""
    first = responses.groupBy("id").agg(F.min("round").alias("round"))
    new = responses.select("round").distinct().join(first.groupBy(F.col("round").alias("_r")).agg(F.count("*").alias("new")), F.expr("round = _r"), "left")
    w = Window.orderBy("round")
    n = F.coalesce("new", F.lit(0))
    seen = new.select("round", F.sum(n).over(w).alias("total"), F.sum(n).over(w.rowsBetween(1 - stale, 0)).alias("late"), F.row_number().over(w).alias("k"))
    stop = seen.where((F.col("total") >= advertised) | ((F.col("k") >= stale) & (F.col("late") == 0))).agg(F.min("round").alias("stop"))
    return first.crossJoin(F.broadcast(stop)).where("stop IS NULL OR round <= stop").drop("stop")  # one row


def reachable(links: DataFrame, roots: DataFrame) -> DataFrame:
    """SRC9: nodes reachable over links (src, dst), with the least number of steps; a round is one join of the new nodes.

    Each round gives nodes that are new, so rounds end; only the new nodes of a round are written.
    """
    levels = [checkpointed(roots.select("node").distinct().withColumn("depth", F.lit(0)))]
    depth = 0
    while not levels[-1].isEmpty():
        new, depth = levels[-1], depth + 1
        step = links.join(new.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        for x in levels:
            step = step.join(x.select("node"), "node", "left_anti")
        levels.append(checkpointed(step.withColumn("depth", F.lit(depth))))
        if len(levels) > 16:  # so that a round's plan stays small
            levels = [checkpointed(reduce(DataFrame.unionByName, levels[:-1])), levels[-1]]
    return reduce(DataFrame.unionByName, levels)


@F.pandas_udf(StringType())
def _cp932(s: pd.Series) -> pd.Series:
    return s.map(lambda b: bytes(b).decode("cp932", "replace"), na_action="ignore")


def pages(spark: SparkSession, glob: str, encoding: str = "utf-8") -> DataFrame:
    """SRC5, SRC6, SRC16: (path, html) of cached pages; cp932 pages are decoded with replacement."""
    b = spark.read.format("binaryFile").load(glob)
    text = _cp932("content") if encoding == "cp932" else F.decode("content", encoding)
    return b.select("path", text.alias("html"))


def state(spark: SparkSession, path: str) -> DataFrame:
    """SRC13, SRC14: an exported state: it must have a version and statistics; marks of the file are dropped, collections default to
    empty ones. A file that is no such state is an error."""
    s = spark.read.schema(schemas.STATE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    ok = F.assert_true((F.coalesce("version", F.lit(0)) > 0) & F.col("stats").isNotNull(), "no exported state")
    s = s.where(ok.isNull()).drop("app", "exportedAt", "exportedFrom")
    empty = {c: F.coalesce(c, F.map_from_arrays(F.array(), F.array()).cast(s.schema[c].dataType)) for c in ("srs", "gcards", "daily", "notes", "study")}
    return s.withColumns(empty)


def collections(s: DataFrame) -> DataFrame:
    """ARR1: (coll, id, t, v): one row an entry of a state's collections, with the time of its last change."""
    zero = F.lit(0).cast("long")

    def rows(c: str, t) -> DataFrame:
        e = s.select(F.explode(c).alias("id", "x"))
        return e.select(F.lit(c).alias("coll"), "id", t(F.col("x")).alias("t"), F.to_json("x").alias("v"))

    def card(x):
        return F.coalesce(F.nullif(x["u"], zero), F.greatest(F.coalesce(x["last"], zero), F.coalesce(x["added"], zero)))

    stats = rows("stats", lambda x: F.greatest(F.coalesce(x["u"], zero), F.coalesce(x["last"], zero)))
    study = rows("study", lambda x: F.coalesce(F.nullif(x["u"], zero), x["at"], zero))
    notes = s.select(F.explode("notes").alias("id", "v"), F.col("meta.noteAt").alias("m")).select(F.lit("notes").alias("coll"), "id", F.coalesce(F.try_element_at("m", F.col("id")), zero).alias("t"), "v")
    return stats.unionByName(rows("srs", card)).unionByName(rows("gcards", card)).unionByName(study).unionByName(notes)


def lessons(spark: SparkSession, glob: str, lines: bool = False) -> DataFrame:
    """SRC15: lesson documents, a file each or (`lines`) a line each."""
    return spark.read.schema(schemas.LESSON).option("multiLine", not lines).json(glob)


def bank_sections(spark: SparkSession, path: str, sections: list[str] | None = None) -> DataFrame:
    """SRC11, SRC12: the written bank; only the partitions of the wanted sections are read."""
    b = spark.read.parquet(path)
    return b.where(F.col("section").isin(sections)) if sections else b


def bank_counts(bank: DataFrame) -> DataFrame:
    """SRC12: rows and distinct ids by section, type and source."""
    return bank.groupBy("section", "type", "source").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


def sampled(df: DataFrame, seed: str, key: str, share: float) -> DataFrame:
    """A drawn share of rows by key, the same in every run."""
    return df.where(draw(seed, F.col(key)) < share)
