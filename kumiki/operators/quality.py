"""Data quality and document-order operators: repeated keys, dependencies, item rules, batches, islands, carried values, rules as data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kumiki.functions import text as T
from kumiki.session import checkpointed


def repeated(df: DataFrame, key: str) -> DataFrame:
    """FLT7: keys of more than one row."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def dependency(df: DataFrame, key: str, value: str) -> DataFrame:
    """FLT7: keys with more than one value, as violations of the dependency of `value` on `key`."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.countDistinct(value).alias("texts")).where("texts > 1")


def answer_positions(df: DataFrame) -> DataFrame:
    """AGG16: answers of each type by place, with the place's share."""
    n = df.groupBy("type", "answer").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.floor(F.col("n") / F.sum("n").over(Window.partitionBy("type")) * 1000 + 0.5) / 1000)


def position_skew(items: DataFrame, by: str, least: int = 8, share: float = 0.45) -> DataFrame:
    """FLT13: sets in which one place holds too many of the right answers."""
    a = items.where(F.col(by).isNotNull() & F.col("answer").isNotNull()).groupBy(by, "answer").agg(F.count("*").alias("n"))
    return a.groupBy(by).agg(F.sum("n").alias("total"), F.max("n").alias("top")).where(f"total >= {least} AND top > {share} * total")


def item_rules(items: DataFrame) -> DataFrame:
    """FLT13: one row for each rule that an item breaks."""
    q = F.col("question")

    def count(c: str) -> Column:
        return F.length(q) - F.length(F.replace(q, F.lit(c), F.lit("")))

    def blank(c: str) -> Column:
        return F.coalesce(F.trim(c), F.lit("")) == ""

    n = F.size("options")
    rules = {
        "four options": F.coalesce(n, F.lit(0)) != 4, "distinct options": F.size(F.array_distinct("options")) < n,
        "answer in range": F.col("answer").isNull() | (F.col("answer") >= n), "question": blank("question"),
        "explanation": blank("explanation"), "ruby": count("{") != count("}"),
    }
    broken = F.filter(F.array(*(F.when(c, F.lit(r)) for r, c in rules.items())), lambda x: x.isNotNull())
    return items.select("id", F.explode(broken).alias("rule"))


def annotation_status(answers: DataFrame, bank: DataFrame) -> DataFrame:
    """FLT14, JN20: UNKNOWN item, PARTIAL, OPTIONS of another number, EMPTY OPTION, or OK."""
    b = bank.groupBy(F.col("id").alias("k")).agg(F.max(F.size("options")).alias("n"))
    blank = F.coalesce(F.trim("trans"), F.lit("")) == ""
    status = (
        F.when(F.col("k").isNull(), "UNKNOWN").when(blank, "PARTIAL").when(F.col("opts").isNotNull() & (F.size("opts") != F.col("n")), "OPTIONS")
        .when(F.exists("opts", lambda o: F.coalesce(F.trim(o), F.lit("")) == ""), "EMPTY OPTION").otherwise("OK")
    )
    return answers.join(b, F.expr("id = k"), "left").select("oid", status.alias("status"))


def blob_ok(rev: Column, blob: Column, pattern: str, most: int = 3_500_000) -> Column:
    """FLT15: a revision that is no negative number and a blob of the right shape and size."""
    return F.coalesce((rev >= 0) & blob.rlike(pattern) & (F.length(blob) <= most), F.lit(False))


def _ranged(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """`df` ranged over tasks by group and order, with `_p`, the number of each row's part, and `_o0`, `_o1`, ... the order
    (ascending; numbers are negated for the other way).

    A group of any size is cut into parts of a task's size; what goes over the parts' borders is taken from a table of parts.
    """
    names = [f"_o{i}" for i in range(len(order))]
    o = df.select("*", *(c.alias(n) for c, n in zip(order, names)))
    # partition numbers must not change between uses
    return checkpointed(o.repartitionByRange(*by, *names).withColumn("_p", F.spark_partition_id()))


def _same(by: list[str]) -> Column:
    """Rows and parts of one group; null keys are a group too."""
    return F.expr(" AND ".join([*(f"r.`{c}` <=> s.`{c}`" for c in by), "r._p = s._p"]))


def _with_parts(r: DataFrame, parts: DataFrame, by: list[str], *columns: str) -> DataFrame:
    return r.alias("r").join(parts.alias("s"), _same(by)).select("r.*", *(f"s.{c}" for c in columns))


def _earlier(by: list[str]):
    return Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)


def _orders(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("_o")]


def _placed(r: DataFrame, by: list[str]) -> DataFrame:
    n = r.groupBy(*by, "_p").agg(F.count("*").alias("_n")).withColumn("_b", F.coalesce(F.sum("_n").over(_earlier(by)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy(*by, "_p").orderBy(*_orders(r))) + F.col("_b")
    return _with_parts(r, n, by, "_b").withColumn("place", place.cast("long")).drop("_b")


def running(df: DataFrame, by: list[str], order: list[Column], value: str, name: str) -> DataFrame:
    """`df` with the sum of `value` up to each row in its group, as `name`, in two levels so that no group is summed in one task.

    The order must tell all rows of a group apart.
    """
    r = _ranged(df, by, order)
    n = r.groupBy(*by, "_p").agg(F.sum(value).alias("_n")).withColumn("_b", F.coalesce(F.sum("_n").over(_earlier(by)), F.lit(0)))
    here = F.sum(value).over(Window.partitionBy(*by, "_p").orderBy(*_orders(r)))
    return _with_parts(r, n, by, "_b").withColumn(name, here + F.col("_b")).select(*df.columns, name)


def numbered(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """`df` with `place`, 1, 2, ... in each group, in two levels so that no group is sorted in one task."""
    r = _ranged(df, by, order)
    return _placed(r, by).drop("_p", *_orders(r))


def batches(df: DataFrame, by: list[str], order: list[Column], size: int) -> DataFrame:
    """WIN5: numbers of batches of a fixed size in each group."""
    return numbered(df, by, order).withColumn("batch", (F.floor((F.col("place") - 1) / size) + 1).cast("int")).drop("place")


def passage_items(items: DataFrame, by: str, order: list[str]) -> DataFrame:
    """WIN1: runs of neighbouring items of one passage; items without a passage stand alone."""
    r = _placed(_ranged(items.select(by, "passage_id", *order), [by], [F.col(c) for c in order]), [by])
    ends = r.groupBy(by, "_p").agg(F.max_by(F.struct("passage_id"), "place").alias("_last"))
    ends = ends.withColumn("_before", F.lag("_last").over(Window.partitionBy(by).orderBy("_p")))
    w = Window.partitionBy(by, "_p").orderBy("place")
    q = _with_parts(r, ends, [by], "_before")
    previous = F.coalesce(F.lag(F.struct("passage_id")).over(w), F.col("_before"))
    q = q.withColumn("_new", (~F.coalesce(F.col("passage_id") == previous["passage_id"], F.lit(False))).cast("long"))
    runs = q.groupBy(by, "_p").agg(F.sum("_new").alias("_s")).withColumn("_b", F.coalesce(F.sum("_s").over(_earlier([by])), F.lit(0)))
    q = _with_parts(q, runs, [by], "_b").withColumn("item", F.sum("_new").over(w) + F.col("_b"))
    return q.groupBy(by, "item").agg(F.min("passage_id").alias("pid"), F.count("*").alias("n"), F.min("place").alias("pos"))


def carry_forward(df: DataFrame, by: str | list[str], order: str, value: str) -> DataFrame:
    """WIN6: the last value seen so far in each group."""
    return _carried(df, [by] if isinstance(by, str) else by, F.col(order), value)


def back_fill(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """WIN7: the next value of the group, of which a heading is part, for rows that come before it. `order` must be a number."""
    return _carried(df, by, -F.col(order), value)


def _carried(df: DataFrame, by: list[str], order: Column, value: str) -> DataFrame:
    r = _ranged(df, by, [order])
    last = r.groupBy(*by, "_p").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("_o0"))).alias("_v"))
    last = last.withColumn("_b", F.last("_v", ignorenulls=True).over(_earlier(by)))
    here = F.last(value, ignorenulls=True).over(Window.partitionBy(*by, "_p").orderBy("_o0"))
    return _with_parts(r, last, by, "_b").withColumn(value, F.coalesce(here, "_b")).select(*df.columns)


def sub_passages(items: DataFrame, by: list[str], order: str, expected: Column, passage: str) -> DataFrame:
    """WIN8: `items` with `part`, the number of the sub-passage that an item belongs to by its place in the group.

    A group of `expected` passages and a multiple of as many items gives each passage the same number of items; else all of its
    items are of part 0.
    """
    g = items.groupBy(*by).agg(F.count("*").alias("_n"), F.countDistinct(passage).alias("_t"))
    q = numbered(items, by, [F.col(order)])
    j = q.alias("q").join(g.alias("g"), F.expr(" AND ".join(f"q.`{c}` <=> g.`{c}`" for c in by))).select("q.*", "g._n", "g._t")
    fits = (expected > 1) & (F.col("_t") == expected) & (F.col("_n") % expected == 0)
    part = F.when(fits, F.floor((F.col("place") - 1) / (F.col("_n") / expected))).otherwise(0)
    return j.withColumn("part", part.cast("int")).drop("place", "_n", "_t")


def neighbours(units: DataFrame, key: str, by: list[str] = ()) -> DataFrame:
    """WIN9: previous and next unit of each group; by joins of the numbered units, so that no group is in one task."""
    n = checkpointed(numbered(units.select(*by, key), list(by), [F.col(key)]))
    at = [F.col(c) for c in by]
    before = n.select(*(c.alias(f"_{i}") for i, c in enumerate(at)), F.col(key).alias("before"), (F.col("place") + 1).alias("_at"))
    after = n.select(*(c.alias(f"_{i}") for i, c in enumerate(at)), F.col(key).alias("after"), (F.col("place") - 1).alias("_at"))
    on = F.expr(" AND ".join([*(f"`{c}` <=> _{i}" for i, c in enumerate(by)), "place = _at"]))
    mine = [*(f"_{i}" for i in range(len(at))), "_at"]
    out = n.join(before, on, "left").drop(*mine).join(after, on, "left").drop(*mine)
    return out.select(*by, key, "before", "after")


def exams_ready(exams: DataFrame, history: DataFrame, need: list[str]) -> DataFrame:
    """JN21: exams with `ready` (every needed section has items) and `done` (the exam's name is in the history's `exam`)."""
    ready = F.forall(F.array(*map(F.lit, need)), lambda s: F.coalesce(F.size(F.try_element_at("parts", s)), F.lit(0)) > 0)
    h = history.where("exam IS NOT NULL").select(F.col("exam").alias("_x")).distinct()
    return exams.join(h, F.expr("name = _x"), "left").withColumns({"ready": F.coalesce(ready, F.lit(False)), "done": F.col("_x").isNotNull()}).drop("_x")


def missing(checks: list[tuple[str, DataFrame, DataFrame]]) -> DataFrame:
    """JN22: (kind, key): distinct keys of each check's first column that its second one lacks; empty keys are no references."""
    out = None
    for kind, refs, targets in checks:
        r = refs.toDF("key").where("key <> ''").distinct()
        got = r.join(targets.toDF("_k"), F.expr("key = _k"), "left_anti").select(F.lit(kind).alias("kind"), "key")
        out = got if out is None else out.unionByName(got)
    return out


def patched(values: Column, fixes: Column) -> Column:
    """ARR3, JN6: values with those of `fixes` (map of place to value) put in."""
    return F.transform(values, lambda x, i: F.coalesce(F.try_element_at(fixes, i), x))


def keyed(text: Column) -> Column:
    """ARR6: the map of "key": number pairs in a script text."""
    keys = F.regexp_extract_all(text, F.lit('"([a-z]+)": *[0-9]+'), F.lit(1))
    values = F.regexp_extract_all(text, F.lit('"[a-z]+": *([0-9]+)'), F.lit(1))
    return F.map_from_arrays(keys, F.transform(values, lambda v: v.cast("int")))


def script_kind(options: Column) -> Column:
    """CLS7: all options kana: a reading; all with kanji: a spelling; else a meaning."""
    kana = F.size(F.filter(options, lambda o: T.is_kana(o)))
    kanji = F.size(F.filter(options, lambda o: o.rlike(T.KANJI)))
    return F.when(kana == F.size(options), "reading").when(kanji == F.size(options), "orthography").otherwise("meaning")


def aligned(reasons: Column, options: Column, answer: Column) -> Column:
    """ARR9: a reason for each option: one each, or one for each wrong option in order; other numbers of reasons fit none."""
    n = F.size(options)
    wrong = F.transform(options, lambda o, i: F.when(i != answer, F.get(reasons, F.when(i > answer, i - 1).otherwise(i))))
    none = F.transform(options, lambda o: F.lit(None).cast("string"))
    return F.when(F.size(reasons) == n, reasons).when(F.size(reasons) == n - 1, wrong).otherwise(none)
