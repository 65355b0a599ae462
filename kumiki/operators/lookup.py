"""JN11-JN16, FLT9-FLT11, AGG15, AGG22, TOP15-TOP19: lookups of patterns, words and characters, and catalogs built from them.

A pattern inside a text is found by an equi-join: both sides are keyed by the pattern's first two characters, so no task compares
every text with every pattern; only then is the whole pattern looked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kumiki.functions import text as T
from kumiki.operators import srs


def _heads(c: Column) -> Column:
    """The distinct pairs of neighbouring characters of a text, and its single characters for patterns of one."""
    two = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2)))
    return F.array_distinct(F.concat(two, F.split(c, "")))


def contained(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """JN11: (id, pattern) for each pattern that occurs in a text.

    `texts` has id and text, one row an id; `patterns` distinct non-empty pattern. Null texts hold nothing. Only ids go with the
    pairs of characters; the text is joined to what is left.
    """
    t = texts.where("text <> ''")
    h = t.select("id", F.explode(_heads(F.col("text"))).alias("h"))
    p = patterns.where("pattern <> ''").select("pattern", F.substring("pattern", 1, 2).alias("h"))
    return h.join(p, "h").select("id", "pattern").join(t.select("id", "text"), "id").where(F.contains("text", "pattern")).select("id", "pattern")


#: Word classes that begin a written pattern and are no part of what is looked for.
CLASSES = "V|N|Aい|Aな|い|な|普通形|ます形|て形|た形|ない形|辞書形|意向形|名詞|動詞"


def core(pattern: Column) -> Column:
    """JN11: what of a written pattern is looked for in sentences: its first variant without brackets and word classes."""
    first = F.split(F.split(pattern, "[（(]").getItem(0), r"[／/]|、|\s/\s").getItem(0)
    return F.regexp_replace(T.norm_ja(first), f"^({CLASSES})+", "")


def _all_text(items: DataFrame) -> Column:
    parts = F.concat(F.array("question"), F.coalesce("options", F.array().cast("array<string>")))
    return F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), "\n")


def related_patterns(items: DataFrame, patterns: DataFrame, most: int = 5) -> DataFrame:
    """JN11: (id, pattern, k): patterns whose core of two characters or more stands in an item's stem or options, longest core first.

    Only items of grammar and reading have any. `items` has id, section, question, options; `patterns` distinct pattern.
    """
    c = patterns.select("pattern", core(F.col("pattern")).alias("core")).where(F.length("core") >= 2)
    t = items.where(F.col("section").isin("bunpo", "dokkai")).select("id", _all_text(items).alias("text"))
    hit = contained(t, c.select(F.col("core").alias("pattern")).distinct()).withColumnRenamed("pattern", "core").join(c, "core")
    w = Window.partitionBy("id").orderBy(F.desc(F.length("core")), "pattern")
    return hit.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).select("id", "pattern", "k")


def related_words(items: DataFrame, words: DataFrame, most: int = 6) -> DataFrame:
    """JN12: (id, word, reading, k): the words an option is, by word or reading, in the order of the options; then, where these
    are fewer than `most` and the item is none of reading, words of two characters or more with kanji that stand in the stem.

    `items` has id, section, question, options; `words` has ord (the dictionary's order), word and reading.
    """
    w = words.groupBy("word", "reading").agg(F.min("ord").alias("ord"))
    keys = w.select("*", F.posexplode(F.array(T.norm_ja(F.col("word")), T.norm_ja(F.col("reading")))).alias("by", "key")).where("key <> ''")
    opt = items.select("id", F.posexplode("options").alias("pos", "o")).select("id", "pos", T.norm_ja(F.col("o")).alias("key"))
    same = opt.join(keys, "key").select("id", "word", "reading", F.struct(F.lit(0).alias("far"), "pos", "by", "ord").alias("at"))
    n = same.groupBy("id").agg(F.countDistinct("word", "reading").alias("n")).where(F.col("n") >= most).select("id")
    longer = w.select("word", "reading", "ord", T.norm_ja(F.col("word")).alias("pattern")).where((F.length("pattern") >= 2) & F.col("pattern").rlike("[一-龯]"))
    few = items.where("section <> 'dokkai'").join(n, "id", "left_anti").select("id", T.norm_ja(F.col("question")).alias("text"))
    inside = contained(few, longer.select("pattern").distinct()).join(longer, "pattern")
    inside = inside.select("id", "word", "reading", F.struct(F.lit(1).alias("far"), F.lit(0).alias("pos"), F.lit(0).alias("by"), "ord").alias("at"))
    best = same.unionByName(inside).groupBy("id", "word", "reading").agg(F.min("at").alias("at"))
    order = Window.partitionBy("id").orderBy("at", "word", "reading")
    return best.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).select("id", "word", "reading", "k")


def related_kanji(items: DataFrame, kanji: DataFrame, most: int = 10) -> DataFrame:
    """JN13: known kanji of an item's options (reading) or of stem and options (else), in the order of their first place."""
    text = F.when(F.col("section") == "dokkai", F.array_join(F.coalesce("options", F.array().cast("array<string>")), "")).otherwise(_all_text(items))
    c = items.select("id", F.posexplode(T.kanji_chars(text)).alias("pos", "kanji"))
    w = Window.partitionBy("id").orderBy("pos")
    return c.join(kanji.select("kanji"), "kanji").withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).select("id", "kanji", "k")


def kanji_words(words: DataFrame, more: DataFrame, most: int = 4) -> DataFrame:
    """JN14: (kanji, word, k): the shortest words of each kanji, topped up from a second list in its own order.

    `words` has word; `more` has ord and word. A word counts once for a kanji.
    """
    first = words.select("word", F.lit(0).alias("list"), F.length("word").cast("long").alias("o"))
    both = first.unionByName(more.where("word <> ''").select("word", F.lit(1).alias("list"), F.col("ord").cast("long").alias("o")))
    one = both.groupBy("word").agg(F.min(F.struct("list", "o")).alias("at"))
    c = one.select("word", "at", F.explode(T.kanji_chars(F.col("word"))).alias("kanji"))
    w = Window.partitionBy("kanji").orderBy("at", "word")
    return c.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).select("kanji", "word", "k")


def translated(points: DataFrame, meanings: DataFrame, examples_vi: DataFrame, fallback: DataFrame) -> DataFrame:
    """JN15: points with `meaning_vi`, their examples with translations, and the fallback's examples where a point has none.

    `points` has pattern and examples (array<string>); `meanings` pattern and vi; `examples_vi` ja and vi; `fallback` pattern and
    examples. Of several translations the least counts; an example without one has null. A point occurs once.
    """
    m = meanings.groupBy(F.col("pattern").alias("mp")).agg(F.min("vi").alias("meaning_vi"))
    f = fallback.groupBy(F.col("pattern").alias("fp")).agg(F.min("examples").alias("more"))
    p = points.where("trim(pattern) <> ''").select(F.trim("pattern").alias("pattern"), "examples")
    p = p.groupBy("pattern").agg(F.min("examples").alias("examples"))
    p = p.join(f, F.expr("pattern = fp"), "left").join(m, F.expr("pattern = mp"), "left")
    bare = F.coalesce(F.size("examples"), F.lit(0)) <= 0
    p = p.select("pattern", "meaning_vi", F.when(bare, F.col("more")).otherwise(F.col("examples")).alias("ex"), (bare & F.col("more").isNotNull()).alias("fallback"))
    e = examples_vi.groupBy("ja").agg(F.min("vi").alias("vi"))
    each = p.select("*", F.posexplode_outer("ex").alias("pos", "ja")).drop("ex").join(e, "ja", "left")
    return each.select("pattern", "meaning_vi", "fallback", "pos", "ja", "vi")


def readings(words: DataFrame) -> DataFrame:
    """AGG15: one row a word and meaning: distinct readings in order joined by a dot, the first translation there is."""
    r = words.groupBy("word", "meaning", "reading").agg(F.min("ord").alias("o"))
    joined = r.groupBy("word", "meaning").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "reading"))), lambda x: x["reading"]), "・").alias("readings"))
    first = words.groupBy("word", "meaning").agg(F.min_by("vi", F.when(F.col("vi").isNotNull(), F.col("ord"))).alias("vi"))
    return joined.join(first, ["word", "meaning"])


def by_priority(wanted: DataFrame, words: DataFrame) -> DataFrame:
    """JN16: of the entries of a word the one of the wanted reading, else the first."""
    w = words.select(F.col("word").alias("w"), F.col("reading").alias("r"), "meaning", "ord")
    j = wanted.join(w, F.expr("word = w"), "left")
    return j.groupBy("word", "reading").agg(F.min_by("meaning", F.struct((~F.coalesce(F.col("reading") == F.col("r"), F.lit(False))).cast("int"), "ord")).alias("meaning"))


def search(df: DataFrame, q: str, columns: list[str], limit: int | None = None, order: list[str] = ()) -> DataFrame:
    """FLT11: rows with the query in one of the columns, case aside; the first `limit` by `order`."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | _holds(F.lower(F.col(c)), q.lower())
    out = df.where(hit)
    return out.orderBy(*order).limit(limit) if limit else out


def _holds(c: Column, q: str) -> Column:
    return F.contains(F.coalesce(c, F.lit("")), F.lit(q))


def search_patterns(df: DataFrame, q: str) -> DataFrame:
    """FLT9: grammar: the pattern in its normal form, or a meaning, case aside. A blank query leaves all rows."""
    if not q.strip():
        return df
    n, raw = T.norm_ja(F.lit(q)), q.strip().lower()
    hit = F.contains(F.coalesce(T.norm_ja(F.col("pattern")), F.lit("")), F.lower(n))
    for c in ("meaning_vi", "meaning_en"):
        hit = hit | _holds(F.lower(F.col(c)), raw)
    return df.where(hit)


def search_words(df: DataFrame, q: str) -> DataFrame:
    """FLT9: vocabulary: word or reading as written, or a meaning, case aside."""
    if not q.strip():
        return df
    hit = _holds(F.col("word"), q.strip()) | _holds(F.col("reading"), q.strip())
    for c in ("meaning_vi", "meaning_en"):
        hit = hit | _holds(F.lower(F.col(c)), q.strip().lower())
    return df.where(hit)


def search_kanji(df: DataFrame, q: str) -> DataFrame:
    """FLT9: kanji: the sign itself, one of its readings (arrays `on` and `kun`), its name or a meaning, case aside."""
    if not q.strip():
        return df
    hit = F.coalesce(F.col("kanji") == q.strip(), F.lit(False))
    for c in ("hanviet", "meaning_vi", "meaning_en"):
        hit = hit | _holds(F.lower(F.col(c)), q.strip().lower())
    for c in ("on", "kun"):
        hit = hit | F.coalesce(F.exists(c, lambda r: F.contains(r, F.lit(q.strip()))), F.lit(False))
    return df.where(hit)


def filter_points(points: DataFrame, cards: DataFrame, query: str = "", group: str = "", status: str = "", today: Column | None = None) -> DataFrame:
    """FLT10: points of a group, of a card status ('new', 'learning', 'known') or due, that hold the query.

    `points` has id, grp, pattern, reading, meaning_vi and formula; `cards` one row an id with box, reps and due.
    """
    c = cards.select(F.col("id").alias("_id"), "box", "reps", "due")
    j = points.where(F.col("grp") == group) if group else points
    j = j.join(c, F.expr("id = _id"), "left")
    if status == "due":
        j = j.where(F.col("due") <= today)
    elif status:
        j = j.where(F.when(F.col("_id").isNull(), "new").otherwise(srs.status(F.col("reps"), F.col("box"))) == status)
    raw = query.strip().lower()
    if raw:
        hit = F.contains(F.coalesce(T.norm_ja(F.col("pattern")), F.lit("")), T.norm_ja(F.lit(query))) | _holds(F.col("reading"), raw)
        j = j.where(hit | _holds(F.lower(F.col("meaning_vi")), raw) | _holds(F.lower(F.col("formula")), raw))
    return j.drop("_id", "box", "reps", "due")


def point_rollup(pairs: DataFrame, exams: DataFrame) -> DataFrame:
    """AGG22, JN7, JN8, TOP16: of each point its items, the official ones among them, and its official exams in order.

    `pairs` has pattern and qid (distinct), `exams` qid and label of official exams (one row each).
    """
    e = exams.select(F.col("qid").alias("q"), "label")
    j = pairs.join(e, F.expr("qid = q"), "left")
    return j.groupBy("pattern").agg(
        F.countDistinct("qid").alias("n"), F.countDistinct(F.when(F.col("q").isNotNull(), F.col("qid"))).alias("official"), F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels")
    )


def examples(pairs: DataFrame, sentences: DataFrame, official: DataFrame, most: int = 6, least: int = 6) -> DataFrame:
    """TOP15: example sentences of each point: official items first, then the rest; each sentence once, `least` characters long."""
    o = official.select(F.col("qid").alias("q")).distinct().withColumn("is_official", F.lit(0))
    j = pairs.join(sentences.where(F.length("sentence") >= least), "qid").join(o, F.expr("qid = q"), "left")
    one = j.groupBy("pattern", "sentence").agg(F.min(F.struct(F.coalesce("is_official", F.lit(1)).alias("o"), "qid")).alias("x"))
    w = Window.partitionBy("pattern").orderBy("x.o", "x.qid", "sentence")
    return one.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).select("pattern", "sentence", "k")
