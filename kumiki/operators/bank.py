"""From raw questions to the bank: filters, validation, keys, linkage with survivorship, exams, manifest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kumiki import dims
from kumiki.functions import text as T
from kumiki.functions.scalars import official
from kumiki.session import checkpointed

LISTEN_STEM = "（音声を聞いて答えてください）"
#: Fixed value: options that refer to the other options.
ALL_OF_ABOVE = r"^(すべて|全て|いずれも|どれも|上記)(が|は)?(正しい|可能|関連|当てはまる|間違い|すべて)"


def admitted(raw: DataFrame, excluded: list[str] = (), no_audio: list[str] = ()) -> DataFrame:
    """FLT1: without excluded sources, other levels, and listening items of sources without audio."""
    level = F.coalesce(T.strip(F.col("level")), F.lit(""))
    return raw.where(~F.col("source").isin(*excluded, "") & level.isin("", "N3", "3") & ~(F.col("source").isin(*no_audio, "") & (F.col("type") == "listening")))


def _blank(c: Column) -> Column:
    return T.strip(F.coalesce(c, F.lit(""))) == ""


def drop_reason(options: Column, answer: Column, section: Column, kind: Column, stem: Column, passage: Column, audio: Column) -> Column:
    """FLT2, FLT6: the first rule that a question breaks, else null."""
    n = F.coalesce(F.size(options), F.lit(0))
    return (
        F.when((n < 2) | (n > 4), "options")
        .when(F.exists(options, lambda o: _blank(o)), "empty option")
        .when(F.exists(options, lambda o: o.rlike(ALL_OF_ABOVE)), "all of the above")
        .when(answer.isNull() | (answer < 0) | (answer >= n), "answer")
        .when(section.isNull() | ~section.isin(*dims.SECTIONS), "section")
        .when(_blank(stem) & (section != "choukai"), "stem")
        .when(dims.needs_passage(kind) & _blank(passage), "passage")
        .when((kind == "listening") & _blank(audio), "audio")
    )


def reconciled(raw: DataFrame) -> DataFrame:
    """FLT3: unknown types become their section's default, and the type decides the section."""
    section = F.coalesce(F.col("section"), dims.section_of(F.col("type")))
    kind = F.coalesce(F.col("type"), F.lit("grammar_misc"))
    kind = F.when(dims.section_of(kind).isNotNull(), kind).otherwise(dims.chosen(section, dims.DEFAULT_TYPE))
    return raw.withColumn("type", kind).withColumn("section", F.when(section.isin(*dims.SECTIONS), dims.section_of(F.col("type"))))


def validated(raw: DataFrame, tiers: DataFrame) -> DataFrame:
    """FLT2-FLT4: every row with `reason` (null for valid ones) and the derived columns of the bank.

    `tiers` has one row a source with its tier. Null options, answers and texts count as missing.
    """
    r = reconciled(raw).join(tiers.select(F.col("source").alias("s"), F.col("tier").alias("t")), F.expr("source = s"), "left").drop("s")
    stem = T.clean_text(F.coalesce("question", F.lit("")))
    kind = T.stem_type(stem, F.col("type"))
    return r.select(
        "rid", "id", "source", "exam", "section", kind.alias("type"), F.coalesce("t", F.lit("B")).alias("tier"),
        F.coalesce(F.when(kind == F.col("type"), F.col("mondai")), dims.mondai_of(kind)).alias("mondai"),
        F.coalesce("passage_id", F.when(~_blank(F.col("passage")), F.concat(F.col("source"), F.lit(":p:"), F.substring(F.sha1("passage"), 1, 10)))).alias("passage_id"),
        F.when(stem == "", LISTEN_STEM).otherwise(T.normalize_stem(stem, F.col("type"))).alias("question"),
        F.transform("options", lambda o: T.clean_text(o)).alias("options"), "answer", T.clean_text(F.col("passage")).alias("passage"),
        F.nullif(T.clean_text(F.col("explanation")), F.lit("")).alias("explanation"), "audio", "image", F.nullif(T.clean_text(F.col("transcript")), F.lit("")).alias("transcript"), "crawled_at",
        drop_reason(F.col("options"), F.col("answer"), F.col("section"), F.col("type"), F.col("question"), F.col("passage"), F.col("audio")).alias("reason"),
    )


def suspect(note: Column) -> Column:
    """FLT5: the note doubts the answer, and not merely the label."""
    return F.coalesce(F.contains(note, F.lit("(?)")) & ~note.rlike(r"\(\?\)\s*Đề gắn nhãn"), F.lit(False))


def media_key(kind: Column, audio: Column, image: Column, transcript: Column) -> Column:
    e = F.lit("")
    has = (kind == "listening") | (F.coalesce(image, e) != "")
    return F.when(has, F.concat(F.lit("|"), F.coalesce(audio, e), F.lit("|"), F.coalesce(image, e), F.lit("|"), F.substring(F.coalesce(transcript, e), 1, 80))).otherwise("")


def with_keys(q: DataFrame) -> DataFrame:
    """DED1, DED2: `k`, the exact key (stem head, options in any order, media), and `lk`, the loose one (stem, right option, media)."""
    stem = T.norm(F.col("question"))
    options = F.split(T.norm_list(F.col("options")), "\u0001")
    media = media_key(F.col("type"), F.col("audio"), F.col("image"), F.col("transcript"))
    n = q.withColumn("_s", stem).withColumn("_o", options).withColumn("_m", media)
    return n.select(
        *q.columns,
        F.concat(F.substring("_s", 1, 160), F.lit("|"), F.array_join(F.array_sort("_o"), "|"), "_m").alias("k"),
        F.concat("_s", F.lit("|"), F.get("_o", F.col("answer")), "_m").alias("lk"),
        "_o",
    ).withColumnRenamed("_o", "norm_options")


def linked(rows: DataFrame) -> DataFrame:
    """DED3: (rank, kept, survivor): a row is kept iff no earlier kept row shares either key.

    `rows` has rank (unique, the order of preference), k and lk; rows equal in both keys are collapsed first, as only the first
    of them can be kept. The rest is decided in rounds: within each key the earliest undecided row is kept if it is earliest in
    both its keys; rows sharing a key with a kept earlier row are dropped. A round is two aggregations over the undecided keys
    with map-side combine, so a key of any size costs one row a task, and decides a row at least; only the rows it decides are written. `survivor` is the kept row of the exact key, else of the
    loose key; of a kept row it is itself. Null keys are as empty ones.
    """
    r = rows.select("rank", F.coalesce("k", F.lit("")).alias("k"), F.coalesce("lk", F.lit("")).alias("lk"))
    r = checkpointed(r.select("rank", F.xxhash64("k", F.lit(1)).alias("k1"), F.xxhash64("k", F.lit(2)).alias("k2"), F.xxhash64("lk", F.lit(1)).alias("l1"), F.xxhash64("lk", F.lit(2)).alias("l2")))
    todo = checkpointed(r.groupBy("k1", "k2", "l1", "l2").agg(F.min("rank").alias("rank")))
    cols, done = todo.columns, [todo.where("false")]
    while not todo.isEmpty():
        a = todo.groupBy("k1", "k2").agg(F.min("rank").alias("ka"))
        b = todo.groupBy("l1", "l2").agg(F.min("rank").alias("la"))
        now = checkpointed(todo.join(a, ["k1", "k2"]).join(b, ["l1", "l2"]).where("rank = ka AND rank = la").select(*cols))
        done.append(now)
        todo = todo.join(now.select("k1", "k2").distinct(), ["k1", "k2"], "left_anti")
        todo = checkpointed(todo.join(now.select("l1", "l2").distinct(), ["l1", "l2"], "left_anti").select(*cols))
        if len(done) > 32:  # so that the plan of the union stays small
            done = [checkpointed(reduce(DataFrame.unionByName, done))]
    kept = reduce(DataFrame.unionByName, done)
    by_k = kept.select("k1", "k2", F.col("rank").alias("sk"))
    by_l = kept.select("l1", "l2", F.col("rank").alias("sl"))
    out = r.join(by_k, ["k1", "k2"], "left").join(by_l, ["l1", "l2"], "left")
    # a kept row of a key may come later than a row that another key dropped; only earlier ones stand for it
    sk, sl = (F.when(F.col(c) <= F.col("rank"), F.col(c)) for c in ("sk", "sl"))
    return out.select("rank", F.coalesce(F.col("sk") == F.col("rank"), F.lit(False)).alias("kept"), F.coalesce(sk, sl).alias("survivor"))


def survivors(rows: DataFrame, links: DataFrame, annotations: DataFrame | None = None) -> DataFrame:
    """DED4: kept rows with explanation and exam from their first donor where they lack them; `donors` counts dropped rows.

    `annotations` (id, opts, trans, note, one row an id) adds `ex`: the row's own annotation, else what the first donor with one
    gives (its options only if both rows have the same normalized options in the same order), and `suspect` from that note.
    """
    dropped = links.where("NOT kept")
    lost = dropped.join(rows.select("rank", "explanation", "exam"), "rank")
    gift = lost.groupBy(F.col("survivor").alias("s")).agg(
        F.min_by("explanation", F.when(F.nullif("explanation", F.lit("")).isNotNull(), F.col("rank"))).alias("ge"),
        F.min_by("exam", F.when(F.nullif("exam", F.lit("")).isNotNull(), F.col("rank"))).alias("gx"),
        F.count("*").alias("donors"),
    )
    kept = rows.join(links.where("kept").select("rank"), "rank", "left_semi").join(gift, F.expr("rank = s"), "left")
    kept = (
        kept.withColumn("explanation", F.coalesce(F.nullif("explanation", F.lit("")), "ge"))
        .withColumn("exam", F.coalesce(F.nullif("exam", F.lit("")), "gx"))
        .withColumn("donors", F.coalesce("donors", F.lit(0)))
        .drop("s", "ge", "gx")
    )
    return kept if annotations is None else _annotated(kept, rows, dropped, annotations)


def _annotated(kept: DataFrame, rows: DataFrame, dropped: DataFrame, annotations: DataFrame) -> DataFrame:
    some = F.struct(
        F.when(F.size("opts") > 0, F.col("opts")).alias("opts"), F.nullif("trans", F.lit("")).alias("trans"), F.nullif("note", F.lit("")).alias("note")
    )
    a = annotations.select(F.col("id").alias("_a"), some.alias("_e"))
    gives = dropped.join(rows.select("rank", "id", F.col("norm_options").alias("_o")), "rank").join(a, F.expr("id = _a")).select("survivor", "rank", "_o", "_e")
    own = rows.select(F.col("rank").alias("_r"), F.col("norm_options").alias("_k"))
    gives = gives.join(own, F.expr("survivor = _r")).select(
        "survivor", "rank", F.struct(F.when(F.col("_o") == F.col("_k"), F.col("_e.opts")).alias("opts"), F.col("_e.trans").alias("trans"), F.col("_e.note").alias("note")).alias("_g")
    )
    first = gives.where("_g.opts IS NOT NULL OR _g.trans IS NOT NULL OR _g.note IS NOT NULL").groupBy(F.col("survivor").alias("_s")).agg(F.min_by("_g", "rank").alias("_g"))
    j = kept.join(a, F.expr("id = _a"), "left").join(first, F.expr("rank = _s"), "left")
    ex = F.when(F.col("_a").isNotNull(), F.col("_e")).otherwise(F.col("_g"))
    return j.withColumn("ex", ex).withColumn("suspect", suspect(F.col("ex.note"))).drop("_a", "_e", "_s", "_g")


def canonical_passages(passages: DataFrame) -> DataFrame:
    """DED5, DED6: (pid, canonical, vi): the first pid of each text's normalized head, with that pid's translation, else the first
    one of the other pids of the text.

    `passages` has rank, pid, text, vi.
    """
    h = passages.withColumn("h", F.md5(F.substring(T.norm(F.col("text")), 1, 200)))
    first = h.groupBy("h").agg(F.min_by("pid", "rank").alias("canonical"))
    told = h.where(F.nullif("vi", F.lit("")).isNotNull()).join(first, "h")
    told = told.groupBy("h").agg(F.min_by("vi", F.struct(F.col("pid") != F.col("canonical"), F.col("rank"))).alias("vi"))
    return h.select("h", "pid").distinct().join(first, "h").join(told, "h", "left").select("pid", "canonical", "vi").distinct()


def exams_of(bank: DataFrame, raw_sizes: DataFrame, sources: DataFrame, least: int = 10, share: float = 0.6) -> DataFrame:
    """AGG11, AGG12, SCL9: exams of enough items that hold enough of their raw items, with ordered item ids by section.

    `bank` has exam, source, section, mondai, id and rank; `raw_sizes` (exam, size) counts before validation. Lists of one exam
    and section are collected: they are what is asked for, and bounded by the size of an exam.
    """
    b = bank.where(F.nullif("exam", F.lit("")).isNotNull())
    order = F.struct(F.coalesce("mondai", F.lit(99)).alias("m"), T.natural(F.col("id")).alias("n"), F.col("id").alias("id"))
    parts = b.groupBy("exam", "section").agg(F.array_sort(F.collect_list(order)).alias("l"), F.max(F.struct("rank", "source")).alias("last"))
    parts = parts.select("exam", "section", F.transform("l", lambda x: x["id"]).alias("ids"), "last")
    e = parts.groupBy("exam").agg(F.map_from_entries(F.collect_list(F.struct("section", "ids"))).alias("parts"), F.sum(F.size("ids")).alias("total"), F.max("last").alias("last"))
    off = sources.select(F.col("source").alias("s"), "official")
    e = e.join(raw_sizes, "exam", "left").where((F.col("total") >= least) & (F.col("total") >= share * F.coalesce("size", "total")))
    e = e.withColumn("source", F.col("last.source")).join(off, F.expr("source = s"), "left")
    return e.select("exam", "source", "parts", "total", official(F.col("exam"), F.col("official")).alias("official"))


def manifest(bank: DataFrame) -> DataFrame:
    """AGG10, AGG18: (kind, key, n): totals and counts by section, type and source, every known section and type included."""
    by = bank.groupBy("section", "type", "source").agg(F.count("*").alias("n"))  # the rest works on this small table
    spark = bank.sparkSession
    out = by.agg(F.lit("total").alias("kind"), F.lit("").alias("key"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    t = dims.types(spark)
    for kind, known in (("section", t.select(F.col("section").alias("key")).distinct()), ("type", t.select(F.col("type").alias("key")))):
        got = by.groupBy(F.col(kind).alias("key")).agg(F.sum("n").alias("n"))
        out = out.unionByName(F.broadcast(known).join(got, "key", "left").select(F.lit(kind).alias("kind"), "key", F.coalesce("n", F.lit(0)).alias("n")))
    return out.unionByName(by.groupBy(F.col("source").alias("key")).agg(F.sum("n").alias("n")).select(F.lit("source").alias("kind"), "key", "n"))


def fixed(rows: DataFrame, fixes: DataFrame, replacements: list[tuple[str, str]] = ()) -> DataFrame:
    """JN6: rows with their manual corrections: literal replacements in stems, and options by place (`fixes`: key, fixes map)."""
    j = rows.join(fixes.select(F.col("key").alias("_k"), F.col("fixes").alias("_f")), F.expr("rid = _k"), "left")
    patched = F.transform("options", lambda x, i: F.coalesce(F.try_element_at("_f", i), x))
    return j.withColumn("question", T.replace_all(F.col("question"), list(replacements))).withColumn("options", F.when(F.col("_f").isNull(), F.col("options")).otherwise(patched)).drop("_k", "_f")
