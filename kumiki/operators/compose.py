"""TOP5-TOP14: ranked, seeded samples of items. A draw is a number in [0, 1) from the seed and the key, so plans can be re-run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kumiki.functions.scalars import draw
from kumiki.operators import srs
from kumiki.operators.quality import numbered

#: Parts into which a type's groups are spread before they are ranked.
SHARDS = 64


def staleness(c: Column, w: Column) -> Column:
    """TOP8: unseen 0, only missed so far 1, else 2 and the right answers."""
    return F.when(c.isNull() & w.isNull(), 0).when((w > 0) & (c == 0), 1).otherwise(2 + c)


def fresh(items: DataFrame, stats: DataFrame) -> DataFrame:
    """Items with `score`; items without statistics are unseen."""
    s = stats.select(F.col("qid").alias("q"), F.col("c").alias("sc"), F.col("w").alias("sw"))
    return items.join(s, F.expr("qid = q"), "left").withColumn("score", staleness(F.col("sc"), F.col("sw"))).drop("q", "sc", "sw")


def _pooled(items: DataFrame, blueprint: DataFrame, scale: float) -> DataFrame:
    """TOP6: of each type the items of tier A, of all tiers if those are fewer than twice what is wanted; no suspect ones."""
    want = F.greatest(F.lit(1), F.floor(F.col("want") * scale + 0.5)).cast("int").alias("wanted")
    b = blueprint.where("want > 0").select(F.col("type").alias("ty"), want, F.col("passage").alias("whole"))
    p = items.where("NOT coalesce(suspect, false)").join(F.broadcast(b), F.expr("type = ty")).drop("ty")  # one row a type
    n = p.groupBy(F.col("type").alias("ty")).agg(F.count_if(F.expr("tier <> 'B'")).alias("good"))
    return p.join(F.broadcast(n), F.expr("type = ty")).where("tier <> 'B' OR good < 2 * wanted").drop("ty", "good")


def paper(items: DataFrame, stats: DataFrame, blueprint: DataFrame, seed: str, scale: float = 1.0) -> DataFrame:
    """TOP6, TOP7: a paper: of each type as many items as the blueprint wants, freshest first; passages whole.

    `items` has qid, type, tier, suspect, passage_id; `blueprint` type, want, passage. Passage groups are taken while fewer
    items than wanted are. Each type is spread over SHARDS parts, each of which keeps its best groups, so no task ranks a type.
    """
    p = fresh(_pooled(items, blueprint, scale), stats)
    p = p.withColumn("grp", F.when(F.col("whole"), F.coalesce("passage_id", "qid")).otherwise(F.col("qid")))
    g = p.groupBy("type", "wanted", "grp").agg(F.avg("score").alias("m"), F.count("*").alias("n"))
    g = g.withColumn("place", F.col("m") + draw(seed, F.col("grp")) * 0.5).withColumn("shard", F.pmod(F.xxhash64("grp"), F.lit(SHARDS)))
    shard, w = Window.partitionBy("type", "shard").orderBy("place", "grp"), Window.partitionBy("type").orderBy("place", "grp")
    few = g.withColumn("k", F.row_number().over(shard)).where("k <= wanted")  # each group has an item, so more are never needed
    best = few.withColumn("k", F.row_number().over(w)).where("k <= wanted")
    before = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = best.withColumn("before", before).where("before < wanted").select(F.col("type").alias("ty"), F.col("grp").alias("gr"), "k")
    return p.join(taken, F.expr("type = ty AND grp = gr")).select("type", "qid", "grp", "k")


def deck(points: DataFrame, cards: DataFrame, mode: str, today: Column, limit: int = 0, group: str = "", official: bool = False, seed: str = "") -> DataFrame:
    """TOP5: (id, place): one learner's deck: due (earliest first), new (no card yet; official: by exam frequency first, then by
    number of items), weak (lapses, not yet known, most lapses first), or all points in a drawn order; `limit` 0 means all.

    `points` has id, grp, n and exams (official exams); `cards` one row an id with box, due, reps, lapses. Equals go by id.
    """
    p = points.where(F.col("grp") == group) if group else points
    p = p.where("exams > 0") if official else p
    c = cards.select(F.col("id").alias("_id"), "box", "due", "lapses")
    if mode == "due":
        d, order = p.join(c, F.expr("id = _id")).where(F.col("due") <= today), [F.col("due"), F.col("id")]
    elif mode == "new":
        d, order = p.join(c, F.expr("id = _id"), "left_anti"), [*([-F.col("exams")] if official else []), -F.col("n"), F.col("id")]
    elif mode == "weak":
        d, order = p.join(c, F.expr("id = _id")).where("lapses > 0 AND box < 4"), [-F.col("lapses"), F.col("id")]
    else:
        d, order = p, [draw(seed, F.col("id").cast("string")), F.col("id")]
    if limit:
        return d.orderBy(*order).limit(limit).select("id", F.row_number().over(Window.orderBy(*order)).alias("place"))
    return numbered(d, [], order).select("id", "place")


def quiz(points: DataFrame, cards: DataFrame, scope: str, seed: str, often: int = 10) -> DataFrame:
    """TOP13: (id, kind): the points of a scope (all, weak: not known, freq: in `often` official exams or more) with the kind of
    question drawn for each: p2m, m2p, and twice as likely ex2p where the point has examples.

    `points` has id, exams and examples (their number); `cards` as in `deck`.
    """
    if scope == "weak":
        known = cards.where(srs.status(F.col("reps"), F.col("box")) == "known").select(F.col("id").alias("_id"))
        points = points.join(known, F.expr("id = _id"), "left_anti")
    elif scope == "freq":
        points = points.where(F.col("exams") >= often)
    kinds = F.when(F.col("examples") > 0, F.array(*map(F.lit, ("p2m", "m2p", "ex2p", "ex2p")))).otherwise(F.array(F.lit("p2m"), F.lit("m2p")))
    return points.select("id", F.get(kinds, F.floor(draw(seed, F.col("id").cast("string")) * F.size(kinds)).cast("int")).alias("kind"))


def drill(items: DataFrame, stats: DataFrame, seed: str, count: int, strategy: str = "mixed") -> DataFrame:
    """TOP9: `count` items without passage: unseen ones if there are enough, missed ones if there are any, or the best 3 * count."""
    p = fresh(items.where("NOT coalesce(suspect, false) AND passage_id IS NULL"), stats).join(stats.select(F.col("qid").alias("q"), "w"), F.expr("qid = q"), "left")
    if strategy == "unseen":
        u = p.where("q IS NULL")
        p = u if u.limit(min(count, 5)).count() >= min(count, 5) else p
    if strategy == "wrong":
        w = p.where("w > 0")
        p = p if w.isEmpty() else w
    if strategy == "mixed":
        p = p.withColumn("place", F.col("score") + draw(seed, F.col("qid")) * 0.5).orderBy("place", "qid").limit(3 * count)
    return p.orderBy(draw(seed + "/pick", F.col("qid")), "qid").limit(count).select("qid", "type", "score")


def passage_drill(items: DataFrame, stats: DataFrame, seed: str, count: int, no_suspects: bool = False) -> DataFrame:
    """TOP10: the items of the `count` freshest passages; suspect items stay unless `no_suspects`."""
    p = fresh(items.where("NOT coalesce(suspect, false)") if no_suspects else items, stats).where("passage_id IS NOT NULL")
    g = p.groupBy("passage_id").agg(F.avg("score").alias("m")).withColumn("place", F.col("m") + draw(seed, F.col("passage_id")) * 0.5)
    return p.join(F.broadcast(g.orderBy("place", "passage_id").limit(count).select("passage_id")), "passage_id").select("passage_id", "qid")


def distractors(points: DataFrame, seed: str, n: int = 3) -> DataFrame:
    """TOP12: for each point n other points of distinct text: those of its own group first, each in a drawn order.

    `points` has id, grp, text. Candidates are the first points of each group in its drawn order (one aggregation), not all
    pairs: a point needs at most n + 1 of a group, and n more of all points together.
    """
    one = points.groupBy("grp", "text").agg(F.min("id").alias("id"))
    one = one.withColumn("h", F.md5(F.concat(F.lit(seed + "|"), F.col("id").cast("string"))))
    g = one.withColumn("k", F.row_number().over(Window.partitionBy("grp").orderBy("h", "id"))).where(F.col("k") <= n + 1)
    all_ = one.groupBy("text").agg(F.min(F.struct("h", "id", "grp")).alias("x")).select("text", "x.*").orderBy("h", "id").limit(2 * n + 2)
    p = points.select("id", "grp", "text")
    same = p.alias("p").join(g.alias("o"), F.expr("p.grp = o.grp AND p.text <> o.text")).select("p.id", F.lit(0).alias("far"), F.col("o.text").alias("t"), F.col("o.h").alias("h"))
    few = F.broadcast(all_)  # 2 n + 2 rows
    far = p.alias("p").crossJoin(few.alias("o")).where("p.text <> o.text").select("p.id", F.lit(1).alias("far"), F.col("o.text").alias("t"), F.col("o.h").alias("h"))
    c = same.unionByName(far).groupBy("id", "t").agg(F.min(F.struct("far", "h")).alias("f"))
    return c.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("f.far", "f.h", "t"))).where(F.col("k") <= n).select("id", "k", "t")


def matching(points: DataFrame, weak: Column, seed: str, n: int = 6) -> DataFrame:
    """TOP14: n points of distinct text, weak ones first."""
    one = points.withColumn("weak", weak).groupBy("text").agg(F.min(F.struct((-F.col("weak")).alias("o"), F.col("id"))).alias("x"))
    return one.select(F.col("x.id").alias("id"), "text", F.col("x.o").alias("o")).orderBy("o", F.md5(F.concat(F.lit(seed + "|"), F.col("id").cast("string")))).limit(n).select("id", "text")
