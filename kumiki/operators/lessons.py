"""FLT13: rules of lesson documents, as tables: each broken rule is a row (unit, path, severity, rule).

A lesson is a unit of a track. Its parts come as tables: units, questions, passages, points and words; whatever a rule compares over
several rows (references, sets, repeated ids) is a join or an aggregation, never a collected document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of questions of each track, and the least number of questions of each set.
KINDS = {
    "bunpo": ["form", "order", "usage", "passage"],
    "goi": ["read", "write", "formation", "context", "paraphrase", "usage", "form", "order"],
    "dokkai": ["passage"],
}
SIZES = {
    "bunpo": {"quiz": 4, "practice": 8, "test": 5},
    "goi": {"quiz": 6, "practice": 10, "test": 8},
    "dokkai": {"quiz": 2, "practice": 4, "test": 3},
}
LEAST_EXAMPLES, SHORT_EXPLANATION, LEAST_WORDS, SKEWED_FROM, SKEW = 3, 150, 15, 8, 0.45
ERROR, WARNING = "error", "warning"


def _none(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def _broken(df: DataFrame, path: Column, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """One row for each rule whose condition holds; null conditions don't."""
    hits = F.array(*(F.when(c, F.struct(F.lit(s).alias("severity"), F.lit(r).alias("rule"))) for s, r, c in rules))
    x = F.explode(F.filter(hits, lambda h: h.isNotNull()))
    return df.select("unit", path.alias("path"), x.alias("_x")).select("unit", "path", "_x.severity", "_x.rule")


def _place() -> Column:
    return F.concat(F.col("part"), F.lit("["), F.col("pos").cast("string"), F.lit("]"))


def question_rules(questions: DataFrame, refs: DataFrame, passages: DataFrame) -> DataFrame:
    """Rules of single questions (unit, track, part, pos, id, kind, q, options, answer, order, why, vi, pass, ref).

    `refs` has unit and ref, `passages` unit and pid: what a question may refer to.
    """
    r = refs.select(F.col("unit").alias("_u"), F.col("ref").alias("_r")).distinct()
    p = passages.select(F.col("unit").alias("_v"), F.col("pid").alias("_p")).distinct()
    j = questions.join(r, F.expr("unit = _u AND ref = _r"), "left").join(p, F.expr("unit = _v AND `pass` = _p"), "left")
    o, n, a = F.col("options"), F.coalesce(F.size("options"), F.lit(0)), F.col("answer")
    known = F.lit(False)
    for track, kinds in KINDS.items():
        known = known | ((F.col("track") == track) & F.col("kind").isin(kinds))
    slots = F.regexp_extract_all("q", F.lit("＿＿＿|★"), F.lit(0))
    four = F.array_sort("order") == F.array(*map(F.lit, range(4)))
    right_slots = (F.size(slots) == 4) & (F.size(F.filter(slots, lambda x: x == "★")) == 1)
    is_order = F.col("kind") == "order"
    at_star = F.get("order", (F.array_position(slots, "★") - 1).cast("int"))
    rules = [
        *((ERROR, f"no {c}", _none(F.col(c))) for c in ("id", "kind", "q", "why")), (ERROR, "no options", n <= 0), (ERROR, "no answer", a.isNull()),
        (ERROR, "kind of another track", ~_none(F.col("kind")) & ~known), (ERROR, "four options", n != 4), (ERROR, "distinct options", F.size(F.array_distinct(o)) < n),
        (ERROR, "empty option", F.exists(o, lambda x: F.coalesce(F.trim(F.translate(x, "　\n\t", "   ")), F.lit("")) == "")), (ERROR, "answer in range", a.isNull() | (a < 0) | (a >= F.greatest(n, F.lit(1)))),
        (ERROR, "order is a permutation", is_order & ~F.coalesce(four, F.lit(False))), (ERROR, "one star and three slots", is_order & four & ~right_slots),
        (ERROR, "answer at the star", is_order & four & right_slots & ~F.coalesce(a == at_star, F.lit(False))), (WARNING, "unknown ref", ~_none(F.col("ref")) & F.col("_r").isNull()),
        (ERROR, "unknown passage", ~_none(F.col("pass")) & F.col("_p").isNull()), (ERROR, "passage question without passage", (F.col("kind") == "passage") & _none(F.col("pass"))),
        (WARNING, "no translation", (F.col("track") != "dokkai") & _none(F.col("vi")) & (F.coalesce(F.col("kind"), F.lit("")) != "usage")),
    ]
    return _broken(j, _place(), rules)


def set_rules(units: DataFrame, questions: DataFrame) -> DataFrame:
    """Rules over the questions of a unit: sizes of sets, answers that crowd one place, sets without an order question, repeated
    ids, passages used by several sets. `units` has unit and track."""
    least = units.select("unit", "track", F.explode(F.create_map(*[x for t, s in SIZES.items() for x in (F.lit(t), F.array(*(F.struct(F.lit(p).alias("part"), F.lit(n).alias("least")) for p, n in s.items())))])[F.col("track")]).alias("s"))
    per = questions.groupBy("unit", "part", "answer").agg(F.count("*").alias("n"), F.count_if(F.expr("kind = 'order'")).alias("orders"))
    per = per.groupBy(F.col("unit").alias("_u"), F.col("part").alias("_p")).agg(F.sum("n").alias("n"), F.max("n").alias("top"), F.sum("orders").alias("orders"))
    s = least.select("unit", "track", "s.part", "s.least").join(per, F.expr("unit = _u AND part = _p"), "left")
    n = F.coalesce("n", F.lit(0))
    sets = _broken(s, F.col("part"), [
        (ERROR, "too few questions", n < F.col("least")), (WARNING, "answers crowd one place", (n >= SKEWED_FROM) & (F.col("top") / n > SKEW)),
        (WARNING, "no order question", (F.col("track") == "bunpo") & F.col("part").isin("practice", "test") & (F.coalesce("orders", F.lit(0)) == 0)),
    ])
    ids = questions.groupBy("unit", "id").agg(F.count("*").alias("n"))
    crowd = questions.where(~_none(F.col("pass"))).groupBy("unit", "pass").agg(F.countDistinct("part").alias("n"))
    return sets.unionByName(_broken(ids, F.col("id"), [(ERROR, "repeated id", F.col("n") > 1)])).unionByName(_broken(crowd, F.col("pass"), [(WARNING, "passage in several sets", F.col("n") > 1)]))


def text_rules(texts: DataFrame) -> DataFrame:
    """Rules of every text (unit, path, text): ruby in its form, no tags, underlines closed."""
    rest = F.regexp_replace("text", r"\{([^{}|]+)\|([^{}|]+)\}", "")

    def count(sign: str) -> Column:
        return F.length("text") - F.length(F.replace(F.col("text"), F.lit(sign), F.lit("")))

    rules = [(ERROR, "ruby", rest.rlike(r"[{}|]")), (ERROR, "tag", F.col("text").rlike("<[a-zA-Z/]")), (ERROR, "underline", count("[[") != count("]]"))]
    return _broken(texts.where("text IS NOT NULL"), F.col("path"), rules)


def unit_rules(units: DataFrame, passages: DataFrame, points: DataFrame, words: DataFrame, worked: DataFrame) -> DataFrame:
    """Rules of units (unit, file, track, intro, focus, strategy, signals), and of what each track's units must hold.

    `passages` has unit, pid, ja, vi; `points` unit, id, pattern, meaning, structure, explain, examples (ja, vi), compare, tip; `words`
    unit, id, w, r, vi, key, ex (ja, vi), senses; `worked` unit, pos, walkthrough.
    """
    j = units
    for name, df in (("_passages", passages), ("_points", points), ("_words", words), ("_worked", worked)):
        n = df.groupBy(F.col("unit").alias(f"u{name}")).agg(F.count("*").alias(name))
        j = j.join(n, F.expr(f"unit = u{name}"), "left").withColumn(name, F.coalesce(name, F.lit(0)))
    bunpo, goi, dokkai = (F.col("track") == t for t in ("bunpo", "goi", "dokkai"))
    out = _broken(j, F.lit("unit"), [
        (ERROR, "id is the file's name", ~(F.col("unit") == F.col("file"))), (ERROR, "unknown track", ~F.coalesce(bunpo | goi | dokkai, F.lit(False))), (ERROR, "no intro", _none(F.col("intro"))),
        (ERROR, "no points", bunpo & (F.col("_points") == 0)), (ERROR, "no words", goi & (F.col("_words") == 0)), (WARNING, "few words", goi & (F.col("_words") < LEAST_WORDS)), (WARNING, "no focus", goi & _none(F.col("focus"))),
        (ERROR, "no strategy", dokkai & _none(F.col("strategy"))), (WARNING, "no signals", dokkai & _none(F.col("signals"))), (ERROR, "no passages", dokkai & (F.col("_passages") == 0)), (ERROR, "no worked questions", dokkai & (F.col("_worked") == 0)),
    ])
    bare = F.exists("examples", lambda e: _none(e["ja"]) | _none(e["vi"]))
    n = F.greatest(F.coalesce(F.size("examples"), F.lit(0)), F.lit(0))
    out = out.unionByName(_broken(points, F.concat(F.lit("points/"), F.coalesce("id", F.lit("?"))), [
        *((ERROR, f"no {c}", _none(F.col(c))) for c in ("id", "pattern", "meaning", "structure", "explain")), (ERROR, "few examples", n < LEAST_EXAMPLES), (WARNING, "one example more", n == LEAST_EXAMPLES),
        (ERROR, "example without text or translation", bare), (WARNING, "no compare", _none(F.col("compare"))), (WARNING, "no tip", _none(F.col("tip"))), (WARNING, "short explanation", F.length(F.coalesce("explain", F.lit(""))) < SHORT_EXPLANATION),
    ]))
    out = out.unionByName(_broken(passages, F.concat(F.lit("passages/"), "pid"), [(ERROR, "no ja", _none(F.col("ja"))), (ERROR, "no vi", _none(F.col("vi")))]))
    out = out.unionByName(_broken(words, F.concat(F.lit("words/"), F.coalesce("id", F.lit("?"))), [
        *((ERROR, f"no {c}", _none(F.col(c))) for c in ("id", "w", "r", "vi")), (ERROR, "key word without example", F.coalesce("key", F.lit(False)) & F.col("ex").isNull() & _none(F.col("senses"))),
        (ERROR, "example without text or translation", F.col("ex").isNotNull() & (_none(F.col("ex.ja")) | _none(F.col("ex.vi")))),
    ]))
    twice = words.groupBy("unit", "id").agg(F.count("*").alias("n"))
    out = out.unionByName(_broken(twice, F.concat(F.lit("words/"), F.coalesce("id", F.lit("?"))), [(ERROR, "repeated id", F.col("n") > 1)]))
    return out.unionByName(_broken(worked, F.concat(F.lit("worked["), F.col("pos").cast("string"), F.lit("]")), [(ERROR, "no walkthrough", _none(F.col("walkthrough")))]))
