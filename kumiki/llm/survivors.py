"""Best representative of each group of copies, by a latent model of how far each source can be trusted.

Each group of copies and field is an entity with one or several candidate values; each source that has a row in the group and
says something in that field either asserts a value or is silent on it. A value is judged true or not; a source asserts true
values at the rate of its sensitivity and false ones at the rate of one less its specificity. Both rates are inferred by
expectation-maximisation. The field is multi-valued: every value judged true is retained. As a row holds one value of a field,
the sensitivity is shared among the group's n worded values: silence on one of many values tells little, and as sites copy from
each other, the silent sources of a group count together as one. Empty talk is known to be false, whoever says it; from it, over
all groups that each source speaks in, the rates of false assertion are learned. A source that asserts false values as readily
as true ones tells nothing, so an assertion never lowers the odds of what is said of one group only: such a value stays above even
odds. A wording that is said of several groups may be empty talk that EMPTY_TALK doesn't list. Its assertions in all groups are
weighed together, and there those of a source that asserts false values more readily than true ones lower the odds: what only
sources full of empty talk repeat falls below even odds and counts as nothing, what one of the others says as well hardly does.

A value's likelihood depends only on which sources assert it, which are silent and whether its wording is empty talk; so the
claims are first reduced to such patterns with counts (wordings of several groups each with patterns of their own), and the
iterations run over patterns, whose number doesn't follow the rows. The rates (two for each source and field) are a table that each round joins; only their greatest change reaches the driver.
Rounds go on until no rate changes by more than SETTLED.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kumiki.llm import fold
from kumiki.llm.copies import copy_pairs
from kumiki.session import checkpointed

#: Rates have settled if none changes by more than this in a round. More than LONGEST rounds are an error.
SETTLED, LONGEST = 1e-3, 200
#: Groups of this share of the rows in groups, and this many rows, are hot: their rows are salted where values are joined.
HOT_SHARE, HOT_LEAST = 0.02, 50_000
#: Wordings of a field that say that nothing is said, as letters and digits in lower case.
EMPTY_TALK = (
    "none null nil nan na nocontent noexplanation notavailable tbd tba todo pending undefined unknown test xxx "
    "trống không khôngcó khôngrõ chưacó chưacógiảithích khôngcógiảithích đangcậpnhật cậpnhậtsau "
    "なし 無し 無 ない 説明なし 解説なし 解説無し 説明無し 解説はありません 説明はありません 準備中 未定 未記入 空欄 省略 同上"
).split()
#: Prior counts of (true asserted, true silent) and (false asserted, false silent): a source rarely asserts what is false.
SENSITIVE, SPECIFIC = (4.0, 4.0), (1.0, 99.0)
#: Prior log odds that a worded value is true.
WORDED = 5.0


def made_of(text: str, parts: list[str]) -> bool:
    """Whether a text is a sequence of `parts` and nothing else."""
    ends, at = {0}, 0
    while ends:
        at = min(ends)
        if at == len(text):
            return at > 0
        ends.remove(at)
        ends |= {at + len(x) for x in parts if text.startswith(x, at)}
    return False


def says_nothing(text: str | None) -> bool:
    """Whether a field's text is blank, without letters and digits, or wordings of EMPTY_TALK and nothing else."""
    f = fold.folded(text)
    return not f or made_of(f, EMPTY_TALK)


def _values(fields: list[str]):
    """mapInArrow: of each field in `fields` its letters and digits, a 64-bit hash of them and whether it says nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            more, names = [], []
            for f in fields:
                col = b.column(f).to_pylist()
                h, _, n = fold.hashes(col)
                empty = [not x or made_of(x, EMPTY_TALK) for x in fold.folded_many(col)]
                more += [pa.array(n, pa.int64()), pa.array(h.view(np.int64), pa.int64()), pa.array(empty, pa.bool_())]
                names += [f"n_{f}", f"h_{f}", f"e_{f}"]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, *names])

    return run


def source_quality(patterns: DataFrame, settled: float = SETTLED) -> DataFrame:
    """(field, source, sens, miss): sensitivity and rate of false assertion, by expectation-maximisation over `patterns`.

    `patterns` has field, empty (wording is empty talk), wording (0 if of one group only), n (worded values of the group), said
    and silent (arrays of sources) and cnt. Empty talk has z near 0 and, as silent, every other source that speaks in the group: all of these could have said it.
    """
    keyed = checkpointed(patterns.withColumn("key", F.struct("empty", "wording", "n", "said", "silent")))
    rates = None
    for _ in range(LONGEST):
        p = truth(keyed, rates, ["field", "key"])
        each = p.select("field", "z", "cnt", F.explode("said").alias("source"), F.lit(1).alias("x")).unionByName(
            p.select("field", "z", "cnt", F.explode("silent").alias("source"), F.lit(0).alias("x"))
        )
        new = checkpointed(
            each.groupBy("field", "source")
            .agg(F.sum(F.expr("z * cnt * x")).alias("tp"), F.sum(F.expr("z * cnt")).alias("t"), F.sum(F.expr("(1 - z) * cnt * x")).alias("fp"), F.sum(F.expr("(1 - z) * cnt")).alias("f"))
            .select(
                "field", "source",
                ((F.col("tp") + SENSITIVE[0]) / (F.col("t") + sum(SENSITIVE))).alias("sens"),
                ((F.col("fp") + SPECIFIC[0]) / (F.col("f") + sum(SPECIFIC))).alias("miss"),
            )
        )
        if rates is not None:
            old = rates.select("field", "source", F.col("sens").alias("s0"), F.col("miss").alias("m0"))
            moved = new.join(old, ["field", "source"]).agg(F.max(F.greatest(F.abs(F.col("sens") - F.col("s0")), F.abs(F.col("miss") - F.col("m0")))).alias("d")).first()["d"]
            if moved is None or moved <= settled:
                return new
        rates = new
    raise RuntimeError(f"the sources' rates did not settle in {LONGEST} rounds")


def truth(values: DataFrame, rates: DataFrame | None, key: list[str]) -> DataFrame:
    """`values` with z, the probability that a value is true, from who said it, who kept silent and its wording.

    `key` names the columns that identify a row, cnt says how many values it stands for; `rates` is what `source_quality` gives,
    None the prior rates. The rate of false assertion counts as at most that of a true one, but for a wording of several groups
    whose assertions together lower the odds: there the sum over all groups counts. No sources are collected: each row's sources
    are joined with their rates and summed again.
    """
    sens0, spec0 = SENSITIVE[0] / sum(SENSITIVE), SPECIFIC[0] / sum(SPECIFIC)
    each = values.select(*key, "n", F.explode("said").alias("source"), F.lit(True).alias("says")).unionByName(
        values.select(*key, "n", F.explode("silent").alias("source"), F.lit(False).alias("says"))
    )
    if rates is None:
        each = each.withColumns({"sens": F.lit(sens0), "miss": F.lit(spec0)})
    else:
        each = each.join(rates.withColumnRenamed("field", "rf").withColumnRenamed("source", "rs"), F.expr("field = rf AND source = rs"), "left")
    a = F.coalesce("sens", F.lit(sens0)) / F.col("n")
    b = F.least(F.coalesce("miss", F.lit(spec0)), a)
    likely = each.withColumn("l", F.when(F.col("says"), F.log(a / b)).otherwise(F.log((1 - a) / (1 - b))))
    likely = likely.withColumn("u", F.when(F.col("says"), F.log(a / F.coalesce("miss", F.lit(spec0)))))
    said, silent = F.sum(F.when(F.col("says"), F.col("l"))), F.avg(F.when(~F.col("says"), F.col("l")))
    sums = likely.groupBy(*key).agg((F.coalesce(said, F.lit(0.0)) + F.coalesce(silent, F.lit(0.0))).alias("l"), F.coalesce(F.sum("u"), F.lit(0.0)).alias("u"))
    summed = values.join(sums, key)
    doubted = summed.where("NOT empty AND wording <> 0").groupBy(F.col("field").alias("df"), F.col("wording").alias("dw")).agg(F.sum(F.expr("u * cnt")).alias("w")).where("w < 0")
    summed = summed.join(doubted, F.expr("field = df AND wording = dw"), "left")
    odds = F.when(F.col("empty"), F.lit(-30.0)).otherwise(F.lit(WORDED) + F.coalesce("w", "l"))
    return summed.withColumn("z", 1 / (1 + F.exp(-F.greatest(F.least(odds, F.lit(500.0)), F.lit(-500.0))))).drop("l", "u", "w", "df", "dw")


FIELDS = ("explanation", "transcript")


def claims_and_truth(rows: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of all groups of copies with n_, h_ and e_<field>, and (first, field, h, z, said) of each value of a group."""
    members = groups.select(F.col("rid_a").alias("first"), F.col("rid_b").alias("k")).unionByName(
        groups.select(F.col("rid_a").alias("first"), F.col("rid_a").alias("k")).distinct()
    )
    own = rows.select("rid", "source", "crawled_at", *FIELDS).join(members, F.expr("rid = k")).drop("k")
    kinds = ", ".join(f"{c} {t}" for c, t in own.dtypes)
    more = ", ".join(f"n_{f} long, h_{f} long, e_{f} boolean" for f in FIELDS)
    own = checkpointed(own.mapInArrow(_values(list(FIELDS)), f"{kinds}, {more}"))
    claims = None
    for f in FIELDS:
        c = own.where(f"n_{f} > 0").select("first", F.lit(f).alias("field"), F.col(f"h_{f}").alias("h"), F.col(f"e_{f}").alias("empty"), F.coalesce("source", F.lit("")).alias("source"))
        claims = c if claims is None else claims.unionByName(c)
    # a group has at most one entry for each source here, so the sets are bounded by the number of sources
    worded = F.expr("NOT empty")
    heard = claims.groupBy("first", "field").agg(
        F.collect_set("source").alias("all"), F.collect_set(F.when(worded, F.col("source"))).alias("worded"), F.countDistinct(F.when(worded, F.col("h"))).alias("n")
    )
    values = (
        claims.groupBy("first", "field", "h", "empty")
        .agg(F.array_sort(F.collect_set("source")).alias("said"))
        .join(heard, ["first", "field"])
        # whoever speaks in the group could have said its empty talk, but who says nothing else isn't silent on its values
        .withColumn("silent", F.array_sort(F.array_except(F.when(F.col("empty"), F.col("all")).otherwise(F.col("worded")), "said")))
        .withColumn("n", F.greatest("n", F.lit(1)))
        .drop("all", "worded")
    )
    values = checkpointed(values)
    often = values.where(worded).groupBy(F.col("field").alias("of"), F.col("h").alias("wording")).agg(F.count("*").alias("groups")).where("groups > 1").drop("groups")
    values = values.join(often, F.expr("field = of AND h = wording"), "left").drop("of").withColumns({"wording": F.coalesce("wording", F.lit(0)), "cnt": F.lit(1)})
    values = checkpointed(values)
    patterns = values.groupBy("field", "empty", "wording", "n", "said", "silent").agg(F.count("*").alias("cnt"))
    return own, checkpointed(truth(values, source_quality(patterns), ["field", "first", "h"]).select("first", "field", "h", "z", "said"))


def judged(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Every row of a group of copies with `n_<field>`, letters and digits counted only where the field's value is judged true.

    Columns: first (the group), rid, source, crawled_at, and of each field its text, n_<field> and z_<field>.
    """
    own, z = claims_and_truth(rows, groups)
    size = own.groupBy("first").agg(F.count("*").alias("n"))
    total = own.count()
    # at most 1 / HOT_SHARE groups
    hot = checkpointed(size.where(F.col("n") >= max(HOT_LEAST, int(total * HOT_SHARE))).select(F.col("first").alias("hot"), F.lit(32).alias("salts")))
    out = own.join(F.broadcast(hot), F.expr("first = hot"), "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("rid"), F.col("salts")), F.lit(0))).drop("hot", "salts")
    z = z.join(F.broadcast(hot), F.expr("first = hot"), "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts") - 1, F.lit(0)))))
    for f in FIELDS:
        true = z.where(F.col("field") == f).select(F.col("first").alias("g"), F.col("h").alias("v"), F.col("z").alias(f"z_{f}"), F.col("salt").alias("at"))
        out = out.join(true, F.expr(f"first = g AND h_{f} = v AND salt = at"), "left").drop("g", "v", "at")
        out = out.withColumn(f"n_{f}", F.when(F.col(f"z_{f}") >= 0.5, F.col(f"n_{f}")).otherwise(0))
    return out.drop("salt")


def true_values(rows: DataFrame, fields: list[str], list_fields: tuple[str, ...]) -> DataFrame:
    """(group_rid, field, rid, z, sources): every value judged true of each group and field, one row each.

    `rid` is the smallest row that carries the value, `sources` the number of sources that assert it.
    """
    own, z = claims_and_truth(rows, copy_pairs(rows, fields, list_fields))
    out = None
    for f in FIELDS:
        held = own.where(f"n_{f} > 0").groupBy(F.col("first").alias("g"), F.col(f"h_{f}").alias("v")).agg(F.min("rid").alias("rid"))
        true = z.where((F.col("field") == f) & (F.col("z") >= 0.5)).join(held, F.expr("first = g AND h = v"))
        true = true.select(F.col("first").alias("group_rid"), "field", "rid", "z", F.size("said").alias("sources"))
        out = true if out is None else out.unionByName(true)
    return out


def _ranked(rows: DataFrame, trust: DataFrame) -> DataFrame:
    t = trust.groupBy(F.col("source").alias("s")).agg(F.min("trust").alias("t"))
    known = rows.join(t, F.expr("source = s"), "left").drop("s")  # one row per source
    return known.withColumn("t", -F.coalesce("t", F.lit(2**31 - 1)).cast("long")).withColumn("at", F.coalesce("crawled_at", F.expr("timestamp_ntz'0001-01-01'")))


def best_rows(rows: DataFrame, trust: DataFrame, fields: list[str], list_fields: tuple[str, ...]) -> DataFrame:
    """(group_rid, best_rid): the row that is beaten in nothing, of each group that has one.

    Compared are what the model leaves of explanation and transcript (letters and digits), crawled_at and the trust of the
    source. The row that is greatest by these in turn is beaten in nothing if any row is; so one pass of maxima decides.
    Null dates are earliest, unknown sources least trusted; the smallest rid stands for equals.
    """
    r = _ranked(judged(rows, copy_pairs(rows, fields, list_fields)), trust)
    best = r.groupBy("first").agg(
        F.max(F.struct("n_explanation", "n_transcript", "at", "t", -F.col("rid"))).alias("b"),
        *(F.max(c).alias(f"m{i}") for i, c in enumerate(("n_explanation", "n_transcript", "at", "t"))),
    )
    whole = F.expr("b.n_explanation = m0 AND b.n_transcript = m1 AND b.at = m2 AND b.t = m3")
    return best.where(whole).select(F.col("first").alias("group_rid"), (-F.col("b.col5")).alias("best_rid"))


def fused(rows: DataFrame, trust: DataFrame, fields: list[str], list_fields: tuple[str, ...]) -> DataFrame:
    """One built record per group of copies, field by field.

    explanation and transcript: of the values judged true the most complete, then the latest, then the most trusted one (null
    where none is); sources: every source of the group, most trusted first; rows: the size of the group.
    """
    r = _ranked(judged(rows, copy_pairs(rows, fields, list_fields)), trust)
    pick = {f: F.max(F.when(F.col(f"n_{f}") > 0, F.struct(f"n_{f}", "at", "t", -F.col("rid"), f))).alias(f"b_{f}") for f in FIELDS}
    g = r.groupBy("first").agg(
        *pick.values(), F.count("*").alias("rows"), F.array_sort(F.collect_set(F.struct(-F.col("t"), F.col("source")))).alias("src")
    )
    return g.select(
        F.col("first").alias("group_rid"), *(F.col(f"b_{f}.{f}").alias(f) for f in FIELDS),
        F.transform("src", lambda x: x["source"]).alias("sources"), "rows",
    )
