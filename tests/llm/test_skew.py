"""Hot groups: one key holds a third of the rows or more; results stay whole."""

import random

from pyspark.sql import functions as F

from kumiki.llm import copies, neardup


def test_a_third_of_the_rows_are_copies(spark):
    hot = spark.range(3000).select(F.col("id").alias("rid"), F.concat(F.lit("the same text "), F.repeat(F.lit(" "), (F.col("id") % 7).cast("int"))).alias("question"))
    cold = spark.range(3000, 9000).select(F.col("id").alias("rid"), F.concat(F.lit("text number "), F.col("id").cast("string")).alias("question"))
    got = copies.copy_pairs(hot.unionByName(cold), ["question"], hot_least=100)
    assert got.count() == 2999 and got.agg(F.min("rid_a"), F.max("rid_a"), F.countDistinct("rid_b")).first()[:] == (0, 0, 2999)


def test_a_third_of_the_rows_share_a_passage(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choices("abcdefghijklmnop", k=5))
    passage = " ".join(word() for _ in range(40))
    stems = [" ".join(word() for _ in range(12)) for _ in range(150)]
    rows = [(i, passage, s) for i, s in enumerate(stems)]
    rows += [(200 + i, " ".join(word() for _ in range(40)), s) for i, s in enumerate(stems + stems[:100])]
    rows += [(900 + i, passage, s[:-3]) for i, s in enumerate(stems[:20])]  # the same passage, stems cut short
    rows += [(950, passage + " " + word(), stems[0])]
    p, m = neardup.versions(spark.createDataFrame(rows, "rid long, passage string, question string"), hot=20)
    got = {(r.rid_a, r.rid_b) for r in neardup.row_pairs(p, m).collect()}
    assert got == {(i, 900 + i) for i in range(20)} | {(0, 950), (900, 950)}
