"""STR1-STR5: the attempt log as a stream: running statistics, card folds, lockouts, and versioned writes by micro-batch."""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kumiki.operators.srs import DAYS
from kumiki.session import new_folder


def source(spark: SparkSession, path: str, schema: StructType, per_trigger: int | None = None) -> DataFrame:
    """STR1: files of a folder as a stream; each trigger takes at most `per_trigger` files."""
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", per_trigger) if per_trigger else r).parquet(path)


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """The stream's result once all that is there has been read: each batch is written as one version, the last version is read.

    A batch that runs again after a failure overwrites its own version, so the result is that of one run.
    """
    spark, where = stream.sparkSession, new_folder(stream.sparkSession, "stream")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{where}/out/v={number}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    out = spark.read.option("basePath", f"{where}/out").parquet(f"{where}/out")
    if mode == "complete":
        last = out.agg(F.max("v")).first()[0]
        return out.where(F.col("v") == last).drop("v")
    return out.drop("v")


def running_stats(attempts: DataFrame) -> DataFrame:
    """STR2: attempts and right answers of each item so far."""
    return attempts.groupBy("qid").agg(F.count("*").alias("n"), F.count_if("ok").alias("c"))


def running_writes(changes: DataFrame) -> DataFrame:
    """STR5: (coll, id, t, value): the last change of each key so far, unless a deletion (null v) is as late. Order, delay and
    repetition of the changes are without effect. `changes` has coll, id, ts, event_id and v."""
    live, dead = F.col("v").isNotNull(), F.col("v").isNull()
    g = changes.groupBy("coll", "id").agg(
        F.max(F.when(live, F.col("ts"))).alias("t"), F.max_by("v", F.when(live, F.struct("ts", "event_id"))).alias("value"), F.max(F.when(dead, F.col("ts"))).alias("d")
    )
    return g.where("t IS NOT NULL AND (d IS NULL OR t > d)").drop("d")


def running_lockouts(failures: DataFrame, gap: str, most: int, late: str) -> DataFrame:
    """STR4: sessions of failures with gaps below `gap` and at least `most` failures, closed once the watermark has passed."""
    f = failures.withWatermark("ts", late)
    w = f.groupBy("key", F.session_window("ts", gap)).agg(F.count("*").alias("fails"))
    return w.where(F.col("fails") >= most).select("key", F.col("session_window.start").alias("begin"), "fails")


def _box(before: Column, e: Column) -> Column:
    """The box of a card after one event: again goes to 0, hard stays, easy goes up 2 and all else 1, 5 at most."""
    up = F.least(F.lit(5), before + F.when(e["kind"] == "easy", 2).otherwise(1))
    return F.when(e["kind"] == "again", 0).when(e["kind"] == "hard", before).otherwise(up).cast("int")


def folded_cards(events: DataFrame, before: DataFrame | None) -> DataFrame:
    """(user_id, k, box, due, reps, lapses): the cards `before` (None: no card yet) after `events` (user_id, k, ts, id, kind)."""
    keys = ["user_id", "k"]
    both = events.select(*keys, F.struct("ts", "id", "kind").alias("e"), F.lit(None).cast("struct<box:int,due:date,reps:int,lapses:int>").alias("c"))
    if before is not None:
        both = both.unionByName(before.select(*keys, F.struct("box", "due", "reps", "lapses").alias("c")), allowMissingColumns=True)
    g = both.groupBy(*keys).agg(F.array_sort(F.collect_list("e")).alias("es"), F.first("c", ignorenulls=True).alias("c"))  # nulls aren't collected
    g = g.withColumn("box", F.aggregate("es", F.coalesce("c.box", F.lit(0)), _box)).withColumn("last", F.try_element_at("es", F.lit(-1)))
    days = F.element_at(F.array(*map(F.lit, DAYS)), F.col("box") + 1)
    wait = F.when(F.col("last.kind") == "again", 1).when(F.col("last.kind") == "hard", 2).otherwise(days)
    return g.select(
        *keys, "box", F.when(F.col("last").isNull(), F.col("c.due")).otherwise(F.date_add(F.to_date("last.ts"), wait)).alias("due"),
        (F.coalesce("c.reps", F.lit(0)) + F.size("es")).alias("reps"),
        (F.coalesce("c.lapses", F.lit(0)) + F.size(F.filter("es", lambda e: e["kind"] == "again"))).alias("lapses"),
    )


def running_cards(events: DataFrame) -> DataFrame:
    """STR2: the card of each (user, item) once all that is there has been read, folded batch by batch.

    Each batch writes all cards as one version, from its events and the version before it, without Python. A batch that runs again
    overwrites its own version; versions that no batch can need any more are removed.
    """
    spark, where = events.sparkSession, new_folder(events.sparkSession, "cards")

    def put(batch: DataFrame, number: int) -> None:
        before = spark.read.parquet(f"{where}/out/v={number - 1}") if number else None
        folded_cards(batch, before).write.mode("overwrite").parquet(f"{where}/out/v={number}")
        if number > 1:
            fs, old = _store(spark, f"{where}/out/v={number - 2}")
            fs.delete(old, True)

    q = events.writeStream.option("checkpointLocation", f"{where}/state").trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    fs, p = _store(spark, f"{where}/out")
    names = [f.getPath().getName() for f in fs.listStatus(p)]
    if not names:  # nothing to read
        return spark.createDataFrame([], "user_id long, k long, box int, due date, reps int, lapses int")
    return spark.read.parquet(f"{where}/out/v={max(int(n[2:]) for n in names)}")


def _store(spark: SparkSession, path: str):
    """The folder of a store in the file system it names, which all machines share."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    return fs, p


def _latest(fs, p) -> int:
    return max([int(f.getPath().getName()) for f in fs.listStatus(p) if f.getPath().getName().isdigit()], default=0)


def put_if(spark: SparkSession, path: str, base: int, blob: str) -> tuple[bool, int]:
    """STR3: writes revision base + 1 if the stored revision is still `base`; the answer is whether it did, and the revision.

    A revision is a file made without overwriting, which one of several writers can win.
    """
    fs, p = _store(spark, path)
    have = _latest(fs, p)
    if have != base:
        return False, have
    try:
        out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(p, str(base + 1)), False)
    except Py4JJavaError as e:
        if "exist" not in str(e.java_exception):
            raise
        return False, base + 1
    out.write(json.dumps({"rev": base + 1, "blob": blob}).encode())
    out.close()
    return True, base + 1


def synced(spark: SparkSession, path: str, local: dict, merge, tries: int = 4) -> dict | None:
    """STR3: pull, merge, write if unchanged; again on a conflict, at most `tries` times."""
    for _ in range(tries):
        fs, p = _store(spark, path)
        rev = _latest(fs, p)
        remote = json.loads(spark.read.option("wholetext", True).text(f"{path}/{rev}").first()[0])["blob"] if rev else None
        merged = merge(local, json.loads(remote)) if remote is not None else local
        if put_if(spark, path, rev, json.dumps(merged, sort_keys=True))[0]:
            return merged
    return None
