"""What the operators share of the session: tables, lineage cuts, spreading of Python-heavy work."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table `name` of a data folder; one parquet file or a folder of parts."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """Within it, a setting of the session has a value; it has its own again afterwards."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def swept(spark: SparkSession):
    """Within it, the shuffle files of a query go when the query has ended, not when the driver happens to collect its garbage.

    Only plans made within it are swept; whatever is read again later must be checkpointed or is computed again.
    """
    return setting(spark, SWEEP, "true")


def shared_folder(spark: SparkSession) -> str:
    """The folder in which lineage is cut: the one the cluster names in spark.checkpoint.dir.

    Only where that is unset on a single machine a local folder is made; on a cluster that is an error, as executors share none.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "kumiki-checkpoints"))
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession, kind: str) -> str:
    """A new folder under the shared one, for tables that are written and read again."""
    return f"{shared_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` written to the shared checkpoint folder and read again, so that a lost executor costs no recomputation.

    The shuffle files that led to it are removed.
    """
    shared_folder(df.sparkSession)
    with swept(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def slots(spark: SparkSession) -> int:
    """Tasks that the session can expect to run at once, at least its default parallelism."""
    return max(2, spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, *keys: str, per_slot: int = 1, scanned: bool = True) -> DataFrame:
    """`df` in at least `per_slot` partitions for each task slot, hashed by `keys`; as it is where the scan gives enough.

    Python stages cost CPU, not bytes, so partitions of the scan's size leave slots idle on few large files. `scanned` says that
    `df` comes straight from a scan or a checkpoint; the partitions of other plans aren't counted, as that would run them.
    """
    want = slots(df.sparkSession) * per_slot
    if not scanned or df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want, *[F.col(k) for k in keys])


def partitions_for(rows: int, per_partition: int, spark: SparkSession) -> int:
    """A partition count that follows the data: `rows` / `per_partition`, at least one for each slot."""
    return max(slots(spark), ceil(rows / per_partition))


def shipped(spark: SparkSession) -> SparkSession:
    """`spark`, with this package on its Python workers wherever they run; sent once a session.

    Needed only where the package isn't installed on the executors; it is served to them by the driver.
    """
    sc = spark.sparkContext
    if not getattr(sc, "_kumiki_shipped", False):
        here = os.path.dirname(os.path.abspath(__file__))
        target = os.path.join(tempfile.mkdtemp(prefix="kumiki-"), "kumiki.zip")
        with zipfile.ZipFile(target, "w") as z:
            for folder, _, files in os.walk(here):
                for f in files:
                    if f.endswith(".py"):
                        path = os.path.join(folder, f)
                        z.write(path, os.path.join("kumiki", os.path.relpath(path, here)))
        sc.addPyFile(target)
        sc._kumiki_shipped = True
    return spark
