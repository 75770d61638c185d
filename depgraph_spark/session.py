"""Session helpers: lineage cuts, row counts taken in passing, and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when its row count is known and at most this many (narrow) rows.
BROADCAST_ROWS = 200_000

# Rows per partition that loop state is laid out for.
ROWS_PER_PARTITION = 500_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts: the cluster's setting, or a scratch one in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        shared = tempfile.mkdtemp(prefix="spark-")
    sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and return a scan of it.

    Columnar, so later rounds read only the columns they use, and safe against lost executors.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_counted(df: DataFrame, which: Column | None = None) -> tuple[DataFrame, int]:
    """``cut`` that also returns how many rows (or rows with ``which`` true) the writing job saw."""
    seen = Observation()
    counted = F.count(F.lit(1)) if which is None else F.count_if(which)
    stored = cut(df.observe(seen, counted.alias("n")))
    return stored, int(seen.get["n"])


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast ``df`` if its counted size allows, otherwise leave the join to the optimizer."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def per_item(df: DataFrame, items: Column, item: str, *keep: str, place: str | None = None) -> DataFrame:
    """``keep`` columns and a row per item of an array, as ``item``, without nulls; ``place`` names its index.

    The array is computed in a projection of its own. Inside a generator, parts without generated code would have Spark
    interpret all of it, and the filter it puts below an inner generator would compute the array twice.
    """
    name = "_items"
    held = df.select(*keep, items.alias(name))
    made = F.explode_outer(name).alias(item) if place is None else F.posexplode_outer(name).alias(place, item)
    return held.select(*keep, made).where(F.col(item).isNotNull())


def loop_partitions(spark: SparkSession, rows: int) -> int:
    """Partition count for loop state of ``rows`` rows, never below what the cores can use."""
    floor = min(
        int(spark.conf.get("spark.sql.shuffle.partitions")),
        spark.sparkContext.defaultParallelism,
    )
    return max(1, floor, -(-rows // ROWS_PER_PARTITION))


@contextmanager
def shuffle_partitions(spark: SparkSession, n: int):
    """Run the rounds of a loop with ``n`` shuffle partitions, and keep persisted tables laid out in that many."""
    values = {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning": "false",
    }
    before = {key: spark.conf.get(key) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
