"""Structured Streaming of warnings and their acknowledgements, with state that expires."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def open_warning_state(warnings: DataFrame, acks: DataFrame) -> DataFrame:
    """``(repo, id, seen, acked, open)`` of a table of warnings and one of acks, in any order, repeats included.

    An ack may come before its warning; the flags only ever rise, so late and repeated rows change nothing.
    """
    return _flags(_tagged(warnings, True).unionByName(_tagged(acks, False)))


def _tagged(rows: DataFrame, warning: bool, *more: str) -> DataFrame:
    return rows.select("repo", "id", F.lit(warning).alias("seen"), F.lit(not warning).alias("acked"), *more)


def _flags(rows: DataFrame) -> DataFrame:
    state = rows.groupBy("repo", "id").agg(F.bool_or("seen").alias("seen"), F.bool_or("acked").alias("acked"))
    return state.withColumn("open", F.col("seen") & ~F.col("acked"))


def open_warning_stream(
    warnings: DataFrame, acks: DataFrame, out: str, checkpoint: str, keep: str = "1 hour", arrived: str | None = None
) -> StreamingQuery:
    """Keep the open warnings of two streams below ``out``; stops when the available input is used up.

    Repeats of a row within ``keep`` of each other meet in the state store and go; their keys expire when the watermark
    has passed, so the state holds what arrived within ``keep``, however long the stream runs. What is left is written,
    a folder per batch, which a replay overwrites. The flags only rise, so a repeat after its key has expired, an ack
    long after or before its warning, or a restart changes nothing in ``read_open_warnings``.

    The watermark follows the time of arrival, not the time in a row, so nothing is ever late: the clock of the batch, or
    a column ``arrived`` of both streams that rises within each source but for ``keep``.
    """
    when = F.current_timestamp() if arrived is None else F.col(arrived)

    def stamped(rows: DataFrame, warning: bool) -> DataFrame:
        return _tagged(rows.withColumn("_arrived", when), warning, "_arrived").withWatermark("_arrived", keep)

    fresh = stamped(warnings, True).unionByName(stamped(acks, False)).dropDuplicatesWithinWatermark(["repo", "id", "seen"])

    def write(batch: DataFrame, batch_id: int) -> None:
        _flags(batch).drop("open").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    stream = fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return stream.trigger(availableNow=True).start()


def read_open_warnings(spark: SparkSession, out: str) -> DataFrame:
    """``(repo, id, seen, acked, open)`` as of the last batch that was written."""
    return _flags(spark.read.parquet(out))
