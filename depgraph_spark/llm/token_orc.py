"""Token ids in ORC files: integer run-length encoding, row indexes and Bloom filters on document ids.

Files hold ranges of ascending document ids. Readers take stripes in parallel, and a lookup of some documents skips
stripes and row groups by their statistics and Bloom filters.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import small
from .bpe import Encoder, load_vocabulary, text_slices

# Bytes of a stripe before compression, and rows between entries of the row index.
STRIPE_BYTES = 16 << 20
INDEX_ROWS = 2_000

TOKENS = "part int, doc_id bigint, part_start bigint, n_tokens bigint, ids array<int>"


def write_token_orc(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0) -> None:
    """Encode every text of docs(doc_id, text), add ``end_id``, and write the rows in ascending order of doc_id.

    Null ids come first; rows of one id stand in the order of their texts. A null or empty text has the end id alone.
    ``part_start`` counts the ids before a document in its part; parts are numbered in the order of their ids. Columns of
    ``docs`` other than the two are not read, whatever their names; an empty table is written without rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(tokenizer_path))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            done = 0
            for texts in text_slices(batch.column(1)):
                ids, counts = encoder.encode(texts)
                total = counts + 1
                ends = np.cumsum(total)
                out = np.full(int(ends[-1]), end_id, np.int32)
                body = np.ones(len(out), bool)
                body[ends - 1] = False
                out[body] = ids
                rows = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(out))
                columns = [
                    pa.array(np.full(len(texts), part, np.int32)), batch.column(0).slice(done, len(texts)),
                    pa.array(start + ends - total), pa.array(total), rows,
                ]
                yield pa.RecordBatch.from_arrays(columns, ["part", "doc_id", "part_start", "n_tokens", "ids"])
                start += int(ends[-1])
                done += len(texts)

    by_id = F.asc_nulls_first("doc_id")
    ordered = docs.select(F.col("doc_id").cast("bigint"), "text").repartitionByRange(by_id)
    rows = ordered.sortWithinPartitions(by_id, "text").mapInArrow(encoded, TOKENS)
    options = {
        "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true",
        "orc.row.index.stride": str(INDEX_ROWS), "orc.stripe.size": str(STRIPE_BYTES),
    }
    rows.write.options(**options).orc(path)


def read_token_orc(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The stored rows, or those of the documents asked for, found through Bloom filters and row indexes."""
    rows = spark.read.schema(TOKENS).orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def token_digest(stored: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every stored row.

    Repeated rows and null ids have a row each, at their own start; without stored rows there are none.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            at = np.asarray(ids.offsets).tolist()
            raw = memoryview(np.ascontiguousarray(np.asarray(ids.values, "<u4"))).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:])]
            counts = np.diff(np.asarray(ids.offsets)).astype(np.int64)
            columns = [*(batch.column(i) for i in range(3)), pa.array(counts), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["part", "doc_id", "part_start", "n_tokens", "ids_crc32"])

    schema = "part int, doc_id bigint, part_start bigint, n_tokens bigint, ids_crc32 bigint"
    rows = stored.select("part", "doc_id", "part_start", "ids").mapInArrow(digest, schema)
    totals = stored.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # One row per written part: their totals are summed before each, in the order of the parts.
    listed = sorted((r["part"], r["n"]) for r in totals.collect())
    before = np.concatenate([[0], np.cumsum([n for _, n in listed])]).tolist()
    offsets = stored.sparkSession.createDataFrame(
        [(part, int(n)) for (part, _), n in zip(listed, before)], "part int, before bigint"
    )
    joined = rows.join(small(offsets, len(listed)), "part")
    return joined.select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")
