"""Vectorised word and shingle hashing over Arrow batches, shared by the operators that compare texts."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes of text that are hashed at once, so that the arrays of a task stay small; a longer text is taken alone.
SLICE_BYTES = 1 << 18
SHINGLE_WORDS = 5
EMPTY = ""

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def powers(base: int, n: int) -> np.ndarray:
    out = np.empty(max(n, 1), np.uint64)
    out[0] = 1
    done = 1
    while done < len(out):
        step = np.uint64(pow(base, done, 1 << 64))
        more = min(done, len(out) - done)
        out[done : done + more] = out[:more] * step
        done += more
    return out


_POWERS = powers(_BASE, 4096)


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null(EMPTY)
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], *columns: str, budget: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of ``columns`` in each piece stay within ``budget`` bytes where rows allow."""
    for batch in batches:
        size = np.zeros(batch.num_rows, np.int64)
        for column in columns:
            size += np.diff(text_buffers(batch.column(batch.schema.get_field_index(column)))[1])
        until = np.cumsum(size)
        at = 0
        while at < batch.num_rows:
            before = until[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(until, before + budget, "right")))
            yield batch.slice(at, end - at)
            at = end


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of every text, A-Z lower-cased, and each text's offset."""
    solid = ~_SPACE[raw]
    begins = solid.copy()
    if len(raw):
        joined = solid[:-1].copy()
        inner = at[1:-1]
        joined[inner[(inner > 0) & (inner < len(raw))] - 1] = False
        begins[1:] &= ~joined
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    where = np.flatnonzero(solid)
    first = np.flatnonzero(begins[where])
    lengths = np.diff(np.append(first, len(where)))
    place = np.arange(len(where)) - np.repeat(first, lengths)
    longest = int(lengths.max())
    power = _POWERS if longest <= len(_POWERS) else powers(_BASE, longest)
    value = (_LOWER[raw[where]].astype(np.uint64) + np.uint64(1)) * power[place]
    hashed = mix(np.add.reduceat(value, first) + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return hashed, np.searchsorted(starts, at)


def _step(i: int) -> np.uint64:
    return np.uint64(pow(0xC2B2AE3D27D4EB4F, i + 1, 1 << 64))


def shingle_hashes(words: np.ndarray, at: np.ndarray, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``size``-word windows of each text, repeats included, and each text's offset.

    A text with fewer words, but some, has its whole sequence as one window.
    """
    n = np.diff(at)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    out_at = np.concatenate([[0], np.cumsum(count)])
    total = np.zeros(max(len(words) - size + 1, 0), np.uint64)
    for i in range(size):
        total += words[i : i + len(total)] * _step(i)
    out = np.zeros(out_at[-1], np.uint64)
    long = np.flatnonzero(n >= size)
    from_word = np.repeat(at[:-1][long] - out_at[:-1][long], count[long])
    target = np.flatnonzero(np.repeat(n >= size, count))
    out[target] = total[target + from_word]
    for i in np.flatnonzero((n > 0) & (n < size)):
        short = words[at[i] : at[i + 1]]
        out[out_at[i]] = sum(int(w) * int(_step(j)) for j, w in enumerate(short)) + len(short) * _BASE & _MASK
    return mix(out), out_at


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indexes starts[i] .. starts[i] + lengths[i] - 1, one range after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def binary(rows: np.ndarray) -> pa.Array:
    """A binary column of the rows of a C-ordered matrix."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize if len(rows) else 0
    at = pa.array(np.arange(len(rows) + 1, dtype=np.int64) * width)
    return pa.Array.from_buffers(pa.large_binary(), len(rows), [None, at.buffers()[1], pa.py_buffer(rows)]).cast(pa.binary())


@contextmanager
def arrow_rows(spark: SparkSession, n: int):
    """Run actions with at most ``n`` rows in an Arrow batch, so that batches of whole texts stay small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def crc_remainder(doc_id="doc_id"):
    """crc32 of the decimal doc_id modulo 3; a null id counts as empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "UTF-8")) % 3


def text_hash():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def row_keys(docs: DataFrame) -> DataFrame:
    """``_id``, ``_text``, text and source: what tells documents apart, for null-safe joins that find a row again."""
    source = F.col("source") if "source" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("bigint").alias("_id"), text_hash().alias("_text"), "text", source.alias("source"))


def whole_rows(docs: DataFrame) -> DataFrame:
    """``_row``, the row as a struct whatever its columns are named, with ``_id``, ``_text`` and text beside it."""
    return docs.select(
        F.struct("*").alias("_row"), F.col("doc_id").cast("bigint").alias("_id"), text_hash().alias("_text"), F.col("text").alias("text")
    )


def same_row(left: DataFrame, right: DataFrame):
    """``left``'s (_id, _text) is ``right``'s (_doc, _doc_text)."""
    return left["_id"].eqNullSafe(right["_doc"]) & (left["_text"] == right["_doc_text"])
