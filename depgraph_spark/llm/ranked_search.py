"""Ranked lexical search: an inverted index in shards, searched with Block-Max MaxScore, and a merge of the shards' heaps.

A shard holds the postings of a bounded piece of the corpus, in blocks of bit-width bytes with the highest impact of every
block and every list. Queries go through a shard together: a query's lists are divided by their global bounds, candidates
come from the essential ones, and the block maxima of the others reject candidates before a block is decompressed.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir, cut, cut_counted, small
from .common import text_buffers

# Terms, and the characters that are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Bytes of text in a shard (one longer text is a shard of its own), postings in a block, queries that run together
# (a power of two), documents whose candidates are scored at once; the first window is small, to find a threshold.
SHARD_BYTES = 32 << 20
BLOCK = 128
QUERIES = 256
FIRST_WINDOW, WINDOW = 512, 4096
TOP = 10

# Bytes as terms see them: what is no part of a term is a blank.
_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
_HEAD = np.dtype([("first", "<i4"), ("top", "<i4"), ("widths", "u1")])


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What one weight unit of a term counts in a document, rounding down."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def length_norm(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    return 25 + 75 * n * documents // terms


def _widths(values: np.ndarray) -> np.ndarray:
    return np.where(values < 1 << 8, 1, np.where(values < 1 << 16, 2, 4))


def _store(out: np.ndarray, at: np.ndarray, values: np.ndarray, width: np.ndarray) -> None:
    for k in range(4):
        wide = width > k
        out[at[wide] + k] = values[wide] >> (8 * k) & 255


class Shard:
    """Postings of documents as they come in, until they are packed."""

    def __init__(self) -> None:
        self.terms: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.term, self.tf = [], []
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.distinct: list[int] = []
        self.bytes = 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        terms = text.translate(_BYTES).split()
        found = Counter(terms)
        self.term.append(np.fromiter(map(self.terms.__getitem__, found), np.int32, len(found)))
        self.tf.append(np.fromiter(found.values(), np.int64, len(found)))
        self.ids.append(doc_id)
        self.lengths.append(len(terms))
        self.distinct.append(len(found))
        self.bytes += len(text)

    def pack(self, number: int, documents: int, terms: int) -> pa.RecordBatch:
        """One row per term, and one with the empty term that holds the documents' ids and length norms.

        Documents are numbered in the order of their ids, null ones last.
        """
        null = np.array([i is None for i in self.ids])
        ids = np.array([i or 0 for i in self.ids], np.int64)
        order = np.lexsort((ids, null))
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        norms = length_norm(np.array(self.lengths, np.int64), documents, terms)
        term = np.concatenate(self.term) if self.term else np.zeros(0, np.int32)
        tf = np.concatenate(self.tf) if self.tf else np.zeros(0, np.int64)
        doc = np.repeat(place, self.distinct)
        by_term = np.lexsort((doc, term))
        term, tf, doc = term[by_term], tf[by_term], doc[by_term].astype(np.int64)
        value = impact(tf, norms[order][doc]) if len(doc) else tf
        n_terms = len(self.terms)
        df = np.bincount(term, minlength=n_terms)
        first = np.cumsum(df) - df
        pos = np.arange(len(doc)) - np.repeat(first, df)
        begin = np.flatnonzero(pos % BLOCK == 0)
        sizes = np.diff(np.append(begin, len(doc)))
        delta = np.diff(doc, prepend=0)
        delta[begin] = 0
        head = np.zeros(len(begin), _HEAD)
        if len(begin):
            head["first"], head["top"] = doc[begin], np.maximum.reduceat(value, begin)
            wide_doc = _widths(np.maximum.reduceat(delta, begin))
            wide_tf = _widths(np.maximum.reduceat(tf, begin))
            head["widths"] = wide_doc | wide_tf << 4
            block_bytes = sizes * (wide_doc + wide_tf)
            block_at = np.cumsum(block_bytes) - block_bytes
            raw = np.zeros(int(block_bytes.sum()), np.uint8)
            inner = pos % BLOCK
            wd, wf, base = (np.repeat(x, sizes) for x in (wide_doc, wide_tf, block_at))
            _store(raw, base + inner * wd, delta, wd)
            _store(raw, base + np.repeat(sizes * wide_doc, sizes) + inner * wf, tf, wf)
            n_blocks = -(-df // BLOCK)
            last = np.cumsum(n_blocks)
            raw_at = np.append(block_at, len(raw))[np.append(0, last)]
            top = np.maximum.reduceat(head["top"], last - n_blocks)
            head_at = np.append(0, last) * _HEAD.itemsize
        else:
            raw, raw_at, head_at, top = np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(1, np.int64), df
        columns = [
            pa.array([number] * (n_terms + 1), pa.int64()),
            pa.array(["", *(t.decode() for t in self.terms)], pa.string()),
            pa.array(np.append(len(ids), df), pa.int64()),
            pa.array(np.append(0, top), pa.int64()),
            _binaries(norms[order].astype("<i8").tobytes(), head.tobytes(), head_at),
            _binaries(ids[order].astype("<i8").tobytes() + null[order].astype(np.uint8).tobytes(), raw.tobytes(), raw_at),
        ]
        return pa.RecordBatch.from_arrays(columns, ["shard", "term", "df", "top", "heads", "postings"])


def _binaries(one: bytes, rest: bytes, at: np.ndarray) -> pa.Array:
    """``one``, then the pieces of ``rest`` between the places ``at``."""
    offsets = np.concatenate([[0], at + len(one)]).astype(np.int64)
    whole = pa.py_buffer(one + rest)
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), whole]).cast(pa.binary())


INDEX = "shard bigint, term string, df bigint, top bigint, heads binary, postings binary"


@dataclass(frozen=True)
class LexicalIndex:
    """``postings`` (a row per shard and term) with the number of documents that have a term, and of all their terms."""

    postings: DataFrame
    documents: int
    terms: int


def build_index(docs: DataFrame, path: str | None = None, shard_bytes: int = SHARD_BYTES) -> LexicalIndex:
    """Index every row's whole text below ``path`` (a new folder beside the checkpoints if none is given).

    A null or empty text, or one without a term, has no postings; repeated rows and null ids are documents of their own.
    Only doc_id and text are read. An empty table gives an empty index.
    """
    spark = docs.sparkSession
    path = path or f"{checkpoint_dir(spark)}/search/{uuid.uuid4().hex}"
    n = F.regexp_count("text", F.lit(TERM))
    row = docs.select(n.alias("n")).agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    documents, terms = row[0], max(row[1] or 0, 1)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, shard = TaskContext.get().partitionId() << 32, 0, Shard()
        for batch in batches:
            raw, at = text_buffers(batch.column(1))
            whole = raw.tobytes()
            for doc_id, a, b in zip(batch.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                if shard.ids and shard.bytes + b - a > shard_bytes:
                    yield shard.pack(part + made, documents, terms)
                    made, shard = made + 1, Shard()
                shard.add(doc_id, whole[a:b])
        if shard.ids:
            yield shard.pack(part + made, documents, terms)

    docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(packed, INDEX).write.parquet(path)
    return LexicalIndex(spark.read.schema(INDEX).parquet(path), documents, terms)


class Postings:
    """One list of a shard: block heads at hand, blocks decompressed when asked for and kept while the shard is."""

    def __init__(self, df: int, heads: bytes, raw: bytes, norms: np.ndarray):
        head = np.frombuffer(heads, _HEAD)
        self.first, self.top = head["first"].astype(np.int64), head["top"].astype(np.int64)
        self.wide_doc, self.wide_tf = (head["widths"] & 15).tolist(), (head["widths"] >> 4).tolist()
        self.sizes = [BLOCK] * (len(head) - 1) + [df - BLOCK * (len(head) - 1)]
        ends = np.cumsum([n * (a + b) for n, a, b in zip(self.sizes, self.wide_doc, self.wide_tf)])
        self.at = [0, *ends.tolist()]
        self.raw, self.norms = raw, norms
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of a block."""
        if i not in self.open:
            n, wd, wf = self.sizes[i], self.wide_doc[i], self.wide_tf[i]
            doc = self.first[i] + np.cumsum(np.frombuffer(self.raw, f"<u{wd}", n, self.at[i]), dtype=np.int64)
            tf = np.frombuffer(self.raw, f"<u{wf}", n, self.at[i] + n * wd).astype(np.int64)
            self.open[i] = doc, impact(tf, self.norms[doc])
        return self.open[i]

    def blocks(self, numbers) -> tuple[np.ndarray, np.ndarray]:
        found = [self.block(i) for i in numbers]
        if len(found) == 1:
            return found[0]
        return np.concatenate([d for d, _ in found]), np.concatenate([v for _, v in found])

    def between(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Documents low <= d < high with their impacts."""
        a = max(int(np.searchsorted(self.first, low, "right")) - 1, 0)
        b = int(np.searchsorted(self.first, high, "left"))
        if a >= b:
            return None
        doc, value = self.blocks(range(a, b))
        i, j = np.searchsorted(doc, (low, high))
        return doc[i:j], value[i:j]


class Heap:
    """The best documents of a query so far: score, id and whether the id is null; ties go to the smaller id, nulls last."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.null = np.zeros(0, bool)

    @property
    def threshold(self) -> int:
        """A score below which nothing can enter any more."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def offer(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        score, ids, null = (np.concatenate(x) for x in ((self.score, score), (self.id, ids), (self.null, null)))
        best = np.lexsort((ids, null, -score))[: self.k]
        self.score, self.id, self.null = score[best], ids[best], null[best]


def search_shard(lists: list[tuple[int, Postings]], ids: np.ndarray, null: np.ndarray, heap: Heap) -> None:
    """Offer a shard's documents to a query's heap; ``lists`` are its (weight, postings)."""
    lists = sorted(((w, p) for w, p in lists if w > 0), key=lambda x: x[0] * int(x[1].top.max()))
    # What the first j lists can add together.
    bound = [0]
    for weight, postings in lists:
        bound.append(bound[-1] + weight * int(postings.top.max()))
    low, window = 0, FIRST_WINDOW
    while low < len(ids):
        high = min(low + window, len(ids))
        least = heap.threshold
        rest = 0
        while rest < len(lists) and bound[rest + 1] < least:
            rest += 1
        if rest == len(lists):
            return
        total = np.zeros(high - low, np.int64)
        for weight, postings in lists[rest:]:
            found = postings.between(low, high)
            if found is not None:
                total[found[0] - low] += weight * found[1]
        doc = np.flatnonzero(total)
        score = total[doc]
        doc += low
        for j in range(rest - 1, -1, -1):
            weight, postings = lists[j]
            block = np.searchsorted(postings.first, doc, "right") - 1
            most = np.where(block >= 0, postings.top[block], 0) * weight
            keep = score + most + bound[j] >= least
            doc, score, block = doc[keep], score[keep], block[keep]
            if not len(doc):
                break
            wanted = np.unique(block[block >= 0])
            if len(wanted):
                listed, value = postings.blocks(wanted.tolist())
                at = np.minimum(np.searchsorted(listed, doc), len(listed) - 1)
                score += np.where(listed[at] == doc, value[at], 0) * weight
        keep = score >= least
        if keep.any():
            doc = doc[keep]
            heap.offer(score[keep], ids[doc], null[doc])
        low, window = high, WINDOW


def _searched(k: int):
    """Runs rows (batch, shard, term, df, heads, postings, weight, uses), sorted by batch and shard, through the heaps."""

    def emit(heaps: dict[int, Heap]) -> pa.RecordBatch:
        items = [i for i, h in heaps.items() for _ in h.score]
        score = [int(s) for h in heaps.values() for s in h.score]
        ids = [None if n else int(d) for h in heaps.values() for d, n in zip(h.id, h.null)]
        columns = [pa.array(items, pa.int64()), pa.array(ids, pa.int64()), pa.array(score, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score"])

    def finish(rows: list[dict], heaps: dict[int, Heap]) -> None:
        about = next((r for r in rows if not r["term"]), None)
        if about is None:
            return
        n = about["df"]
        norms = np.frombuffer(about["heads"], "<i8")
        ids = np.frombuffer(about["postings"], "<i8", n)
        null = np.frombuffer(about["postings"], np.uint8, n, 8 * n).astype(bool)
        queries: dict[int, list[tuple[int, Postings]]] = defaultdict(list)
        for row in rows:
            if row["term"]:
                postings = Postings(row["df"], row["heads"], row["postings"], norms)
                for use in row["uses"]:
                    queries[use["item"]].append((row["weight"] * use["times"], postings))
        for item, lists in queries.items():
            search_shard(lists, ids, null, heaps.setdefault(item, Heap(k)))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, heaps = None, [], {}
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            for key, row in zip(keys, batch.to_pylist()):
                if key != at:
                    if at is not None:
                        finish(rows, heaps)
                        if key[0] != at[0]:
                            yield emit(heaps)
                            heaps = {}
                    at, rows = key, []
                rows.append(row)
        if at is not None:
            finish(rows, heaps)
            yield emit(heaps)

    return searched


def query_terms(items: DataFrame) -> DataFrame:
    """(item, term, times) of ``items(item, text)``."""
    terms = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0))
    return items.select("item", F.explode(terms).alias("term")).groupBy("item", "term").agg(F.count(F.lit(1)).alias("times"))


def search(index: LexicalIndex, queries: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank (int, from 1), doc_id and score: the ``k`` best documents of every row of ``queries(item_id, text)``.

    Only scores above 0 count; equal scores stand in the order of doc_id, null ids last. A query without a term that some
    document has gives no rows, and so do a null text and empty tables; two rows with one item_id are two queries. Other
    columns are not read. A task holds the lists of one shard for at most 256 queries.
    """
    items = cut(queries.select("item_id", "text").withColumn("item", F.monotonically_increasing_id()))
    wanted, n_wanted = cut_counted(query_terms(items))
    terms, n_terms = cut_counted(wanted.select("term").distinct())
    df = index.postings.select("term", "df").join(small(terms, n_terms), "term").groupBy("term").agg(F.sum("df").alias("all"))
    weight = F.floor(1000 * F.log((2.0 * index.documents + 2) / (2.0 * F.col("all") + 1))).cast("bigint")
    weights, n_weights = cut_counted(df.select("term", weight.alias("weight")).where("weight > 0"))
    batch = F.expr(f"item div {QUERIES}").alias("batch")
    uses = (
        wanted.join(small(weights, n_weights), "term")
        .groupBy(batch, "term")
        .agg(F.first("weight").alias("weight"), F.collect_list(F.struct("item", "times")).alias("uses"))
    )
    # The row of a shard's documents goes to every batch of queries.
    own = items.select(batch).distinct().select("batch", F.lit("").alias("term"), F.lit(0).cast("bigint").alias("weight"))
    uses, n_uses = cut_counted(uses.unionByName(own, allowMissingColumns=True))
    rows = index.postings.join(small(uses, n_uses), "term")
    rows = rows.select("batch", "shard", "term", "df", "heads", "postings", "weight", "uses")
    found = (
        rows.repartition("batch", "shard").sortWithinPartitions("batch", "shard")
        .mapInArrow(_searched(k), "item bigint, doc_id bigint, score bigint")
    )
    best = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return top.join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
