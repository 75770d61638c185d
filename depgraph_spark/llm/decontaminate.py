"""Benchmark decontamination by greedy string tiling.

Five-word seeds of the items are rows, joined with the seeds of the documents; a bitmap of the seeds keeps other
windows out of that join. A text and an item that share enough seeds are tiled: the longest match of words that neither
side has marked yet, found by rolling hashes, is marked again and again. The share of the item under tiles is its coverage, which doesn't depend on the
order in which the passages stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, cut_counted, small
from .common import (
    SHINGLE_WORDS, arrow_rows, mix, powers, ragged, row_keys, shingle_hashes, slices, text_buffers, text_hash, whole_rows,
    word_hashes,
)

# Share of an item's words under tiles from which on a document is contaminated.
COVERAGE = 0.8
# A tile of so many words contaminates as well, however long the item is.
PASSAGE_WORDS = 50
# The bitmap that most windows of documents fail has this many bits a seed, as powers of two, within both bounds.
BITS_A_SEED, LEAST_BITS, MOST_BITS = 8, 16, 26
# Words of all items up to which they are broadcast (8 bytes each).
BROADCAST_WORDS = 4_000_000
# Rows of pairs that a task tiles at once.
BATCH_ROWS = 500

_BASE = 0xD1342543DE82EF95


def window_hashes(sums: np.ndarray, free: np.ndarray, power: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and rolling hashes of the windows of ``n`` words none of which is marked.

    ``sums`` are the polynomial hashes of all beginnings, ``free`` counts the words not marked before each place.
    """
    at = np.flatnonzero(free[n:] - free[:-n] == n)
    return at, mix(sums[at + n] - sums[at] * power[n])


def beginnings(words: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the first 0, 1, 2, ... words, modulo 2**64."""
    power = powers(_BASE, len(words) + 1)
    back = powers(pow(_BASE, -1, 1 << 64), len(words) + 1)
    # sum of words[i] * base**-i, times base**(n - 1), is the hash of the first n words.
    return np.append(np.uint64(0), np.cumsum(words * back[: len(words)]) * power[: len(words)])


def tiles(item: np.ndarray, doc: np.ndarray, gaps: np.ndarray) -> list[tuple[int, int, int]]:
    """Greedy tiles (item place, document place, words); words of the document where ``gaps`` is true match nothing.

    The greatest length with a match of unmarked words is found by bisection over rolling hashes. All its matches are
    marked in one pass, the first in the item first, each with the first in the document.
    """
    out: list[tuple[int, int, int]] = []
    open_item, open_doc = np.ones(len(item), bool), ~gaps
    item_sums, doc_sums = beginnings(item), beginnings(doc)
    power = powers(_BASE, len(item) + 2)
    most = min(len(item), len(doc))

    def matches(n: int):
        sides = []
        for sums, free in ((item_sums, open_item), (doc_sums, open_doc)):
            sides.append(window_hashes(sums, np.append(0, np.cumsum(free)), power, n))
        (p, left), (q, right) = sides
        keep = np.isin(left, right)
        return p[keep], left[keep], q, right

    while most >= SHINGLE_WORDS:
        low, high = SHINGLE_WORDS - 1, most
        while low < high:
            n = (low + high + 1) // 2
            low, high = (n, high) if len(matches(n)[0]) else (low, n - 1)
        if low < SHINGLE_WORDS:
            break
        p, left, q, right = matches(low)
        order = np.argsort(right, kind="stable")
        q, right = q[order], right[order]
        # Marked windows never open again, so each hash has one position from which on to look.
        hashes, begin = np.unique(right, return_index=True)
        at, end = begin.copy(), np.append(begin[1:], len(right))
        for place, group in zip(p.tolist(), np.searchsorted(hashes, left).tolist()):
            if not open_item[place : place + low].all():
                continue
            while at[group] < end[group]:
                other = int(q[at[group]])
                at[group] += 1
                if open_doc[other : other + low].all() and np.array_equal(item[place : place + low], doc[other : other + low]):
                    out.append((place, other, low))
                    open_item[place : place + low] = False
                    open_doc[other : other + low] = False
                    break
        most = low - 1
    return out


def item_rows(benchmark: DataFrame) -> DataFrame:
    """_item, item_id, n, words and seeds of every different item of five words or more, one row each."""
    items = benchmark.where(F.col("text").isNotNull()).select("item_id", "text").distinct()
    items = items.select(F.xxhash64("item_id", "text").alias("_item"), F.col("item_id").cast("bigint").alias("item_id"), "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words, at = word_hashes(*text_buffers(batch.column(2)))
            seeds, seed_at = shingle_hashes(words, at)
            n = np.diff(at)
            rows = np.flatnonzero(n >= SHINGLE_WORDS)
            ids = batch.take(pa.array(rows))
            columns = [
                ids.column(0), ids.column(1), pa.array(n[rows]),
                pa.array([words[at[i] : at[i + 1]].tobytes() for i in rows], pa.binary()),
                pa.array([seeds[seed_at[i] : seed_at[i + 1]].view(np.int64) for i in rows], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["_item", "item_id", "n", "words", "seeds"])

    return items.mapInArrow(hashed, "_item bigint, item_id bigint, n bigint, words binary, seeds array<bigint>")


def needed_seeds(items: DataFrame, coverage: float) -> DataFrame:
    """_item, seed, places and least: the seeds to join, and how many of their places a document has to hold.

    A tile of w words holds w - 4 >= w / 5 seeds, so coverage asks for a fifth of it in places, and a passage for its
    own number. By that many places less one an item does without the seeds that most items share: a document that
    holds enough still holds the rest of them.
    """
    asked = F.least(F.ceil(F.col("n") * (coverage / SHINGLE_WORDS) - 1e-9), F.lit(PASSAGE_WORDS - SHINGLE_WORDS + 1))
    seeds = items.select("_item", F.greatest(asked, F.lit(1)).cast("bigint").alias("asked"), F.explode("seeds").alias("seed"))
    seeds = seeds.groupBy("_item", "seed", "asked").agg(F.count(F.lit(1)).alias("places"))
    common = seeds.groupBy("seed").agg(F.count(F.lit(1)).alias("holders"))
    order = Window.partitionBy("_item").orderBy(F.desc("holders"), "seed").rowsBetween(Window.unboundedPreceding, 0)
    ranked = seeds.join(common, "seed").withColumn("passed", F.sum("places").over(order))
    spared = (F.col("holders") > 1) & (F.col("passed") < F.col("asked"))
    whole = Window.partitionBy("_item")
    left = F.coalesce(F.sum(F.when(spared, F.col("places"))).over(whole), F.lit(0))
    return ranked.select("_item", "seed", "places", (F.col("asked") - left).alias("least"), spared.alias("spared"))


def seed_bitmap(seeds: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """Which leading bits of hashes occur among the seeds, as 64-bit words, and the number of bits (2**26 at most)."""
    bits = min(max(int(n).bit_length() + BITS_A_SEED, LEAST_BITS), MOST_BITS)
    slot = F.shiftrightunsigned("seed", 64 - bits)
    word = F.shiftright(slot, 6).alias("word")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), slot.bitwiseAND(F.lit(63)).cast("int"))
    found = seeds.select(word, bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bitmap = np.zeros(1 << (bits - 6), np.uint64)
    bitmap[found.column(0).to_numpy()] = found.column(1).to_numpy().astype(np.int64).view(np.uint64)
    return bitmap, bits


def seeded_texts(docs: DataFrame, bitmap: np.ndarray, bits: int) -> DataFrame:
    """_text, seeds, words and gaps of each different text that may hold seeds: only the words in such windows."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for batch in slices(batches, "text"):
            words, at = word_hashes(*text_buffers(batch.column(1)))
            hashes, seed_at = shingle_hashes(words, at)
            slot = hashes >> np.uint64(64 - bits)
            hit = (bitmap[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
            hit &= np.repeat(np.diff(at) >= SHINGLE_WORDS, np.diff(seed_at))
            rows = np.flatnonzero(np.diff(np.append(0, np.cumsum(hit))[seed_at]) > 0)
            seeds, kept, gaps = [], [], []
            for d in rows:
                windows = np.flatnonzero(hit[seed_at[d] : seed_at[d + 1]])
                seeds.append(np.unique(hashes[seed_at[d] + windows]).view(np.int64))
                inside = np.unique(ragged(windows, np.full(len(windows), SHINGLE_WORDS)))
                # A gap stands for the words left out between two kept ones.
                jumps = np.flatnonzero(np.diff(inside) > 1) + 1
                kept.append(np.insert(words[at[d] + inside], jumps, np.uint64(0)).tobytes())
                gaps.append(jumps + np.arange(len(jumps)))
            columns = [
                batch.column(0).take(pa.array(rows)), pa.array(seeds, pa.list_(pa.int64())),
                pa.array(kept, pa.binary()), pa.array(gaps, pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["_text", "seeds", "words", "gaps"])

    found = docs.select(text_hash().alias("_text"), "text").mapInArrow(
        seeded, "_text bigint, seeds array<bigint>, words binary, gaps array<bigint>"
    )
    return found.dropDuplicates(["_text"])


def tiled(pairs: DataFrame, coverage: float) -> DataFrame:
    """_text, item_id, coverage and n_tiles of the pairs that contaminate."""

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                item = np.frombuffer(batch.column(2)[i].as_buffer(), np.uint64)
                doc = np.frombuffer(batch.column(3)[i].as_buffer(), np.uint64)
                gaps = np.zeros(len(doc), bool)
                gaps[batch.column(4)[i].values.to_numpy()] = True
                found = tiles(item, doc, gaps)
                share = sum(n for _, _, n in found) / len(item)
                if share >= coverage - 1e-9 or any(n >= PASSAGE_WORDS for _, _, n in found):
                    rows.append((i, share, len(found)))
            at, share, n = zip(*rows) if rows else ((), (), ())
            ids = batch.take(pa.array(at, pa.int64()))
            columns = [ids.column(0), ids.column(1), pa.array(share, pa.float64()), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["_text", "item_id", "coverage", "n_tiles"])

    columns = pairs.select("_text", "item_id", "item_words", "words", "gaps")
    return columns.mapInArrow(judged, "_text bigint, item_id bigint, coverage double, n_tiles bigint")


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> tuple[DataFrame, int]:
    """(_text, item_id, coverage, n_tiles) of every different text and item it covers, and how many rows those are."""
    spark = docs.sparkSession
    items, n_items = cut_counted(item_rows(benchmark))
    ranked, _ = cut_counted(needed_seeds(items, coverage))
    seeds, n_seeds = cut_counted(ranked.where(~F.col("spared")).drop("spared"))
    texts = cut(seeded_texts(docs, *seed_bitmap(ranked, n_seeds)))
    held = texts.select("_text", F.explode("seeds").alias("seed"))
    counted = held.join(small(seeds, n_seeds), "seed").groupBy("_text", "_item").agg(
        F.sum("places").alias("places"), F.first("least").alias("least")
    )
    pairs = cut(counted.where(F.col("places") >= F.col("least")).select("_text", "_item"))
    words = items.select("_item", "item_id", F.col("words").alias("item_words"))
    n_words = items.agg(F.sum("n")).first()[0] or 0
    if n_words <= BROADCAST_WORDS:
        words = small(words, n_items)
    with arrow_rows(spark, BATCH_ROWS):
        return cut_counted(tiled(pairs.join(texts.drop("seeds"), "_text").join(words, "_item"), coverage))


def judge_contamination(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, contaminated, item_id, coverage, n_tiles and n_items of every row of docs(doc_id, text).

    A document is contaminated by an item of which it covers at least ``coverage``, or PASSAGE_WORDS words in one tile.
    item_id is the item covered most of those (of equal ones the least id), n_items the number of those; without any,
    item_id is null and the numbers are 0. Words are runs of other than white space, A-Z lower-cased. Null and empty
    texts, and items of under five words or without text, match nothing; repeated items count once. A long or
    repetitive text takes memory in proportion to its words. Repeated rows keep a row each; an empty table gives none.
    Only doc_id and text are read, so further columns can have any name.
    """
    matches, n = benchmark_matches(docs, benchmark, coverage)
    best = matches.groupBy(F.col("_text").alias("_found")).agg(
        F.max(F.struct("coverage", (-F.col("item_id")).alias("item"), "n_tiles")).alias("best"),
        F.countDistinct("item_id").alias("n_items"),
    )
    keyed = row_keys(docs).select("_id", "_text")
    joined = keyed.join(small(best, n), F.col("_text") == F.col("_found"), "left")
    return joined.select(
        F.col("_id").alias("doc_id"),
        F.col("best").isNotNull().alias("contaminated"),
        (-F.col("best.item")).alias("item_id"),
        F.coalesce("best.coverage", F.lit(0.0)).alias("coverage"),
        F.coalesce("best.n_tiles", F.lit(0)).cast("bigint").alias("n_tiles"),
        F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that no item contaminates.

    Rows whose text is null, empty or under five words stay, and so do repeated rows; an empty table, or an empty
    benchmark, takes nothing away.
    """
    matches, n = benchmark_matches(docs, benchmark, coverage)
    gone = matches.select(F.col("_text").alias("_found")).distinct()
    keyed = whole_rows(docs)
    return keyed.join(small(gone, n), F.col("_text") == F.col("_found"), "left_anti").select("_row.*")
