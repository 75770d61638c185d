"""Near-duplicate documents: MinHash bands propose pairs, sequential Bayesian tests prune them, full sets confirm.

Documents with the same words are one class, known by a 64-bit hash of its words. Classes that share a band are
candidates. Their signatures are compared batch by batch; a pair goes as soon as the posterior probability that it is
similar enough falls below the chosen miss probability. What survives is compared on full sets.

No group is expanded into pairs of rows. Every bucket first sends its members to one leader, which joins most groups.
Only buckets whose members are then still in different components are looked at again, in blocks, and only pairs
across components that pass the signature test leave them.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, cut_counted, loop_partitions, small
from .common import arrow_rows, binary, powers, row_keys, same_row, shingle_hashes, slices, text_buffers, whole_rows, word_hashes

# Bands of hashes: a pair of similarity 0.8 shares none of them three times in a million.
BANDS, ROWS = 24, 4
# Hashes of a signature, eight bits of each kept for tests, and how many are compared at a time.
HASHES, BATCH = 512, 64
# Similarity that links, in percent, and the probability with which one test may prune a pair that is that similar.
THRESHOLD_PERCENT = 80
MISS = 1e-5
# Pairs across components at least this likely to be similar are confirmed first; what they join needs no further test.
LIKELY = 0.5
# Rows of an Arrow batch; their texts are held by a task at once.
BATCH_ROWS = 1_000
# Members of a bucket that make a block, on average; two blocks are compared at a time.
BLOCK = 512

_draw = np.random.default_rng(20_240_601)
_FACTORS = _draw.integers(0, 1 << 31, HASHES).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_TERMS = _draw.integers(0, 1 << 32, HASHES).astype(np.uint32)
_SEQUENCE = 0x2545F4914F6CDD1D


def least_matches(percent: int, miss: float) -> dict[int, int]:
    """After n compared hashes, the least matches at which P(similarity >= threshold) is not below ``miss``.

    With a uniform prior the posterior of the match rate is a beta distribution, whose tail is a binomial sum. Eight
    bits agree by chance once in 256 times, which the threshold allows for.
    """
    rate = percent / 100 + (1 - percent / 100) / 256
    out = {}
    for n in range(BATCH, HASHES + 1, BATCH):
        tail, m = 0.0, -1
        while tail < miss and m <= n:
            m += 1
            tail += comb(n + 1, m) * rate**m * (1 - rate) ** (n + 1 - m)
        out[n] = m
    return out


def promising(left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Which pairs left[a[i]], right[b[i]] of signatures pass all tests."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), np.int64)
    for n, need in least.items():
        part = slice(n - BATCH, n)
        matches = matches + (left[a[alive], part] == right[b[alive], part]).sum(axis=1)
        ok = matches >= need
        alive, matches = alive[ok], matches[ok]
        if not len(alive):
            break
    return alive


def class_hashes(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit hash of each text's word sequence; 0 for a text without words."""
    n = np.diff(at)
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n > 0)
    if len(some):
        place = np.arange(len(words)) - np.repeat(at[:-1], n)
        value = words * powers(_SEQUENCE, int(n.max()))[place]
        out[some] = np.add.reduceat(value, at[:-1][some]) + n[some].astype(np.uint64)
    return out


def signatures(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per text: class hash, set size, BANDS band hashes and the HASHES-byte signature."""
    words, at = word_hashes(*text_buffers(texts))
    hashes, shingle_at = shingle_hashes(words, at)
    sets = [np.unique(hashes[a:b]) for a, b in zip(shingle_at[:-1].tolist(), shingle_at[1:].tolist())]
    sizes = np.array([len(s) for s in sets], np.int64)
    some = np.flatnonzero(sizes > 0)
    least = np.zeros((HASHES, len(sets)), np.uint32)
    if len(some):
        short = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
        starts = (np.cumsum(sizes) - sizes)[some]
        for k in range(HASHES):
            least[k, some] = np.minimum.reduceat(short * _FACTORS[k] + _TERMS[k], starts)
    bands = np.zeros((len(sets), BANDS), np.uint64)
    for b in range(BANDS):
        value = np.full(len(sets), b + 1, np.uint64)
        for r in range(ROWS):
            value = (value ^ least[b * ROWS + r]) * np.uint64(0x9E3779B97F4A7C15)
            value ^= value >> np.uint64(29)
        bands[:, b] = value
    bits = ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).T
    return class_hashes(words, at), sizes, bands, np.ascontiguousarray(bits)


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, _text, node, n_shingles, bands, bits) of every row; node is null for a text without words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            node, sizes, bands, bits = signatures(batch.column(2))
            columns = [
                batch.column(0), batch.column(1), pa.array(node.view(np.int64), pa.int64(), mask=sizes == 0), pa.array(sizes),
                binary(bands), binary(bits),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "_text", "node", "n_shingles", "bands", "bits"])

    rows = row_keys(docs).select(F.col("_id").alias("doc_id"), "_text", "text")
    return rows.mapInArrow(sign, "doc_id bigint, _text bigint, node bigint, n_shingles bigint, bands binary, bits binary")


def matrix(column: pa.Array, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def banded(classes: DataFrame) -> DataFrame:
    """(band, node): BANDS rows per class."""

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands = matrix(batch.column(1), np.int64, BANDS)
            node = np.repeat(np.asarray(batch.column(0)), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(bands.ravel()), pa.array(node)], ["band", "node"])

    return classes.select("node", "bands").mapInArrow(unfold, "band bigint, node bigint")


def survivors(pairs: DataFrame, classes: DataFrame, percent: int, miss: float) -> DataFrame:
    """The pairs (a, b) whose signatures pass the sequential tests."""
    least = least_matches(percent, miss)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (matrix(batch.column(i), np.uint8, HASHES) for i in (2, 3))
            every = np.arange(batch.num_rows)
            keep = pa.array(promising(left, right, every, every, least))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], ["a", "b"])

    bits = classes.select("node", "bits")
    first = pairs.join(bits.select(F.col("node").alias("a"), F.col("bits").alias("left")), "a")
    both = first.join(bits.select(F.col("node").alias("b"), F.col("bits").alias("right")), "b")
    return both.select("a", "b", "left", "right").mapInArrow(test, "a bigint, b bigint")


def class_texts(docs: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """(node, text) for the classes (node, rep) asked for: a text of a document that carries the class's least id."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            node = class_hashes(*word_hashes(*text_buffers(batch.column(0))))
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), batch.column(0)], ["node", "text"])

    ids = nodes.select(F.col("rep").alias("_rep")).distinct()
    rows = docs.select(F.col("doc_id").cast("bigint").alias("_id"), "text")
    rows = rows.join(small(ids, n), F.col("_id").eqNullSafe(F.col("_rep")), "left_semi").select("text")
    found = rows.mapInArrow(named, "node bigint, text string")
    return found.join(small(nodes.select("node"), n), "node", "left_semi").dropDuplicates(["node"])


def confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full shingle sets."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "left", "right"):
            (left, left_at), (right, right_at) = (shingle_hashes(*word_hashes(*text_buffers(batch.column(i)))) for i in (2, 3))
            keep, last, last_set = [], None, None
            for i in range(batch.num_rows):
                b = batch.column(1)[i].as_py()
                if b != last:
                    last, last_set = b, np.unique(right[right_at[i] : right_at[i + 1]])
                own = np.unique(left[left_at[i] : left_at[i + 1]])
                common = len(np.intersect1d(own, last_set, assume_unique=True))
                if 100 * common >= percent * (len(own) + len(last_set) - common):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["a", "b"])

    ends = pairs.select(F.col("a").alias("node")).distinct().unionByName(pairs.select(F.col("b").alias("node")).distinct()).distinct()
    nodes, n = cut_counted(classes.select("node", "rep").join(ends, "node", "left_semi"))
    texts = cut(class_texts(docs, nodes, n))
    first = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("left")), "a")
    both = first.join(texts.select(F.col("node").alias("b"), F.col("text").alias("right")), "b")
    return both.select("a", "b", "left", "right").mapInArrow(compare, "a bigint, b bigint")


def connected(edges: DataFrame) -> tuple[DataFrame, int]:
    """(node, comp) of every node of edges(a, b): comp is the least node of its component. And how many rows.

    Large-star and small-star steps in turn: every neighbour of a node, then every lesser one, is hung under the least
    of them, until every node hangs under a root. Each step halves the way to the root at least and sums up before it
    shuffles. A round's tables have at most twice as many rows as the edges before it and are written in parts for those.
    """
    spark = edges.sparkSession
    stored, n = cut_counted(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    starred = not n
    while not starred:
        parts = loop_partitions(spark, n)
        both = stored.unionByName(stored.select(F.col("v").alias("u"), F.col("u").alias("v")))
        roots = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        roots, n_roots = cut_counted(roots.coalesce(parts))
        large = both.join(small(roots, n_roots), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.where("u <> v").distinct().coalesce(parts))
        least, n_least = cut_counted(large.groupBy("u").agg(F.min("v").alias("m")).coalesce(parts))
        hung = large.join(small(least, n_least), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        stored, n = cut_counted(after.coalesce(parts))
        if n == n_least:
            # No node hangs under two others. Of these trees those of height one are done.
            below = small(stored.select(F.col("u").alias("v")), n)
            starred = stored.join(below, "v", "left_semi").isEmpty()
    pairs = stored.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    roots = stored.select(F.col("v").alias("node"), F.col("v").alias("comp"))
    return cut_counted(pairs.unionByName(roots).distinct().coalesce(loop_partitions(spark, 2 * n)))


def block_pairs(members: DataFrame, percent: int, miss: float, partitions: int) -> DataFrame:
    """Pairs across components that pass the tests, from members(band, low, high, home, node, comp, bits, bands).

    Rows of a cell stand together in a partition; a cell is held at a time. It compares the block ``low`` with the
    block ``high``, see ``dealt``. Of the bands that two rows share, only the first reports the pair.
    """
    least = least_matches(percent, miss)

    def compare(rows: dict[str, np.ndarray]) -> np.ndarray:
        node, comp, home, bits, bands = (rows[k] for k in ("node", "comp", "home", "bits", "bands"))
        low, high = rows["low"][0], rows["high"][0]
        here = int(np.argmax(bands[0] == rows["band"][0]))
        facing = home == high
        found = []
        for i in np.flatnonzero(home == low):
            others = facing & (comp != comp[i])
            j = np.flatnonzero(others & (node > node[i]) if low == high else others)
            if len(j):
                j = j[~(bands[j, :here] == bands[i, :here]).any(axis=1)]
                keep = j[promising(bits, bits, np.full(len(j), i), j, least)]
                found.append(np.stack([np.full(len(keep), node[i]), node[keep]], axis=1))
        return np.concatenate(found) if found else np.zeros((0, 2), np.int64)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None

        def flush(rows, until):
            pairs = [np.zeros((0, 2), np.int64)]
            edges = np.flatnonzero(np.any([np.diff(rows[k][:until]) != 0 for k in ("band", "low", "high")], axis=0)) + 1
            for a, b in zip(np.append(0, edges), np.append(edges, until)):
                if b - a > 1:
                    pairs.append(compare({k: v[a:b] for k, v in rows.items()}))
            out = np.unique(np.sort(np.concatenate(pairs), axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = {k: np.asarray(batch.column(i).to_numpy(zero_copy_only=False)) for i, k in enumerate(batch.schema.names[:-2])}
            rows["bits"] = matrix(batch.column(batch.num_columns - 2), np.uint8, HASHES)
            rows["bands"] = matrix(batch.column(batch.num_columns - 1), np.int64, BANDS)
            if held is not None:
                rows = {k: np.concatenate([held[k], v]) for k, v in rows.items()}
            same = np.all([rows[k] == rows[k][-1] for k in ("band", "low", "high")], axis=0)
            begin = len(same) - int(np.argmin(np.append(same[::-1], False)))
            if begin:
                yield flush(rows, begin)
            held = {k: v[begin:] for k, v in rows.items()}
        if held is not None:
            yield flush(held, len(held["node"]))

    laid = members.select("band", "low", "high", "home", "node", "comp", "bits", "bands")
    laid = laid.repartition(partitions, "band", "low", "high").sortWithinPartitions("band", "low", "high")
    return laid.mapInArrow(walk, "a bigint, b bigint")


def dealt(rows: DataFrame) -> DataFrame:
    """Rows (band, node, size, n_main, outside, ...) of buckets with the cells they are compared in: home, low and high.

    The rows outside a bucket's main component and those inside are dealt out to blocks of about BLOCK rows each, the
    outside ones numbered first. A cell is a pair low <= high of blocks of which low is outside, so that every pair
    with a row outside meets in one cell, and no cell has more rows than two blocks, whatever the bucket's size.
    """
    n_out = F.ceil((F.col("size") - F.col("n_main")) / BLOCK).cast("int")
    n_in = F.ceil(F.col("n_main") / BLOCK).cast("int")
    drawn = F.xxhash64("node")
    home = F.when(F.col("outside"), F.pmod(drawn, n_out)).otherwise(n_out + F.pmod(drawn, n_in)).cast("int")
    facing = F.sequence(F.lit(0), F.when(F.col("outside"), n_out + n_in).otherwise(n_out) - 1)
    met = rows.withColumn("home", home).withColumn("other", F.explode(facing))
    return met.withColumns({"low": F.least("home", "other"), "high": F.greatest("home", "other")}).drop("other")


def links(docs: DataFrame, classes: DataFrame, percent: int, miss: float) -> tuple[DataFrame, int]:
    """(node, comp) of all classes that are linked with another, from classes(node, rep, bands, bits)."""
    mixed = F.xxhash64("band", "node")
    # The leader is drawn anew in every bucket, so that members of a group meet many of each other.
    leaders = banded(classes).groupBy("band").agg(
        F.count(F.lit(1)).alias("size"), F.min(mixed).alias("lead"),
    ).where("size > 1")
    leaders, n_leaders = cut_counted(leaders)
    members = banded(classes).join(small(leaders, n_leaders), "band")
    members = cut(members.select("band", "node", "size", (mixed == F.col("lead")).alias("leads")))
    heads, n_heads = cut_counted(members.where("leads").select("band", F.col("node").alias("b")))
    pairs = members.where("not leads").join(small(heads, n_heads), "band").where("node <> b")
    pairs = cut(pairs.select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b")).distinct())
    edges = cut(confirmed(cut(survivors(pairs, classes, percent, miss)), docs, classes, percent))
    comps, n_comps = connected(edges)

    for least_chance in (LIKELY, miss):
        pairs = pairs_across(members, comps, n_comps, classes, percent, least_chance)
        extra, n_extra = cut_counted(confirmed(pairs, docs, classes, percent))
        if n_extra:
            comps, n_comps = connected(comps.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(extra))
    return comps, n_comps


def pairs_across(
    members: DataFrame, comps: DataFrame, n_comps: int, classes: DataFrame, percent: int, miss: float
) -> DataFrame:
    """Pairs (a, b) of members(band, node, size, leads) of one bucket and different components that pass the tests."""
    named = members.where("size > 2").join(small(comps, n_comps), "node", "left")
    named = cut(named.select("band", "node", "size", "leads", F.coalesce("comp", "node").alias("comp")))
    mains = named.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("band").agg(
        F.count(F.lit(1)).alias("comps"), F.max(F.struct("n", "comp")).alias("most")
    ).where("comps > 1").select("band", F.col("most.comp").alias("main"), F.col("most.n").alias("n_main"))
    mains, n_mains = cut_counted(mains)
    # Pairs with the bucket's leader were compared before.
    rest = named.where("not leads").join(small(mains, n_mains), "band").join(classes.select("node", "bits", "bands"), "node")
    spread = dealt(rest.withColumn("outside", F.col("comp") != F.col("main")))
    partitions = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(block_pairs(spread, percent, miss, partitions).distinct())


def grouped(docs: DataFrame, percent: int, miss: float) -> DataFrame:
    """(doc_id, _text, n_shingles, node, comp, component_id) of every row; comp is one node per component."""
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        return _grouped(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), percent, miss)


def _grouped(docs: DataFrame, percent: int, miss: float) -> DataFrame:
    rows = cut(signed(docs))
    classes = rows.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("bits").alias("bits")
    )
    classes = cut(classes)
    comps, n_comps = links(docs, classes, percent, miss)
    reps = classes.select("node", "rep").join(small(comps, n_comps), "node")
    least = cut(reps.groupBy("comp").agg(F.min("rep").alias("component_id")))
    linked, n_linked = cut_counted(reps.join(least, "comp").select("node", "comp", "component_id"))
    alone = classes.select("node", F.col("node").alias("comp"), F.col("rep").alias("component_id"))
    alone = alone.join(small(linked.select("node"), n_linked), "node", "left_anti")
    target, n_target = cut_counted(alone.unionByName(linked))
    return rows.select("doc_id", "_text", "n_shingles", "node").join(small(target, n_target), "node", "left")


def near_duplicates(docs: DataFrame, percent: int = THRESHOLD_PERCENT, miss: float = MISS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and node of every row of docs(doc_id, text).

    Words are runs of other than white space, A-Z lower-cased; a text's set is its distinct five-word shingles, or its
    whole sequence if it has fewer words. Texts are linked if 100 * intersection >= percent * union, and component_id
    is the least doc_id that is reachable, the row's own included; kept says whether that is the row's own.

    A text that is null or has no words has an empty set and is linked with nothing. Rows that repeat an id and a text
    get equal results; of copies under one id all are kept. A null doc_id counts as no id: such a row belongs to the
    least id of its component, and is kept if that has none. An empty table gives no rows. Other columns aren't read.
    """
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return grouped(docs, percent, miss).select(
        "doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), "node"
    )


def without_near_duplicates(docs: DataFrame, percent: int = THRESHOLD_PERCENT, miss: float = MISS) -> DataFrame:
    """The rows of ``docs``, all columns as they are, without all but one of each group of near-duplicates.

    The row with the least doc_id stays (null ids come last), of several with that id one. Rows without words stay.
    """
    key = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "_text")
    rows = grouped(docs, percent, miss).where(F.col("node").isNotNull())
    counted = rows.groupBy("comp", "doc_id", "_text").agg(F.count(F.lit(1)).alias("n"))
    counted = cut(counted.withColumn("key", key))
    winners, n_winners = cut_counted(counted.groupBy("comp").agg(F.min("key").alias("first"), F.sum("n").alias("all")).where("all > 1"))
    many = counted.join(small(winners, n_winners), "comp")
    stays = F.col("key").eqNullSafe(F.col("first"))
    gone, n_gone = cut_counted(many.where(~stays).select(F.col("doc_id").alias("_doc"), F.col("_text").alias("_doc_text")).distinct())
    twice, n_twice = cut_counted(many.where(stays & (F.col("n") > 1)).select(F.col("doc_id").alias("_doc"), F.col("_text").alias("_doc_text")))

    keyed = whole_rows(docs)
    left = keyed.join(small(gone, n_gone), same_row(keyed, gone), "left_anti")
    if not n_twice:
        return left.select("_row.*")
    single = left.join(small(twice, n_twice), same_row(left, twice), "left_anti")
    repeated = keyed.join(small(twice, n_twice), same_row(keyed, twice), "left_semi").dropDuplicates(["_id", "_text"])
    return single.unionByName(repeated).select("_row.*")
