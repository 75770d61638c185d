"""Level-by-level reachability over an id-encoded step table ``(a, b)``: one join per level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS, cut, cut_counted, loop_partitions, shuffle_partitions, small

# Tables of words found earlier that one round looks into; where there are more, they are merged first.
MAX_LAYERS = 8


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def reach(steps: DataFrame, seeds: DataFrame | None = None, steps_rows: int | None = None) -> DataFrame:
    """``(start, node, level)`` for every node reachable from a start in >= 1 step, with its BFS level.

    ``steps(a, b)`` are distinct moves from ``a`` to ``b``. ``seeds(start)`` limits the starts; without it
    every ``a`` is one. A start never reaches itself. All starts advance together. Once a
    round's candidates are few, they are broadcast to the pairs found so far, which are scanned in place.
    """
    spark = steps.sparkSession
    steps = steps.where(F.col("a") != F.col("b"))
    if steps_rows is None:
        steps, steps_rows = cut_counted(steps)
    n = loop_partitions(spark, steps_rows)
    with shuffle_partitions(spark, n):
        first = steps.select(F.col("a").alias("start"), F.col("b").alias("node"))
        if seeds is not None:
            first = first.join(seeds.select("start").distinct(), "start", "left_semi")
        frontier, rows = cut_counted(
            first.distinct().repartition(n, "start", "node").withColumn("level", F.lit(1))
        )
        seen = [frontier]
        level = 1
        while rows:
            level += 1
            ahead = small(frontier.select("start", F.col("node").alias("a")), rows)
            found = (
                steps.join(ahead, "a")
                .where(F.col("start") != F.col("b"))
                .select("start", F.col("b").alias("node"))
                .distinct()
            )
            if rows <= BROADCAST_ROWS:
                found, m = cut_counted(found)
                known = _all(seen).select("start", "node").join(small(found, m), ["start", "node"], "left_semi")
                fresh = found.join(small(known, m), ["start", "node"], "left_anti")
            else:
                fresh = found.join(_all(seen).select("start", "node"), ["start", "node"], "left_anti")
            frontier, rows = cut_counted(fresh.withColumn("level", F.lit(level)))
            seen.append(frontier)
    return _all(seen)


def own_bits(members: DataFrame) -> DataFrame:
    """``(node, block, bits)`` of ``members(node, id)``: ids as bits of 64-bit words, words of neighbouring ids."""
    bit = F.expr("shiftleft(1L, cast(id % 64 AS INT))")
    return members.groupBy("node", F.expr("id div 64").alias("block")).agg(F.bit_or(bit).alias("bits"))


def reach_counts(steps: DataFrame, own: DataFrame, steps_rows: int) -> DataFrame:
    """``(node, reached, depth)`` for every node of an acyclic ``steps(a, b)`` that steps lead on from.

    ``own(node, block, bits)`` are what a node counts for, as bits. All starts advance together: in round k a node gets
    what its steps' targets were first found with in round k - 1, so only words move, one for up to 64 reached ids, and at
    most edges times words. Words found before are taken off; popcounts and rounds are all that leaves. Steps and found
    words are laid out once and stay in place, so a round shuffles what it found, not what was found before it.
    """
    spark = steps.sparkSession
    own, rows = cut_counted(own)
    frontier, seen, laid, level, n = own, [], [], 0, 0
    while rows:
        level += 1
        wanted = loop_partitions(spark, max(rows, steps_rows))
        if wanted > 2 * n:
            _release(laid)
            n = wanted
            with shuffle_partitions(spark, n):
                laid = [steps.repartition(n, "b").persist(), *(_in_place(found, n) for found in seen)]
        with shuffle_partitions(spark, n):
            ahead = small(frontier.select(F.col("node").alias("b"), "block", "bits"), rows)
            found = laid[0].join(ahead, "b").groupBy(F.col("a").alias("node"), "block").agg(F.bit_or("bits").alias("bits"))
            few = rows <= BROADCAST_ROWS
            if seen and few:
                found, m = cut_counted(found)
                key = small(found.select("node", "block"), m)
                before = _all([words.join(key, ["node", "block"], "left_semi") for words in laid[1:]])
                before = before.groupBy("node", "block").agg(F.bit_or("bits").alias("old"))
                found = _without(found, small(before, m))
            elif seen:
                if len(laid) > MAX_LAYERS:
                    merged = cut(_all(laid[1:]).groupBy("node", "block").agg(F.bit_or("bits").alias("bits")))
                    _release(laid[1:])
                    laid[1:] = [_in_place(merged, n)]
                for words in laid[1:]:
                    found = _without(found, words.withColumnRenamed("bits", "old"))
            frontier, rows = cut_counted(found.withColumn("level", F.lit(level)))
            laid.append(_in_place(frontier, n))
        seen.append(frontier)
    _release(laid)
    if not seen:
        return own.where("false").select("node", F.lit(0).cast("bigint").alias("reached"), F.lit(0).alias("depth"))
    return _all(seen).groupBy("node").agg(F.sum(F.bit_count("bits")).alias("reached"), F.max("level").alias("depth"))


def _in_place(words: DataFrame, n: int) -> DataFrame:
    """Words kept on the executors, spread as a grouping by node and block spreads them."""
    return words.select("node", "block", "bits").repartition(n, "node", "block").persist()


def _without(found: DataFrame, before: DataFrame) -> DataFrame:
    """``found`` less the bits of ``before(node, block, old)``, which has a word of a node once."""
    rows = found.join(before, ["node", "block"], "left")
    return rows.select("node", "block", F.expr("bits & ~coalesce(old, 0L)").alias("bits")).where("bits <> 0")


def _release(laid: list[DataFrame]) -> None:
    for df in laid:
        df.unpersist()


def spread_set(steps: DataFrame, seeds: DataFrame, rounds: int | None = None) -> DataFrame:
    """``(node)``: the seeds and everything reachable from them by ``steps(a, b)``, in ``rounds`` steps at most, as one set."""
    spark = steps.sparkSession
    steps, steps_rows = cut_counted(steps)
    with shuffle_partitions(spark, loop_partitions(spark, steps_rows)):
        frontier, rows = cut_counted(seeds.select("node").distinct())
        seen = [frontier]
        while rows and (rounds is None or len(seen) <= rounds):
            ahead = steps.join(small(frontier.select(F.col("node").alias("a")), rows), "a")
            found = ahead.select(F.col("b").alias("node")).distinct()
            frontier, rows = cut_counted(found.join(_all(seen), "node", "left_anti"))
            seen.append(frontier)
    return _all(seen)
