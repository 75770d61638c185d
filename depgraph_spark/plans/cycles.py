"""Simple cycles of a few nodes in an id-encoded edge table ``(s, d)``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut


def _from_least(nodes: Column) -> Column:
    """The same cycle, begun at its least node."""
    at = F.array_position(nodes, F.array_min(nodes)).cast("int")
    return F.concat(F.slice(nodes, at, F.size(nodes)), F.slice(nodes, F.lit(1), at - 1))


def neighbour_pairs(edges: DataFrame) -> DataFrame:
    """``(u, v, out, back)``: linked nodes once, from the one with fewer neighbours, and which directions exist.

    A node has at most about the root of twice the number of pairs in front of it, however many neighbours it has.
    """
    ways = edges.select(F.least("s", "d").alias("x"), F.greatest("s", "d").alias("y"), (F.col("s") < F.col("d")).alias("up"))
    pairs = cut(ways.groupBy("x", "y").agg(F.bool_or("up").alias("xy"), F.bool_or(~F.col("up")).alias("yx")))
    degree = cut(pairs.select(F.explode(F.array("x", "y")).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("k")))
    ends = pairs.join(degree.withColumnsRenamed({"n": "x", "k": "kx"}), "x").join(degree.withColumnsRenamed({"n": "y", "k": "ky"}), "y")
    first = F.struct("kx", "x") < F.struct("ky", "y")
    return ends.select(
        F.when(first, F.col("x")).otherwise(F.col("y")).alias("u"),
        F.when(first, F.col("y")).otherwise(F.col("x")).alias("v"),
        F.when(first, F.col("xy")).otherwise(F.col("yx")).alias("out"),
        F.when(first, F.col("yx")).otherwise(F.col("xy")).alias("back"),
    )


def wedges(pairs: DataFrame) -> DataFrame:
    """``(u, x, y)``: ways y -> u -> x through a node to two that both follow it in the order of degrees."""
    ahead = pairs.where("out").select("u", F.col("v").alias("x"))
    behind = pairs.where("back").select("u", F.col("v").alias("y"))
    return ahead.join(behind, "u").where("x <> y")


def short_cycles(edges: DataFrame, max_length: int) -> DataFrame:
    """``(nodes)``: every simple cycle of 2 to ``max_length`` nodes, from its least node on.

    Pairs and triangles are closed from the node with the fewest neighbours, so hubs make no wedges of their own. Longer
    cycles are grown from their least node.
    """
    pairs = cut(neighbour_pairs(edges))
    found = [pairs.where("out AND back").select(F.array(F.least("u", "v"), F.greatest("u", "v")).alias("nodes"))]
    if max_length >= 3:
        closing = edges.select(F.col("s").alias("x"), F.col("d").alias("y"))
        closed = wedges(pairs).join(closing, ["x", "y"], "left_semi")
        found.append(closed.select(_from_least(F.array("u", "x", "y")).alias("nodes")))
    if max_length > 3:
        walks = edges.where("s < d").select("s", F.array("s", "d").alias("nodes"), F.col("d").alias("end"))
        back = edges.select(F.col("s").alias("end"), F.col("d").alias("s"))
        step = edges.select(F.col("s").alias("end"), F.col("d").alias("next"))
        for length in range(3, max_length + 1):
            walks = (
                walks.join(step, "end")
                .where((F.col("next") > F.col("s")) & ~F.array_contains("nodes", F.col("next")))
                .select("s", F.concat("nodes", F.array("next")).alias("nodes"), F.col("next").alias("end"))
            )
            if length > 3:
                found.append(walks.join(back, ["end", "s"], "left_semi").select("nodes"))
    return reduce(DataFrame.unionByName, found)
