"""Strongly connected components by peeling and label spreading over an id-encoded edge table ``(s, d)``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_counted, loop_partitions, shuffle_partitions, small

# A peeling round that removes less than this share of the edges ends the peeling; the rest is left to spreading.
PEEL_SHARE = 0.02


def _peel(edges: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """Drop edges whose start has nothing coming in or whose end has nothing going out: they lie on no cycle."""
    while rows:
        inner = edges.join(edges.select(F.col("d").alias("s")).distinct(), "s", "left_semi").join(
            edges.select(F.col("s").alias("d")).distinct(), "d", "left_semi"
        )
        before = rows
        edges, rows = cut_counted(inner.select("s", "d"))
        if before - rows <= PEEL_SHARE * before:
            break
    return edges, rows


def _spread(edges: DataFrame) -> DataFrame:
    """``(id, f, b)``: smallest id that reaches the node and smallest id the node reaches, itself included.

    A round passes moved labels along the edges, then lets every node take its label's own label: what reaches the
    label reaches the node. So labels come from twice as far each round, and a ring takes a logarithm of its length.
    """
    both = edges.select(F.col("s").alias("u"), F.col("d").alias("v"), F.lit("f").alias("way")).unionByName(
        edges.select(F.col("d").alias("u"), F.col("s").alias("v"), F.lit("b").alias("way"))
    )
    nodes = edges.select(F.col("s").alias("u")).union(edges.select("d")).distinct()
    labels, rows = cut_counted(
        nodes.select("u", F.explode(F.array(F.lit("f"), F.lit("b"))).alias("way"))
        .withColumn("label", F.col("u"))
        .withColumn("moved", F.lit(True))
    )
    while rows:
        moved = small(labels.where("moved").select("u", "way", "label"), rows)
        offers = both.join(moved, ["u", "way"]).groupBy(F.col("v").alias("u"), "way").agg(F.min("label").alias("offer"))
        above = labels.where("label <> u").select(F.col("u").alias("next"), "way", F.col("label").alias("above"))
        taken = labels.join(offers, ["u", "way"], "left").withColumn("next", F.least("label", "offer"))
        labels, rows = cut_counted(
            taken.join(above, ["next", "way"], "left").select(
                "u", "way",
                F.least("next", "above").alias("label"),
                (F.least("next", "above") < F.col("label")).alias("moved"),
            ),
            F.col("moved"),
        )
    return labels.groupBy(F.col("u").alias("id")).agg(
        F.min(F.when(F.col("way") == "f", F.col("label"))).alias("f"),
        F.min(F.when(F.col("way") == "b", F.col("label"))).alias("b"),
    )


def strong_components(nodes: DataFrame, edges: DataFrame, edge_rows: int) -> DataFrame:
    """``(id, comp)`` for every node; ``comp`` is the smallest id in its component.

    A node whose smallest ancestor equals its smallest descendant is in that node's component. Every round settles at
    least the smallest node of each remaining piece; edges between differing labels cannot lie on a cycle and go.
    """
    spark = nodes.sparkSession
    settled: list[DataFrame] = []
    live = edges.where(F.col("s") != F.col("d")).select("s", "d").distinct()
    rows = edge_rows
    with shuffle_partitions(spark, loop_partitions(spark, edge_rows)):
        live, rows = _peel(live, rows)
        while rows:
            labels, n = cut_counted(_spread(live))
            settled.append(labels.where(F.col("f") == F.col("b")).select("id", F.col("f").alias("comp")))
            open_ends = small(labels.where(F.col("f") != F.col("b")), n)
            live, rows = cut_counted(
                live.join(open_ends.withColumnsRenamed({"id": "s", "f": "sf", "b": "sb"}), "s")
                .join(open_ends.withColumnsRenamed({"id": "d", "f": "df", "b": "db"}), "d")
                .where((F.col("sf") == F.col("df")) & (F.col("sb") == F.col("db")))
                .select("s", "d")
            )
            live, rows = _peel(live, rows)
        out = nodes.select("id")
        if not settled:
            return out.withColumn("comp", F.col("id"))
        found = reduce(DataFrame.unionByName, settled)
        return out.join(found, "id", "left").select("id", F.coalesce("comp", "id").alias("comp"))


def longest_levels(nodes: DataFrame, steps: DataFrame, used: list[int] | None = None) -> DataFrame:
    """``(node, level)`` on an acyclic step table ``(a, b)``: length of the longest walk that ends in the node.

    Peeling: a node has a level once all its steps' starts have one, which a counter that falls tells; that round is its
    level. Every step is taken once, in the round after its start; a list ``used`` gets the steps of each round, counted apart.
    """
    spark = nodes.sparkSession
    need = steps.groupBy("b").agg(F.count(F.lit(1)).alias("need"))
    steps, step_rows = cut_counted(steps.select("a", "b").join(need, "b"))
    with shuffle_partitions(spark, loop_partitions(spark, step_rows)):
        level = 0
        frontier, rows = cut_counted(
            nodes.select("node").join(need.select(F.col("b").alias("node")), "node", "left_anti").withColumn("level", F.lit(0))
        )
        rounds, waiting = [frontier], None
        while rows:
            level += 1
            ahead = steps.join(small(frontier.select(F.col("node").alias("a")), rows), "a")
            met = ahead.groupBy("b").agg(F.first("need").alias("need"), F.count(F.lit(1)).alias("got"))
            if used is not None:
                used.append(ahead.count())
            if waiting is not None:
                met = met.unionByName(waiting).groupBy("b").agg(F.first("need").alias("need"), F.sum("got").alias("got"))
            met, rows = cut_counted(met, F.col("need") == F.col("got"))
            frontier = met.where("need = got").select(F.col("b").alias("node"), F.lit(level).alias("level"))
            waiting = met.where("need > got")
            rounds.append(frontier)
    return reduce(DataFrame.unionByName, rounds)
