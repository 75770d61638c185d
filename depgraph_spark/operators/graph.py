"""Lookups and counts on ``files(repo, path)`` and ``edges(repo, src, dst, n_refs)``; src imports dst."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import classify_risk


def reverse_dependencies(edges: DataFrame) -> DataFrame:
    """``(repo, file, importer, n_refs)``: one row per importer, so a file everyone imports needs no giant list."""
    return edges.select("repo", F.col("dst").alias("file"), F.col("src").alias("importer"), "n_refs")


def importer_lists(edges: DataFrame, block: int = 1000) -> DataFrame:
    """``(repo, file, block, importers)``: importers as sorted lists of bounded expected size.

    A file with n importers gets about n / block lists; within a file the lists hold disjoint importers.
    """
    totals = edges.groupBy("repo", "dst").agg(F.count(F.lit(1)).alias("n"))
    blocks = F.ceil(F.col("n") / block).cast("bigint")
    return (
        edges.join(totals, ["repo", "dst"])
        .withColumn("block", F.pmod(F.xxhash64("src"), blocks))
        .groupBy("repo", F.col("dst").alias("file"), "block")
        .agg(F.sort_array(F.collect_list("src")).alias("importers"))
    )


def forward_dependencies(requests: DataFrame, edges: DataFrame) -> DataFrame:
    """``(repo, file, dependency, n_refs)`` for the requested ``(repo, file)``."""
    return requests.select("repo", "file").distinct().join(
        edges.select("repo", F.col("src").alias("file"), F.col("dst").alias("dependency"), "n_refs"), ["repo", "file"]
    )


def direct_dependents(requests: DataFrame, edges: DataFrame) -> DataFrame:
    """``(repo, file, dependent, n_refs)`` for the requested ``(repo, file)``."""
    return requests.select("repo", "file").distinct().join(
        edges.select("repo", F.col("dst").alias("file"), F.col("src").alias("dependent"), "n_refs"), ["repo", "file"]
    )


def unknown_files(requests: DataFrame, files: DataFrame) -> DataFrame:
    """Requested files that are not in the graph."""
    known = files.select("repo", F.col("path").alias("file"))
    return requests.select("repo", "file").distinct().join(known, ["repo", "file"], "left_anti")


def isolated_files(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Files without an import in either direction."""
    linked = edges.select("repo", F.col("src").alias("path")).unionByName(edges.select("repo", F.col("dst").alias("path")))
    return files.select("repo", "path").distinct().join(linked.distinct(), ["repo", "path"], "left_anti")


def degrees(files: DataFrame, edges: DataFrame) -> DataFrame:
    """``(repo, path, fan_in, fan_out, n_refs_in)``: distinct importers and imports per file, zeros included.

    Both directions are counted in one aggregation, so the edges are read and shuffled once.
    """
    ends = F.explode(
        F.array(
            F.struct(F.col("src").alias("path"), F.lit(0).alias("i"), F.lit(1).alias("o"), F.lit(0).cast("bigint").alias("r")),
            F.struct(F.col("dst").alias("path"), F.lit(1).alias("i"), F.lit(0).alias("o"), F.col("n_refs").alias("r")),
        )
    )
    nodes = files.select("repo", "path", F.lit(0).alias("i"), F.lit(0).alias("o"), F.lit(0).cast("bigint").alias("r"))
    rows = edges.select("repo", ends.alias("e")).select("repo", "e.*").unionByName(nodes)
    return rows.groupBy("repo", "path").agg(
        F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"), F.sum("r").alias("n_refs_in")
    )


def instability(degree_rows: DataFrame) -> DataFrame:
    """Adds ``instability`` = out / (in + out); null for a file without imports in either direction."""
    both = F.col("fan_in") + F.col("fan_out")
    return degree_rows.withColumn("instability", F.when(both > 0, F.col("fan_out") / both))


def hub_files(files: DataFrame, edges: DataFrame, top_n: int = 10) -> DataFrame:
    """``(repo, path, dependents, risk_level, rank)``: per repository the files with most importers, ties by path.

    The row-number filter is applied inside every task before the shuffle, so a large repository stays split.
    """
    most = Window.partitionBy("repo").orderBy(F.col("fan_in").desc(), "path")
    return (
        degrees(files, edges)
        .withColumn("rank", F.row_number().over(most))
        .where(F.col("rank") <= top_n)
        .select("repo", "path", F.col("fan_in").alias("dependents"), classify_risk(F.col("fan_in")).alias("risk_level"), "rank")
    )


def graph_stats(files: DataFrame, edges: DataFrame, components: DataFrame, languages: DataFrame) -> DataFrame:
    """One row per repository: files, edges, import lines, components, cyclic components, languages."""
    per_comp = components.groupBy("repo", "comp").agg(F.count(F.lit(1)).alias("size"))
    comps = per_comp.groupBy("repo").agg(
        F.count(F.lit(1)).alias("components"), F.count_if(F.col("size") > 1).alias("cyclic_components")
    )
    n_files = files.groupBy("repo").agg(F.count(F.lit(1)).alias("files"))
    n_edges = edges.groupBy("repo").agg(F.count(F.lit(1)).alias("edges"), F.sum("n_refs").alias("import_lines"))
    langs = languages.select("repo", F.array_join("languages", "+").alias("languages"))
    out = n_files.join(n_edges, "repo", "left").join(comps, "repo", "left").join(langs, "repo", "left")
    return out.fillna(0, ["edges", "import_lines", "components", "cyclic_components"])
