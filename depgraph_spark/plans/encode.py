"""Dictionary encoding of files: loops run on 8-byte ids, paths come back once at the end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, cut_counted


def assign_ids(files: DataFrame) -> DataFrame:
    """``(repo, path, id)``, ids rising with (repo, path), so the smallest id is the smallest path.

    Range-sorted and numbered in place; written out, because a recomputed range split could number differently.
    """
    ordered = files.select("repo", "path").distinct().repartitionByRange("repo", "path")
    return cut(ordered.sortWithinPartitions("repo", "path").withColumn("id", F.monotonically_increasing_id()))


def encode_edges(edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, int]:
    """Stored ``(s, d, n_refs)`` with its row count; edges with an end that is no known file are dropped."""
    src = ids.select("repo", F.col("path").alias("src"), F.col("id").alias("s"))
    dst = ids.select("repo", F.col("path").alias("dst"), F.col("id").alias("d"))
    return cut_counted(edges.join(src, ["repo", "src"]).join(dst, ["repo", "dst"]).select("s", "d", "n_refs"))


def named(df: DataFrame, ids: DataFrame, **columns: str) -> DataFrame:
    """Replace id columns by paths: ``named(df, ids, start="file")``. The first one also brings ``repo``."""
    for i, (col, name) in enumerate(columns.items()):
        names = ids.select(F.col("id").alias(col), F.col("path").alias(name), *(["repo"] if i == 0 else []))
        df = df.join(names, col).drop(col)
    return df.select("repo", *columns.values(), *[c for c in df.columns if c not in ("repo", *columns.values())])
