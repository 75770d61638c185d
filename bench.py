"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Inputs (rendered texts, edges, commits, warnings) are written before the clock starts; coupling is mined on the clock.
The graph queries share one graph, as a user would: ``encode`` numbers its files, ``scc`` uses that,
``impact_summary_all`` uses both.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession

from depgraph_spark import catalog
from depgraph_spark import fixtures as fx
from depgraph_spark.operators import rank


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("depgraph-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def consume(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    spark = session()
    began = time.perf_counter()
    sources, *_ = catalog.corpus(spark, sf_dir)
    n_files, n_edges = sources.count(), fx.edges(spark, sf_dir).count()
    graph = catalog.graph_of(spark, sf_dir)
    graph.files.count()
    for table in (catalog._changes, catalog._warnings, catalog._acks, catalog._commit_files):
        table(spark, sf_dir).count()
    setup = time.perf_counter() - began

    queries = catalog.all_queries()
    steps = {
        "dependency_edges": lambda: consume(queries["dependency_edges"](spark, sf_dir)),
        "encode": lambda: graph._encoded,
        "scc": lambda: consume(graph.components()),
        "impact_summary_all": lambda: consume(graph.impact_summary()),
        "pagerank": lambda: consume(rank.pagerank(graph)),
        "co_change_pairs": lambda: consume(queries["co_change_pairs"](spark, sf_dir)),
        "gate_verdict": lambda: consume(queries["gate_verdict"](spark, sf_dir)),
    }
    seconds = {}
    for name, step in steps.items():
        start = time.perf_counter()
        step()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(sf_dir.rsplit("sf", 1)[-1]),
                "files": n_files,
                "edges": n_edges,
                "setup_seconds": round(setup, 3),
                "spark": spark.version,
                "cpus": spark.sparkContext.defaultParallelism,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
