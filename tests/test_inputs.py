"""What the registered queries read, and path arithmetic by patterns."""

import random

import pytest
from pyspark.sql import functions as F

from depgraph_spark import catalog
from depgraph_spark import fixtures as fx
from depgraph_spark.functions.paths import _kept, resolve_under

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "name", ["graph_stats", "broken_imports", "broken_import_warnings", "updated_components", "updated_pagerank"]
)
def test_no_texts_are_rendered_for(spark, monkeypatch, name):
    def fail(*_, **__):
        raise AssertionError("texts rendered")

    monkeypatch.setattr(fx, "_STORED", {})
    monkeypatch.setattr(catalog, "_GRAPHS", {})
    monkeypatch.setattr(fx, "_render", fail)
    assert catalog.all_queries()[name](spark, SF_DIR).columns[0] == "repo"


def test_deleted_files_are_those_of_the_feed(spark):
    feed = fx.file_changes(spark, SF_DIR).where("op = 'delete'").select("repo", "path")
    gone = fx.deleted_files(spark, SF_DIR)
    assert sorted(map(tuple, gone.collect())) == sorted(map(tuple, feed.collect())) != []


def test_listing_is_that_of_the_texts(spark):
    _, listing, _, _ = catalog.corpus(spark, SF_DIR)
    assert sorted(map(tuple, catalog.corpus_listing(spark, SF_DIR).collect())) == sorted(map(tuple, listing.collect()))


def test_patterns_resolve_as_the_fold_does(spark):
    draw = random.Random(5)
    parts = ["", "a", "..", ".", "b.c", "...", "..x", "x..", "\n", "a b"]
    rows = [
        ["/".join(draw.choice(parts) for _ in range(draw.randrange(n))) for n in (6, 7)] for _ in range(5000)
    ] + [[None, "a"], ["a", None]]
    whole = F.concat("folder", F.lit("/"), "rest")
    both = spark.createDataFrame(rows, "folder string, rest string").select(
        "folder", "rest",
        resolve_under(F.col("folder"), F.col("rest")).alias("got"),
        F.array_join(_kept(F.split(whole, "/"), True), "/").alias("want"),
    )
    assert both.where("NOT got <=> want").collect() == []


def test_only_edited_files_are_rendered_for_the_feed(spark, monkeypatch):
    rendered, render = [], fx._render

    def recorded(*args, **options):
        rendered.append(render(*args, **options))
        return rendered[-1]

    monkeypatch.setattr(fx, "_STORED", {})
    monkeypatch.setattr(fx, "_render", recorded)
    edits = fx.file_changes(spark, SF_DIR).where("op = 'change' AND ts >= '2024-01-02'").select("repo", "path")
    assert len(rendered) == 1
    assert sorted(map(tuple, rendered[0].select("repo", "path").collect())) == sorted(map(tuple, edits.collect())) != []


def test_graph_inputs_are_counted_as_numbers(spark, monkeypatch):
    written, cut = [], fx.cut

    def recorded(df):
        written.append(df)
        return cut(df)

    monkeypatch.setattr(fx, "_STORED", {})
    monkeypatch.setattr(fx, "cut", recorded)
    found = {
        "edges": fx.edges(spark, SF_DIR),
        "edited": fx.edited_edges(spark, SF_DIR),
        "files": fx.named_files(spark, SF_DIR),
    }
    for name, got in found.items():
        table = "files" if name == "files" else "edges"
        want = fx.run(spark, SF_DIR, fx.graph_ctes(edited=name == "edited"), f"SELECT * FROM {table}")
        assert got.columns == want.columns
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and not got.isEmpty()
    # No path goes through a shuffle or a stored table: only the letters of the kinds stand beside the numbers.
    assert len(written) == 3
    for df in written:
        assert {c for c, kind in df.dtypes if kind == "string"} <= {"x", "y", "kind"}


def test_scanned_files_grow_with_blocks_of_documents(spark, tmp_path, monkeypatch):
    texts = ["a\nb\n", "", None, "\\n \"q\" \x00\x01   \U0001f600\r\n", *[f"t {i}" for i in range(2000)]]
    rows = [(i, text, "s t%" if i % 2 else "u") for i, text in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    scan, scanned = catalog.scans.scan_source_files, []
    monkeypatch.setattr(catalog.scans, "scan_source_files", lambda *args: scanned.append(scan(*args)) or scanned[0])
    got = catalog.all_queries()["scan_source_files"](spark, str(tmp_path)).select("doc_id", "content").collect()
    assert sorted(map(tuple, got)) == [(i, (text or "") + "\n") for i, text, _ in rows]
    assert scanned[0].count() <= len(texts) / catalog.DOCS_PER_FILE + 2 * spark.sparkContext.defaultParallelism


def test_import_rules_run_outside_generators(spark):
    """Spark interprets what stands inside a generator, if any part of it has no generated code."""
    texts = spark.createDataFrame([("r", "src/a.py", "import b\n"), ("r", "go.mod", "module m\n")], "repo string, path string, content string")
    dirs = catalog.scans.source_dirs(texts)
    specs = catalog.resolve.specifiers(texts)
    steps = [
        catalog.scans.discover_files(texts), dirs, specs,
        catalog.resolve.import_stems(specs, dirs), catalog.resolve.resolution_index(texts.select("repo", "path"), dirs),
    ]
    for step in steps:
        plan = step._jdf.queryExecution().optimizedPlan().toString().splitlines()
        made = [line.split("Generate ", 1)[1] for line in plan if "Generate " in line]
        assert made and all(line.startswith(("explode(_items#", "posexplode(_items#")) for line in made)


def test_paths_that_tell_the_same_are_one_row_before_folders_are_listed(spark):
    rows = [("r", f"{top}f{i}{end}") for top in ("src/", "lib/x/", ".h/", "a/dist/", "") for i in range(50) for end in (".py", ".rs")]
    marks = [("r", "setup.py"), ("r", "Cargo.toml"), ("r", "sub/pubspec.yaml")]
    found = catalog.scans.source_dirs(spark.createDataFrame(rows + marks, "repo string, path string"))
    want = {("r", "python", "src"), ("r", "python", "lib"), ("r", "python", ""), ("r", "rust", "src")}
    assert sorted(map(tuple, found.select("repo", "lang", "source_dir").collect())) == sorted(want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "array_remove(transform" not in plan and "exists(slice" not in plan


def test_texts_are_laid_out_as_numbers(spark):
    plan = fx._render(spark, SF_DIR, None, False)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(n#" in plan
    assert not any(f"hashpartitioning({column}#" in plan for column in ("repo", "name", "src_name"))


def test_difference_of_versions_is_computed_once(spark):
    names = "repo string, src string, dst string, n_refs bigint"
    old = spark.createDataFrame([("r", "a", "b", 1), ("r", "b", "a", 1), ("r", "c", "d", 1)], names)
    new = spark.createDataFrame([("r", "a", "b", 1), ("r", "b", "c", 1), ("r", "c", "d", 1), ("r", "d", "b", 1)], names)
    files = spark.createDataFrame([("r", p) for p in "abcd"], "repo string, path string")
    graph, seen = catalog.DependencyGraph(files, old), spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    diff = catalog.incremental.edge_diff(old, new)
    n, diff = diff.count(), diff.mapInArrow(counted, diff.schema)
    comps = catalog.dynamic.updated_components(graph.components(), files, new, diff)
    assert sorted(map(tuple, comps.collect())) == [("r", "a", "a"), ("r", "b", "b"), ("r", "c", "b"), ("r", "d", "b")]
    assert seen.value == n == 3
    ranks = catalog.rank.updated_pagerank(catalog.rank.pagerank_state(graph), files, new, diff)[1].collect()
    want = catalog.rank.pagerank(catalog.DependencyGraph(files, new)).collect()
    assert {r["path"]: r["pagerank"] for r in ranks} == pytest.approx({r["path"]: r["pagerank"] for r in want}, abs=1e-8)
    assert seen.value == 2 * n


def test_refresh_reads_texts_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [("r", "lib/a.rb", "require_relative 'b'\n"), ("r", "lib/b.rb", ""), ("r", "Gemfile", "")]
    texts = spark.createDataFrame(rows, "repo string, path string, content string")
    listing = texts.select("repo", "path")
    got = catalog.incremental.refresh_graph(texts.mapInArrow(counted, texts.schema), listing, str(tmp_path / "g"))
    assert [(r["files"], r["edges"], r["components"]) for r in got.collect()] == [(2, 1, 2)]
    assert seen.value == len(rows)
