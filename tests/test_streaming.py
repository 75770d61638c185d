"""Incremental updates against full rebuilds, in batch and as a stream with a restart."""

import datetime

from pyspark.sql import functions as F

from depgraph_spark.operators.incremental import apply_file_changes, graph_tables
from depgraph_spark.operators.resolve import dependency_edges
from depgraph_spark.sources.listing import graph_files, scan_files, scan_source_files
from depgraph_spark.sources.manifests import declared_packages, path_aliases
from depgraph_spark.streaming.changes import FILE_CHANGES, WarningLog, file_change_stream, start_state, warning_stream
from depgraph_spark.streaming.warnings import open_warning_state, open_warning_stream, read_open_warnings

TEXTS = "repo string, path string, content string"
BEFORE = {
    "package.json": "{}",
    "src/a.ts": "import './b';\nimport './c';\nimport './late';",
    "src/b.ts": "import './c';",
    "src/c/index.ts": "",
    "src/d.ts": "import './b';",
    "src/e.ts": "",
}
# c.ts outranks c/index.ts, late.ts rescues an import, b goes away, e gains an import.
FEED = [
    [("src/c.ts", "import './e';", "add", 1), ("src/late.ts", "", "add", 1), ("src/e.ts", "import './d'", "change", 3)],
    [("src/b.ts", None, "delete", 4), ("src/e.ts", "import './stale'", "change", 2), ("src/e.ts", "import './a'", "change", 5)],
    [("src/c.ts", None, "delete", 6), ("notes.txt", "import './a'", "add", 6)],
]


def at(seconds):
    return datetime.datetime(2024, 1, 1, 0, 0, seconds)


def rows_of(batch):
    return [("r", p, c, op, at(ts)) for p, c, op, ts in batch]


def after(n):
    files = dict(BEFORE)
    for batch in FEED[:n]:
        last = {}
        for p, c, op, ts in batch:
            if p not in last or ts > last[p][1]:
                last[p] = ((c, op), ts)
        for p, ((c, op), _) in last.items():
            files.pop(p, None)
            if op != "delete":
                files[p] = c
    return files


def table(spark, files):
    return spark.createDataFrame([("r", p, c) for p, c in files.items()], TEXTS)


def edge_set(df):
    return {(r["src"], r["dst"], r["n_refs"]) for r in df.collect()}


def rebuilt(spark, files):
    """Edges of a full build, with packages and aliases from the manifests among the files."""
    texts = table(spark, files)
    return edge_set(dependency_edges(texts, packages=declared_packages(texts), aliases=path_aliases(texts)))


def feed_between(before, later):
    """The changes that lead from one set of files to another."""
    rows = [(p, c, "change", 1) for p, c in later.items() if before.get(p) != c]
    return rows_of(rows + [(p, None, "delete", 1) for p in before if p not in later])


def test_apply_equals_rebuild(spark):
    tables = graph_tables(table(spark, BEFORE))
    for n, batch in enumerate(FEED[:2], 1):
        tables = apply_file_changes(tables, spark.createDataFrame(rows_of(batch), FILE_CHANGES))
        assert edge_set(tables.edges) == rebuilt(spark, after(n))
        known = {r["path"] for r in tables.files.where("known").collect()}
        assert known == {p for p in after(n) if p.endswith(".ts")}
        assert {r["path"] for r in tables.files.collect()} == set(after(n))


def test_other_files_can_win_a_stem(spark):
    """A listed file without a language's ending shadows the one with it, as in a rebuild."""
    before = {"package.json": "{}", "src/foo": "", "src/foo.ts": "", "src/a.ts": "", "src/b.ts": "import './bar'", "src/bar.ts": ""}
    later = before | {"src/a.ts": "import x from './foo'", "src/bar": "new"}
    feed = spark.createDataFrame(feed_between(before, later), FILE_CHANGES)
    tables = apply_file_changes(graph_tables(table(spark, before)), feed)
    assert edge_set(tables.edges) == rebuilt(spark, later) == set()
    assert {r["path"]: r["known"] for r in tables.files.collect()}["src/bar"] is False


# Steps that change what imports mean: folders, aliases, modules, packages and languages come, change and go.
STEPS = [
    {
        "package.json": "{}", "tsconfig.json": '{"compilerOptions": {"paths": {"@/*": ["src/*"]}}}',
        "src/a.ts": "import x from '@/b';\nimport './c';", "src/b.ts": "", "src/c.ts": "", "gen/b.ts": "",
        "go.mod": "module example.org/app\n", "cmd/m.go": 'package x\nimport "example.org/app/lib"\n', "lib/l.go": "package l\n",
        "other/m.go": 'package x\nimport "example.org/new/lib"\n', "lib/a.dart": "import 'package:one/b.dart';", "lib/b.dart": "",
        "lib/c.dart": "import 'package:two/b.dart';", "main.py": "import util\n", "util.py": "", "pkg/util.py": "", "pkg/x.py": "import util\n",
    },
    # Another alias target, module and Dart package; Python and a source folder of TypeScript appear.
    {"tsconfig.json": '{"compilerOptions": {"paths": {"@/*": ["gen/*"]}}}', "go.mod": "module example.org/new\n",
     "pubspec.yaml": "name: one\n", "setup.py": "", "web/index.ts": "import '../src/b';\nimport './lost';", "web/lost.ts": ""},
    # A renamed package; a folder, the root's Python files and manifests vanish; Rust appears.
    {"pubspec.yaml": "name: two\n", "web/index.ts": None, "web/lost.ts": None, "go.mod": None, "main.py": None, "util.py": None,
     "tsconfig.json": None, "gen/b.ts": None, "Cargo.toml": '[package]\nname = "r"\n', "src/main.rs": "mod other;\n", "src/other.rs": ""},
]


def states():
    files = {}
    for step in STEPS:
        files = {p: c for p, c in (files | step).items() if c is not None}
        yield files


def test_manifests_folders_and_packages(spark, tmp_path):
    """Each step of the stream, the last one also as a batch, equals a rebuild."""
    before, *later = states()
    tables = graph_tables(table(spark, before))
    state = start_state(spark, str(tmp_path / "state"), tables)
    assert edge_set(tables.edges) == rebuilt(spark, before) != set()
    for files in later:
        feed = spark.createDataFrame(feed_between(before, files), FILE_CHANGES)
        if files is later[-1]:
            tables = apply_file_changes(state.tables(), feed)
        feed.write.mode("append").parquet(str(tmp_path / "feed"))
        source = spark.readStream.schema(FILE_CHANGES).parquet(str(tmp_path / "feed"))
        file_change_stream(source, state, str(tmp_path / "progress")).awaitTermination()
        assert edge_set(state.current("edges")) == rebuilt(spark, files)
        before = files
    assert edge_set(tables.edges) == edge_set(state.current("edges"))
    known = {r["path"] for r in state.current("files").where("known").collect()}
    listing = table(spark, before).select("repo", "path")
    assert known == {r["path"] for r in graph_files(listing).collect()}


def test_late_rows_change_nothing(spark, tmp_path):
    state = start_state(spark, str(tmp_path / "state"), graph_tables(table(spark, BEFORE)))
    feed = str(tmp_path / "feed")
    for content, ts in (("import './c'", 9), ("import './d'", 5)):
        spark.createDataFrame(rows_of([("src/e.ts", content, "change", ts)]), FILE_CHANGES).write.mode("append").parquet(feed)
        source = spark.readStream.schema(FILE_CHANGES).parquet(feed)
        file_change_stream(source, state, str(tmp_path / "progress")).awaitTermination()
    found = {r["dst"] for r in state.current("edges").where("src = 'src/e.ts'").collect()}
    assert found == {"src/c/index.ts"}


def test_stream_restart_and_replay(spark, tmp_path):
    state = start_state(spark, str(tmp_path / "state"), graph_tables(table(spark, BEFORE)))
    feed = str(tmp_path / "feed")

    def arrive(batch):
        spark.createDataFrame(rows_of(batch), FILE_CHANGES).coalesce(1).write.mode("append").parquet(feed)

    def run(progress="progress"):
        source = spark.readStream.schema(FILE_CHANGES).parquet(feed)
        file_change_stream(source, state, str(tmp_path / progress)).awaitTermination()

    for n, batch in enumerate(FEED, 1):
        arrive(batch)
        run()
        assert edge_set(state.current("edges")) == rebuilt(spark, after(n))
    # Replaying batch 2 alone reads version 1 and writes the same version 2 again.
    again = spark.createDataFrame(rows_of(FEED[2]), FILE_CHANGES)
    redone = apply_file_changes(state.tables(before=2), again)
    assert edge_set(redone.edges) == edge_set(state.current("edges"))
    # A compacted state reads the same and takes further batches.
    short = state.compacted(str(tmp_path / "short"))
    assert edge_set(short.current("edges")) == edge_set(state.current("edges"))


def test_batches_write_what_they_touch(spark, tmp_path):
    """A batch of one file in a repository of 300 writes a few rows of each table."""
    files = {"package.json": "{}"} | {f"src/f{i}.ts": f"import './f{i + 1}'" for i in range(300)}
    state = start_state(spark, str(tmp_path / "state"), graph_tables(table(spark, files)))
    feed = str(tmp_path / "feed")
    spark.createDataFrame(rows_of([("src/f9.ts", "import './f1'", "change", 1)]), FILE_CHANGES).write.parquet(feed)
    source = spark.readStream.schema(FILE_CHANGES).parquet(feed)
    file_change_stream(source, state, str(tmp_path / "progress")).awaitTermination()
    for name in ("files", "specs", "stems", "edges", "stamps", "owners"):
        assert spark.read.parquet(str(tmp_path / "state" / name)).where("version = 0").count() <= 6
    assert ("src/f9.ts", "src/f1.ts", 1) in edge_set(state.current("edges")) and state.current("edges").count() == 299


def test_warning_stream(spark, tmp_path):
    """Imports of the moment count: one that an earlier batch added breaks, warns once, and is withdrawn on return."""
    state = start_state(spark, str(tmp_path / "state"), graph_tables(table(spark, BEFORE | {"src/c.ts": ""})))
    feed, out = str(tmp_path / "feed"), str(tmp_path / "out")
    log = WarningLog(spark, out)

    def run(rows):
        if rows:
            spark.createDataFrame(rows_of(rows), FILE_CHANGES).write.mode("append").parquet(feed)
        source = spark.readStream.schema(FILE_CHANGES).parquet(feed)
        warning_stream(source, state, out, str(tmp_path / "progress")).awaitTermination()

    run([("src/e.ts", "import './b'", "change", 1)])
    assert log.warnings().count() == 0
    # Imports of c.ts fall back to c/index.ts, so only b leaves imports that reach nothing.
    run([("src/b.ts", None, "delete", 2), ("src/d.ts", "", "change", 2), ("src/c.ts", None, "delete", 2)])
    (first,) = log.warnings().collect()
    assert (first["file"], first["broken"], first["affected"], first["risk_level"]) == ("src/b.ts", 2, 3, "LOW")
    assert first["ts"] == at(2) and "src/b.ts" in first["summary"]
    assert {r["importer"] for r in log.broken().collect()} == {"src/a.ts", "src/e.ts"}
    # As after a crash before the batch was committed: it runs again and raises the same warning.
    for name in ("1", ".1.crc"):
        (tmp_path / "progress" / "commits" / name).unlink(missing_ok=True)
    run([])
    assert log.warnings().collect() == [first]
    run([("src/b.ts", "", "add", 3)])
    assert log.warnings().count() == 0 and log.broken().count() == 0


def test_open_warnings_keep_bounded_state(spark, tmp_path):
    """Late and repeated rows, a restart, and ever new warnings: the batch twin's result, with a flat state store."""
    schema = "repo string, id bigint, arrived timestamp"
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    begin = datetime.datetime(2024, 1, 1)
    kept = {"w": [], "a": []}
    sizes = []
    for hour in range(8):
        now = begin + datetime.timedelta(hours=hour)
        news = [("r", 100 * hour + i) for i in range(50)]
        # The first two hours' acks come for what was raised earlier, some twice, some before the warning.
        acks = [("r", 100 * (hour - 2) + i) for i in range(0, 50, 3)] * 2 + [("r", 100 * (hour + 1) + 1), ("x", hour)]
        for name, rows in (("w", news + news[:5]), ("a", acks)):
            kept[name] += rows
            spark.createDataFrame([(*r, now) for r in rows], schema).write.mode("append").parquet(str(tmp_path / name))
        sources = [spark.readStream.schema(schema).parquet(str(tmp_path / n)) for n in "wa"]
        query = open_warning_stream(*sources, out, progress, keep="90 minutes", arrived="arrived")
        query.awaitTermination()
        sizes.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    twin = open_warning_state(*(spark.createDataFrame(kept[n], "repo string, id bigint") for n in "wa"))
    rows = lambda df: sorted(map(tuple, df.select("repo", "id", "seen", "acked", "open").collect()))
    assert rows(read_open_warnings(spark, out)) == rows(twin)
    assert max(sizes[3:]) <= 3 * 80 and sizes[-1] <= sizes[3] + 5


def test_open_warnings_by_the_clock(spark, tmp_path):
    for name, ids in {"w": [1, 2, 3, 3], "a": [2, 2, 9]}.items():
        rows = [("r", i) for i in ids] + [("other", 2)] * (name == "w")
        spark.createDataFrame(rows, "repo string, id bigint").write.parquet(str(tmp_path / name))
    sources = [spark.readStream.schema("repo string, id bigint").parquet(str(tmp_path / n)) for n in "wa"]
    open_warning_stream(*sources, str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()
    left = {(r["repo"], r["id"]) for r in read_open_warnings(spark, str(tmp_path / "out")).where("open").collect()}
    assert left == {("r", 1), ("r", 3), ("other", 2)}


def test_scan_reads_whole_files(spark, tmp_path):
    folder = tmp_path / "code" / "repo one" / "src"
    folder.mkdir(parents=True)
    (folder / "a+b %1.ts").write_text("line 1\nline 2\n")
    (tmp_path / "code" / "two").mkdir()
    (tmp_path / "code" / "two" / "x.py").write_text("")
    got = {(r["repo"], r["path"]): r["content"] for r in scan_source_files(spark, str(tmp_path / "code")).collect()}
    assert got[("repo one", "src/a+b %1.ts")] == "line 1\nline 2\n"
    # A file that vanishes after the listing and one that is no UTF-8 come back as rows with an error.
    (folder / "bad.ts").write_bytes(b"import './x'; \xff")
    (folder / "gone.ts").write_text("import './bad'")
    rows = scan_files(spark, str(tmp_path / "code"))
    (folder / "gone.ts").unlink()
    found = {r["path"]: (r["content"], r["error"]) for r in rows.collect()}
    assert found["src/gone.ts"] == (None, "unreadable") and found["src/bad.ts"] == ("import './x'; \ufffd", "undecodable")
    assert found["src/a+b %1.ts"][1] is None and found["x.py"] == ("", None)
