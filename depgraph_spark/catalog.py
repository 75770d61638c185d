"""Registered queries: each builds its inputs from the tables of a folder and runs one operator over all of them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import fixtures as fx
from .functions import complexity, layers, paths, scoring
from .graph import DependencyGraph
from .operators import coupling, gate, incremental, profile, rank, resolve
from .operators import graph as lookups
from .operators.languages import Language, lines_starting, register_language, unregister_language
from .plans import dynamic
from .session import checkpoint_dir, cut
from .sources import graph_store
from .sources import listing as scans
from .sources import manifests as texts
from .streaming import changes as streams
from .streaming import warnings as alerts

# Documents that the input of the file scan puts into one file; a file system takes far longer to make a file than to fill it.
DOCS_PER_FILE = 100

Query = Callable[[SparkSession, str], DataFrame]
_GRAPHS: dict[tuple, DependencyGraph] = {}
_TABLES: dict[tuple, incremental.GraphTables] = {}


def graph_of(spark: SparkSession, sf_dir: str) -> DependencyGraph:
    """The graph over stored edges; derived tables inside it are computed once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _GRAPHS:
        _GRAPHS[key] = DependencyGraph(fx.files(spark, sf_dir), fx.edges(spark, sf_dir))
    return _GRAPHS[key]


def corpus_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing that ``corpus`` has, from the files and manifests alone; no text is rendered for it."""
    return fx.files(spark, sf_dir).select("repo", "path").unionByName(fx.manifests(spark, sf_dir).select("repo", "path"))


def corpus(spark: SparkSession, sf_dir: str, lang: str | None = None, by_alias: bool = False):
    """Texts, listing, packages and aliases of the rendered code base."""
    sources = fx.source_files(spark, sf_dir, lang, by_alias)
    manifests = fx.manifests(spark, sf_dir, lang)
    listing = sources.select("repo", "path").unionByName(manifests.select("repo", "path"))
    return sources, listing, texts.declared_packages(manifests), texts.path_aliases(manifests)


def path_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.run(spark, sf_dir, fx.LISTING_CTES, "SELECT * FROM listing")


def _imports(lang: str | None, by_alias: bool = False) -> Query:
    def query(spark, sf_dir):
        sources, listing, packages, aliases = corpus(spark, sf_dir, lang, by_alias)
        return resolve.dependency_edges(sources, listing, packages, aliases, [lang] if lang else None)

    return query


def _graph(run: Callable[[DependencyGraph], DataFrame]) -> Query:
    return lambda spark, sf_dir: run(graph_of(spark, sf_dir))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file, as a request table."""
    return fx.files(spark, sf_dir).select("repo", F.col("path").alias("file"))


def graph_queries() -> dict[str, Query]:
    q: dict[str, Query] = {"dependency_edges": _imports(None)}
    for lang in fx.LANGS:
        q[f"imports_{lang}"] = _imports(lang)
    q["imports_typescript_alias"] = _imports("typescript", by_alias=True)
    q["reverse_dependencies"] = lambda s, d: lookups.reverse_dependencies(fx.edges(s, d))
    q["forward_dependencies"] = lambda s, d: lookups.forward_dependencies(_requests(s, d), fx.edges(s, d))
    q["direct_dependents"] = lambda s, d: lookups.direct_dependents(_requests(s, d), fx.edges(s, d))
    q["isolated_files"] = lambda s, d: lookups.isolated_files(fx.files(s, d), fx.edges(s, d))
    q["unknown_files"] = lambda s, d: lookups.unknown_files(
        path_listing(s, d).withColumnRenamed("path", "file"), fx.files(s, d)
    )
    q["degrees"] = _graph(lambda g: g.degrees())
    q["instability"] = _graph(lambda g: lookups.instability(g.degrees()))
    q["hub_files"] = _graph(lambda g: g.hub_files())

    def stats(spark, sf_dir):
        listing = corpus_listing(spark, sf_dir)
        g = graph_of(spark, sf_dir)
        return lookups.graph_stats(g.files, g.edges, g.components(), scans.detect_languages(listing))

    q["graph_stats"] = stats
    return q


def traversal_queries() -> dict[str, Query]:
    return {
        "transitive_dependents": _graph(lambda g: g.transitive_dependents()),
        "check_safe": _graph(lambda g: g.check_safe()),
        "scc": _graph(lambda g: g.components()),
        "condensed_dag": _graph(lambda g: g.condensed()),
        "cyclic_clusters": _graph(lambda g: g.cyclic_clusters()),
        "bounded_cycles": _graph(lambda g: g.bounded_cycles()),
        "impact": _graph(lambda g: g.impact()),
        "impact_summary_all": _graph(lambda g: g.impact_summary()),
        "cascade_depth": _graph(lambda g: g.cascade_depth()),
        "topological_levels": _graph(lambda g: g.topological_levels()),
    }


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for a query that writes, beside the checkpoints."""
    return f"{checkpoint_dir(spark)}/{name}/{uuid.uuid4().hex}"


def listing_queries() -> dict[str, Query]:
    def listed(run: Callable[[DataFrame], DataFrame]) -> Query:
        return lambda s, d: run(path_listing(s, d))

    def languages_of_repos(listing):
        return scans.detect_languages(listing).select("repo", F.array_join("languages", "+").alias("languages"))

    def packages(spark, sf_dir):
        manifests = fx.manifests(spark, sf_dir)
        return texts.package_names(scans.detected(manifests), manifests)

    def scanned(spark, sf_dir):
        """Every document as a line of a file of up to ``DOCS_PER_FILE``, one folder per source; the files come back whole."""
        root = scratch(spark, "scan")
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        lines = docs.select("source", F.to_json(F.struct("doc_id", "text")).alias("value"))
        lines = lines.repartition(spark.sparkContext.defaultParallelism)
        lines.write.option("maxRecordsPerFile", DOCS_PER_FILE).partitionBy("source").text(root)
        found = scans.scan_source_files(spark, root)
        line = F.explode(F.split("content", "\n")).alias("line")
        rows = found.select(F.regexp_extract("repo", "source=(.*)", 1).alias("repo"), line).where("line <> ''")
        return rows.select("repo", F.from_json("line", "doc_id bigint, text string").alias("doc")).select(
            "repo", "doc.doc_id", F.concat(F.coalesce("doc.text", F.lit("")), F.lit("\n")).alias("content")
        )

    def saved(spark, sf_dir):
        path = scratch(spark, "graph")
        graph_store.write_graph(graph_of(spark, sf_dir), path)
        return graph_store.read_graph(spark, path).edges.select("repo", "src", "dst", "n_refs")

    def normalized(spark, sf_dir):
        detour = F.concat(F.lit("./x//../y/./z/../../"), F.regexp_replace("path", "/", "/./skip/..//"))
        return fx.files(spark, sf_dir).select("repo", paths.normalize_path(detour).alias("path"))

    return {
        "scan_source_files": scanned,
        "discover_files": listed(scans.discover_files),
        "language_of_file": listed(scans.language_of_file),
        "detect_languages": listed(languages_of_repos),
        "project_roots": listed(scans.project_roots),
        "source_dirs": listed(scans.source_dirs),
        "package_names": packages,
        "path_aliases": lambda s, d: texts.path_aliases(fx.manifests(s, d)),
        "resolve_request_path": listed(
            lambda df: df.withColumn(
                "resolved", paths.resolve_request_path(F.col("path"), F.lit("app"), F.lit("app/src"))
            )
        ),
        "write_graph": saved,
        "normalize_path": normalized,
        "relative_path": listed(
            lambda df: df.withColumn("relative", paths.relative_path(F.col("path"), F.lit("src")))
        ),
    }


def import_queries() -> dict[str, Query]:
    def parts(spark, sf_dir, sources, listing, packages, aliases):
        dirs = scans.source_dirs(listing)
        stems = resolve.import_stems(resolve.specifiers(sources), dirs, packages, aliases)
        return stems, resolve.resolve_imports(stems, resolve.resolution_index(listing, dirs))

    def resolved(spark, sf_dir):
        _, rows = parts(spark, sf_dir, *corpus(spark, sf_dir))
        nth = Window.partitionBy("repo", "src", "dst").orderBy("import_no")
        return rows.select("repo", "src", "dst", F.row_number().over(nth).cast("bigint").alias("occurrence"))

    def unresolved(spark, sf_dir):
        sources, listing, packages, aliases = corpus(spark, sf_dir)
        gone = fx.deleted_files(spark, sf_dir)
        left = listing.join(gone, ["repo", "path"], "left_anti")
        stems, rows = parts(spark, sf_dir, sources, left, packages, aliases)
        return resolve.unresolved_imports(stems, rows).groupBy("repo", "path").agg(F.count(F.lit(1)).alias("n"))

    def registered(spark, sf_dir):
        """The whole code base in a language the library does not know, added for this one job."""
        added = Language(
            "rbx",
            (".rbx",),
            lines_starting("require_relative"),
            lambda line: F.regexp_extract(line, "^require_relative '([^']+)'", 1),
            lambda spec, path, _source_dir, _package: F.array(paths.resolve_under(paths.dirname(path), spec)),
            (".rbx",),
            manifests=("Rbxfile",),
        )
        sources = fx.source_files(spark, sf_dir, "ruby").withColumn("path", F.regexp_replace("path", r"\.rb$", ".rbx"))
        marks = fx.manifests(spark, sf_dir, "ruby").where(F.col("path") == "Gemfile")
        listing = sources.select("repo", "path").unionByName(marks.select("repo", F.lit("Rbxfile").alias("path")))
        register_language(added)
        try:
            return resolve.dependency_edges(sources, listing)
        finally:
            unregister_language(added.id)

    return {"resolve_imports": resolved, "unresolved_imports": unresolved, "register_language": registered}


def _warnings(spark, sf_dir) -> DataFrame:
    rows = fx.table(spark, sf_dir, "warnings", ",".join([fx.graph_ctes(), fx.GATE_CTES]))
    return rows.withColumn("broken_imports", F.array_compact(F.array("broken_import"))).drop("broken_import")


def _acks(spark, sf_dir) -> DataFrame:
    return fx.table(spark, sf_dir, "acks", ",".join([fx.graph_ctes(), fx.GATE_CTES]))


def _changes(spark, sf_dir) -> DataFrame:
    return fx.table(spark, sf_dir, "changes", ",".join([fx.graph_ctes(), fx.GATE_CTES]))


def _change_sets(spark, sf_dir) -> DataFrame:
    """Every change set with files, and per repository one without a file list and one with an empty list."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("repo"), "n_nationkey").alias("repo"))
    extra = nations.select("repo", F.explode(F.array(F.lit(-1).cast("bigint"), F.lit(-2).cast("bigint"))).alias("change_id"))
    given = _changes(spark, sf_dir).select("repo", "change_id").distinct().withColumn("has_files", F.lit(True))
    return given.unionByName(extra.withColumn("has_files", F.col("change_id") == -2))


def _commit_files(spark, sf_dir) -> DataFrame:
    return fx.table(spark, sf_dir, "commit_files", ",".join([fx.graph_ctes(), fx.COMMIT_CTES]))


def _commits(spark, sf_dir) -> DataFrame:
    return fx.table(spark, sf_dir, "commits", ",".join([fx.graph_ctes(), fx.COMMIT_CTES]))


def _coupling(spark, sf_dir) -> DataFrame:
    """Coupling over the whole history, as a stored input of the gate."""
    return fx.stored(
        spark, (sf_dir, "coupling"),
        lambda: coupling.change_coupling(_commit_files(spark, sf_dir), edges=fx.edges(spark, sf_dir)),
    )


def scalar_queries() -> dict[str, Query]:
    def complexities(spark, sf_dir):
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        rules = F.explode(F.array(*map(F.lit, fx.LANGS)))
        return docs.select("doc_id", "text", rules.alias("rules")).select(
            "doc_id", "rules", complexity.cyclomatic_complexity(F.col("text"), F.col("rules")).alias("complexity")
        )

    return {
        "classify_risk": lambda s, d: graph_of(s, d)
        .degrees()
        .select("repo", "path", "fan_in", scoring.classify_risk(F.col("fan_in")).alias("risk_level")),
        "map_severity": lambda s, d: _warnings(s, d).select(
            "repo", "id", "risk_level", scoring.map_severity(F.col("risk_level")).alias("severity")
        ),
        "classify_layer_typescript": lambda s, d: path_listing(s, d).withColumn(
            "layer", layers.typescript_layer(F.col("path"))
        ),
        "classify_layer_dart": lambda s, d: path_listing(s, d).withColumn("layer", layers.dart_layer(F.col("path"))),
        "cyclomatic_complexity": complexities,
    }


def rank_queries() -> dict[str, Query]:
    def ranks(spark, sf_dir):
        return fx.stored(spark, (sf_dir, "pagerank"), lambda: rank.pagerank(graph_of(spark, sf_dir)))

    def scores(spark, sf_dir):
        def build():
            sources, *_ = corpus(spark, sf_dir)
            found = rank.complexity_of_files(sources)
            return rank.risk_score(graph_of(spark, sf_dir), found, ranks(spark, sf_dir))

        return fx.stored(spark, (sf_dir, "scores"), build)

    return {
        "pagerank": lambda s, d: rank.pagerank(graph_of(s, d)),
        "pagerank_percentile": lambda s, d: rank.pagerank_percentile(ranks(s, d)),
        "risk_score": scores,
        "risk_action": lambda s, d: scores(s, d).select(
            "repo", "path", "composite", scoring.risk_action(F.col("composite")).alias("action")
        ),
        "hub_files_pagerank": lambda s, d: rank.hub_files_pagerank(scores(s, d), ranks(s, d)),
    }


def coupling_queries() -> dict[str, Query]:
    def percents(spark, sf_dir):
        rows = coupling.change_coupling(_commit_files(spark, sf_dir)).select(
            "repo", "file", "other",
            scoring.coupling_percent(F.col("confidence")).alias("percent"),
            scoring.coupling_severity(F.col("confidence")).alias("severity"),
        )
        return rows.where(F.col("severity").isNotNull())

    return {
        "mega_commit_filter": lambda s, d: coupling.mega_commit_filter(_commit_files(s, d)),
        "co_change_pairs": lambda s, d: coupling.co_change_pairs(_commit_files(s, d)),
        "change_coupling": lambda s, d: coupling.change_coupling(_commit_files(s, d), edges=fx.edges(s, d)),
        "hidden_coupling": lambda s, d: coupling.hidden_coupling(
            coupling.change_coupling(_commit_files(s, d), edges=fx.edges(s, d))
        ),
        "coupling_percent": percents,
        "recent_commits": lambda s, d: rank.recent_commits(_commits(s, d)),
    }


def gate_queries() -> dict[str, Query]:
    def open_warnings(spark, sf_dir):
        return gate.unacknowledged_warnings(_warnings(spark, sf_dir), _acks(spark, sf_dir))

    def renamed(spark, sf_dir):
        risk, file = F.col("risk_level"), F.col("file")
        return open_warnings(spark, sf_dir).withColumn(
            "file",
            F.when(risk == "HIGH", paths.basename(file))
            .when(risk == "MEDIUM", F.concat(F.lit("home/"), file))
            .when(risk == "LOW", F.expr("substring(file, 5)"))
            .when(risk == "SAFE", F.concat(F.lit("x"), file))
            .otherwise(file),
        )

    def found_warnings(spark, sf_dir):
        opened = open_warnings(spark, sf_dir)
        matched = gate.warnings_for_files(_changes(spark, sf_dir), opened, _change_sets(spark, sf_dir))
        return gate.warning_issues(matched, opened)

    def all_issues(spark, sf_dir):
        """Issues of the change sets with files; those without any see the warnings that ``warning_issues`` has."""
        opened, changes = open_warnings(spark, sf_dir), _changes(spark, sf_dir)
        matched = gate.warnings_for_files(changes, opened)
        return gate.gate_issues(graph_of(spark, sf_dir), changes, matched, opened, _coupling(spark, sf_dir))

    def verdict(spark, sf_dir):
        return gate.gate_verdict(
            graph_of(spark, sf_dir), _change_sets(spark, sf_dir), _changes(spark, sf_dir), _warnings(spark, sf_dir),
            _acks(spark, sf_dir), _coupling(spark, sf_dir),
        )

    return {
        "unacknowledged_warnings": lambda s, d: open_warnings(s, d).select("repo", "id", "ts", "file", "risk_level"),
        "acknowledge_warnings": lambda s, d: gate.acknowledge_warnings(
            _warnings(s, d), _acks(s, d), F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")
        ),
        "warnings_for_files": lambda s, d: gate.warnings_for_files(_changes(s, d), renamed(s, d), _change_sets(s, d)),
        "warning_issues": found_warnings,
        "cycles_for_files": lambda s, d: graph_of(s, d).cycles_for_files(_changes(s, d)),
        "cycle_issues": lambda s, d: gate.cycle_issues(graph_of(s, d), _changes(s, d)),
        "cycle_members": lambda s, d: gate.cycle_members(graph_of(s, d), _changes(s, d)),
        "hub_issues": lambda s, d: gate.hub_issues(graph_of(s, d), _changes(s, d)),
        "coupling_issues": lambda s, d: gate.coupling_issues(graph_of(s, d), _changes(s, d), _coupling(s, d)),
        "gate_issues": all_issues,
        "gate_verdict": verdict,
        "pass_acknowledgements": lambda s, d: gate.pass_acknowledgements(
            verdict(s, d), open_warnings(s, d), F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")
        ),
    }


def incremental_queries() -> dict[str, Query]:
    def deleted(spark, sf_dir):
        return fx.deleted_files(spark, sf_dir).select("repo", F.lit(1).alias("change_id"), F.col("path").alias("file"))

    def before(spark, sf_dir):
        """Tables of the first version, with the manifests among the files."""
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in _TABLES:
            sources, *_ = corpus(spark, sf_dir)
            _TABLES[key] = incremental.graph_tables(sources.unionByName(fx.manifests(spark, sf_dir)))
        return _TABLES[key]

    def applied(spark, sf_dir):
        feed = fx.file_changes(spark, sf_dir)
        return incremental.apply_file_changes(before(spark, sf_dir), feed).edges.select("repo", "src", "dst", "n_refs")

    def fed(spark, sf_dir, run):
        """The change feed in two slices of time; the stream stops after the first and starts again from its checkpoint."""
        state = streams.start_state(spark, scratch(spark, "state"), before(spark, sf_dir))
        folder, progress = scratch(spark, "feed"), scratch(spark, "progress")
        feed = fx.file_changes(spark, sf_dir)
        late = F.col("ts") >= F.lit("2024-01-02").cast("timestamp")
        for part in (feed.where(~late), feed.where(late)):
            part.write.mode("append").parquet(folder)
            source = spark.readStream.schema(streams.FILE_CHANGES).parquet(folder)
            run(source, state, progress).awaitTermination()
        return state

    def streamed(spark, sf_dir):
        state = fed(spark, sf_dir, streams.file_change_stream)
        return state.current("edges").select("repo", "src", "dst", "n_refs")

    def warned(spark, sf_dir):
        out = scratch(spark, "warned")
        fed(spark, sf_dir, lambda source, state, progress: streams.warning_stream(source, state, out, progress))
        return streams.WarningLog(spark, out).broken().select("repo", "file", "importer")

    def open_state(spark, sf_dir):
        """Half of both tables, then the rest with every ack of the first half once more, after a restart."""
        folder, out, progress = (scratch(spark, n) for n in ("warnings", "open", "progress"))
        warnings, acks = (t(spark, sf_dir).select("repo", "id") for t in (_warnings, _acks))
        first = F.pmod(F.xxhash64("repo", "id"), F.lit(2)) == 0
        for w, a in ((warnings.where(first), acks.where(~first)), (warnings.where(~first), acks.unionByName(acks.where(first)))):
            w.write.mode("append").parquet(f"{folder}/w")
            a.write.mode("append").parquet(f"{folder}/a")
            sources = [spark.readStream.schema("repo string, id bigint").parquet(f"{folder}/{n}") for n in "wa"]
            alerts.open_warning_stream(*sources, out, progress).awaitTermination()
        return alerts.read_open_warnings(spark, out)

    def components_of_edited(spark, sf_dir):
        """The second version's components, from the first version's and the difference of the edges."""
        old, new = fx.edges(spark, sf_dir), fx.edited_edges(spark, sf_dir)
        gone = fx.deleted_files(spark, sf_dir)
        files = fx.files(spark, sf_dir).select("repo", "path").join(gone, ["repo", "path"], "left_anti")
        diff = incremental.edge_diff(old, new)
        return dynamic.updated_components(cut(graph_of(spark, sf_dir).components()), files, new, diff)

    def ranks_of_edited(spark, sf_dir):
        """The second version's ranks, from the first version's stored walks and the difference of the edges."""
        old, new = fx.edges(spark, sf_dir), fx.edited_edges(spark, sf_dir)
        gone = fx.deleted_files(spark, sf_dir)
        files = fx.files(spark, sf_dir).select("repo", "path").join(gone, ["repo", "path"], "left_anti")
        first = cut(rank.pagerank_state(graph_of(spark, sf_dir)))
        return rank.updated_pagerank(first, files, new, incremental.edge_diff(old, new))[1]

    def refreshed(spark, sf_dir):
        sources, listing, packages, aliases = corpus(spark, sf_dir)
        return incremental.refresh_graph(sources, listing, scratch(spark, "refresh"), packages, aliases)

    return {
        "updated_components": components_of_edited,
        "updated_pagerank": ranks_of_edited,
        "edge_diff": lambda s, d: incremental.edge_diff(fx.edges(s, d), fx.edited_edges(s, d)),
        "invalidation_set": lambda s, d: incremental.invalidation_set(fx.edges(s, d), fx.edited_edges(s, d)),
        "broken_imports": lambda s, d: incremental.broken_imports(fx.edges(s, d), deleted(s, d)),
        "broken_import_warnings": lambda s, d: incremental.broken_import_warnings(graph_of(s, d), deleted(s, d)),
        "apply_file_changes": applied,
        "refresh_graph": refreshed,
        "file_change_stream": streamed,
        "warning_stream": warned,
        "open_warning_state": open_state,
    }


def profile_queries() -> dict[str, Query]:
    def overview(spark, sf_dir):
        sources, *_ = corpus(spark, sf_dir)
        newlines = F.length("content") - F.length(F.replace(F.col("content"), F.lit("\n"), F.lit("")))
        lines = sources.select("repo", "path", (newlines + 1).alias("lines"))
        g = graph_of(spark, sf_dir)
        cyclic = g.cyclic_clusters().select("repo", F.col("member").alias("path"))
        return profile.project_profile(g.files, g.edges, lines, cyclic)

    def context(spark, sf_dir):
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.lit("o"), "doc_id").alias("name"), "text")
        bodies = fx.named_files(spark, sf_dir).join(docs, "name", "left")
        bodies = bodies.select("repo", "path", F.coalesce("text", F.lit("")).alias("content"))
        rows = profile.analysis_context(bodies, fx.edges(spark, sf_dir))
        return rows.select("repo", "path", "dependent", F.md5(F.encode("content", "UTF-8")).alias("content_md5"))

    return {"project_profile": overview, "analysis_context": context}


def all_queries() -> dict[str, Query]:
    return {
        **listing_queries(),
        **graph_queries(),
        **import_queries(),
        **scalar_queries(),
        **traversal_queries(),
        **rank_queries(),
        **coupling_queries(),
        **gate_queries(),
        **incremental_queries(),
        **profile_queries(),
    }
