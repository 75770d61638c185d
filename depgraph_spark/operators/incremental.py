"""Keeping a graph current: diffs, dangling imports, partial re-resolution, full refresh."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import classify_risk
from ..graph import DependencyGraph
from ..plans.encode import assign_ids
from ..plans.reach import spread_set
from ..session import cut, cut_counted, per_item, small
from ..sources.listing import discover_files, graph_files, source_dirs
from ..sources.manifests import declared_packages, is_manifest, path_aliases
from .languages import languages
from .resolve import count_edges, import_stems, path_stems, resolution_index, resolve_imports, specifiers


def edge_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(repo, src, dst, change)`` with change = added / removed; both versions meet in one aggregation."""
    key = ["repo", "src", "dst"]
    tagged = old.select(*key, F.lit(1).alias("was"), F.lit(0).alias("now")).unionByName(
        new.select(*key, F.lit(0).alias("was"), F.lit(1).alias("now"))
    )
    sides = tagged.groupBy(*key).agg(F.max("was").alias("was"), F.max("now").alias("now")).where("was <> now")
    return sides.select(*key, F.when(F.col("now") == 1, F.lit("added")).otherwise(F.lit("removed")).alias("change"))


def invalidation_set(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(repo, path)``: files whose set of dependents may differ between two versions of the edges.

    An edge matters to the file it points at and to everything that file imports, directly or not.
    """
    key = ["repo", "src", "dst"]
    either = old.select(*key).unionByName(new.select(*key)).distinct()
    ends = either.select("repo", F.explode(F.array("src", "dst")).alias("path"))
    ids = assign_ids(ends)
    src = ids.select("repo", F.col("path").alias("src"), F.col("id").alias("a"))
    dst = ids.select("repo", F.col("path").alias("dst"), F.col("id").alias("b"))
    steps = either.join(src, ["repo", "src"]).join(dst, ["repo", "dst"]).select("a", "b")
    seeds = edge_diff(old, new).join(dst, ["repo", "dst"]).select(F.col("b").alias("node"))
    return ids.join(spread_set(steps, seeds).withColumnRenamed("node", "id"), "id").select("repo", "path")


def broken_imports(edges: DataFrame, deleted: DataFrame, present: DataFrame | None = None) -> DataFrame:
    """``(repo, change_id, file, importer)``: surviving files whose import of a deleted file now dangles.

    ``deleted(repo, change_id, file)``; ``present(repo, file)`` are paths that exist again after the change.
    """
    gone = deleted.select("repo", "change_id", "file")
    if present is not None:
        gone = gone.join(present.select("repo", "file"), ["repo", "file"], "left_anti")
    links = edges.select("repo", F.col("dst").alias("file"), F.col("src").alias("importer"))
    survivors = deleted.select("repo", "change_id", F.col("file").alias("importer"))
    return gone.join(links, ["repo", "file"]).join(survivors, ["repo", "change_id", "importer"], "left_anti")


def broken_import_warnings(graph: DependencyGraph, deleted: DataFrame, present: DataFrame | None = None) -> DataFrame:
    """``(repo, change_id, file, broken, affected, risk_level)``: one warning per deleted file that is still imported."""
    counts = broken_imports(graph.edges, deleted, present).groupBy("repo", "change_id", "file").agg(
        F.count(F.lit(1)).alias("broken")
    )
    reach = graph.check_safe(counts.select("repo", "file").distinct()).select(
        "repo", "file", F.col("total_impacted").alias("affected")
    )
    return counts.join(reach, ["repo", "file"]).withColumn("risk_level", classify_risk(F.col("affected")))


def latest_changes(changes: DataFrame) -> DataFrame:
    """The newest row per file of ``file_changes(repo, path, content, op, ts)``; ties go by op, then content."""
    last = F.max(F.struct("ts", "op", "content")).alias("last")
    return changes.groupBy("repo", "path").agg(last).select("repo", "path", "last.content", "last.op", "last.ts")


def stems_answered_by(paths: DataFrame) -> DataFrame:
    """``(repo, path, lang, stem)`` that each of ``paths(repo, path)`` could be the answer to, in any language."""
    every = F.explode(F.array(*[F.lit(k.id) for k in languages()]))
    rows = paths.select("repo", "path", every.alias("lang"))
    stems = per_item(rows, path_stems(), "a", "repo", "path", "lang")
    return stems.select("repo", "path", "lang", "a.stem").distinct()


@dataclass(frozen=True)
class GraphTables:
    """What a graph is kept current from; every row belongs to one file, its owner.

    ``files(repo, path, known)`` is the whole listing (known: a graph file), ``manifests(repo, path, content)`` the texts
    that name packages and aliases, ``specs`` every import line's specifier, ``stems`` where each may point, ``edges``.
    """

    files: DataFrame
    manifests: DataFrame
    specs: DataFrame
    stems: DataFrame
    edges: DataFrame


# The column that names a row's owner.
OWNERS = {"files": "path", "manifests": "path", "specs": "path", "stems": "path", "edges": "src"}


@dataclass(frozen=True)
class GraphDelta:
    """Per table the files whose rows are replaced, ``owners[name](repo, path)``, and their new rows, if any.

    ``stems`` and ``resolved`` are the imports that were looked up again; ``gone`` are graph files that were deleted.
    """

    owners: dict[str, DataFrame]
    rows: dict[str, DataFrame]
    stems: DataFrame
    resolved: DataFrame
    gone: DataFrame

    def applied(self, tables: GraphTables) -> GraphTables:
        whole = {}
        for name, owner in OWNERS.items():
            replaced = self.owners[name].withColumnRenamed("path", owner)
            kept = getattr(tables, name).join(replaced, ["repo", owner], "left_anti")
            whole[name] = kept.unionByName(self.rows[name])
        return GraphTables(**whole)

    def dangling(self) -> DataFrame:
        """``(repo, file, importer)``: imports that a deleted file could answer and that reach nothing any more."""
        done = self.resolved.select("repo", F.col("src").alias("path"), "import_no").distinct()
        lost = self.stems.join(done, ["repo", "path", "import_no"], "left_anti")
        answers = stems_answered_by(self.gone).withColumnRenamed("path", "file")
        found = lost.join(answers, ["repo", "lang", "stem"])
        return found.select("repo", "file", F.col("path").alias("importer")).distinct()


def _manifests(texts: DataFrame) -> DataFrame:
    return texts.where(is_manifest(F.col("path"))).select("repo", "path", "content")


def graph_tables(source_files: DataFrame) -> GraphTables:
    """All tables from ``source_files(repo, path, content)``, every listed file of the repositories."""
    listing = source_files.select("repo", "path").distinct()
    manifests = cut(_manifests(source_files))
    dirs = cut(source_dirs(listing))
    members = graph_files(listing, dirs).select("repo", "path").distinct().withColumn("known", F.lit(True))
    files = cut(listing.join(members, ["repo", "path"], "left").fillna(False, ["known"]))
    specs = cut(specifiers(source_files))
    stems = cut(import_stems(specs, dirs, declared_packages(manifests), path_aliases(manifests)))
    edges = cut(count_edges(resolve_imports(stems, resolution_index(files, dirs))))
    return GraphTables(files, manifests, specs, stems, edges)


def _differing(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Distinct keys of rows that only one of two tables has."""
    columns = old.columns
    tagged = old.select(*columns, F.lit(-1).alias("_way")).unionByName(new.select(*columns, F.lit(1).alias("_way")))
    return tagged.groupBy(*columns).agg(F.sum("_way").alias("_way")).where("_way <> 0").select(*keys).distinct()


def change_graph(tables: GraphTables, changes: DataFrame) -> GraphDelta:
    """What a batch of added, changed and deleted files replaces; applied, it equals a full rebuild.

    Only the repositories in the batch are looked at, and only touched rows are written. Texts of the batch are read
    again. The source folders, packages and aliases are derived from the listing and the manifests before and after; a
    language of a repository for which they differ has its kept specifiers placed again, without its texts. Every other
    file keeps its edges unless one of its stems could be answered by a path that came, went, or became or ceased to be
    a graph file: a new file can outrank or rescue a target, a deleted one lets it fall back.
    """
    last = cut(latest_changes(changes))
    key = ["repo", "path"]
    repos = last.select("repo").distinct()
    old = {name: getattr(tables, name).join(repos, "repo", "left_semi") for name in OWNERS}
    gone = last.where(F.col("op") == "delete").select(*key)
    texts = last.where(F.col("op") != "delete").select(*key, "content")
    listed = old["files"].select(*key)
    listing = cut(listed.join(gone, key, "left_anti").unionByName(texts.select(*key)).distinct())
    changed = last.select(*key)
    manifests = cut(old["manifests"].join(changed, key, "left_anti").unionByName(_manifests(texts)))

    # Folders, packages and aliases, a few rows per repository, before and after.
    was = [cut(source_dirs(listed)), declared_packages(old["manifests"]), path_aliases(old["manifests"])]
    dirs, packages, aliases = now = [cut(source_dirs(listing)), declared_packages(manifests), path_aliases(manifests)]
    aliased = F.explode(F.array(*[F.lit(k.id) for k in languages() if k.aliases]))
    shifted = (
        _differing(was[0], now[0], "repo", "lang")
        .unionByName(_differing(was[1], now[1], "repo", "lang"))
        .unionByName(_differing(was[2], now[2], "repo").select("repo", aliased.alias("lang")))
        .distinct()
    )
    shifted, n_shifted = cut_counted(shifted)
    shifted = small(shifted, n_shifted)

    looked_at = texts.select(*key).unionByName(discover_files(listing).join(shifted, ["repo", "lang"]).select(*key)).distinct()
    members = graph_files(looked_at, dirs).select(*key).distinct().withColumn("known", F.lit(True))
    before = old["files"].select(*key, F.col("known").alias("was"))
    files = cut(
        looked_at.join(members, key, "left").fillna(False, ["known"])
        .join(before, key, "left").where("was IS NULL OR was <> known").select(*key, "known")
    )
    moved_files = files.select(*key).unionByName(gone).distinct()

    fresh = cut(specifiers(texts))
    specs = old["specs"].join(changed, key, "left_anti").unionByName(fresh)
    replaced = cut(
        changed.unionByName(old["stems"].join(shifted, ["repo", "lang"], "left_semi").select(*key))
        .unionByName(specs.join(shifted, ["repo", "lang"], "left_semi").select(*key))
        .distinct()
    )
    placed = cut(import_stems(specs.join(replaced, key, "left_semi"), dirs, packages, aliases))
    stems = old["stems"].join(replaced, key, "left_anti").unionByName(placed)
    moved = cut(stems_answered_by(moved_files).select("repo", "lang", "stem").distinct())
    touched = cut(replaced.unionByName(stems.join(moved, ["repo", "lang", "stem"], "left_semi").select(*key)).distinct())
    again = cut(stems.join(touched, key, "left_semi"))
    wanted = again.select("repo", "lang", "stem").distinct()
    kept = old["files"].join(moved_files, key, "left_anti")
    index = resolution_index(kept.unionByName(files), dirs).join(wanted, ["repo", "lang", "stem"], "left_semi")
    resolved = cut(resolve_imports(again, index))
    return GraphDelta(
        owners={
            "files": moved_files, "manifests": changed, "specs": changed, "stems": replaced,
            "edges": touched.unionByName(gone).distinct(),
        },
        rows={
            "files": files, "manifests": _manifests(texts), "specs": fresh, "stems": placed, "edges": count_edges(resolved),
        },
        stems=again,
        resolved=resolved,
        gone=gone.join(before.where("was"), key, "left_semi"),
    )


def apply_file_changes(tables: GraphTables, changes: DataFrame) -> GraphTables:
    """The tables after a batch of added, changed and deleted files; equal to a full rebuild, manifests included."""
    return change_graph(tables, changes).applied(tables)


def refresh_graph(
    source_files: DataFrame,
    listing: DataFrame,
    path: str,
    packages: DataFrame | None = None,
    aliases: DataFrame | None = None,
) -> DataFrame:
    """Rebuild everything from the texts, replace the stored graph below ``path``, and return its counts.

    Components are found from the edges before these are stored, so the edges are written once first, not resolved twice.
    """
    from ..sources.graph_store import read_graph, write_graph
    from ..sources.listing import detect_languages, graph_files
    from .graph import graph_stats
    from .resolve import dependency_edges

    files = cut(graph_files(listing).select("repo", "path", "lang").distinct())
    edges = cut(dependency_edges(source_files, listing, packages, aliases))
    write_graph(DependencyGraph(files, edges), path, mode="overwrite")
    stored = read_graph(source_files.sparkSession, path)
    return graph_stats(stored.files, stored.edges, stored.components(), detect_languages(listing))
