"""The dependency graph of many repositories: two tables, plus derived tables that are computed once and stored."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions.scoring import classify_risk
from .operators import graph as lookups
from .plans.components import longest_levels, strong_components
from .plans.cycles import short_cycles
from .plans.encode import assign_ids, encode_edges, named
from .plans.reach import own_bits, reach, reach_counts, spread_set
from .session import cut, cut_counted, small


class DependencyGraph:
    """``files(repo, path[, lang])`` and ``edges(repo, src, dst, n_refs)``; src imports dst, all within one repository."""

    def __init__(self, files: DataFrame, edges: DataFrame, components: DataFrame | None = None):
        """``components(repo, path, comp)`` may be given if they are known, as of a stored graph."""
        self.files = files
        self.edges = edges
        self.known_components = components

    # --- stored encodings ---

    @cached_property
    def ids(self) -> DataFrame:
        return assign_ids(self.files)

    @cached_property
    def _encoded(self) -> tuple[DataFrame, int]:
        return encode_edges(self.edges, self.ids)

    @cached_property
    def component_ids(self) -> DataFrame:
        """``(id, comp)``."""
        if self.known_components is not None:
            names = self.ids.select("repo", F.col("path").alias("comp"), F.col("id").alias("c"))
            known = self.ids.join(self.known_components.select("repo", "path", "comp"), ["repo", "path"])
            return cut(known.join(names, ["repo", "comp"]).select("id", F.col("c").alias("comp")))
        edges, rows = self._encoded
        return cut(strong_components(self.ids, edges, rows))

    @cached_property
    def component_sizes(self) -> DataFrame:
        """``(comp, size)``."""
        return cut(self.component_ids.groupBy("comp").agg(F.count(F.lit(1)).alias("size")))

    @cached_property
    def _condensed(self) -> tuple[DataFrame, int]:
        """Distinct ``(s, d)`` between different components."""
        comp = self.component_ids
        pairs = (
            self._encoded[0]
            .join(comp.select(F.col("id").alias("s"), F.col("comp").alias("sc")), "s")
            .join(comp.select(F.col("id").alias("d"), F.col("comp").alias("dc")), "d")
        )
        return cut_counted(pairs.where("sc != dc").select(F.col("sc").alias("s"), F.col("dc").alias("d")).distinct())

    def _start_ids(self, files: DataFrame) -> DataFrame:
        wanted = files.select("repo", F.col("file").alias("path")).distinct()
        return self.ids.join(wanted, ["repo", "path"]).select("id")

    # --- traversal over files ---

    def transitive_dependents(self, files: DataFrame | None = None) -> DataFrame:
        """``(repo, file, impacted, level)``: everything that imports the file directly or not, with its BFS depth."""
        edges, rows = self._encoded
        steps = edges.select(F.col("d").alias("a"), F.col("s").alias("b"))
        seeds = None if files is None else self._start_ids(files).select(F.col("id").alias("start"))
        return named(reach(steps, seeds, rows), self.ids, start="file", node="impacted")

    def check_safe(self, files: DataFrame | None = None) -> DataFrame:
        """``(repo, file, risk_level, total_impacted, direct, n_refs)`` per file (all files by default).

        Counted on components: for requested files on what they can reach, otherwise on the whole graph, once.
        """
        links = self._encoded[0].where("s != d")
        if files is None:
            totals = self._impact_totals
        else:
            starts, n = cut_counted(self._start_ids(files))
            totals = self._totals_of(self.component_ids.join(small(starts, n), "id", "left_semi"))
            links = links.join(small(starts.withColumnRenamed("id", "d"), n), "d", "left_semi")
        refs = links.groupBy(F.col("d").alias("id")).agg(
            F.count(F.lit(1)).alias("direct"), F.sum("n_refs").alias("n_refs")
        )
        out = totals.select("id", "total_impacted").join(refs, "id", "left").fillna(0)
        return named(out, self.ids, id="file").withColumn("risk_level", classify_risk(F.col("total_impacted")))

    # --- components ---

    def components(self) -> DataFrame:
        """``(repo, path, comp)``; ``comp`` is the smallest path of the component."""
        if self.known_components is not None:
            return self.known_components
        return named(self.component_ids, self.ids, id="path", comp="comp_path").withColumnRenamed("comp_path", "comp")

    def condensed(self) -> DataFrame:
        """``(repo, src_comp, dst_comp, src_cyclic, dst_cyclic)``: the acyclic graph of components."""
        edges, _ = self._condensed
        cyclic = self.component_sizes.where("size > 1").select("comp", F.lit(True).alias("cyclic"))
        flagged = (
            edges.join(cyclic.withColumnsRenamed({"comp": "s", "cyclic": "src_cyclic"}), "s", "left")
            .join(cyclic.withColumnsRenamed({"comp": "d", "cyclic": "dst_cyclic"}), "d", "left")
            .fillna(False)
        )
        return named(flagged, self.ids, s="src_comp", d="dst_comp")

    @cached_property
    def _cyclic_members(self) -> DataFrame:
        """``(id, comp, size)`` of files in a cyclic component."""
        return cut(self.component_ids.join(self.component_sizes.where("size > 1"), "comp"))

    def cyclic_clusters(self) -> DataFrame:
        """``(repo, comp, member, size)``: one row per member of every component of more than one file."""
        rows = self._cyclic_members
        return named(rows, self.ids, comp="cluster", id="member").withColumnRenamed("cluster", "comp")

    def cycles_for_files(self, changes: DataFrame) -> DataFrame:
        """``(repo, change_id, comp, file, size)``: cyclic components that a change set touches, each once.

        ``changes(repo, change_id, file[, ord])``; the first listed file (by ``ord``, else by path) stands for it.
        """
        order = F.col("ord") if "ord" in changes.columns else F.col("file")
        clusters = self.cyclic_clusters().withColumnRenamed("member", "file")
        return (
            changes.join(clusters, ["repo", "file"])
            .groupBy("repo", "change_id", "comp")
            .agg(F.min_by("file", order).alias("file"), F.first("size").alias("size"))
        )

    def bounded_cycles(self, max_length: int = 3, max_cycles: int | None = None) -> DataFrame:
        """``(repo, length, cycle)``: simple cycles of 2..max_length files, smallest file first.

        All of them, or at most ``max_cycles`` per repository, shortest and then smallest first. Only edges inside cyclic
        components take part; cycles of up to three files are found from their file with the fewest neighbours.
        """
        members = self._cyclic_members
        inner = (
            self._encoded[0].where("s != d")
            .join(members.select(F.col("id").alias("s"), F.col("comp").alias("c1")), "s")
            .join(members.select(F.col("id").alias("d"), F.col("comp").alias("c2")), "d")
            .where("c1 = c2").select("s", "d")
        )
        found = short_cycles(cut(inner), max_length)
        rows = found.withColumn("key", F.monotonically_increasing_id())
        rows = cut(rows)
        spelled = (
            rows.select("key", F.posexplode("nodes").alias("pos", "id"))
            .join(self.ids, "id")
            .groupBy("key", "repo")
            .agg(F.sort_array(F.collect_list(F.struct("pos", "path"))).alias("steps"))
            .select("repo", F.size("steps").alias("length"), F.array_join("steps.path", " -> ").alias("cycle"))
        )
        if max_cycles is None:
            return spelled
        first = Window.partitionBy("repo").orderBy("length", "cycle")
        return spelled.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= max_cycles).drop("rn")

    # --- impact on the condensed graph ---

    def _component_reach(self, starts: DataFrame | None = None) -> DataFrame:
        """``(start, node, level)`` over components, following importers."""
        edges, rows = self._condensed
        steps = edges.select(F.col("d").alias("a"), F.col("s").alias("b"))
        return reach(steps, starts, rows)

    def impact(self, files: DataFrame | None = None) -> DataFrame:
        """``(repo, file, impacted, level, is_direct)``.

        Members of the file's own cyclic component are at level 0 and direct; other files are at the distance of their
        component; direct importers are direct wherever they are.
        """
        comp = self.component_ids
        if files is None:
            starts, pairs = comp, self._component_reach()
        else:
            starts = cut(comp.join(self._start_ids(files), "id", "left_semi"))
            pairs = self._component_reach(starts.select(F.col("comp").alias("start")).distinct())
        own = starts.join(self.component_sizes.where("size > 1"), "comp", "left_semi").select(
            F.col("comp").alias("start"), F.col("comp").alias("node"), F.lit(0).alias("level")
        )
        levels = pairs.unionByName(own.distinct())
        rows = (
            levels.join(starts.select(F.col("id").alias("f"), F.col("comp").alias("start")), "start")
            .join(comp.select(F.col("id").alias("i"), F.col("comp").alias("node")), "node")
            .where("f != i")
            .select("f", "i", "level")
        )
        importers = self._encoded[0].select(F.col("d").alias("f"), F.col("s").alias("i"), F.lit(True).alias("importer"))
        rows = rows.join(importers, ["f", "i"], "left").select(
            "f", "i", "level", (F.coalesce("importer", F.lit(False)) | (F.col("level") == 0)).alias("is_direct")
        )
        return named(rows, self.ids, f="file", i="impacted")

    def _totals_of(self, starts: DataFrame | None = None) -> DataFrame:
        """``(id, comp, total_impacted, cascade_depth, cluster_size)`` of ``starts(id, comp)``, by default of every file.

        Files are bits, so a component's words count its files, and what it reaches is counted without a row per pair.
        For given starts the search is limited to the components that they reach.
        """
        edges, rows = self._condensed
        steps = edges.select(F.col("d").alias("a"), F.col("s").alias("b"))
        members = self.component_ids.select(F.col("comp").alias("node"), "id")
        if starts is None:
            starts = self.component_ids
        else:
            starts = cut(starts)
            inside = cut(spread_set(steps, starts.select(F.col("comp").alias("node"))))
            steps, rows = cut_counted(steps.join(inside.withColumnRenamed("node", "a"), "a", "left_semi"))
            members = members.join(inside, "node", "left_semi")
        own = own_bits(members.join(steps.select(F.col("b").alias("node")).distinct(), "node", "left_semi"))
        counts = reach_counts(steps, own, rows).withColumnRenamed("node", "comp")
        return cut(
            starts.join(self.component_sizes, "comp").join(counts, "comp", "left").select(
                "id", "comp",
                (F.coalesce("reached", F.lit(0)) + F.col("size") - 1).alias("total_impacted"),
                F.coalesce("depth", F.lit(0)).alias("cascade_depth"),
                F.col("size").alias("cluster_size"),
            )
        )

    @cached_property
    def _impact_totals(self) -> DataFrame:
        return self._totals_of()

    def impact_summary(self) -> DataFrame:
        """``(repo, file, total_impacted, direct, transitive, cascade_depth, cluster_size, risk_level)`` for all files."""
        comp = self.component_ids
        edges = self._encoded[0].where("s != d")
        outside = (
            edges.join(comp.select(F.col("id").alias("s"), F.col("comp").alias("sc")), "s")
            .join(comp.select(F.col("id").alias("d"), F.col("comp").alias("dc")), "d")
            .where("sc != dc")
            .groupBy(F.col("d").alias("id"))
            .agg(F.count(F.lit(1)).alias("outside"))
        )
        rows = self._impact_totals.join(outside, "id", "left").select(
            "id", "total_impacted",
            (F.coalesce("outside", F.lit(0)) + F.col("cluster_size") - 1).alias("direct"),
            "cascade_depth", "cluster_size",
        )
        rows = rows.withColumn("transitive", F.col("total_impacted") - F.col("direct"))
        return named(rows, self.ids, id="file").withColumn("risk_level", classify_risk(F.col("total_impacted")))

    def cascade_depth(self) -> DataFrame:
        """``(repo, file, cascade_depth)``: highest impact level of each file."""
        return named(self._impact_totals.select("id", "cascade_depth"), self.ids, id="file")

    def topological_levels(self) -> DataFrame:
        """``(repo, comp, level)``: 0 for components that import nothing, else one above the highest import."""
        edges, _ = self._condensed
        nodes = self.component_sizes.select(F.col("comp").alias("node"))
        levels = longest_levels(nodes, edges.select(F.col("d").alias("a"), F.col("s").alias("b")))
        return named(levels, self.ids, node="comp")

    # --- lookups ---

    def hub_files(self, top_n: int = 10) -> DataFrame:
        return lookups.hub_files(self.files, self.edges, top_n)

    def degrees(self) -> DataFrame:
        return lookups.degrees(self.files, self.edges)
