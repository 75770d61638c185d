"""Imports as one Spark job: texts -> specifiers -> path stems -> join with the files -> edges.

File-existence probes become one equi-join. The stems a file can answer to are generated from the *files* and the best
file per stem is chosen there, so each specifier crosses the shuffle once per stem, not once per candidate path.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import parent_dirs, resolve_under
from ..session import cut, per_item
from ..sources.listing import discover_files, graph_files, is_source, source_dirs
from .languages import languages, trim_line


_BUILT: dict[tuple, Column] = {}


def _once(name: str, build) -> Column:
    """An expression over fixed column names, built once for the registered languages: it has thousands of parts."""
    key = (name, *languages())
    if key not in _BUILT:
        _BUILT[key] = build()
    return _BUILT[key]


def _nothing(lang: Column) -> Column:
    """An empty array of strings for languages without a rule, on purpose in a form that Spark has no generated code for.

    A projection with such a part is compiled in small pieces, where all the rules as one method are too much for the
    compiler of the JVM, which then interprets them.
    """
    return F.filter(F.array(lang), lambda _: F.lit(False))


def _by_lang(lang: Column, value_of, empty: Column, ids=None) -> Column:
    out = empty
    for known in languages():
        if ids is None or known.id in ids:
            out = F.when(lang == known.id, value_of(known)).otherwise(out)
    return out


def specifiers(source_files: DataFrame, langs: list[str] | None = None) -> DataFrame:
    """``(repo, path, lang, import_no, spec)``: one scan of the texts, no shuffle.

    ``import_no`` numbers the candidate lines of a file."""
    files = discover_files(source_files)
    if langs is not None:
        files = files.where(F.col("lang").isin(langs))
    lang, line = F.col("lang"), F.col("line")
    which = ",".join(langs or ["*"])
    found = _once(f"lines {which}", lambda: _by_lang(lang, lambda k: k.lines(F.col("content")), _nothing(lang), langs))
    lines = per_item(files, found, "line", "repo", "path", "lang", place="import_no")
    lines = lines.withColumn("line", trim_line(line))
    spec = _once(f"spec {which}", lambda: _by_lang(lang, lambda k: k.spec(line), F.get(_nothing(lang), 0), langs))
    # A list of one evaluates the patterns once; a filter on the column would run them twice.
    return per_item(lines, F.array(spec), "spec", "repo", "path", "lang", "import_no").where("spec <> ''")


def import_stems(
    specs: DataFrame,
    dirs: DataFrame,
    packages: DataFrame | None = None,
    aliases: DataFrame | None = None,
    langs: list[str] | None = None,
) -> DataFrame:
    """``(repo, path, lang, source_dir, import_no, spec, ord, stem)``: where each specifier may point, best first.

    ``langs`` names the languages of ``specs``, all registered ones by default. Only files below a source folder of their language take part. This is the table to keep beside the edges for
    incremental updates: a changed file touches exactly the specifiers whose stem it can answer to.
    """
    placed = specs.join(dirs, ["repo", "lang"]).where(
        (F.col("source_dir") == "") | F.col("path").startswith(F.concat(F.col("source_dir"), F.lit("/")))
    )
    if packages is None:
        placed = placed.withColumn("package", F.lit(None).cast("string"))
    else:
        placed = placed.join(packages.select("repo", "lang", "package"), ["repo", "lang"], "left")
    package = F.coalesce("package", F.when(F.col("lang") != "go", F.col("repo")).otherwise(F.lit("")))
    cols = ["repo", "path", "lang", "source_dir", "import_no", "spec"]
    stems = _once(
        f"bases {','.join(langs or ['*'])}",
        lambda: _by_lang(
            F.col("lang"),
            lambda k: k.bases(F.col("spec"), F.col("path"), F.col("source_dir"), package),
            _nothing(F.col("lang")),
            langs,
        ),
    )
    order = F.struct(F.lit(0).cast("bigint").alias("first"), F.col("pos").cast("bigint").alias("second"))
    if aliases is not None and any(k.aliases and (langs is None or k.id in langs) for k in languages()):
        # A name that starts with an alias is looked up below the alias targets; joined on, so texts are read once.
        named = aliases.select(F.col("repo").alias("alias_repo"), F.col("ord").alias("alias_ord"), "prefix", "target_ord", "target")
        aliased = F.col("lang").isin([k.id for k in languages() if k.aliases]) & ~F.col("spec").startswith(".")
        fits = (F.col("repo") == F.col("alias_repo")) & aliased & F.col("spec").startswith(F.col("prefix"))
        placed = placed.join(named, fits, "left")
        under = _once(
            "alias", lambda: F.array(resolve_under(F.col("target"), F.expr("substring(spec, length(prefix) + 1)")))
        )
        stems = F.when(F.col("prefix").isNotNull(), under).otherwise(stems)
        cols += ["alias_ord", "target_ord"]
        by_alias = F.struct(F.col("alias_ord").cast("bigint").alias("first"), F.col("target_ord").cast("bigint").alias("second"))
        order = F.when(F.col("alias_ord").isNotNull(), by_alias).otherwise(order)
    rows = per_item(placed, stems, "stem", *cols, place="pos")
    return rows.select("repo", "path", "lang", "source_dir", "import_no", "spec", order.alias("ord"), "stem")


def answered_stems(path: Column, suffixes: tuple[str, ...]) -> Column:
    """Array of ``(rank, stem)`` that the file ``path`` satisfies for one language's suffix list, null for the others."""
    rooted = F.concat(F.lit("/"), path)
    out = []
    for rank, suffix in enumerate(suffixes):
        stem = F.expr(f"substring(path, 1, length(path) - {len(suffix)})") if suffix else path
        hit = path.endswith(suffix) if suffix else F.lit(True)
        if suffix.startswith("/"):
            hit = rooted.endswith(suffix)
            out.append(F.when(hit, F.struct(F.lit(rank).alias("rank"), F.concat(stem, F.lit("/")).alias("stem"))))
        else:
            hit = hit & (stem != "")
        out.append(F.when(hit, F.struct(F.lit(rank).alias("rank"), stem.alias("stem"))))
    return F.array(*out)


def path_stems(langs: list[str] | None = None) -> Column:
    """``language_stems`` of the columns ``path`` and ``lang``."""
    return _once(f"stems {','.join(langs or ['*'])}", lambda: language_stems(F.col("path"), F.col("lang"), langs))


def language_stems(path: Column, lang: Column, langs: list[str] | None = None) -> Column:
    """Array of ``(rank, stem)`` that the file ``path`` answers to in the language ``lang``, one of ``langs``, and nulls."""
    out = F.transform(_nothing(lang), lambda s: F.struct(F.lit(0).alias("rank"), s.alias("stem")))
    for k in languages():
        if langs is not None and k.id not in langs:
            continue
        if k.to_directory:
            above = F.transform(parent_dirs(path), lambda d: F.struct(F.lit(0).alias("rank"), d.alias("stem")))
            stems = F.when(is_source(path, k), above).otherwise(F.array().cast("array<struct<rank:int,stem:string>>"))
        else:
            stems = answered_stems(path, k.suffixes)
        out = F.when(lang == k.id, stems).otherwise(out)
    return out


def resolution_index(
    files: DataFrame, langs: DataFrame, strict_dir_shadow: bool = False, only: list[str] | None = None
) -> DataFrame:
    """``(repo, lang, stem, dst, known)``: the file each stem resolves to, for every language of the repository.

    ``only`` leaves out all languages but those named.

    ``files(repo, path[, known])``; an existing file that is no graph file still wins its stem, with known = false.
    ``strict_dir_shadow`` lets a folder win over files of a lower rank where a bare stem is tried first. Languages that
    import folders get every file of theirs below the folder.
    """
    if "known" not in files.columns:
        files = files.withColumn("known", F.lit(True))
    if only is not None:
        langs = langs.where(F.col("lang").isin(only))
    pairs = files.select("repo", "path", "known").join(langs.select("repo", "lang").distinct(), "repo")
    # A folder import keeps every file of the language below it: there the file itself is part of the key.
    spread = [k.id for k in languages() if k.to_directory]
    keys = per_item(pairs, path_stems(only), "a", "repo", "lang", "path", "known")
    keys = keys.select("repo", "lang", "path", "known", "a.rank", "a.stem")
    if strict_dir_shadow:
        bare_first = [k.id for k in languages() if len(k.suffixes) > 1 and k.suffixes[0] == ""]
        folders = pairs.where(F.col("lang").isin(bare_first)).select(
            "repo", "lang", F.explode(parent_dirs(F.col("path"))).alias("stem")
        )
        keys = keys.unionByName(
            folders.distinct().select(
                "repo", "lang", F.col("stem").alias("path"), F.lit(False).alias("known"), F.lit(0).alias("rank"), "stem"
            )
        )
    each = F.when(F.col("lang").isin(spread), F.col("path")).otherwise(F.lit("")).alias("each")
    best = keys.groupBy("repo", "lang", "stem", each).agg(F.min_by(F.struct("path", "known"), "rank").alias("best"))
    return best.select("repo", "lang", "stem", F.col("best.path").alias("dst"), F.col("best.known").alias("known"))


def resolve_imports(stems: DataFrame, index: DataFrame) -> DataFrame:
    """``(repo, src, import_no, spec, dst)``: per import the files of the first stem that exists, graph files only."""
    hits = stems.join(index, ["repo", "lang", "stem"]).withColumnRenamed("path", "src").repartition("repo", "src")
    one = Window.partitionBy("repo", "src", "source_dir", "import_no")
    return (
        hits.withColumn("first", F.min("ord").over(one))
        .where((F.col("ord") == F.col("first")) & F.col("known"))
        .select("repo", "src", "import_no", "spec", "dst")
        .dropDuplicates(["repo", "src", "import_no", "dst"])
    )


def unresolved_imports(stems: DataFrame, resolved: DataFrame) -> DataFrame:
    """``(repo, path, import_no, spec)``: imports that look internal (they have a stem) but reach no graph file."""
    done = resolved.select("repo", F.col("src").alias("path"), "import_no").distinct()
    return stems.select("repo", "path", "import_no", "spec").distinct().join(done, ["repo", "path", "import_no"], "left_anti")


def count_edges(resolved: DataFrame) -> DataFrame:
    """``edges(repo, src, dst, n_refs)``; n_refs is the number of import lines behind the edge."""
    return resolved.groupBy("repo", "src", "dst").agg(F.count(F.lit(1)).alias("n_refs"))


def dependency_edges(
    source_files: DataFrame,
    listing: DataFrame | None = None,
    packages: DataFrame | None = None,
    aliases: DataFrame | None = None,
    langs: list[str] | None = None,
    strict_dir_shadow: bool = False,
) -> DataFrame:
    """``edges(repo, src, dst, n_refs)`` of all languages from source texts; the texts are read once.

    The source folders, a few rows per repository, are written first: three joins use them, with their size known.

    ``listing(repo, path)`` is every file of the repositories (manifests included); the texts by default. ``langs`` limits
    the edges to imports in these languages; then only their expressions are part of the job.
    """
    listing = source_files.select("repo", "path") if listing is None else listing.select("repo", "path")
    dirs = cut(source_dirs(listing))
    members = graph_files(listing, dirs).select("repo", "path").distinct().withColumn("known", F.lit(True))
    files = listing.join(members, ["repo", "path"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
    stems = import_stems(specifiers(source_files, langs), dirs, packages, aliases, langs)
    index = resolution_index(files, dirs, strict_dir_shadow, langs)
    return count_edges(resolve_imports(stems, index))
