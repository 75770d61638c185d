"""Which files belong to a repository's graph: discovery, languages, project roots, source folders."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import basename, dirname, extension, parent_dirs
from ..operators.languages import Language, languages
from ..session import cut, per_item

# Folders that are never searched, and files that mark a project root.
SKIP_DIRS = [
    "node_modules", ".git", "dist", "build", ".dart_tool", ".pub-cache",
    "__pycache__", ".mypy_cache", ".pytest_cache", "venv", ".venv",
    "target", "vendor", ".gradle", "bin", "obj",
    ".next", "out", ".nuxt", ".output",
]
ROOT_MARKERS = [
    ".git", "pubspec.yaml", "package.json", "tsconfig.json", "pyproject.toml", "requirements.txt", "setup.py",
    "go.mod", "Cargo.toml", "pom.xml", "build.gradle", "CMakeLists.txt", "Makefile", "Gemfile",
]
ROOT_SEARCH_DEPTH = 20

# A folder of a path that is never searched, and one that is hidden or never searched.
_SKIPPED = "|".join(map(re.escape, SKIP_DIRS))
SKIPPED_FOLDER = f"(?:^|/)(?:{_SKIPPED})/"
HIDDEN_FOLDER = rf"(?:^|/)(?:\.[^/]*|{_SKIPPED})/"

# Files that one task of a scan reads one after the other.
FILES_PER_TASK = 1000


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """``(repo, path, content, error)`` of every file below a folder that holds one sub-folder per repository.

    The names are listed first, without reading; then the contents are read apart, and what the listing has beyond them
    comes back as a row with the error ``unreadable`` and no content: files that vanished, or that a passing fault kept
    from being read. Content that is no UTF-8 has the error ``undecodable``, with replacement characters for its bytes.
    Spark's readers pass over files without a byte; those are what its listing names beyond the rows it gives.
    """

    def files(**options) -> DataFrame:
        return spark.read.format("binaryFile").option("recursiveFileLookup", True).options(**options).load(root)

    every = files()
    # These names, which Spark's listing holds on the driver, are encoded; those of the rows are not.
    encoded = every.inputFiles()
    # Spark opens some thirty small files in a task; that many tasks of no work cost more than the files.
    tasks = max(spark.sparkContext.defaultParallelism, -(-len(encoded) // FILES_PER_TASK))
    listed = cut(every.select(F.col("path").alias("uri")).coalesce(tasks))
    names = spark.createDataFrame([(name,) for name in encoded], "uri string")
    plain = F.url_decode(F.replace(F.regexp_replace("uri", "^file:/+", "file:/"), F.lit("+"), F.lit("%2B")))
    empty = names.select(plain.alias("uri")).join(listed, "uri", "left_anti")
    text = F.col("content").cast("string")
    found = files(ignoreMissingFiles=True, ignoreCorruptFiles=True).coalesce(tasks).select(
        F.col("path").alias("uri"),
        F.make_valid_utf8(text).alias("content"),
        F.when(~F.is_valid_utf8(text), F.lit("undecodable")).alias("error"),
        F.lit(True).alias("read"),
    )
    raw = listed.join(found, "uri", "left").withColumn(
        "error", F.when(F.col("read").isNull(), F.lit("unreadable")).otherwise(F.col("error"))
    )
    no_error = F.lit(None).cast("string").alias("error")
    raw = raw.select("uri", "content", "error").unionByName(empty.select("uri", F.lit("").alias("content"), no_error))
    base = root.rstrip("/") + "/"
    # The source gives paths as they are; nothing in them is encoded.
    uri = F.col("uri")
    inside = F.substring(uri, F.instr(uri, base) + len(base), F.length(uri))
    return raw.select(
        F.substring_index(inside, "/", 1).alias("repo"),
        F.regexp_replace(inside, "^[^/]*/", "").alias("path"),
        "content",
        "error",
    )


def scan_source_files(spark: SparkSession, root: str) -> DataFrame:
    """``source_files(repo, path, content)``: the files of ``scan_files`` whose content could be read."""
    return scan_files(spark, root).where("content IS NOT NULL").drop("error")


def _folders(path: Column) -> Column:
    segments = F.split(path, "/")
    return F.slice(segments, F.lit(1), F.size(segments) - 1)


def has_skipped_folder(path: Column) -> Column:
    return path.rlike(SKIPPED_FOLDER)


def _ends_with_any(path: Column, endings) -> Column:
    return reduce(Column.__or__, [path.endswith(e) for e in endings], F.lit(False))


def is_source(path: Column, lang: Language) -> Column:
    """The file name is one of the language's sources (endings are case-sensitive)."""
    return _ends_with_any(path, lang.extensions) & ~_ends_with_any(path, lang.skip_endings)


def discover_files(listing: DataFrame) -> DataFrame:
    """Files of any registered language outside skipped folders, one row per (file, language)."""
    path = F.col("path")
    marks = [F.when(is_source(path, lang), F.lit(lang.id)).otherwise(F.lit("")) for lang in languages()]
    langs = F.array_remove(F.array(*marks), F.lit(""))
    return per_item(listing.where(~has_skipped_folder(path)), langs, "lang", *[c for c in listing.columns if c != "lang"])


def language_of_file(listing: DataFrame) -> DataFrame:
    """Adds ``ext`` and ``lang`` (first registered language with the extension, null if none)."""
    ext = extension(F.col("path"))
    lang = F.lit(None).cast("string")
    for known in reversed(languages()):
        lang = F.when(ext.isin(list(known.extensions)), F.lit(known.id)).otherwise(lang)
    return listing.withColumn("ext", ext).withColumn("lang", lang)


def _hidden_or_skipped(folder: Column) -> Column:
    return folder.startswith(".") | folder.isin(SKIP_DIRS)


def detected(listing: DataFrame) -> DataFrame:
    """``(repo, lang)`` by manifest file: in the root, or for some languages also one folder down."""
    path, name = F.col("path"), basename(F.col("path"))
    folders = _folders(path)
    at_root = F.size(folders) == 0
    one_down = (F.size(folders) == 1) & ~_hidden_or_skipped(F.coalesce(F.get(folders, 0), F.lit("")))
    marks = F.array_compact(
        F.array(
            *[
                F.when(
                    name.isin(list(lang.manifests)) & (at_root | (one_down if lang.manifest_depth else F.lit(False))),
                    F.lit(lang.id),
                )
                for lang in languages()
            ]
        )
    )
    named = listing.where(name.isin(sorted({m for lang in languages() for m in lang.manifests})))
    return per_item(named, marks, "lang", "repo").distinct()


def detect_languages(listing: DataFrame) -> DataFrame:
    """``(repo, languages)``: sorted list, bounded by the number of registered languages."""
    return detected(listing).groupBy("repo").agg(F.sort_array(F.collect_set("lang")).alias("languages"))


def project_roots(listing: DataFrame) -> DataFrame:
    """``(repo, path, root)``: nearest folder at or above the file that holds a project marker.

    At most 20 folders are tested; without a hit the file's own folder is the root. A '.git' folder counts as a
    marker wherever a listed path lies inside it.
    """
    path = F.col("path")
    marker_files = listing.where(basename(path).isin(ROOT_MARKERS)).select("repo", dirname(path).alias("dir"))
    in_git = listing.where(F.concat(F.lit("/"), path).contains("/.git/")).select(
        "repo",
        F.regexp_replace(F.regexp_replace(F.concat(F.lit("/"), path), r"/\.git/.*\z", ""), "^/", "").alias("dir"),
    )
    markers = marker_files.unionByName(in_git).distinct()
    folders = listing.select("repo", dirname(path).alias("own")).distinct()
    above = folders.select(
        "repo",
        "own",
        F.posexplode(F.slice(parent_dirs(F.concat_ws("/", F.nullif(F.col("own"), F.lit("")), F.lit("x"))), 1, ROOT_SEARCH_DEPTH)).alias("up", "dir"),
    )
    nearest = above.join(markers, ["repo", "dir"]).groupBy("repo", "own").agg(F.min_by("dir", "up").alias("root"))
    return (
        listing.select("repo", "path", dirname(path).alias("own"))
        .join(nearest, ["repo", "own"], "left")
        .select("repo", "path", F.coalesce("root", "own").alias("root"))
    )


def source_dirs(listing: DataFrame, detected_langs: DataFrame | None = None) -> DataFrame:
    """``(repo, lang, source_dir)`` for every detected language; '' is the repository root.

    A path tells its first folder and which rules it meets; paths that tell the same are one row before any list is made.
    """
    path = F.col("path")
    found = detected(listing) if detected_langs is None else detected_langs
    top = F.when(path.contains("/"), F.substring_index(path, "/", 1)).otherwise(F.lit(""))
    rules = []
    for lang in languages():
        if lang.spread_dirs:
            rules.append((lang.id, 0, None, _ends_with_any(path, lang.extensions) & F.col("shown")))
        else:
            rules += [
                (lang.id, rank, d, path.startswith(d + "/")) for rank, group in enumerate(lang.source_dirs) for d in group
            ]
    met = F.array(*[F.coalesce(rule, F.lit(False)) for *_, rule in rules])
    told = listing.select("repo", "path", (~path.rlike(HIDDEN_FOLDER)).alias("shown"))
    told = told.select("repo", top.alias("top"), met.alias("met")).distinct()
    candidates = [
        F.when(
            F.get("met", i),
            F.struct(
                F.lit(lang_id).alias("lang"), F.lit(rank).alias("rank"), (F.col("top") if d is None else F.lit(d)).alias("dir")
            ),
        )
        for i, (lang_id, rank, d, _) in enumerate(rules)
    ]
    rows = per_item(told, F.array(*candidates), "c", "repo").select("repo", "c.*").distinct()
    best = rows.groupBy("repo", "lang").agg(F.min("rank").alias("rank"))
    chosen = rows.join(best, ["repo", "lang", "rank"]).select("repo", "lang", F.col("dir").alias("source_dir"))
    with_root = [lang.id for lang in languages() if lang.fallback_root or not (lang.spread_dirs or lang.source_dirs)]
    return (
        found.join(chosen, ["repo", "lang"], "left")
        .withColumn("source_dir", F.coalesce("source_dir", F.when(F.col("lang").isin(with_root), F.lit(""))))
        .where(F.col("source_dir").isNotNull())
    )


def graph_files(listing: DataFrame, dirs: DataFrame | None = None) -> DataFrame:
    """``(repo, path, lang, source_dir)``: discovered files with each source folder of their language above them."""
    dirs = source_dirs(listing) if dirs is None else dirs
    files = discover_files(listing.select("repo", "path"))
    return files.join(dirs, ["repo", "lang"]).where(
        (F.col("source_dir") == "") | F.col("path").startswith(F.concat(F.col("source_dir"), F.lit("/")))
    )
