"""Path arithmetic as column expressions. Paths are '/'-separated and relative to the repository root."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _kept(segments: Column, keep_parent: bool) -> Column:
    """Drop '', '.' and resolve '..' from left to right; unmatched '..' stay when ``keep_parent``."""

    def step(acc: Column, seg: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        can_pop = (F.size(acc) > 0) & (F.coalesce(last, F.lit("")) != "..")
        popped = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        stuck = F.concat(acc, F.array(seg)) if keep_parent else acc
        return (
            F.when(seg.isin("", "."), acc)
            .when(seg == "..", F.when(can_pop, popped).otherwise(stuck))
            .otherwise(F.concat(acc, F.array(seg)))
        )

    return F.aggregate(segments, F.array().cast("array<string>"), step)


# A third '..' segment, the rest of what is dropped, and a segment with the '..' that takes it back.
_MANY_UPS = r"(?:^|/)\.\.(?:/.*)?/\.\.(?:/.*)?/\.\.(?:/|\z)"
_NOTHING = r"/(?:\.?/)+"
_TAKEN_BACK = r"(?<=/)(?!\.\./)[^/]+/\.\./"


def _shortened(path: Column) -> Column:
    """``_kept`` with its '..' as a path, by patterns where at most two '..' are in it: folding an array costs far more."""
    slashed = F.regexp_replace(F.concat(F.lit("/"), path, F.lit("/")), _NOTHING, "/")
    climbed = F.regexp_replace(F.regexp_replace(slashed, _TAKEN_BACK, ""), _TAKEN_BACK, "")
    ends = r"\A/|/\z"
    return (
        F.when(path.rlike(f"(?s){_MANY_UPS}"), F.array_join(_kept(F.split(path, "/"), True), "/"))
        .when(path.contains(".."), F.regexp_replace(climbed, ends, ""))
        .otherwise(F.regexp_replace(slashed, ends, ""))
    )


def normalize_path(path: Column) -> Column:
    """Collapse '.', '..' and empty segments. A relative path keeps '..' that climb out of the root."""
    segments = F.split(path, "/")
    return F.when(
        path.startswith("/"), F.concat(F.lit("/"), F.array_join(_kept(segments, False), "/"))
    ).otherwise(F.array_join(_kept(segments, True), "/"))


def dirname(path: Column) -> Column:
    """Directory part, '' for a file in the root."""
    above = F.length(path) - F.length(basename(path)) - 1
    return F.substring(path, F.lit(1), F.greatest(above, F.lit(0)))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Last extension of the file name in lower case, '' if there is none (a leading dot is no extension)."""
    return F.lower(F.regexp_extract(basename(path), r".(\.[^.]*)\z", 1))


def join_path(folder: Column, rest: Column) -> Column:
    return F.when(folder == "", rest).otherwise(F.concat(folder, F.lit("/"), rest))


# An empty segment or one that begins with a dot: what may have to be dropped from a path.
_ODD = r"//|/\.|\A[/.]|/\z|\A\z"


def _plain(path: Column) -> Column:
    """No segment is empty or begins with a dot, so nothing is dropped from the path.

    One pattern, which names the path once: Spark computes an expression again wherever a branch names it.
    """
    return ~path.rlike(_ODD)


def resolve_under(folder: Column, rest: Column) -> Column:
    """Normalized relative path of ``rest`` seen from ``folder`` ('' is the root).

    A plain path below a plain folder, or below the one above it, takes no pattern.
    """
    above = F.substring(folder, F.lit(1), F.length(folder) - F.length(basename(folder)))
    beside = F.substring(rest, F.lit(4), F.length(rest))
    joined = F.when(folder == "", rest).otherwise(F.concat(folder, F.lit("/"), rest))
    return (
        F.when(_plain(joined), joined)
        .when(rest.startswith("../") & _plain(folder) & _plain(beside), F.concat(above, beside))
        .otherwise(_shortened(joined))
    )


def parent_dirs(path: Column) -> Column:
    """All directories above a file, nearest first, ending with '' for the root."""
    segments = F.split(path, "/")
    depth = F.size(segments) - 1
    return F.transform(
        F.sequence(depth, F.lit(0), F.lit(-1)), lambda k: F.array_join(F.slice(segments, F.lit(1), k), "/")
    )


def relative_path(path: Column, source_dir: Column) -> Column:
    """``path`` as seen from ``source_dir``; climbs with '..' where it lies outside."""
    here = F.filter(F.split(source_dir, "/"), lambda s: s != "")
    there = F.filter(F.split(path, "/"), lambda s: s != "")
    shared = F.aggregate(
        F.sequence(F.lit(0), F.least(F.size(here), F.size(there))),
        F.lit(0),
        lambda n, i: F.when((n == i) & (F.get(here, i) == F.get(there, i)), i + 1).otherwise(n),
    )
    ups = F.array_repeat(F.lit(".."), F.size(here) - shared)
    return F.array_join(F.concat(ups, F.slice(there, shared + 1, F.size(there))), "/")


def resolve_request_path(arg: Column, project_root: Column, source_dir: Column) -> Column:
    """Path given by a user -> graph path: absolute, below the root, or below the source directory."""
    lead = basename(source_dir)
    under_root = arg.startswith(F.concat(lead, F.lit("/"))) | arg.startswith(F.concat(lead, F.lit("\\")))
    return normalize_path(
        F.when(arg.startswith("/"), arg)
        .when(under_root, join_path(project_root, arg))
        .otherwise(join_path(source_dir, arg))
    )
