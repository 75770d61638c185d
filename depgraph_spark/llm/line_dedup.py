"""Line dedup by site spread: HyperLogLog sketches of the sites of each line, exact counts near the threshold.

A line that stands on enough distinct sites is boilerplate. Its first occurrence stays, every other one goes, so no
text vanishes from the corpus and the first of many copies stays whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_counted, small
from .common import row_keys, same_row, whole_rows

# Sites from which on a line is boilerplate: a passage of many words is no chance, a short line may be.
LONG_WORDS, LONG_SITES = 20, 3
MIN_SITES = 10
# Sketch size as a power of two, its relative error, and how many such errors around the threshold are counted exactly.
LG_K = 10
ERROR = 1.04 / 2 ** (LG_K / 2)
MARGIN = 5
SPACES = "\x20\t\n\x0b\x0c\r"


def line_key(line: Column) -> list[Column]:
    """96 bits of hash of a line without white space around it."""
    return [F.xxhash64(line).alias("h"), F.hash(line).alias("g")]


def lines_of(docs: DataFrame) -> DataFrame:
    """(_id, _text, site, pos, h, g, long) of every line with a word; a null source is a site of its own."""
    rows = row_keys(docs).select(
        "_id", "_text", F.coalesce("source", F.lit("")).alias("site"), F.posexplode(F.split("text", "\n")).alias("pos", "line")
    )
    trimmed = rows.withColumn("line", F.btrim("line", F.lit(SPACES))).where(F.col("line") != "")
    long = F.regexp_count("line", F.lit(r"[^\x20\x09-\x0D]+")) >= LONG_WORDS
    return trimmed.select("_id", "_text", "site", "pos", *line_key(F.col("line")), long.alias("long"))


def sites_needed(docs: DataFrame) -> int:
    """Sites from which on a short line is boilerplate: half of all sites, but 3 at least and ``MIN_SITES`` at most."""
    sites = docs.select(F.coalesce("source", F.lit("")).alias("site")).distinct().count()
    return min(MIN_SITES, max(LONG_SITES, -(-sites // 2)))


def boilerplate_lines(lines: DataFrame, min_sites: int, long_sites: int = LONG_SITES) -> tuple[DataFrame, int]:
    """(h, g) of the lines on at least ``min_sites`` sites (long ones ``long_sites``, if that is less), and how many there are.

    Sketches are merged by aggregation. Lines whose estimate is within MARGIN errors of the threshold are counted
    exactly; of the others the estimate decides.
    """
    least = F.when(F.col("long"), min(min_sites, long_sites)).otherwise(min_sites)
    width = F.greatest(F.lit(1.0), MARGIN * ERROR * least)
    sketches = lines.groupBy("h", "g", "long").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"))
    spread = sketches.select("h", "g", "long", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= least - width)
    spread, n = cut_counted(spread)
    is_near = F.col("sites") <= least + width
    near = spread.where(is_near).select("h", "g")
    sites = lines.select("h", "g", "long", "site").join(small(near, n), ["h", "g"], "left_semi").distinct()
    exact = sites.groupBy("h", "g", "long").agg(F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= least)
    return cut_counted(spread.where(~is_near).select("h", "g").unionByName(exact.select("h", "g")))


def without_boilerplate(docs: DataFrame, min_sites: int | None = None, long_sites: int = LONG_SITES) -> DataFrame:
    """``_row``, ``_n_lines``, ``_n_removed`` and ``_clean``, the text without repeated boilerplate lines.

    ``_row`` is the row of ``docs`` as a struct, so that its columns may have any names. A line of 20 words or more is
    boilerplate from ``long_sites`` on, a shorter one from ``min_sites`` on (by default ``sites_needed``).

    The first occurrence of a line is the one with the least (doc_id, line number), null ids first; rows that repeat
    both id and text are treated alike. Lines are compared without white space around them; lines without a word
    always stay. A null text stays null with no lines, an empty one has one line; an empty table gives no rows.
    """
    lines = lines_of(docs)
    common, n = boilerplate_lines(lines, sites_needed(row_keys(docs)) if min_sites is None else min_sites, long_sites)
    found, n_found = cut_counted(lines.join(small(common, n), ["h", "g"]).select("h", "g", "_id", "_text", "pos"))
    first = found.groupBy("h", "g").agg(F.min(F.struct("_id", "pos")).alias("first"))
    first, n_first = cut_counted(first)
    later = found.join(small(first, n_first), ["h", "g"])
    later = later.where(~F.struct("_id", "pos").eqNullSafe(F.col("first")))
    gone = later.groupBy("_id", "_text").agg(F.collect_set("pos").alias("_gone"))
    gone = gone.select(F.col("_id").alias("_doc"), F.col("_text").alias("_doc_text"), "_gone")
    keyed = whole_rows(docs)
    # No broadcast here, however few rows go: the texts are dealt out in the same way at every size.
    joined = keyed.join(gone, same_row(keyed, gone), "left")

    def kept(parts: Column) -> Column:
        places = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_gone"))
        return F.array_join(F.transform(places, lambda i: parts[i]), "\n")

    clean = F.transform(F.array(F.split("text", "\n")), kept)[0]
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n")))
    return joined.select(
        "_row",
        n_lines.cast("bigint").alias("_n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("bigint").alias("_n_removed"),
        F.when(F.col("_gone").isNull(), F.col("text")).otherwise(clean).alias("_clean"),
    )


def dedup_lines(docs: DataFrame, min_sites: int | None = None) -> DataFrame:
    """doc_id, n_lines, n_removed and text of every row; see ``without_boilerplate``."""
    rows = without_boilerplate(docs.select("doc_id", "text", "source"), min_sites)
    return rows.select(
        F.col("_row.doc_id").alias("doc_id"), F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.col("_clean").alias("text")
    )
