"""Quality rules with robust multivariate outlier rejection: minimum-covariance-determinant fits per language and source."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS, cut, cut_counted

SPACES = "\x20\t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
# The word window that counts as repeated if the text has it twice.
WINDOW = 3

# The transformed statistics that a fit describes.
STATS = ("log_words", "word_length", "symbols", "dup_lines", "repeats")
# Share of a group that the determinant is minimised over, and rounds of concentration.
SUPPORT = 0.75
ROUNDS = 4
# Fewer documents than this give no fit of their own: the language's is used, then that of all documents.
LEAST_GROUP = 100
# Squared robust distance beyond which a document is rejected: the 0.999 quantile of chi-square with five degrees of
# freedom, to whose median that of the distances is scaled.
CUTOFF = 20.515
# Median of chi-square with five degrees of freedom.
CHI_MEDIAN = 4.3515
# Least standard deviation of each statistic, so that one that is nearly constant can neither make the determinant
# zero nor reject a document for a line or two. Where it is constant, a document goes by it alone from four duplicate
# lines, 5.2 symbols in a hundred words or 21 % of repeated words on.
FLOORS = {"log_words": 0.05, "word_length": 0.02, "symbols": 0.05, "dup_lines": 0.35, "repeats": 0.1}
# Squared distances are ranked by bins of a hundredth of their logarithm: counts that are equal on every run.
BINS = 100.0


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def occurrences(text: Column, characters: str) -> Column:
    """How often any of ``characters`` stands in ``text``."""
    n = F.length(text)
    return sum((n - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in characters[1:]),
               n - F.length(F.replace(text, F.lit(characters[0]), F.lit(""))))


def repeated_words(words: Column) -> Column:
    """Words in three-word windows that the text has at least twice, the first included.

    Windows are compared by 64-bit hashes, sorted with their places; only texts with a repeat pay for the sort.
    """
    n = F.size(words)

    def covered(at: Column) -> Column:
        """Words below windows that begin at the ascending places ``at``."""
        steps = F.zip_with(F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))),
                           lambda after, before: F.least(after - before, F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(WINDOW), lambda total, step: total + step)

    def places(hashes: Column) -> Column:
        paired = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(sorted_pairs: Column) -> Column:
            size = F.size(sorted_pairs)
            before = F.concat(F.array(F.lit(None).cast("bigint")), F.slice(sorted_pairs, 1, size - 1)["h"])
            after = F.concat(F.slice(sorted_pairs, 2, size - 1)["h"], F.array(F.lit(None).cast("bigint")))
            near = F.arrays_zip(sorted_pairs.alias("own"), before.alias("before"), after.alias("after"))
            marked = F.filter(near, lambda x: x["own"]["h"].eqNullSafe(x["before"]) | x["own"]["h"].eqNullSafe(x["after"]))
            return F.array_sort(F.transform(marked, lambda x: x["own"]["i"]))

        return let(paired, repeated)

    def count(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(places(hashes), covered))

    def hashed(w: Column) -> Column:
        size = F.size(w)
        windows = F.arrays_zip(
            F.slice(w, 1, size - 2).alias("a"), F.slice(w, 2, size - 2).alias("b"), F.slice(w, 3, size - 2).alias("c")
        )
        return F.transform(windows, lambda x: F.xxhash64(x["a"], x["b"], x["c"]))

    return F.when(n < WINDOW, F.lit(0)).otherwise(let(hashed(words), count))


def text_statistics(docs: DataFrame, *keep: str, more: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of whole texts; a null text has no words.

    ``more`` names further statistics, each computed from the array of words.

    Words are ``[^\\x20\\x09-\\x0D]+``; duplicate lines are ``\\n``-split lines with a word, equal to an earlier line.
    """
    extra = more or {}
    text = F.coalesce("text", F.lit(""))
    words = F.array_remove(F.split(text, SPACE_RUN), "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    found = let(words, lambda w: F.struct(F.size(w).alias("n_words"), repeated_words(w).alias("n_repeat_words"),
                                               *[f(w).alias(k) for k, f in extra.items()]))
    dup = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return docs.select(
        *keep,
        found.alias("found"),
        (F.length(text) - occurrences(text, SPACES)).cast("bigint").alias("word_chars"),
        occurrences(text, SYMBOLS).cast("bigint").alias("n_symbols"),
        dup.cast("bigint").alias("n_dup_lines"),
    ).select(
        *keep,
        F.col("found.n_words").cast("bigint").alias("n_words"),
        "word_chars", "n_symbols", "n_dup_lines",
        F.col("found.n_repeat_words").cast("bigint").alias("n_repeat_words"),
        *[F.col(f"found.{k}").alias(k) for k in extra],
    )


def transformed() -> dict[str, Column]:
    """The statistics on scales where ordinary documents are roughly normal."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "log_words": F.log1p(F.col("n_words").cast("double")),
        "word_length": F.log1p(F.col("word_chars") / n),
        "symbols": F.sqrt(F.col("n_symbols") / n),
        "dup_lines": F.log1p(F.col("n_dup_lines").cast("double")),
        "repeats": F.sqrt(F.col("n_repeat_words") / n),
    }


def moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Count, means and covariances of STATS per group."""
    aggs = [F.count(F.lit(1)).alias("n")] + [F.avg(s).alias(f"m_{s}") for s in STATS]
    for i, a in enumerate(STATS):
        aggs += [F.covar_pop(a, b).alias(f"c_{a}_{b}") for b in STATS[: i + 1]]
    return rows.groupBy(*keys).agg(*aggs)


def factored(fits: DataFrame) -> DataFrame:
    """The Cholesky factor of each covariance, variances raised by the floor, as columns l_i_j."""
    for i, a in enumerate(STATS):
        for j in range(i + 1):
            value = F.col(f"c_{a}_{STATS[j]}")
            for k in range(j):
                value = value - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            if i == j:
                value = F.sqrt(F.greatest(value, F.lit(0.0)) + FLOORS[a] ** 2)
            else:
                value = value / F.col(f"l_{j}_{j}")
            fits = fits.withColumn(f"l_{i}_{j}", value)
    return fits


def squared_distance() -> Column:
    """Squared Mahalanobis distance of STATS from the fit joined to the row, by forward substitution."""
    z: list[Column] = []
    for i, s in enumerate(STATS):
        value = F.col(s) - F.col(f"m_{s}")
        for k in range(i):
            value = value - F.col(f"l_{i}_{k}") * z[k]
        z.append(value / F.col(f"l_{i}_{i}"))
    return sum((x * x for x in z[1:]), z[0] * z[0])


def quantile_bins(binned: DataFrame, keys: list[str], share: float) -> DataFrame:
    """Per group the least bin up to which at least ``share`` of the rows fall, from counts of bins."""
    counts = binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    running = Window.partitionBy(*keys).orderBy("bin")
    summed = counts.withColumn("until", F.sum("n").over(running)).withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    return summed.where(F.col("until") >= F.col("total") * share).groupBy(*keys).agg(F.min("bin").alias("cut_bin"))


def distance_bin(d2: Column) -> Column:
    return F.floor(F.log(F.greatest(d2, F.lit(1e-12))) * BINS).cast("int")


def attach(rows: DataFrame, small_side: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """Left join on non-null keys; the side of counted size is broadcast within the bound."""
    return rows.join(F.broadcast(small_side) if n <= BROADCAST_ROWS else small_side, keys, "left")


def starting_fits(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Median and interquartile spread of each statistic on its own: a start that outliers don't move."""
    bin_width = 0.01
    long = rows.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(i).alias("stat"), F.floor(F.col(s) / bin_width).cast("int").alias("bin")) for i, s in enumerate(STATS)
    ])).alias("x")).select(*keys, "x.stat", "x.bin")
    counts = long.groupBy(*keys, "stat", "bin").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy(*keys, "stat")
    summed = counts.withColumn("until", F.sum("n").over(by.orderBy("bin"))).withColumn("total", F.sum("n").over(by))
    at = {q: F.min(F.when(F.col("until") >= F.col("total") * q, F.col("bin"))) * bin_width for q in (0.25, 0.5, 0.75)}
    quartiles = summed.groupBy(*keys, "stat").agg(
        F.max("total").alias("n"), at[0.5].alias("middle"), ((at[0.75] - at[0.25]) / 1.349).alias("spread")
    )
    wide = [F.max("n").alias("n")]
    for i, a in enumerate(STATS):
        mine = F.when(F.col("stat") == i, F.col("middle")), F.when(F.col("stat") == i, F.col("spread"))
        wide += [F.max(mine[0]).alias(f"m_{a}"), F.pow(F.max(mine[1]), 2).alias(f"c_{a}_{a}")]
        wide += [F.max(F.lit(0.0)).alias(f"c_{a}_{b}") for b in STATS[:i]]
    return factored(quartiles.groupBy(*keys).agg(*wide))


def mcd_fits(rows: DataFrame, keys: list[str], enough: Column) -> tuple[DataFrame, int]:
    """A minimum-covariance-determinant fit per group with ``enough`` rows (n): centre, factor and scale; their number.

    From medians and quartile spreads, each round keeps the SUPPORT share of rows nearest to the fit and fits again,
    which never raises the determinant. Ranks come from counts of distance bins, so no group meets in one task.
    """
    fits, n = cut_counted(starting_fits(rows, keys).where(enough))
    for _ in range(ROUNDS):
        near = attach(rows, fits, n, keys).where(F.col("l_0_0").isNotNull())
        near = near.select(*keys, *STATS, distance_bin(squared_distance()).alias("bin"))
        kept = attach(near, quantile_bins(near, keys, SUPPORT), n, keys).where(F.col("bin") <= F.col("cut_bin"))
        fits, n = cut_counted(factored(moments(kept, keys)))
    near = attach(rows, fits, n, keys).where(F.col("l_0_0").isNotNull())
    near = near.select(*keys, distance_bin(squared_distance()).alias("bin"))
    middle = quantile_bins(near, keys, 0.5).select(
        *keys, F.greatest(F.exp((F.col("cut_bin") + 1) / BINS) / CHI_MEDIAN, F.lit(1.0)).alias("scale")
    )
    return cut(fits.join(middle, keys)), n


def at_level(level: int) -> Column:
    """The group of a row: its language and source, its language, or all documents."""
    none = F.substring("_lang", 1, 0)
    return F.struct(
        F.lit(level).alias("level"),
        (F.col("_lang") if level < 2 else none).alias("lang"),
        (F.col("_source") if level < 1 else none).alias("source"),
    )


def judge_documents(docs: DataFrame, cutoff: float = CUTOFF, least_group: int = LEAST_GROUP) -> DataFrame:
    """Statistics and verdict of every document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, distance and kept.

    base_failed: under 50 words, or over half of the words in repeated windows. The others are fitted per language and
    source; a group below ``least_group`` takes its language's fit, then that of all documents. ``kept`` is false if
    the base failed or the squared robust distance exceeds ``cutoff``; without any fit the base alone decides.

    A null text has no words and fails the base. Null languages and sources form groups of their own. Repeated rows
    and ids keep a row each; an empty table gives none. Columns other than doc_id, text, lang and source aren't read.
    """
    groups = {"_lang": F.coalesce("lang", F.lit("\x00")), "_source": F.coalesce("source", F.lit("\x00"))}
    stats = cut(text_statistics(docs.select("doc_id", "text", *[c.alias(k) for k, c in groups.items()]), "doc_id", *groups))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = stats.withColumns({"base_failed": failed, **transformed()})
    levels = F.explode(F.array(*map(at_level, range(3)))).alias("group")
    long = rows.where(~F.col("base_failed")).select(levels, *STATS).select("group.*", *STATS)
    keys = ["level", "lang", "source"]
    fits, n = mcd_fits(long, keys, (F.col("n") >= least_group) | (F.col("level") == 2))
    fits = fits.drop("n")
    values = [c for c in fits.columns if c not in keys]
    judged = rows
    for level in range(3):
        judged = judged.withColumn("group", at_level(level)).select("*", "group.*").drop("group")
        judged = attach(judged, fits, n, keys).withColumn(f"d_{level}", squared_distance() / F.col("scale"))
        judged = judged.drop(*keys, *values)
    distance = F.coalesce("d_0", "d_1", "d_2")
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        distance.alias("distance"),
        (~F.col("base_failed") & F.coalesce(distance <= cutoff, F.lit(True))).alias("kept"),
    )
