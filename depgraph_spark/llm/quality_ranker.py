"""Quality classifier by pairwise ranking: a Bradley-Terry model over text statistics.

Each training pair is a preferred and a rejected document. The logistic loss on their feature differences gives a
utility; a quantile of the utilities of labelled documents is the threshold, and a document's score is the modelled
probability that it would be preferred to a document at the threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS, cut, cut_counted, small
from .common import crc_remainder
from .quality_rules import text_statistics, transformed

# Few documents are paired several times, up to this many pairs; others once each.
PAIRS = 40_000
RIDGE = 1e-3
STEPS = 30
SETTLED = 1e-9


FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "doubled")


def doubled_words(words: Column) -> Column:
    """Words equal to the word before them."""
    rest = F.size(words) - 1
    pairs = F.zip_with(F.slice(words, 1, rest), F.slice(words, 2, rest), lambda a, b: a == b)
    return F.when(rest > 0, F.size(F.filter(pairs, lambda same: same))).otherwise(0)


def featured(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and FEATURES of every text."""
    counts = text_statistics(docs, *keep, more={"n_doubled": doubled_words})
    share = F.sqrt(F.col("n_doubled") / F.greatest(F.col("n_words"), F.lit(1)))
    return counts.withColumns({**transformed(), "doubled": share}).select(*keep, *FEATURES)


@dataclass
class Ranker:
    """Utility = weights x (statistics - means); scores compare it with the threshold."""

    means: list[float]
    weights: list[float]
    threshold: float

    def utility(self) -> Column:
        """Utility above the threshold, from the columns of ``featured``."""
        return sum(((F.col(s) - m) * w for s, m, w in zip(FEATURES, self.means, self.weights)), F.lit(0.0)) - self.threshold

    def score(self) -> Column:
        """0 to 1, from the columns of ``featured``."""
        return 1 / (1 + F.exp(-F.greatest(F.least(self.utility(), F.lit(30.0)), F.lit(-30.0))))


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds ``pos``, from 0 on within each label, in an order by hash inside the partitions that rows were written in."""
    inside = Window.partitionBy("_part", "_label").orderBy(F.xxhash64(*FEATURES))
    parts = rows.groupBy("_part", "_label").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("_label").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts, n = cut_counted(parts.select("_part", "_label", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
    rows = rows.withColumn("row", F.row_number().over(inside)).join(small(starts, n), ["_part", "_label"])
    return rows.select("_label", *FEATURES, (F.col("start") + F.col("row") - 1).cast("bigint").alias("pos"))


def _pairs(rows: DataFrame, counts: dict[int, int], spread: list[float]) -> DataFrame:
    """Scaled differences ``x0..`` of good and bad documents: every row of either label is in a pair, PAIRS at least."""
    numbered = cut(_numbered(rows))
    more = 1 if counts[1] >= counts[0] else 0
    fewer = counts[1 - more]
    draws = F.explode(F.sequence(F.lit(0), F.lit(-(-PAIRS // counts[more]) - 1 if counts[more] < PAIRS else 0)))
    many = numbered.where(F.col("_label") == more).select(*[F.col(s).alias(f"a_{s}") for s in FEATURES], "pos", draws.alias("draw"))
    many = many.withColumn("partner", F.pmod(F.col("pos") + F.col("draw") * F.lit(7919), F.lit(fewer)))
    few = numbered.where(F.col("_label") == 1 - more).select(*[F.col(s).alias(f"b_{s}") for s in FEATURES], F.col("pos").alias("partner"))
    sign = 1.0 if more == 1 else -1.0
    return cut(
        many.join(few, "partner").select(
            *[((F.col(f"a_{s}") - F.col(f"b_{s}")) * (sign / d)).alias(f"x{i}") for i, (s, d) in enumerate(zip(FEATURES, spread))]
        )
    )


def _quantile(values: DataFrame, below: int, n: int) -> float:
    """Between the ``below``-th and the next of ``n`` values ``u``: bracketed by an approximation, then read off exactly."""
    near = [max(0.0, below / n - 5e-4), min(1.0, below / n + 5e-4)]
    low, high = values.agg(F.percentile_approx("u", near, F.lit(10_000)).alias("q")).first()["q"]
    inside = F.col("u").between(low, high)
    under = values.agg(F.count_if(F.col("u") < low).alias("n")).first()["n"]
    found = sorted((r["u"], r["n"]) for r in values.where(inside).groupBy("u").agg(F.count(F.lit(1)).alias("n")).collect())
    at, last = np.array([u for u, _ in found]), under + np.cumsum([k for _, k in found])
    pick = [at[min(int(np.searchsorted(last, k)), len(at) - 1)] for k in (below, min(below + 1, n))]
    return float(pick[0] + pick[1]) / 2


def fit_pairs(rows: DataFrame) -> Ranker:
    """Bradley-Terry by Newton steps over pairs of all rows of ``rows(_label, _part, *FEATURES)``.

    The threshold is the quantile of all utilities at the share of label 0. Only sums over the pairs, one row per step,
    and the values within a thousandth of that quantile reach the driver.
    """
    moments = [f(s).alias(f"{k}_{s}") for s in FEATURES for k, f in (("mean", F.avg), ("sd", F.stddev_pop))]
    top = rows.agg(*[F.count_if(F.col("_label") == k).alias(f"n{k}") for k in (0, 1)], *moments).first()
    counts = {k: top[f"n{k}"] for k in (0, 1)}
    if not counts[0] or not counts[1]:
        neutral = 30.0 if counts[0] else -30.0 if counts[1] else 0.0
        return Ranker([0.0] * len(FEATURES), [0.0] * len(FEATURES), neutral)
    means, spread = [top[f"mean_{s}"] for s in FEATURES], [top[f"sd_{s}"] + 1e-9 for s in FEATURES]
    pairs = _pairs(rows, counts, spread)
    x = [F.col(f"x{i}") for i in range(len(FEATURES))]
    w = np.zeros(len(x))
    corners = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    for _ in range(STEPS):
        dot = sum((c * float(v) for c, v in zip(x, w)), F.lit(0.0))
        p = 1 / (1 + F.exp(F.greatest(F.least(dot, F.lit(30.0)), F.lit(-30.0))))
        weighed = pairs.select(*x, p.alias("p")).withColumn("q", F.col("p") * (1 - F.col("p")))
        sums = weighed.agg(*[F.avg(c * F.col("p")) for c in x], *[F.avg(x[i] * x[j] * F.col("q")) for i, j in corners]).first()
        curvature = np.eye(len(x)) * RIDGE
        for (i, j), value in zip(corners, sums[len(x) :]):
            curvature[i, j] += value
            curvature[j, i] = curvature[i, j]
        step = np.linalg.solve(curvature, np.array(sums[: len(x)]) - RIDGE * w)
        w += step
        if np.abs(step).max() < SETTLED:
            break
    weights = (w / np.array(spread)).tolist()
    utility = Ranker(means, weights, 0.0).utility()
    return Ranker(means, weights, _quantile(rows.select(utility.alias("u")), counts[0], counts[0] + counts[1]))


def learn_ranker(docs: DataFrame, labels: DataFrame) -> Ranker:
    """Fit on all labelled documents whose crc32(doc_id) mod 3 is not 1.

    Labels other than 0 and 1, and ids without a document, are ignored. With one label only, every document gets that
    label; without any, every score is a half.
    """
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_remainder() != 1))
    usable, n = cut_counted(usable.select(F.col("doc_id").cast("bigint").alias("_id"), F.col("quality").alias("_label")))
    texts = docs.where(F.col("doc_id").isNotNull() & (crc_remainder() != 1))
    texts = texts.select(F.col("doc_id").cast("bigint").alias("_id"), "text")
    if n <= BROADCAST_ROWS:
        found = featured(texts.join(small(usable, n), "_id"), "_label")
    else:
        # Statistics first, so that no text is shuffled.
        found = featured(texts, "_id").join(usable, "_id").drop("_id")
    return fit_pairs(cut(found.withColumn("_part", F.spark_partition_id())))


def score_documents(docs: DataFrame, model: Ranker) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs(doc_id, text): whole texts, null ones as empty.

    Repeated rows and ids keep a row each; other columns aren't read; an empty table gives no rows.
    """
    rows = featured(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), "doc_id")
    scored = rows.select("doc_id", (crc_remainder() == 1).alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_preferred(docs: DataFrame, model: Ranker) -> DataFrame:
    """The rows of ``docs``, all columns as they are and of any name, whose score is at least a half.

    Null and empty texts are scored by statistics of zero, very long ones whole; repeated rows stay or go together, and so
    do rows of equal text. A score of exactly a half stays. An empty table gives no rows.
    """
    rows = docs.select(F.struct("*").alias("_row"), F.col("text").alias("text"))
    return featured(rows, "_row").where(model.score() >= 0.5).select("_row.*")
