"""Language identification with bit-sliced Bloom filters of character n-grams.

All languages' filters lie side by side: a row per bit position, a bit per language. Looking up an n-gram takes the
rows of its hashes and ANDs them, which gives every language whose filter holds it at once. A text's count per
language, less what its filter's false positives would give, decides.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_counted, small
from .bpe import text_slices
from .common import crc_remainder, mix

UNKNOWN = "und"
# Bound of the sample that the filters are learned from: documents per language, in expectation.
DOCS_PER_LANGUAGE = 2_000
# Characters handled at once.
SLICE_CHARS = 1 << 19
# Characters of an n-gram; words are padded with a space on either side.
GRAM = 3
# An n-gram belongs to a language if it makes up at least this share of its n-grams, and at least CONTRAST times the
# share it has in the language that uses it most.
LEAST_SHARE = 2e-6
CONTRAST = 0.2
# Bits of a filter per n-gram of the largest language (rounded up to a power of two), and hashes of an n-gram.
BITS_PER_GRAM = 16
HASHES = 3
# Languages in a word of the sliced filter.
WORD_BITS = 63


# Set for letters, not for the marks that are kept within words.
LETTER = np.uint32(1 << 31)


def letter_table() -> np.ndarray:
    """Lower-case letter or mark of every code point, 0 for all else; ``LETTER`` tells letters apart."""
    table = np.zeros(0x110000, np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha() or unicodedata.category(c) in ("Mn", "Mc"):
            low = c.lower()
            table[cp] = (ord(low) if len(low) == 1 else cp) | (LETTER if c.isalpha() else 0)
    return table


def grams(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams of each text's words, their texts, and which texts have a letter."""
    sizes = np.array([len(t) + 2 for t in texts], np.int64)
    points = np.frombuffer(" ".join(["", *(t + " " for t in texts)]).encode("utf-32-le", "surrogatepass"), "<u4")[: sizes.sum()]
    found = table[points]
    low = found & ~LETTER
    owner = np.repeat(np.arange(len(texts)), sizes)
    solid = low > 0
    has = np.bincount(owner[found & LETTER > 0], minlength=len(texts)) > 0
    # A run of other characters counts as one space.
    keep = solid | np.append(True, solid[:-1])
    low, owner = low[keep].astype(np.uint64), owner[keep]
    n = len(low) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), has
    value = np.zeros(n, np.uint64)
    for i in range(GRAM):
        value = value * np.uint64(0x110000) + low[i : i + n]
    whole = (owner[:n] == owner[GRAM - 1 :]) & (low[1 : 1 + n] > 0)
    return mix(value[whole]), owner[:n][whole], has


@dataclass
class SlicedFilter:
    """``rows[w, p]``: bit l of word w says whether language l of that word has position p set."""

    languages: list[str]
    rows: np.ndarray
    false_rate: np.ndarray

    def positions(self, hashes: np.ndarray) -> list[np.ndarray]:
        mask = np.uint64(self.rows.shape[1] - 1)
        step = (hashes >> np.uint64(32)) | np.uint64(1)
        return [((hashes + np.uint64(i) * step) & mask).astype(np.int64) for i in range(HASHES)]

    def languages_of(self, hashes: np.ndarray) -> np.ndarray:
        """Language bits of each n-gram, a row per word of the filter."""
        out = None
        for at in self.positions(hashes):
            got = self.rows[:, at]
            out = got if out is None else out & got
        return out

    def scores(self, hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Per text and language the corrected share of n-grams found, and the number of n-grams per text."""
        bits = self.languages_of(hashes)
        total = np.bincount(owner, minlength=n)
        share = np.zeros((n, len(self.languages)))
        for i in range(len(self.languages)):
            hit = (bits[i // WORD_BITS] >> i % WORD_BITS) & 1
            found = np.bincount(owner, weights=hit, minlength=n)
            false = self.false_rate[i]
            share[:, i] = np.clip((found / np.maximum(total, 1) - false) / (1 - false), 0, 1)
        return share, total


def learn(sample: DataFrame) -> SlicedFilter:
    """Filters from sample(lang, text): n-gram counts per language are summed on Spark, and fill the sliced rows."""
    shared = sample.sparkSession.sparkContext.broadcast(letter_table())

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            done = 0
            for texts in text_slices(batch.column(1)):
                hashes, owner, _ = grams(texts, shared.value)
                own = langs[done : done + len(texts)]
                done += len(texts)
                for lang in sorted(set(own)):
                    mine = np.array([x == lang for x in own])[owner]
                    found, n = np.unique(hashes[mine], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(n)],
                        ["lang", "gram", "n"],
                    )

    counts = sample.select("lang", "text").mapInArrow(counted, "lang string, gram bigint, n bigint")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = F.sum("n").over(Window.partitionBy("lang"))
    shares = counts.withColumn("share", F.col("n") / totals)
    most = F.max("share").over(Window.partitionBy("gram"))
    kept = shares.withColumn("most", most).where((F.col("share") >= LEAST_SHARE) & (F.col("share") >= CONTRAST * F.col("most")))
    table = kept.select("lang", "gram").toArrow().to_pydict()
    languages = sorted(set(table["lang"]))
    of = np.array([languages.index(x) for x in table["lang"]], np.int64)
    hashes = np.array(table["gram"], np.int64).view(np.uint64)
    largest = max([1, *np.bincount(of).tolist()])
    bits = 1 << max(10, (largest * BITS_PER_GRAM - 1).bit_length())
    rows = np.zeros((max(1, -(-len(languages) // WORD_BITS)), bits), np.int64)
    made = SlicedFilter(languages, rows, np.zeros(len(languages)))
    for i in range(len(languages)):
        for at in made.positions(hashes[of == i]):
            rows[i // WORD_BITS, np.unique(at)] |= np.int64(1) << np.int64(i % WORD_BITS)
        made.false_rate[i] = np.mean((rows[i // WORD_BITS] >> i % WORD_BITS) & 1) ** HASHES
    return made


def training_sample(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE) -> DataFrame:
    """About ``per_language`` documents of each language (all if it has fewer), drawn by a hash of their ids.

    Only documents with a language, a text and crc32(doc_id) mod 3 other than 1 take part. Counts per language set the
    share that is drawn, so no text is shuffled.
    """
    usable = docs.select("doc_id", "lang", "text")
    usable = usable.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_remainder() != 1))
    counts, n = cut_counted(usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < 1_000_003.0 * per_language / F.col("n")
    return usable.join(small(counts, n), "lang").where(drawn).select("lang", "text")


def predict(docs: DataFrame, model: SlicedFilter) -> DataFrame:
    """doc_id, lang_pred and score of every row of docs(doc_id, text).

    The language whose corrected share of the text's n-grams is largest (of equal ones the first by name); the score
    is its part of the sum of shares, 0 if no n-gram is known. A text that is null or has no letter is ``und`` with
    score 0, and so is every text if no language was learned. Repeated rows keep a row each; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model, letter_table()))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, table = shared.value
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            langs: list[str] = []
            scores: list[float] = []
            for texts in text_slices(batch.column(1), SLICE_CHARS):
                hashes, owner, has = grams(texts, table)
                if not model.languages:
                    has[:] = False
                    best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
                else:
                    share, _ = model.scores(hashes, owner, len(texts))
                    best = share.argmax(axis=1)
                    total = share.sum(axis=1)
                    score = np.where(total > 0, share.max(axis=1) / np.where(total > 0, total, 1), 0.0)
                langs += names[np.where(has, best, len(names) - 1)].tolist()
                scores += np.where(has, score, 0.0).tolist()
            columns = [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint"), "text")
    return rows.mapInArrow(judged, "doc_id bigint, lang_pred string, score double")


def identify_languages(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE) -> DataFrame:
    """Learn from the documents' own languages, predict all: doc_id, held_out, lang_pred and score; see ``predict``."""
    model = learn(training_sample(docs, per_language))
    return predict(docs, model).select("doc_id", (crc_remainder() == 1).alias("held_out"), "lang_pred", "score")
