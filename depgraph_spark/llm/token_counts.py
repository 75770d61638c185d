"""Token counts: pieces are counted once per distinct pre-token and summed by per-document frequencies.

A first pass counts pre-tokens in the tasks, and every distinct one is cut into pieces once. A second pass sums, for each
document, frequency times pieces. Pre-tokens that are frequent in the corpus, a bounded number, reach the tasks as a
table; the rest leave as rows (document, pre-token, frequency) and are joined with their piece counts. No ids are made.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .bpe import byte_alphabet
from .common import text_buffers

# Pre-tokens that are sent to every task; one that isn't has at most about 1 / FREQUENT of all occurrences.
FREQUENT = 100_000
# Bins of counts per doubling, for choosing the frequent ones.
LEVELS = 4
# Distinct pre-tokens, or words between white space, that a task holds before it passes its counts on or forgets.
HELD = 300_000
LIMIT = 2048


class Splitter:
    """Pre-tokens of words between ASCII white space, by the tokenizer's own normaliser and splitter.

    No pre-token holds white space and no normalisation reaches across it, so words can be split one by one. Strings of
    special tokens are cut out first and stand for themselves.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        listed = "|".join(map(re.escape, sorted(special, key=len, reverse=True)))
        self.cutter = re.compile(f"({listed})") if special else None
        if any(c.isspace() for s in special for c in s):
            raise ValueError("special tokens with white space are not supported")
        if self._plain("a b") != self._plain("a") + self._plain("b"):
            raise ValueError("a tokenizer that drops white space between words is needed")
        self._learn_common(json.loads(spec)["pre_tokenizer"])

    def _learn_common(self, splitter: dict) -> None:
        """Characters whose words need no normaliser: ASCII and Latin ones that the file's own pattern, lower case and
        byte letters treat as the library does, which is tried for each."""
        steps = splitter.get("pretokenizers", [splitter])
        patterns = [s["pattern"]["Regex"] for s in steps if s["type"] == "Split" and "Regex" in s["pattern"]]
        self.common = None
        if len(patterns) != 1:
            return
        self.pattern = regex.compile(patterns[0])
        letters = {b: c for c, b in byte_alphabet().items()}
        chars = [c for c in map(chr, [*range(0x21, 0x7F), *range(0xC0, 0x250)]) if len(c.lower()) == 1]
        self.lower = {ord(c): c.lower() for c in chars}
        self.bytes = {ord(c): "".join(letters[b] for b in c.encode()) for c in chars}
        good = [c for c in chars if all(self._quick(t) == self._plain(t) for t in (c, f"a{c}1", f"'{c}{c}!"))]
        self.common = re.compile(f"[{re.escape(''.join(good))}]+") if good else None

    def _quick(self, text: str) -> list[str]:
        if text.isascii():
            return self.pattern.findall(text.lower())
        return [t if t.isascii() else t.translate(self.bytes) for t in self.pattern.findall(text.translate(self.lower))]

    def _plain(self, text: str) -> list[str]:
        return [token for token, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self._normal(text))]

    def _normal(self, text: str) -> str:
        return self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text

    def _special(self, text: str) -> list[str]:
        out: list[str] = []
        for i, piece in enumerate(self.cutter.split(text)):
            if i % 2:
                out.append(SPECIAL + piece)
            elif piece:
                out += self._plain(piece)
        return out

    def __call__(self, word: bytes) -> list[str]:
        text = word.decode("utf-8", "replace")
        if self.cutter and "<" in text and self.cutter.search(text):
            return self._special(text)
        if self.common and self.common.fullmatch(text):
            return self._quick(text)
        return self._plain(text)

    def pieces(self, pre_token: str) -> int:
        """Pieces of one pre-token; a special token is one."""
        return 1 if pre_token.startswith(SPECIAL) else len(self.tokenizer.model.tokenize(pre_token))


# Marks a special token among pre-tokens; byte-level pre-tokens have no blanks.
SPECIAL = " "


def word_lists(texts: pa.Array) -> Iterator[list[bytes]]:
    """The words between ASCII white space of each text; nulls have none."""
    raw, at = text_buffers(texts)
    whole = raw.tobytes()
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        yield whole[a:b].split()


def count_pre_tokens(docs: DataFrame, spec: str) -> DataFrame:
    """(word, n): every distinct pre-token of all texts with its occurrences, summed in the tasks before the shuffle."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(spec)
        words: Counter[bytes] = Counter()

        def passed_on() -> Iterator[pa.RecordBatch]:
            found: Counter[str] = Counter()
            for word, n in words.items():
                for token in splitter(word):
                    found[token] += n
            words.clear()
            for part in _parts(list(found.items())):
                columns = [pa.array([t for t, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["word", "n"])

        for batch in batches:
            for listed in word_lists(batch.column(0)):
                words.update(listed)
                if len(words) > HELD:
                    yield from passed_on()
        yield from passed_on()

    rows = docs.select("text").mapInArrow(counted, "word string, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def _parts(rows: list, size: int = 50_000) -> Iterator[list]:
    for i in range(0, len(rows), size):
        yield rows[i : i + size]


def count_pieces(pre_tokens: DataFrame, spec: str) -> DataFrame:
    """``pre_tokens(word, n)`` with ``pieces``, each distinct one cut into pieces once."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(spec)
        for batch in batches:
            pieces = [splitter.pieces(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pieces, pa.int64())], ["word", "n", "pieces"])

    return pre_tokens.select("word", "n").mapInArrow(cut_up, "word string, n bigint, pieces bigint")


def frequent_pieces(pieces: DataFrame, size: int = FREQUENT) -> tuple[DataFrame, dict[str, int]]:
    """The rows of ``pieces`` that are not frequent, and the piece counts of those that are, ``size`` at most.

    Occurrences are binned by their logarithm; the highest bins that fit together are taken whole.
    """
    level = F.floor(F.log2("n") * LEVELS).cast("int")
    bins = pieces.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).collect()
    total, least = 0, None
    for row in sorted(bins, reverse=True):
        total += row["words"]
        if total > size:
            break
        least = row["level"]
    if least is None:
        return pieces, {}
    top = pieces.where(level >= least).select("word", "pieces").collect()
    return pieces.where(level < least), {r["word"]: r["pieces"] for r in top}


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes (of UTF-8), n_tokens and over_limit (more than ``limit`` tokens) of every row.

    A null or empty text has no bytes and no tokens; strings of special tokens in a text are one token each, as the
    library has it; repeated rows and null ids get a row each; texts of any length are counted whole, a million
    characters without a blank too. Only doc_id and text are read, so other columns may have any name. An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    pieces = cut(count_pieces(count_pre_tokens(docs, spec), spec))
    rare, known = frequent_pieces(pieces, frequent)
    shared = spark.sparkContext.broadcast((spec, known))
    schema = "doc_id bigint, n_bytes bigint, tokens bigint, rest map<string,bigint>"

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spec, known = shared.value
        splitter = Splitter(spec)
        # A word's pieces if its pre-tokens are all frequent, else the sum of those that are and the others.
        memo: dict[bytes, int | tuple[int, tuple[str, ...]]] = {}

        def learn(word: bytes) -> int | tuple[int, tuple[str, ...]]:
            total, rest = 0, ()
            for token in splitter(word):
                pieces = known.get(token)
                if pieces is None:
                    rest += (token,)
                else:
                    total += pieces
            if len(memo) >= HELD:
                memo.clear()
            memo[word] = entry = (total, rest) if rest else total
            return entry

        def counts(listed: list[bytes]) -> tuple[int, list[tuple[str, int]]]:
            total, rest = 0, Counter()
            for word, n in Counter(listed).items():
                entry = memo.get(word)
                if entry is None:
                    entry = learn(word)
                if type(entry) is int:
                    total += entry * n
                else:
                    total += entry[0] * n
                    for token in entry[1]:
                        rest[token] += n
            return total, list(rest.items())

        for batch in batches:
            tokens, rests = [], []
            for listed in word_lists(batch.column(1)):
                total, rest = counts(listed)
                tokens.append(total)
                rests.append(rest)
            columns = [batch.column(0), batch.column(2), pa.array(tokens, pa.int64()), pa.array(rests, pa.map_(pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "tokens", "rest"])

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes")
    passed = docs.select(F.col("doc_id").cast("bigint"), "text", size).mapInArrow(summed, schema)
    # Written once, so a row keeps its number.
    sums = cut(passed.withColumn("row", F.monotonically_increasing_id()))
    rest = sums.where(F.size("rest") > 0).select("row", F.explode("rest").alias("word", "times"))
    more = rest.join(rare.select("word", "pieces"), "word").groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("more"))
    n_tokens = F.col("tokens") + F.coalesce("more", F.lit(0))
    return sums.join(more, "row", "left").select(
        "doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit")
    )
