"""BPE encoding and decoding with a minimal acyclic transducer of frequent words.

Words are counted over all texts; the most frequent ones are compiled into an acyclic automaton that shares prefixes
and suffixes, whose arcs carry numbers that add up to a word's row in a table of token ids. Tasks map the compiled file
into memory, look new words up in it together, and merge the words it doesn't know exactly.
"""

from __future__ import annotations

import hashlib
import mmap
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .bpe import MEMO_WORDS, Encoder, Vocabulary, load_vocabulary, text_slices
from .common import ragged

# Bounds of the lexicon, and so of what the driver compiles and broadcasts; words beyond them are merged in the tasks.
LEXICON_WORDS = 40_000
WORD_BYTES = 48
# Bins of the logarithm of a count to the base of two.
LEVELS = 16


def count_words(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """word and n over all texts, summed per task before the shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Encoder(shared.value)
        place: dict[int, int] = {}
        words: list[str] = []
        totals = np.zeros(1 << 16, np.int64)

        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(totals[: len(words)])], ["word", "n"])

        for batch in batches:
            for texts in text_slices(batch.column(0)):
                _, begin, end, keys, _ = splitter.words(texts)
                if not len(keys):
                    continue
                joined = "".join(texts)
                distinct, sample, n = np.unique(keys, return_index=True, return_counts=True)
                at = [place.get(k, -1) for k in distinct.tolist()]
                for i, found in enumerate(at):
                    if found < 0:
                        at[i] = place[int(distinct[i])] = len(words)
                        words.append(joined[begin[sample[i]] : end[sample[i]]])
                while len(words) > len(totals):
                    totals = np.concatenate([totals, np.zeros(len(totals), np.int64)])
                totals[at] += n
                if len(words) > MEMO_WORDS:
                    yield emit()
                    place, words, totals = {}, [], np.zeros(1 << 16, np.int64)
        if words:
            yield emit()

    return docs.select("text").mapInArrow(counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def minimal_automaton(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Arcs (state << 8 | byte, ascending), their targets and numbers, and which states are final; state 0 begins.

    ``words`` are distinct and ascending. Each new word first freezes the states of the last one that it leaves, by
    replacing them with equal states that are already known, so the automaton is minimal all the time. The numbers on
    a word's path, and one for each final state left on the way, add up to its rank among ``words``.
    """
    arcs: list[dict[int, int]] = [{}]
    final = [False]
    known: dict[tuple, int] = {}
    path = [0]
    last = b""

    def freeze(down_to: int) -> None:
        while len(path) - 1 > down_to:
            state = path.pop()
            shape = (final[state], tuple(arcs[state].items()))
            arcs[path[-1]][last[len(path) - 1]] = known.setdefault(shape, state)

    for word in words:
        same = next((i for i, (a, b) in enumerate(zip(word, last)) if a != b), min(len(word), len(last)))
        freeze(same)
        for byte in word[same:]:
            arcs.append({})
            final.append(False)
            arcs[path[-1]][byte] = len(arcs) - 1
            path.append(len(arcs) - 1)
        final[path[-1]] = True
        last = word
    freeze(0)
    count: dict[int, int] = {}
    number: dict[int, int] = {0: 0}
    rows = []
    stack = [(0, False)]
    while stack:
        state, ready = stack.pop()
        if state in count:
            continue
        if not ready:
            stack.append((state, True))
            stack += [(t, False) for t in arcs[state].values() if t not in count]
            continue
        total = int(final[state])
        number.setdefault(state, len(number))
        for byte, target in arcs[state].items():
            rows.append((number[state] << 8 | byte, number[target], total))
            total += count[target]
        count[state] = total
    table = np.array(sorted(rows), np.int64).reshape(-1, 3)
    ends = np.zeros(len(number), np.int64)
    for state, i in number.items():
        ends[i] = final[state]
    return table[:, 0], table[:, 1], table[:, 2], ends


def compile_lexicon(words: list[str], vocabulary: Vocabulary) -> bytes:
    """The automaton of ``words`` and the ids of each, as one file."""
    raw = sorted({w.encode("utf-8", "surrogatepass") for w in words})
    keys, targets, numbers, ends = minimal_automaton(raw)
    sizes = np.array([len(w) for w in raw], np.int64)
    ids, counts = Encoder(vocabulary).merger.merge(np.frombuffer(b"".join(raw), np.uint8), sizes)
    parts = [keys, targets, numbers, ends, np.cumsum(counts) - counts, counts, ids]
    header = np.array([len(p) for p in parts], np.int64)
    return b"".join(np.ascontiguousarray(p, np.int64).tobytes() for p in [header, *parts])


class Lexicon:
    """A compiled lexicon, mapped from a file of the task that has no name any more."""

    def __init__(self, compiled: bytes):
        handle, path = tempfile.mkstemp(prefix="lexicon-")
        try:
            os.write(handle, compiled)
            self.map = mmap.mmap(handle, len(compiled), access=mmap.ACCESS_READ)
        finally:
            os.close(handle)
            os.unlink(path)
        values = np.frombuffer(self.map, np.int64)
        cuts = 7 + np.concatenate([[0], np.cumsum(values[:7])])
        parts = [values[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        self.keys, self.targets, self.numbers, self.ends, self.at, self.n, self.ids = parts

    def __call__(self, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and id counts of the words that the automaton accepts, and which those are; all walk a byte at a time."""
        known = np.zeros(len(sizes), bool)
        number = np.zeros(len(sizes), np.int64)
        start = np.cumsum(sizes) - sizes
        walking = np.flatnonzero(sizes <= WORD_BYTES) if len(self.keys) else np.zeros(0, np.int64)
        state = np.zeros(len(walking), np.int64)
        step = 0
        while len(walking):
            ended = sizes[walking] == step
            known[walking[ended & (self.ends[state] > 0)]] = True
            walking, state = walking[~ended], state[~ended]
            want = state << 8 | raw[start[walking] + step]
            arc = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            ok = self.keys[arc] == want
            walking, arc = walking[ok], arc[ok]
            number[walking] += self.numbers[arc]
            state = self.targets[arc]
            step += 1
        found = number[known]
        return self.ids[ragged(self.at[found], self.n[found])], self.n[found], known


class Codec:
    """Encoder with a lexicon, and decoder, of a task."""

    def __init__(self, vocabulary: Vocabulary, compiled: bytes | None = None):
        self.encoder = Encoder(vocabulary, Lexicon(compiled) if compiled else None)
        self.pieces = self._table(vocabulary.token_bytes)
        self.decimals = self._table([b"%d," % i for i in range(len(vocabulary.token_bytes))])

    @staticmethod
    def _table(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(r) for r in rows], np.int64)
        return np.frombuffer(b"".join(rows), np.uint8), np.cumsum(sizes) - sizes, sizes

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.encoder.encode(texts)

    def _gather(self, table, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        flat, at, sizes = table
        size = sizes[ids]
        raw = flat[ragged(at[ids], size)].tobytes()
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [raw[a:b] for a, b in zip(ends[:-1], ends[1:])]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of ids, special tokens included; bytes that are no UTF-8 become replacement characters."""
        return [b.decode("utf-8", "replace") for b in self._gather(self.pieces, ids, counts)]

    def digits(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Decimal ids joined by commas."""
        return [b[:-1] for b in self._gather(self.decimals, ids, counts)]


def build_lexicon(docs: DataFrame, vocabulary: Vocabulary, size: int = LEXICON_WORDS) -> bytes:
    """Compile the most frequent words of all texts, ``size`` of them at most.

    Counts are binned by their logarithm; the words of the highest bins that fit together come to the driver, so what
    it receives doesn't grow with the corpus or its partitions.
    """
    counts = cut(count_words(docs, vocabulary).where(F.octet_length("word") <= WORD_BYTES))
    level = F.floor(F.log2("n") * LEVELS).cast("int")
    listed = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).collect()
    total, least = 0, None
    for row in sorted(listed, reverse=True):
        total += row["words"]
        if total > size:
            break
        least = row["level"]
    top = [] if least is None else counts.where(level >= least).select("word").collect()
    return compile_lexicon([r["word"] for r in top], vocabulary)


def encode_texts(docs: DataFrame, tokenizer_path: str, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """doc_id and ids (array of int) of every row; a null or empty text has no ids, repeated rows a row each.

    Strings of special tokens are those tokens. Only doc_id and text are read; an empty table gives no rows.
    """
    vocabulary = load_vocabulary(tokenizer_path)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, build_lexicon(docs, vocabulary, lexicon_words)))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(*shared.value)
        for batch in batches:
            done = 0
            for texts in text_slices(batch.column(1)):
                ids, counts = codec.encode(texts)
                at = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                rows = pa.ListArray.from_arrays(at, pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(texts)), rows], ["doc_id", "ids"])
                done += len(texts)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(encoded, "doc_id bigint, ids array<int>")


def decode_ids(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id and text of every row of encoded(doc_id, ids); null ids give an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(load_vocabulary(tokenizer_path))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for batch in batches:
            rows = batch.column(1)
            counts = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(rows), 0), np.int64)
            texts = codec.decode(np.asarray(rows.flatten(), np.int64), counts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("bigint"), "ids").mapInArrow(decoded, "doc_id bigint, text string")


def round_trip(docs: DataFrame, tokenizer_path: str, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """Encode and decode every row in one task: doc_id, n_tokens, ids_sha256 and decoded_sha256.

    Same rules as ``encode_texts``; the hashes are of the decimal ids joined by commas and of the decoded text.
    """
    vocabulary = load_vocabulary(tokenizer_path)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, build_lexicon(docs, vocabulary, lexicon_words)))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(*shared.value)
        for batch in batches:
            n_tokens: list[int] = []
            hashed: list[str] = []
            again: list[str] = []
            for texts in text_slices(batch.column(1)):
                ids, counts = codec.encode(texts)
                n_tokens += counts.tolist()
                hashed += [hashlib.sha256(d).hexdigest() for d in codec.digits(ids, counts)]
                again += [hashlib.sha256(t.encode()).hexdigest() for t in codec.decode(ids, counts)]
            columns = [batch.column(0), pa.array(n_tokens, pa.int64()), pa.array(hashed, pa.string()), pa.array(again, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(digest, schema)
