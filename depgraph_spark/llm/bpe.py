"""Byte-pair encoding of Arrow batches: vectorised splitting into words, exact merges, and a memo of encoded words.

Texts are handled as arrays of code points. A word's key is a 64-bit hash of its code points; every distinct word of a
task is encoded once, words new to the task together, and its ids are then gathered wherever it stands.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .common import mix, powers, ragged

# Classes of code points for splitting.
OTHER, LETTER, NUMBER, BLANK = range(4)
_BASE = 0x9E3779B97F4A7C15
_POWERS = powers(_BASE, 4096)

# Distinct words that a task remembers before it starts anew; a bound on memory that changes no result.
MEMO_WORDS = 400_000
# Words of more bytes than this are merged one at a time by a heap instead of in step with others.
LONG_WORD = 256
# Code points that are split at once.
SLICE_CHARS = 1 << 20


def character_classes(tokenizer_path: str) -> bytes:
    """Class of every code point, as the tokenizer's own splitter sees it.

    Code points that this Python's Unicode tables don't know yet are tried with the splitter itself.
    """
    import regex
    from tokenizers import Tokenizer

    classes = np.zeros(0x110000, np.uint8)
    unknown = []
    numeric = regex.compile(r"\p{N}")
    worded = regex.compile(r"[\p{L}\p{N}]")
    for cp in range(0x110000):
        category = unicodedata.category(chr(cp))
        if category[0] == "L":
            classes[cp] = LETTER
        elif category[0] == "N":
            classes[cp] = NUMBER
        elif category == "Cn" and worded.match(chr(cp)):
            unknown.append(cp)
    # White space.
    blanks = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    classes[blanks] = BLANK
    split = Tokenizer.from_file(tokenizer_path).pre_tokenizer.pre_tokenize_str
    probe = "".join(("1" if numeric.match(chr(cp)) else "a") + chr(cp) + "\n" for cp in unknown)
    ends = {end for _, (_, end) in split(probe)}
    for i, cp in enumerate(unknown):
        if 3 * i + 1 not in ends:
            classes[cp] = NUMBER if numeric.match(chr(cp)) else LETTER
    return classes.tobytes()


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(spare)}


@dataclass
class Vocabulary:
    """A byte-level BPE vocabulary: ids of bytes and merged pairs, bytes of ids, special tokens, character classes."""

    byte_ids: np.ndarray
    pairs: np.ndarray  # left << 32 | right, ascending
    ranks: np.ndarray
    merged: np.ndarray
    token_bytes: list[bytes]
    special: dict[str, int]
    classes: bytes


def load_vocabulary(path: str) -> Vocabulary:
    """Read a tokenizers file; its size bounds what is broadcast. Splitters other than byte-level are refused."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    splitter = spec["pre_tokenizer"] or {}
    if spec["model"]["type"] != "BPE" or splitter.get("type") != "ByteLevel" or splitter.get("add_prefix_space"):
        raise ValueError("a byte-level BPE file without prefix space is needed")
    alphabet = byte_alphabet()
    vocab = spec["model"]["vocab"]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    token_bytes = [b""] * (max([*vocab.values(), *special.values()]) + 1)
    for token, i in vocab.items():
        token_bytes[i] = bytes(alphabet[c] for c in token)
    for token, i in special.items():
        token_bytes[i] = token.encode()
    byte_ids = np.zeros(256, np.int64)
    for c, b in alphabet.items():
        byte_ids[b] = vocab[c]
    triples = []
    for rank, pair in enumerate(spec["model"]["merges"]):
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        triples.append((vocab[left] << 32 | vocab[right], rank, vocab[left + right]))
    table = np.array(sorted(triples), np.int64)
    return Vocabulary(byte_ids, table[:, 0], table[:, 1], table[:, 2], token_bytes, special, character_classes(path))


class Merger:
    """Exact merges: always the pair of lowest rank, leftmost first."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        bits = max(16, int(len(vocabulary.pairs) * 8).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slots = np.full((1 << bits) + 64, -1, np.int64)
        for i, slot in enumerate(self._slot(vocabulary.pairs)):
            while self.slots[slot] >= 0:
                slot += 1
            self.slots[slot] = i
        self.by_pair = {int(p): (int(r), int(m)) for p, r, m in zip(vocabulary.pairs, vocabulary.ranks, vocabulary.merged)}

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return (pairs.astype(np.uint64) * np.uint64(_BASE) >> self.shift).astype(np.int64)

    def _find(self, pairs: np.ndarray) -> np.ndarray:
        """Index of each pair in the merge table, or -1."""
        slot = self._slot(pairs)
        out = np.full(len(pairs), -1, np.int64)
        open_ = np.arange(len(pairs))
        while len(open_):
            entry = self.slots[slot[open_]]
            hit = (entry >= 0) & (self.v.pairs[entry] == pairs[open_])
            out[open_[hit]] = entry[hit]
            open_ = open_[(entry >= 0) & ~hit]
            slot[open_] += 1
        return out

    def merge(self, raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words at once: bytes and byte lengths in, ids and id counts out."""
        n = len(lengths)
        done_ids: list[np.ndarray] = []
        done_words: list[np.ndarray] = []
        ids = self.v.byte_ids[raw]
        word = np.repeat(np.arange(n), lengths)
        long = np.flatnonzero(lengths > LONG_WORD)
        if len(long):
            begin = np.cumsum(lengths) - lengths
            for w in long:
                one = self.merge_long(ids[begin[w] : begin[w] + lengths[w]].tolist())
                done_ids.append(np.array(one, np.int64))
                done_words.append(np.full(len(one), w))
            keep = (lengths <= LONG_WORD)[word]
            ids, word = ids[keep], word[keep]
        rank_of = np.append(self.v.ranks, np.iinfo(np.int64).max)
        merged_of = np.append(self.v.merged, -1)
        no_rank = np.iinfo(np.int64).max
        while len(ids):
            found = self._find(ids << 32 | np.append(ids[1:], 0))
            same = np.append(word[1:] == word[:-1], False)
            rank = np.where(same, rank_of[found], no_rank)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            counts = np.diff(np.append(first, len(ids)))
            least = np.minimum.reduceat(rank, first)
            active = np.repeat(least < no_rank, counts)
            if not active.all():
                done_ids.append(ids[~active])
                done_words.append(word[~active])
                ids, word, found, rank = ids[active], word[active], found[active], rank[active]
                if not len(ids):
                    break
                least, counts = least[least < no_rank], counts[least < no_rank]
            take = rank == np.repeat(least, counts)
            # In a run of overlapping hits every second one stands, from the left.
            at = np.flatnonzero(take)
            run = np.flatnonzero(np.append(True, np.diff(at) != 1))
            take[at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 1]] = False
            ids = np.where(take, merged_of[found], ids)
            gone = np.append(False, take[:-1])
            ids, word = ids[~gone], word[~gone]
        if not done_ids:
            return np.zeros(0, np.int64), np.zeros(n, np.int64)
        all_ids, words = np.concatenate(done_ids), np.concatenate(done_words)
        order = np.argsort(words, kind="stable")
        return all_ids[order], np.bincount(words, minlength=n)

    def merge_long(self, ids: list[int]) -> list[int]:
        """One long word, by a heap of candidate pairs over a linked list."""
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (hit := self.by_pair.get(ids[i] << 32 | ids[j])):
                heapq.heappush(heap, (hit[0], i, ids[i], ids[j], hit[1]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, left, right, whole = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue
            ids[i], ids[j] = whole, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [x for x in ids if x >= 0]


def split_words(points: np.ndarray, at: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Ascending begins of the words of texts that begin at ``at`` (last: the end) in an array of code points.

    A word is a contraction ending, or letters, numbers or other characters with at most one space before them, or
    white space; of white space before a word the last character is left to the word, or alone if it's no space.
    """
    n = len(points)
    kind = classes[points]
    first = np.zeros(n + 1, bool)
    first[at[:-1]] = True
    first = first[:n]
    begin = first.copy()
    begin[1:] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(begin & (kind != BLANK) & ~first)
    run = run[kind[run - 1] == BLANK]
    begin[run - 1] = True
    begin[run[points[run - 1] == 0x20]] = False
    # Contractions: an apostrophe that begins a word, right before letters.
    mark = np.flatnonzero((points == 0x27) & begin)
    mark = mark[mark + 1 < n]
    mark = mark[(kind[mark + 1] == LETTER) & ~first[mark + 1]]
    if len(mark):
        padded = np.append(points, [0, 0])
        one, two = padded[mark + 1], padded[mark + 2]
        two = np.where(np.append(first, [True, True])[mark + 2], 0, two)
        pair = np.zeros(len(mark), bool)
        for a, b in ("re", "ve", "ll"):
            pair |= (one == ord(a)) & (two == ord(b))
        single = np.isin(one, [ord(c) for c in "stmd"])
        length = np.where(single, 2, np.where(pair, 3, 0))
        mark, length = mark[length > 0], length[length > 0]
        begin[mark + 1] = False
        # Later marks may stand right behind: ends are set after all inner begins are cleared.
        ends = mark + length
        begin[ends[ends < n]] = True
    return np.flatnonzero(begin)


class Encoder:
    """Encodes lists of texts; ``lookup`` may offer ids of words before they are merged.

    ``lookup(raw, lengths)`` gets the bytes of new words and returns their ids, id counts and which of them it knew.
    """

    def __init__(self, vocabulary: Vocabulary, lookup=None):
        self.v, self.lookup = vocabulary, lookup
        self.classes = np.frombuffer(vocabulary.classes, np.uint8)
        self.merger = Merger(vocabulary)
        self.forget()

    def forget(self) -> None:
        self.memo: dict[int, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.at, self.n = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = 0

    def _remember(self, keys: list[int], ids: np.ndarray, counts: np.ndarray) -> None:
        entry = len(self.memo)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.int32)])
        while entry + len(keys) > len(self.at):
            self.at, self.n = (np.concatenate([x, np.zeros(len(x), np.int64)]) for x in (self.at, self.n))
        self.ids[self.used : self.used + len(ids)] = ids
        self.at[entry : entry + len(keys)] = self.used + np.cumsum(counts) - counts
        self.n[entry : entry + len(keys)] = counts
        self.used += len(ids)
        self.memo.update(zip(keys, range(entry, entry + len(keys))))

    def words(self, texts: list[str]):
        """Code points of all texts, word begins and ends, word keys, and how many words each text has."""
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        if not len(points):
            return points, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
        bounds = at[:-1][np.diff(at) > 0]
        begin = split_words(points, np.append(bounds, at[-1]), self.classes)
        end = np.append(begin[1:], len(points))
        length = end - begin
        longest = int(length.max())
        power = _POWERS if longest <= len(_POWERS) else powers(_BASE, longest)
        place = np.arange(len(points)) - np.repeat(begin, length)
        value = (points.astype(np.uint64) + np.uint64(1)) * power[place]
        keys = mix(np.add.reduceat(value, begin) + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        return points, begin, end, keys, np.diff(np.searchsorted(begin, at))

    def _entries(self, points, begin, end, keys) -> np.ndarray:
        """The memo's entry of every word, after encoding those that are new."""
        distinct, sample, inverse = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.memo) + len(distinct) > MEMO_WORDS and len(self.memo) > len(distinct):
            self.forget()
        listed = distinct.tolist()
        get = self.memo.get
        entry = np.array([get(k, -1) for k in listed], np.int64)
        new = np.flatnonzero(entry < 0)
        if len(new):
            at, length = begin[sample[new]], (end - begin)[sample[new]]
            chars = points[ragged(at, length)]
            raw = np.frombuffer(chars.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
            width = 1 + (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000)
            sizes = np.add.reduceat(width, np.cumsum(length) - length)
            ids, counts = self._encode(raw, sizes)
            self._remember([listed[i] for i in new], ids, counts)
            entry = np.array([self.memo[k] for k in listed], np.int64)
        return entry[inverse.reshape(-1)]

    def _encode(self, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.lookup is None:
            return self.merger.merge(raw, sizes)
        known_ids, known_counts, known = self.lookup(raw, sizes)
        rest = np.flatnonzero(~known)
        starts = np.cumsum(sizes) - sizes
        merged, merged_counts = self.merger.merge(raw[ragged(starts[rest], sizes[rest])], sizes[rest])
        counts = np.zeros(len(sizes), np.int64)
        counts[known], counts[rest] = known_counts, merged_counts
        out = np.zeros(int(counts.sum()), np.int64)
        begin = np.cumsum(counts) - counts
        out[ragged(begin[known], known_counts)] = known_ids
        out[ragged(begin[rest], merged_counts)] = merged
        return out, counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts, one after another, and the number of ids of each; special tokens' strings are tokens."""
        pieces, owner, fixed = texts, None, None
        if any(s in t for s in self.v.special for t in texts):
            pieces, owner, fixed = self._cut_special(texts)
        points, begin, end, keys, per_text = self.words(pieces)
        entry = self._entries(points, begin, end, keys) if len(keys) else np.zeros(0, np.int64)
        lengths = self.n[entry]
        ids = self.ids[ragged(self.at[entry], lengths)]
        word_text = np.repeat(np.arange(len(pieces)), per_text)
        counts = np.bincount(word_text, weights=lengths, minlength=len(pieces)).astype(np.int64)
        if owner is None:
            return ids, counts
        total = counts + (fixed >= 0)
        out = np.zeros(int(total.sum()), np.int32)
        begin = np.cumsum(total) - total
        out[ragged(begin, counts)] = ids
        out[begin[fixed >= 0]] = fixed[fixed >= 0]
        return out, np.bincount(owner, weights=total, minlength=len(texts)).astype(np.int64)

    def _cut_special(self, texts: list[str]):
        """Texts in pieces: ordinary ones, and empty ones that stand for a special token's id."""
        import re

        pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.v.special, key=len, reverse=True))) + ")")
        pieces, owner, fixed = [], [], []
        for i, text in enumerate(texts):
            for j, piece in enumerate(pattern.split(text)):
                pieces.append("" if j % 2 else piece)
                owner.append(i)
                fixed.append(self.v.special[piece] if j % 2 else -1)
        return pieces, np.array(owner), np.array(fixed)


def text_slices(texts: pa.Array, budget: int = SLICE_CHARS):
    """Lists of texts with at most ``budget`` characters each where texts allow; nulls are empty."""
    part, size = [], 0
    for text in texts.to_pylist():
        text = text or ""
        if part and size + len(text) > budget:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part
