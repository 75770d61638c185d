"""Ranked search against brute force, and token counts against the library."""

import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from depgraph_spark.llm import ranked_search, token_counts

from .conftest import MESSY, documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
WORDS = public_tokenizers.path("word_bpe_49k.json")


# 12. Ranked search


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute_search(docs, items, k=10):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, bag, n in bags:
            m = 100 - 75 + 75 * n * n_docs // n_terms
            score = 0
            for t in terms(text):
                if t in bag:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * (1000000000 * bag[t] // (1000 * bag[t] + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def corpus(seed, n, words=400):
    draw = random.Random(seed)
    vocabulary = [f"t{i}" for i in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    rows = [(i, " ".join(draw.choices(vocabulary, weights, k=draw.choice([3, 20, 80, 300])))) for i in range(n)]
    rows += [(i + n, rows[i][1]) for i in range(0, n, 9)]
    draw.shuffle(rows)
    items = [(j, " ".join(draw.choices(vocabulary, [w**0.6 for w in weights], k=draw.choice([1, 4, 12])))) for j in range(60)]
    return rows, items


def searched(spark, rows, items, **options):
    index = ranked_search.build_index(documents(spark, rows), **options)
    queries = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in ranked_search.search(index, queries).collect()), key=repr)


@pytest.mark.parametrize("shard_bytes", [1 << 25, 20_000])
def test_search_equals_brute_force(spark, shard_bytes):
    rows, items = corpus(1, 900)
    assert searched(spark, rows, items, shard_bytes=shard_bytes) == brute_search(rows, items)


def test_small_blocks_windows_and_batches(spark, monkeypatch):
    for name, value in {"BLOCK": 4, "FIRST_WINDOW": 8, "WINDOW": 16, "QUERIES": 4}.items():
        monkeypatch.setattr(ranked_search, name, value)
    # Workers import the module afresh, so the search itself runs here.
    rows, items = corpus(2, 300)
    shard = ranked_search.Shard()
    for i, t in rows:
        shard.add(i, t.encode())
    n_docs, n_terms = len(rows), sum(len(terms(t)) for _, t in rows)
    packed = shard.pack(0, n_docs, n_terms).to_pylist()
    head = packed[0]
    norms, ids = np.frombuffer(head["heads"], "<i8"), np.frombuffer(head["postings"], "<i8", head["df"])
    null = np.zeros(len(ids), bool)
    lists = {r["term"]: ranked_search.Postings(r["df"], r["heads"], r["postings"], norms) for r in packed[1:]}
    df = {r["term"]: r["df"] for r in packed[1:]}
    got, opened, blocks = [], 0, 0
    for item, text in items:
        for p in lists.values():
            p.open.clear()
        weighted = [
            (math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * n, lists[t]) for t, n in Counter(terms(text)).items() if t in lists
        ]
        heap = ranked_search.Heap(10)
        ranked_search.search_shard(weighted, ids, null, heap)
        got += [(item, r, int(i), int(s)) for r, (i, s) in enumerate(zip(heap.id, heap.score), 1)]
        opened += sum(len(p.open) for _, p in weighted)
        blocks += sum(len(p.first) for _, p in weighted)
    assert sorted(got, key=repr) == brute_search(rows, items)
    assert opened < 0.8 * blocks


def test_search_of_messy_rows(spark, messy, nothing):
    items = [(1, "the quick brown fox"), (1, "FOX fox"), (None, "漢😀 end"), (2, None), (3, ""), (4, "x" * 100_000), (5, "unknown-term")]
    queries = spark.createDataFrame([(*i, None) for i in items], "item_id long, text string, term string")
    index = ranked_search.build_index(messy)
    got = sorted((tuple(r) for r in ranked_search.search(index, queries).collect()), key=repr)
    assert got == brute_search([(r[0], r[1]) for r in MESSY], items)
    assert ranked_search.search(ranked_search.build_index(nothing), queries).count() == 0
    assert ranked_search.search(index, queries.where("false")).count() == 0


# 13. Token counts


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


def counted(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def expected(library, rows, limit=2048):
    out = []
    for i, text in rows:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        out.append((i, len((text or "").encode()), n, n > limit))
    return sorted(out, key=repr)


@pytest.mark.parametrize("frequent", [0, 20, 100_000])
def test_counts_equal_the_library(spark, library, frequent):
    draw = random.Random(frequent)
    parts = [
        "a", "B", "é", "é", "́", "İ", "ß", "Σ", " ", "\n", "\t", "\x1c", "\x85", " ", "1", "²", "漢", "😀", "'s", "'", "S",
        "<|endoftext|>", "<|startoftext|>", "<|", "|>", "\x00", "-", "ǅ", "가", "Ⅷ", "‍", "!", " the ", " The quick", "l'été",
    ]
    rows = [(i, "".join(draw.choices(parts, k=draw.randint(0, 40)))) for i in range(400)]
    got = token_counts.count_tokens(documents(spark, rows), WORDS, limit=25, frequent=frequent)
    assert counted(got) == expected(library, rows, 25)


def test_counts_of_messy_rows(spark, library, messy, nothing):
    assert counted(token_counts.count_tokens(messy, WORDS)) == expected(library, [(r[0], r[1]) for r in MESSY])
    assert token_counts.count_tokens(nothing, WORDS).count() == 0


def test_frequent_words_are_bounded(spark):
    pieces = spark.range(1000).select(F.col("id").cast("string").alias("word"), (1000 - F.col("id")).alias("n"), F.lit(1).alias("pieces"))
    rare, known = token_counts.frequent_pieces(pieces, 300)
    assert 100 < len(known) <= 300 and rare.count() + len(known) == 1000
    # If all are equally frequent, none is sent along.
    assert token_counts.frequent_pieces(pieces.withColumn("n", F.lit(7)), 300)[1] == {}


def test_each_pre_token_is_cut_once(spark):
    docs = documents(spark, [(i, "same words same <|endoftext|> words.") for i in range(50)])
    with open(WORDS, encoding="utf-8") as f:
        spec = f.read()
    found = {r["word"]: (r["n"], r["pieces"]) for r in token_counts.count_pieces(token_counts.count_pre_tokens(docs, spec), spec).collect()}
    assert found == {"same": (100, 1), "words": (100, 1), " <|endoftext|>": (50, 1), ".": (50, 1)}
