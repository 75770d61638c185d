"""Each operator on messy and empty tables, and against brute force or fixed answers on small ones."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyarrow import orc
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from depgraph_spark.llm import bpe, decontaminate, language_id, lexicon, line_dedup, near_dedup, pii, quality_ranker
from depgraph_spark.llm import quality_rules, token_orc, url_filter
from depgraph_spark.llm.queries import URL_RULES

from .conftest import MESSY, PLAIN, documents

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(TOKENIZER)


# 1. Near-duplicates


def shingles(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(docs, percent):
    sets = [(i, shingles(t)) for i, t in docs]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a][1] & sets[b][1])
            if both and 100 * both >= percent * len(sets[a][1] | sets[b][1]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted((i, len(s), least[find(k)], least[find(k)] == i) for k, (i, s) in enumerate(sets))


def mutated_groups(seed, groups=6, members=25):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    out = []
    for _ in range(groups):
        base = [draw.choice(vocabulary) for _ in range(draw.choice([4, 30, 120, 300]))]
        for _ in range(members):
            copy = list(base)
            for _ in range(draw.choice([0, 0, 1, 2, 4, 8])):
                copy[draw.randrange(len(copy))] = draw.choice(vocabulary)
            out.append(" ".join(copy))
    draw.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_equal_brute_force(spark, percent):
    docs = mutated_groups(percent)
    got = near_dedup.near_duplicates(documents(spark, docs), percent)
    assert rows_of(got, "doc_id", "n_shingles", "component_id", "kept") == sorted(brute_components(docs, percent), key=repr)


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """Buckets larger than a block give the same components."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    docs = mutated_groups(3, groups=2, members=60)
    got = near_dedup.near_duplicates(documents(spark, docs), 85)
    assert rows_of(got, "doc_id", "n_shingles", "component_id", "kept") == sorted(brute_components(docs, 85), key=repr)


def test_cells_of_large_buckets_are_bounded(spark, monkeypatch):
    """Whether a bucket has a main component or none, every pair across meets once and no cell grows with the bucket."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    for n_main in (1, 100):
        rows = [(1, i, 200, n_main, i >= n_main) for i in range(200)]
        table = spark.createDataFrame(rows, "band long, node long, size long, n_main long, outside boolean")
        cells = {}
        for r in near_dedup.dealt(table).collect():
            cells.setdefault((r["low"], r["high"]), []).append((r["home"], r["node"]))
        assert max(map(len, cells.values())) <= 5 * 8
        met = Counter()
        for (low, high), members in cells.items():
            for home, a in members:
                if home == low:
                    met.update((min(a, b), max(a, b)) for other, b in members if other == high and (low < high or a < b))
        assert met == Counter((a, b) for b in range(n_main, 200) for a in range(b))


def test_posterior_bound_keeps_similar_pairs():
    least = near_dedup.least_matches(85, 1e-5)
    assert all(0.5 * n < m < 0.85 * n for n, m in least.items())


def test_near_duplicates_of_messy_rows(spark, messy, nothing):
    got = {(r["doc_id"], r["n_shingles"]): r for r in near_dedup.near_duplicates(messy, 85).collect()}
    assert got[1, 19]["kept"] and got[2, 19]["component_id"] == 1 and not got[2, 19]["kept"]
    assert got[3, 0]["kept"] and got[5, 0]["component_id"] == 5
    assert got[6, 5000]["kept"] and got[7, 1]["kept"]
    assert got[None, 9]["component_id"] is None and got[None, 9]["kept"]
    assert near_dedup.near_duplicates(nothing).count() == 0
    kept = near_dedup.without_near_duplicates(messy)
    assert kept.columns == messy.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 3, 4, 5, 6, None, None, 7, 8, 9])
    assert near_dedup.without_near_duplicates(nothing).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    found, n = near_dedup.connected(edges)
    assert n == 201 and {r["comp"] for r in found.collect()} == {0}


def test_components_of_few_edges_write_few_parts(spark, monkeypatch):
    written = []

    def counting(df, *args, cut=near_dedup.cut_counted):
        written.append(cut(df, *args))
        return written[-1]

    monkeypatch.setattr(near_dedup, "cut_counted", counting)
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        edges = spark.createDataFrame([(i, 1000 + i % 300) for i in range(600) if i % 300], "a long, b long")
        found, n = near_dedup.connected(edges)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert n == 897 and found.select("comp").distinct().count() == 299
    assert max(len(df.inputFiles()) for df, _ in written[1:]) <= 8


# 2. Lines


def brute_lines(docs, sites):
    spread, first = {}, {}
    for i, text, _, source in docs:
        for pos, line in enumerate((text or "").split("\n")):
            k = line.strip(" \t\n\x0b\x0c\r")
            if k:
                spread.setdefault(k, set()).add(source)
                first[k] = min(first.get(k, (i, pos)), (i, pos))
    out = []
    for i, text, _, _ in docs:
        lines = [] if text is None else text.split("\n")
        kept = [
            x for pos, x in enumerate(lines)
            if len(spread.get(k := x.strip(" \t\n\x0b\x0c\r"), ())) < sites or first[k] == (i, pos)
        ]
        out.append((i, len(lines), len(lines) - len(kept), None if text is None else "\n".join(kept)))
    return sorted(out, key=repr)


def test_lines_equal_brute_force(spark):
    draw = random.Random(5)
    pool = [f"line {i}" for i in range(30)] + ["", " ", "  line 1 "]
    docs = [(i, "\n".join(draw.choice(pool) for _ in range(draw.randrange(6))), "en", f"s{draw.randrange(12)}") for i in range(60)]
    got = line_dedup.dedup_lines(documents(spark, docs), min_sites=4)
    assert rows_of(got, "doc_id", "n_lines", "n_removed", "text") == brute_lines(docs, 4)


def test_lines_of_few_sites_and_a_hot_one(spark):
    """Five sites, one with most rows: long passages go from three sites on, short lines from half of the sites."""
    passage = " ".join(f"word{i}" for i in range(25))
    docs = [(i, f"own {i}\n{passage}\nmenu\nrare", "en", "hot") for i in range(40)]
    docs += [(100 + i, f"own {i + 100}\n{passage}" + "\nmenu" * (i < 2), "en", f"s{i}") for i in range(4)]
    docs += [(200 + i, f"two sites only {passage}\nrare", "en", f"s{i}") for i in range(1)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(documents(spark, docs)).collect()}
    assert got[0] == docs[0][1] and got[7] == "own 7\nrare" and got[101] == "own 101" and got[200] == docs[-1][1]


def test_lines_of_messy_rows(messy, nothing):
    got = line_dedup.dedup_lines(messy, min_sites=2).collect()
    assert len(got) == len(MESSY)
    assert sorted(r["n_lines"] for r in got if r["text"] is None) == [0, 0]
    assert {r["n_lines"] for r in got if r["text"] == ""} == {1}
    assert line_dedup.dedup_lines(nothing).count() == 0


# 3. URLs


def test_urls(spark):
    urls = [
        "https://a.EXAMPLE.org/es/x?q", "http://example.org/en/12", "http://example.org/en/2", "x://com/fr/", "x://a.com/de/1#f",
        "x://notcom/fr/", "http://org", "no url", None, "", "a://b://c.org/", "http://x.com/fr", "http://" + "a." * 5000 + "org/y",
    ]
    pages = spark.createDataFrame([(i, u, "r", "h") for i, u in enumerate(urls)] + [(None, urls[0], "r", "h")] * 2,
                                  "page_id long, url string, rule string, host string")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    got = {(r["page_id"]): (r["host"][:20], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, rules).collect()}
    assert got[0] == got[None] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[1][2:] == ("example.org/en/1", "block") and got[2][2:] == ("org/", "allow")
    assert got[3][2:] == ("com/fr/", "allow") and got[4] == ("a.com", "/de/1", "com/de/", "block")
    assert got[5][2] is None and got[6] == ("org", "", None, "allow")
    assert got[7] == got[8] == got[9] == ("", "", None, "allow")
    assert got[10][:2] == ("b:", "//c.org/") and got[11][2] is None and got[12][2] == "org/"
    assert url_filter.filter_urls(pages, rules).count() == len(urls) + 2
    assert url_filter.filter_urls(pages, rules.limit(0)).where("rule is not null").count() == 0
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0


# 4. Quality


def test_ranker_separates_junk(spark):
    draw = random.Random(2)
    good = [" ".join(draw.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(draw.randrange(99)) for _ in range(80)) for _ in range(150)]
    junk = [" ".join(["| # *"] * draw.randrange(5, 40)) for _ in range(80)]
    docs = documents(spark, list(enumerate(good + junk)))
    labels = spark.createDataFrame([(i, int(i < 150), None) for i in range(230)] + [(None, 1, None), (3, None, None)],
                                   "doc_id long, quality int, text string")
    model = quality_ranker.learn_ranker(docs, labels)
    got = quality_ranker.score_documents(docs, model).collect()
    wrong = [r for r in got if r["held_out"] and r["predicted"] != int(r["doc_id"] < 150)]
    assert not wrong and any(r["held_out"] for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert quality_ranker.keep_preferred(docs, model).count() == 150


def test_ranker_of_messy_rows(spark, messy, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality_ranker.learn_ranker(messy, none)
    got = quality_ranker.score_documents(messy, model).collect()
    assert len(got) == len(MESSY) and all(r["score"] == 0.5 for r in got)
    ones = spark.createDataFrame([(i, 1) for i in range(9)], "doc_id long, quality int")
    assert all(r["predicted"] == 1 for r in quality_ranker.score_documents(messy, quality_ranker.learn_ranker(messy, ones)).collect())
    assert quality_ranker.score_documents(nothing, model).count() == 0
    assert quality_ranker.keep_preferred(messy, model).columns == messy.columns


# 5. Benchmark


def brute_tiles(doc, item, least=5):
    d, t = ([w.lower() for w in WORD.findall(x)] for x in (doc, item))
    free_d, free_t, covered = [True] * len(d), [True] * len(t), 0
    while True:
        best = (0, 0, 0)
        for p in range(len(t)):
            for q in range(len(d)):
                n = 0
                while p + n < len(t) and q + n < len(d) and t[p + n] == d[q + n] and free_t[p + n] and free_d[q + n]:
                    n += 1
                if n > best[0]:
                    best = (n, p, q)
        n, p, q = best
        if n < least:
            return covered / len(t)
        covered += n
        for k in range(n):
            free_t[p + k] = free_d[q + k] = False


def test_tiles_equal_brute_force(spark):
    draw = random.Random(4)
    words = [f"v{i}" for i in range(12)]
    items = [" ".join(draw.choice(words) for _ in range(draw.randrange(5, 40))) for _ in range(12)]
    docs = []
    for i in range(40):
        w = draw.choice(items).split()
        cut = draw.randrange(len(w))
        text = [*w[cut:], *draw.choices(words, k=10), *w[: cut - draw.randrange(3)]]
        docs.append((i, " ".join(text)))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.judge_contamination(documents(spark, docs), bench, 0.6).collect()}
    for i, text in docs:
        shares = [brute_tiles(text, item) for item in items]
        hit = [s for s in shares if s >= 0.6 - 1e-9]
        assert got[i]["contaminated"] == bool(hit) and got[i]["n_items"] == len(hit)
        if hit:
            assert abs(got[i]["coverage"] - max(hit)) < 1e-9 and got[i]["item_id"] == shares.index(max(shares))


def test_contamination_of_messy_rows(spark, messy, nothing):
    bench = spark.createDataFrame([(0, PLAIN, 1), (1, None, 1), (2, "too short", 1), (3, "", 1), (0, PLAIN, 1)],
                                  "item_id long, text string, score int")
    got = decontaminate.judge_contamination(messy, bench)
    assert got.count() == len(MESSY)
    assert [r["doc_id"] for r in got.where("contaminated").orderBy("doc_id").collect()] == [1, 1, 2]
    left = decontaminate.without_contaminated(messy, bench)
    assert left.count() == len(MESSY) - 3 and left.columns == messy.columns
    assert decontaminate.judge_contamination(nothing, bench).count() == 0
    assert decontaminate.judge_contamination(messy, bench.limit(0)).where("contaminated").count() == 0


def test_benchmark_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr("depgraph_spark.session.BROADCAST_ROWS", 0)
    monkeypatch.setattr(decontaminate, "BROADCAST_WORDS", 0)
    stem = "which of these is the one that is right "
    items = [(i, stem + " ".join(f"i{i}x{k}" for k in range(30))) for i in range(9)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = [*items, (9, stem + "nothing else"), (10, items[3][1] + " " + items[4][1])]
    got = decontaminate.judge_contamination(documents(spark, docs), bench).orderBy("doc_id").collect()
    assert [r["item_id"] for r in got] == [*range(9), None, 3] and got[10]["n_items"] == 2


def test_tiles_of_repetitive_texts():
    begun = time.perf_counter()
    same = np.full(20_000, 7, np.uint64)
    assert decontaminate.tiles(same[:5_000], same, np.zeros(20_000, bool)) == [(0, 0, 5_000)]
    assert time.perf_counter() - begun < 1


def test_long_passage_of_a_longer_item(spark):
    item = [f"w{k}" for k in range(500)]
    bench = spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")
    docs = [(1, "a b " + " ".join(item[100:150]) + " c"), (2, "a b " + " ".join(item[100:149]) + " c"), (3, " ".join(item[:10]))]
    got = {r["doc_id"]: r for r in decontaminate.judge_contamination(documents(spark, docs), bench).collect()}
    assert got[1]["contaminated"] and abs(got[1]["coverage"] - 0.1) < 1e-9
    assert not got[2]["contaminated"] and not got[3]["contaminated"]


# 6. Personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255:
                continue
            if kind == "card" and not (12 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


def test_personal_data_equals_brute_force(spark):
    draw = random.Random(9)
    parts = ["a@b.co", "x@y", "@", ".", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567",
             "+1", "5", " ", "-", "é", "😀", "\n", "_z@q.r.s", "00012345678901234567890", "word ", "+49.30.123456", "(", ")"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randrange(25))) for _ in range(400)]
    got = {r["doc_id"]: r for r in pii.pii_digest(documents(spark, list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        want = brute_spans(text)
        assert got[i]["spans"] == ",".join(want), text
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in BASE] == [sum(s.startswith(k + ":") for s in want) for k in BASE]


def test_checksums_add_spans(spark):
    docs = documents(spark, [(1, "pay to DE89 3704 0044 0532 0130 00 now"), (2, "pay to DE88370400440532013000 now")])
    got = {r["doc_id"]: r for r in pii.pii_digest(docs).collect()}
    assert "iban:7:34" in got[1]["spans"] and "iban" not in got[2]["spans"]
    scores = pii.find_pii(documents(spark, [(1, "call +1 555 123 4567"), (2, "fax +1 555 123 4567")])).orderBy("doc_id").collect()
    assert scores[0]["found"][0]["score"] > scores[1]["found"][0]["score"]


def test_context_words_decide_on_secrets(spark):
    run = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"
    texts = [f'token = "{run}"', f'commit = "{run}"', f'{run} {"-" * 30} password', f'{run} {"-" * 50} password',
             "token abcdefghijklmnopqrstuvwxyz", "token 12345678901234567890", "token a1" + "b" * 200, "é token a1b2c3d4e5f6g7h8i9j0"]
    got = {r["doc_id"]: r for r in pii.pii_digest(documents(spark, list(enumerate(texts)))).collect()}
    assert [got[i]["spans"] for i in range(8)] == ["secret:9:49", "", "secret:0:40", "", "", "", "", "secret:8:28"]
    assert [got[i]["scores"] for i in range(8)] == ["80", "", "80", "", "", "", "", "80"]


def test_personal_data_of_messy_rows(spark, messy, nothing):
    got = pii.pii_digest(messy)
    assert got.count() == len(MESSY) and got.where("spans <> ''").count() == 0
    assert pii.pii_digest(nothing).count() == 0
    hard = ["a" * 200_000, "1" * 200_000, "1 " * 100_000, "1." * 100_000, "+" + "1 " * 100_000, "a@" * 50_000, "a.b@c." * 20_000, "AB12" * 50_000]
    assert pii.pii_digest(documents(spark, list(enumerate(hard)))).count() == len(hard)


# 7. Languages


def test_languages(spark):
    draw = random.Random(8)
    sounds = {"aa": ["ka", "to", "mi"], "bb": ["sch", "ung", "ber"], "cc": ["éau", "que", "ment"]}
    docs = []
    for i in range(240):
        lang = draw.choice(sorted(sounds))
        docs.append((i, " ".join("".join(draw.choices(sounds[lang], k=3)) for _ in range(30)), lang))
    docs += [(900, None, "aa"), (901, "123 ...", "bb"), (902, "", "cc"), (903, "katomi", None)]
    got = {r["doc_id"]: r for r in language_id.identify_languages(documents(spark, docs)).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in docs[:240])
    model = language_id.learn(language_id.training_sample(documents(spark, docs)))
    marks = language_id.predict(documents(spark, [(1, "\u0301"), (2, "1\u0301 \u0903!"), (3, "a\u0301")]), model)
    assert [r["lang_pred"] == "und" for r in marks.orderBy("doc_id").collect()] == [True, True, False]
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und", "und", "und", "aa"]
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_more_languages_than_bits(spark):
    docs = [(i * 200 + k, f"{chr(0x4E00 + i)}{chr(0x5E00 + i)}{chr(0x6E00 + i)} " * 5, f"l{i:03}") for i in range(70) for k in range(6)]
    got = language_id.identify_languages(documents(spark, docs)).collect()
    assert all(r["lang_pred"] == f"l{r['doc_id'] // 200:03}" for r in got)


def test_languages_of_messy_rows(messy, nothing):
    got = language_id.identify_languages(messy)
    assert got.count() == len(MESSY) and got.where("lang_pred is null or score is null").count() == 0
    assert language_id.identify_languages(nothing).count() == 0
    model = language_id.learn(language_id.training_sample(nothing))
    assert {r["lang_pred"] for r in language_id.predict(messy, model).collect()} == {"und"}


# 8. Byte-pair encoding


def odd_texts(n=300):
    draw = random.Random(1)
    alphabet = "ab'stredmlv \n\t\u00a0\u3000é9²Ⅷ漢😀!?.<|>\x1c\x85\u200b"
    return ["".join(draw.choice(alphabet) for _ in range(draw.randrange(40))) for _ in range(n)] + [
        "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "don't I'll 's 're '''s", "a" * 5000, "ab" * 40_000, " " * 3000 + "x", "",
    ]


def test_round_trip_equals_library(spark, library):
    texts = odd_texts()
    docs = documents(spark, list(enumerate(texts)))
    got = {r["doc_id"]: r for r in lexicon.round_trip(docs, TOKENIZER, lexicon_words=50).collect()}
    ids = {r["doc_id"]: list(r["ids"]) for r in lexicon.encode_texts(docs, TOKENIZER, lexicon_words=50).collect()}
    for i, e in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert ids[i] == e.ids, texts[i][:80]
        again = library.decode(e.ids, skip_special_tokens=False)
        want = (len(e.ids), hashlib.sha256(",".join(map(str, e.ids)).encode()).hexdigest(), hashlib.sha256(again.encode()).hexdigest())
        assert tuple(got[i])[1:] == want
    decoded = lexicon.decode_ids(lexicon.encode_texts(docs, TOKENIZER, 50), TOKENIZER)
    assert {r["doc_id"]: r["text"] for r in decoded.collect()} == dict(enumerate(texts))


def test_automaton_is_minimal_and_exact(library):
    words = sorted({b"tap", b"taps", b"top", b"tops", b"stop", b"", b"stops", b"a"} - {b""})
    keys, targets, numbers, ends = lexicon.minimal_automaton(words)
    # One state each for the start, after s, t, st, [ts]t[oa], the shared ends "p" and "s", and after a.
    assert len(ends) <= 7
    vocabulary = bpe.load_vocabulary(TOKENIZER)
    table = lexicon.Lexicon(lexicon.compile_lexicon([w.decode() for w in words], vocabulary))
    asked = [*words, b"ta", b"tapsx", b"z", b"stopp"]
    raw = np.frombuffer(b"".join(asked), np.uint8)
    ids, counts, known = table(raw, np.array([len(w) for w in asked]))
    assert known.tolist() == [True] * len(words) + [False] * 4
    want = [library.encode(w.decode(), add_special_tokens=False).ids for w in words]
    assert ids.tolist() == sum(want, []) and counts.tolist() == [len(w) for w in want]


def test_encoding_of_messy_rows(messy, nothing):
    got = lexicon.round_trip(messy, TOKENIZER)
    assert got.count() == len(MESSY)
    assert got.where("n_tokens = 0").count() == 3
    assert lexicon.round_trip(nothing, TOKENIZER).count() == 0


# 9. ORC


def test_token_files(spark, tmp_path, library):
    texts = odd_texts()
    order = list(range(len(texts)))
    random.Random(3).shuffle(order)
    docs = documents(spark, [(2 * i, texts[i]) for i in order]).repartition(7)
    path = str(tmp_path / "tokens")
    token_orc.write_token_orc(docs, path, TOKENIZER)
    got = {r["doc_id"]: r for r in token_orc.token_digest(token_orc.read_token_orc(spark, path)).collect()}
    start = 0
    for i, e in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        ids = np.array([*e.ids, 0], "<u4")
        assert tuple(got[2 * i]) == (2 * i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    some = token_orc.read_token_orc(spark, path, [4, 5]).collect()
    assert [r["doc_id"] for r in some] == [4] and list(some[0]["ids"])[-1] == 0


def test_token_file_metadata(spark, tmp_path):
    """Row index stride and stripes as written; an id that is absent is ruled out by Bloom filters before a row is read."""
    path = str(tmp_path / "indexed")
    docs = spark.range(0, 40_000, 2, 2).select(F.col("id").alias("doc_id"), F.lit("a few words of text").alias("text"))
    token_orc.write_token_orc(docs, path, TOKENIZER)
    files = [orc.ORCFile(str(f)) for f in (tmp_path / "indexed").glob("*.orc")]
    assert sum(f.nrows for f in files) == 20_000 and all(f.nstripes >= 1 for f in files if f.nrows)
    assert {f.row_index_stride for f in files} == {token_orc.INDEX_ROWS}

    def rows_read(doc_id):
        found = token_orc.read_token_orc(spark, path, [doc_id])
        n = len(found.collect())
        scan = found._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
        return n, scan.metrics().apply("numOutputRows").value()

    kept, read = rows_read(10_000)
    assert kept == 1 and 0 < read <= 2 * token_orc.INDEX_ROWS
    absent = [rows_read(i) for i in range(10_001, 10_021, 2)]
    assert all(n == 0 for n, _ in absent) and sum(read == 0 for _, read in absent) >= 8


def test_token_files_of_messy_rows(spark, messy, nothing, tmp_path):
    token_orc.write_token_orc(messy, str(tmp_path / "a"), TOKENIZER)
    got = token_orc.token_digest(token_orc.read_token_orc(spark, str(tmp_path / "a"))).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, None, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9]
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    token_orc.write_token_orc(nothing, str(tmp_path / "b"), TOKENIZER)
    assert token_orc.token_digest(token_orc.read_token_orc(spark, str(tmp_path / "b"))).count() == 0


# 10. Quality rules


def brute_statistics(text):
    w = WORD.findall(text or "")
    windows = Counter(zip(w, w[1:], w[2:]))
    covered, seen, dup = set(), set(), 0
    for k in range(len(w) - 2):
        if windows[w[k], w[k + 1], w[k + 2]] > 1:
            covered |= {k, k + 1, k + 2}
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_statistics_equal_brute_force(spark, messy):
    draw = random.Random(6)
    texts = ["".join(draw.choice(["a", "b", "é😀", "#", "|", " ", " ", "\n", "\t", "\x0b"]) for _ in range(draw.randrange(80))) for _ in range(300)]
    docs = documents(spark, [*enumerate(texts)]).unionByName(messy.select("doc_id", "text", "lang", "source").where("doc_id is not null"))
    got = quality_rules.judge_documents(docs)
    want = [*enumerate(texts), *[(r[0], r[1]) for r in MESSY if r[0] is not None]]
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert rows_of(got, "doc_id", *names) == sorted(((i, *brute_statistics(t)) for i, t in want), key=repr)
    for r in got.collect():
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_outliers_go(spark):
    draw = random.Random(7)
    docs = [(i, " ".join(f"w{draw.randrange(900)}" for _ in range(draw.randrange(60, 200))), "en", "a") for i in range(300)]
    docs += [(900 + i, " ".join(f"w{draw.randrange(900)} | #" for _ in range(60)), "en", "a") for i in range(20)]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judge_documents(documents(spark, docs)).collect()}
    assert all(got[i] == (i < 900) for i in got)


def test_each_statistic_rejects_alone(spark):
    """Documents that the base keeps and that are odd in one statistic go; slightly odd ones stay."""
    draw = random.Random(8)

    def words(n, vocabulary=900):
        return [f"w{draw.randrange(vocabulary)}" for _ in range(n)]

    def lines(copies):
        return "\n".join([*["one line"] * (copies + 1), " ".join(words(120))])

    def repeats(n):
        again = words(n)
        return " ".join([*again, *words(200 - 2 * n), *again])

    plain = [" ".join(words(draw.randrange(60, 200))) for _ in range(300)]
    odd = {
        "log_words": " ".join(words(5_000, 1_000_000_000)),
        "word_length": " ".join(w + "abcdefgh" for w in words(100)),
        "symbols": " ".join([*words(100), *["#"] * 12]),
        "dup_lines": lines(8),
        "repeats": repeats(35),
    }
    slight = [lines(2), repeats(5), " ".join([*words(100), "#"])]
    docs = [(i, text, "en", "a") for i, text in enumerate([*plain, *slight, *odd.values()])]
    got = {r["doc_id"]: r for r in quality_rules.judge_documents(documents(spark, docs)).collect()}
    usual = len(plain) + len(slight)
    assert all(got[i]["kept"] for i in range(usual))
    assert not any(got[i]["base_failed"] for i in range(usual, len(docs)))
    assert {name for i, name in enumerate(odd, usual) if not got[i]["kept"]} == set(odd)


def test_rules_of_messy_rows(messy, nothing):
    got = quality_rules.judge_documents(messy)
    assert got.count() == len(MESSY) and got.where("kept is null").count() == 0
    assert quality_rules.judge_documents(nothing).count() == 0


def test_ranker_learns_from_every_labelled_document(spark, monkeypatch):
    held = [i for i in range(1, 400) if zlib.crc32(str(i).encode()) % 3 == 1]
    learned = [i for i in range(1, 400) if i not in held]
    docs = spark.createDataFrame(
        [(i, " ".join(["word"] * (i % 40 + 1)) + " #" * (i % 3)) for i in range(1, 400)], "doc_id bigint, text string"
    )
    labels = spark.createDataFrame([(i, int(i % 40 > 12)) for i in range(1, 400)], "doc_id bigint, quality int")
    seen = []
    fit = quality_ranker.fit_pairs
    monkeypatch.setattr(quality_ranker, "fit_pairs", lambda rows: seen.append(rows) or fit(rows))
    model = quality_ranker.learn_ranker(docs, labels)
    assert seen[0].count() == len(learned)
    pos = quality_ranker._numbered(seen[0]).groupBy("_label").agg(F.sort_array(F.collect_list("pos")).alias("p")).collect()
    assert all(r["p"] == list(range(len(r["p"]))) for r in pos) and len(pos) == 2
    # The threshold lies between the two utilities that part as many documents as label 0 has.
    rows = seen[0].select((model.utility() + model.threshold).alias("u")).collect()
    utility, n_bad = sorted(r["u"] for r in rows), sum(i % 40 <= 12 for i in learned)
    assert abs(model.threshold - (utility[n_bad - 1] + utility[n_bad]) / 2) < 1e-9
    monkeypatch.setattr(quality_ranker, "BROADCAST_ROWS", 10)
    large = quality_ranker.learn_ranker(docs, labels)
    assert seen[1].count() == len(learned) and abs(large.threshold - model.threshold) < 0.5
