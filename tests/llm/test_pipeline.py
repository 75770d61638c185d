"""The stages of the pipeline one after another, against decisions that are known beforehand."""

import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline

FOOTER = "this footer stands on every site of the crawl"


def test_stages_in_turn(spark, tmp_path):
    draw = random.Random(11)

    def prose(n=80):
        words = [f"{draw.choice(['al', 'be', 'ga', 'de'])}{draw.randrange(5000)}" for _ in range(n)]
        return "\n".join(" ".join(words[i : i + 20]) for i in range(0, n, 20))

    good = {i: prose() for i in range(60)}
    bench = prose(20)
    texts = {i: f"{t}\n{FOOTER}" for i, t in good.items()}
    texts |= {100 + i: " ".join(["| # *"] * draw.randrange(5, 40)) for i in range(40)}
    texts |= {200 + i: texts[0] for i in range(3)}
    texts[203] = texts[0].replace(good[0].split()[40], "changed")
    texts[204] = f"{prose()}\n{bench.upper()}\n{prose(20)}"
    rows = [(i, t, "en", f"s{i % 12}", len(t), "x") for i, t in texts.items()]
    sf_dir = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long, node string"
    spark.createDataFrame(rows, schema).write.parquet(f"{sf_dir}/documents.parquet")
    labels = [(i, int(i < 100), 0) for i in texts if i < 200]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf_dir}/labels.parquet")
    spark.createDataFrame([(0, bench)], "item_id long, text string").write.parquet(f"{sf_dir}/benchmark.parquet")

    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "near_dedup", "decontamination", "bpe"]
    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, sf_dir).write.parquet(f"{sf_dir}/{name}")
        docs = spark.read.parquet(f"{sf_dir}/{name}")
        if name != "bpe":
            assert docs.dtypes == before.dtypes
            kept.append({r["doc_id"]: r for r in docs.collect()})
    prime = set(good) | {200, 201, 202, 203, 204}
    assert [set(k) for k in kept] == [prime, prime, set(good) | {204}, set(good)]
    assert {i for i, r in kept[1].items() if FOOTER in r["text"]} == {0}
    assert all(r["n_chars"] == len(r["text"]) for r in kept[1].values())
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r["doc_id"]: r for r in docs.collect()}
    assert set(got) == set(good)
    for i, r in got.items():
        want = library.encode(kept[3][i]["text"], add_special_tokens=False).ids
        assert list(r["ids"]) == want and r["n_tokens"] == len(want)


def tables(spark, folder, docs, benchmark):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages_on_messy_rows(spark, messy, tmp_path):
    """Every stage alone on the messy table: which rows stay, and that the columns do."""
    leaked = "no id here but a text with enough words in it to count"
    sf_dir = tables(spark, tmp_path, messy, [(0, leaked), (1, None), (2, ""), (3, "one"), (None, None)])
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted(map(repr, docs.collect()))
    for name, stage in corpus_pipeline.STAGES[:4]:
        found = stage(spark, docs, sf_dir)
        assert found.dtypes == docs.dtypes
        got = sorted(map(repr, found.collect()))
        if name in ("quality_classifier", "line_dedup"):
            assert got == rows
        elif name == "near_dedup":
            assert len(got) == len(rows) - 2 and set(got) < set(rows)
            assert sorted(r["doc_id"] for r in found.collect() if r["doc_id"]) == [*range(1, 2), *range(3, 10)]
        else:
            assert got == [r for r in rows if leaked not in r]
    encoded = corpus_pipeline.tokens(spark, docs, sf_dir)
    got = encoded.collect()
    assert encoded.columns == ["doc_id", "n_tokens", "ids"] and len(got) == len(rows)
    assert all(r["n_tokens"] == len(r["ids"]) for r in got)
    assert {r["doc_id"]: r["n_tokens"] for r in got if r["doc_id"] in (3, 4)} == {3: 0, 4: 0}


def test_run(spark, messy, nothing, tmp_path):
    """The whole pipeline on messy rows, and on tables without a row."""
    leaked = "no id here but a text with enough words in it to count"
    got = corpus_pipeline.run(spark, tables(spark, tmp_path / "messy", messy, [(0, leaked)])).collect()
    assert sorted(r["doc_id"] or 0 for r in got) == [0, 1, 3, 4, 5, 6, 7, 8, 9]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] or "" for r in messy.collect() if r["doc_id"]}
    for r in got:
        if r["doc_id"]:
            assert list(r["ids"]) == library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
    empty = corpus_pipeline.run(spark, tables(spark, tmp_path / "nothing", nothing, []))
    assert empty.columns == ["doc_id", "n_tokens", "ids"] and empty.count() == 0
