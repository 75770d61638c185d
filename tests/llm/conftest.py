import pytest

LONG = " ".join(f"word{i % 5000}" for i in range(60_000))
PLAIN = "The quick brown fox jumps over the lazy dog and then it runs away from all of the other animals in the wood"

# doc_id, text, lang, source and columns whose names clash with inner ones.
MESSY = [
    (1, PLAIN, "en", "a"),
    (1, PLAIN, "en", "a"),
    (2, PLAIN.upper(), "en", "b"),
    (3, None, "en", "a"),
    (4, "", None, "b"),
    (5, " \t\n\x0b ", "en", None),
    (6, LONG, None, None),
    (None, "no id here but a text with enough words in it to count", "fr", "a"),
    (None, None, None, None),
    (7, "x" * 100_000, "en", "a"),
    (8, "one", "de", "c"),
    (9, "<|endoftext|> it's\n\né漢😀 \x00 end", "fr", "c"),
]
CLASHING = (
    "_id long, _text string, _row int, node long, n int, h long, g int, pos int, line string, found string, score double, "
    "kept boolean, part int, ids string, level int, group int, word string, _doc long, _gone int, bands int, comp long"
)
SCHEMA = f"doc_id long, text string, lang string, source string, {CLASHING}"
WIDTH = len(CLASHING.split(","))


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame([(*r, *[None] * WIDTH) for r in MESSY], SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark, rows):
    """(doc_id, text[, lang[, source]]) rows as a documents table."""
    full = [(*r, *[None] * (4 - len(r)))[:4] for r in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string")
