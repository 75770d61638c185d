"""Training-data pipeline: quality, line dedup, near-dedup, benchmark decontamination, tokens.

Each stage takes (spark, docs, sf_dir), works on all documents that the one before kept, and returns a DataFrame that is
written as Parquet and read again for the next. All but the last return the columns of the documents.

Every stage takes nulls in any column, empty and very long texts, repeated rows, empty tables and further columns of any
name; what it makes of them is stated below. Columns other than ``doc_id``, ``text`` and ``source`` only pass through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depgraph_spark.llm.decontaminate import without_contaminated
from depgraph_spark.llm.lexicon import encode_texts
from depgraph_spark.llm.line_dedup import MIN_SITES, without_boilerplate
from depgraph_spark.llm.near_dedup import without_near_duplicates
from depgraph_spark.llm.quality_ranker import keep_preferred, learn_ranker
from depgraph_spark.llm.queries import read, tokenizer_path
from depgraph_spark.session import checkpoint_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at least a half, under a ranking learned from the labels.

    Null and empty texts are scored like others, by statistics of zero. Equal texts have equal scores, so repeated rows
    stay or go together; a score of exactly a half stays. Without usable labels nothing goes.
    """
    return keep_preferred(docs, learn_ranker(docs, read(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated boilerplate lines; a document of which only white space is left goes.

    Long lines need as many sites as short ones here: a text copied to a few sites is left whole for near_dedup.
    Null, empty and blank texts lose no line and stay, as they are. Null sources are one site. The first occurrence of a
    line is the one with the least (doc_id, line number), null ids first; rows equal in id and text are treated alike.
    """
    rows = without_boilerplate(docs, long_sites=MIN_SITES)
    left = (F.col("_n_removed") == 0) | F.col("_clean").rlike(r"[^\x20\x09-\x0D]")
    changed = F.col("_n_removed") > 0
    return rows.where(left).select(*[
        F.col("_clean").alias("text") if c == "text"
        else F.when(changed, F.length("_clean")).otherwise(F.col("_row")[c]).cast("bigint").alias(c) if c == "n_chars"
        else F.col("_row")[c].alias(c)
        for c in docs.columns
    ])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates.

    The row with the least doc_id stays, null ids come last; of rows that repeat id and text, one stays. Null, empty and
    blank texts resemble nothing and all stay.
    """
    return without_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item.

    Null and empty texts, texts and items under five words, and an empty benchmark match nothing. Repeated rows stay or
    go together.
    """
    return without_contaminated(docs, read(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every document.

    A null or empty text has no ids and a count of zero; repeated rows and null ids keep a row each. Other columns go.
    """
    encoded = encode_texts(docs, tokenizer_path())
    return encoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("bpe", tokens),
]

# Rankings, sketches and token merges have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{checkpoint_dir(spark)}/pipeline/{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
