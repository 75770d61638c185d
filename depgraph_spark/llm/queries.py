"""Queries of the operators over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .conversation_repair import repair_conversations
from .decontaminate import judge_contamination
from .language_id import identify_languages
from .lexicon import round_trip
from .line_dedup import dedup_lines
from .near_dedup import near_duplicates
from .pii import pii_digest
from .quality_ranker import learn_ranker, score_documents
from .quality_rules import judge_documents
from .ranked_search import build_index, search
from .token_counts import count_tokens
from .token_orc import read_token_orc, token_digest, write_token_orc
from .url_filter import filter_urls

# The tokenizer file of the byte-level vocabulary, in the public_tokenizers package.
TOKENIZER = "byte_bpe_50k.json"
# The file of the vocabulary with word ends.
WORD_TOKENIZER = "word_bpe_49k.json"

Query = Callable[[SparkSession, str], DataFrame]

# Fixed values of the URL rules: host, path, verdict.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), percent=85)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read(spark, sf_dir, "documents"))


OP2_SQL = """
WITH parts AS (
  SELECT doc_id, coalesce(source, '') AS site, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents),
keyed AS (SELECT *, trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS k FROM parts),
needed AS (SELECT least(10, greatest(3, CAST(ceil(count(DISTINCT coalesce(source, '')) / 2) AS BIGINT))) AS sites FROM documents),
common AS (
  SELECT k, min({'d': doc_id, 'p': pos}) AS first FROM keyed, needed WHERE k != '' GROUP BY k, sites
  HAVING count(DISTINCT site) >= CASE WHEN len(regexp_extract_all(k, '[^\\x20\\x09-\\x0D]+')) >= 20 THEN least(3, sites) ELSE sites END),
marked AS (
  SELECT keyed.*, c.k IS NOT NULL AND {'d': doc_id, 'p': pos} != c.first AS gone FROM keyed LEFT JOIN common c USING (k)),
kept AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, kept.text AS text
FROM documents d LEFT JOIN kept USING (doc_id)
"""


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return filter_urls(read(spark, sf_dir, "pages"), rules)


OP3_SQL = """
WITH rules(host, path, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
parts AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
judged AS (
  SELECT p.*, (
    SELECT max({'n': length(r.host || r.path), 'rule': r.host || r.path, 'verdict': r.verdict}) FROM rules r
    WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)) AS best
  FROM parts p)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM judged
"""


def op4_quality_ranker(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score_documents(docs, learn_ranker(docs, read(spark, sf_dir, "labels")))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(read(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(read(spark, sf_dir, "documents"))


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "documents"), tokenizer_path())


def op9_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_dir(spark)}/tokens/{uuid.uuid4().hex}"
    write_token_orc(read(spark, sf_dir, "documents"), path, tokenizer_path())
    return token_digest(read_token_orc(spark, path))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_documents(read(spark, sf_dir, "documents"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with planted faults, by crc32 of ``conv_id:turn`` modulo 20; nulls count as one blank."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"),
        (F.crc32(F.encode(key, "UTF-8")) % 20).alias("fault"),
    ).where("fault <> 0")
    fault = F.col("fault")
    text = F.when(fault == 1, F.lit("")).when(fault == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(fault == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(fault == 3, F.lit(2)).otherwise(F.lit(1)))).alias("copy")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read(spark, sf_dir, "conversations")
    return repair_conversations(damaged(conversations), ids=conversations.select("conv_id")).digests()


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build_index(read(spark, sf_dir, "documents")), read(spark, sf_dir, "benchmark"), k=10)


OP12_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS d, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
items AS (SELECT row_number() OVER () AS q, item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM benchmark),
found AS (SELECT d, doc_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
wanted AS (
  SELECT q, item_id, term, count(*) AS times
  FROM (SELECT q, item_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM items)
  GROUP BY ALL),
lens AS (SELECT d, count(*) AS n FROM found GROUP BY d),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lens),
tfs AS (SELECT d, doc_id, term, count(*) AS tf FROM found WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM tfs, totals GROUP BY term, docs),
scored AS (
  SELECT q, item_id, d, doc_id,
    CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) AS BIGINT) AS score
  FROM wanted JOIN weights USING (term) JOIN tfs USING (term) JOIN lens USING (d), totals
  GROUP BY q, item_id, d, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS r FROM scored WHERE score > 0)
SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, score FROM ranked WHERE r <= 10
"""


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"), tokenizer_path(WORD_TOKENIZER))


OP6_SQL = r"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
proposed AS (
  SELECT r, doc_id, t, kind, rank, words,
    regexp_extract_all(t, pattern) AS found, string_split_regex(t, pattern) AS gaps
  FROM texts, (VALUES
    ('email', 0, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+', 'mail|contact|write'),
    ('ip', 1, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)', 'address|host|server|login'),
    ('card', 2, '[0-9](?:[ -]?[0-9])+', 'card|visa|credit|payment'),
    ('phone', 3, '\+[0-9][ ().0-9-]+[0-9]', 'phone|call|tel|mobile'),
    ('iban', 4, '\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\b', 'iban|account|bank|transfer'),
    ('secret', 5, '[A-Za-z0-9_-]{20,}', 'token|secret|password|passwd|api.?key|access.?key|bearer')
  ) AS kinds(kind, rank, pattern, words)),
placed AS (
  SELECT r, doc_id, t, kind, rank, words, i, found[i] AS x,
    list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda f: length(f))), 0) AS s
  FROM proposed, unnest(range(1, len(found) + 1)) AS u(i)),
digit AS (SELECT *, regexp_replace(x, '[^0-9]', '', 'g') AS d, replace(x, ' ', '') AS plain FROM placed),
checked AS (
  SELECT *, CASE kind
    WHEN 'ip' THEN list_max(list_transform(string_split(x, '.'), lambda p: CAST(p AS HUGEINT))) <= 255
    WHEN 'card' THEN length(d) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda k:
      CASE WHEN k % 2 = 1 THEN CAST(d[length(d) + 1 - k] AS INT)
           WHEN CAST(d[length(d) + 1 - k] AS INT) > 4 THEN 2 * CAST(d[length(d) + 1 - k] AS INT) - 9
           ELSE 2 * CAST(d[length(d) + 1 - k] AS INT) END)) % 10 = 0
    WHEN 'phone' THEN length(d) BETWEEN 9 AND 15
    WHEN 'iban' THEN length(plain) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, list_transform(
      string_split(plain[5:] || plain[:4], ''), lambda c: CASE WHEN c >= 'A' THEN 100 + ascii(c) - 55 ELSE ascii(c) - 48 END)),
      lambda a, b: CASE WHEN b >= 100 THEN (a * 100 + b - 100) % 97 ELSE (a * 10 + b) % 97 END) = 1
    WHEN 'secret' THEN length(x) BETWEEN 20 AND 128 AND regexp_matches(x, '[A-Za-z]') AND regexp_matches(x, '[0-9]')
    ELSE true END AS ok,
    least(40 + CASE WHEN kind IN ('ip', 'card', 'iban') THEN 40 ELSE 0 END + CASE WHEN regexp_matches(
      lower(substr(t, CAST(greatest(s - 40, 0) AS BIGINT) + 1, CAST(s + length(x) - greatest(s - 40, 0) AS BIGINT) + 40)), words)
      THEN 40 ELSE 0 END, 100) AS score
  FROM digit),
spans AS (SELECT r, kind, rank, s, score, kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + length(x) AS BIGINT) AS span
  FROM checked WHERE ok AND (rank < 4 OR score >= 80)),
summed AS (
  SELECT r, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip,
    count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
    string_agg(span, ',' ORDER BY s, rank) FILTER (rank < 4) AS base, string_agg(span, ',' ORDER BY s, rank) AS spans,
    string_agg(CAST(score AS VARCHAR), ',' ORDER BY s, rank) AS scores
  FROM spans GROUP BY r)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
  coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM texts LEFT JOIN summed USING (r)
"""


def queries() -> dict[str, Query]:
    return {
        "op1_near_dedup": op1_near_dedup,
        "op2_line_dedup": op2_line_dedup,
        "op3_url_filter": op3_url_filter,
        "op4_quality_ranker": op4_quality_ranker,
        "op5_decontaminate": op5_decontaminate,
        "op6_pii": op6_pii,
        "op7_language_id": op7_language_id,
        "op8_bpe": op8_bpe,
        "op9_token_orc": op9_token_orc,
        "op10_quality_rules": op10_quality_rules,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_ranked_search": op12_ranked_search,
        "op13_token_counts": op13_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": OP2_SQL, "op3_url_filter": OP3_SQL, "op6_pii": OP6_SQL, "op12_ranked_search": OP12_SQL}
