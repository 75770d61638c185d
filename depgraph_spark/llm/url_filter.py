"""URL filter: lookups of host-suffix and path-prefix expressions by short hash, confirmed by full digest.

Every distinct URL is expanded into the expressions a rule could have: host suffixes with as many labels as some rule
has, times path prefixes as long as some rule's path. Expressions meet rules in an equi-join on the first four bytes
of their SHA-256; the whole digest confirms a hit, and the longest rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_counted, small

PREFIX_HEX = 8
DEFAULT_VERDICT = "allow"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_table(rules: DataFrame) -> DataFrame:
    """Digests of rules(host, path, verdict); of repeated rules with different verdicts, ``block`` stands."""
    named = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull()).select(
        F.concat("host", "path").alias("rule"), F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict"
    )
    one = named.groupBy("rule", "rule_host", "rule_path").agg(F.max("verdict").alias("verdict"))
    digest = F.sha2(F.concat_ws("\n", "rule_host", "rule_path"), 256)
    return one.select("rule", "verdict", digest.alias("digest"), F.substring(digest, 1, PREFIX_HEX).alias("short"))


def expressions(urls: DataFrame, labels: list[int], lengths: list[int]) -> DataFrame:
    """A row per distinct (host, path) and expression: its digest and the short prefix it is looked up by."""
    n_labels = F.size(F.split("host", r"\."))
    suffixes = F.array(*[F.when(n_labels >= k, F.substring_index("host", ".", -k)) for k in labels])
    prefixes = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths])
    one = urls.select("host", "path", F.explode(F.array_compact(suffixes)).alias("suffix"), prefixes.alias("prefixes"))
    both = one.select("host", "path", "suffix", F.explode(F.array_compact("prefixes")).alias("prefix"))
    digest = F.sha2(F.concat_ws("\n", "suffix", "prefix"), 256)
    return both.select("host", "path", digest.alias("full")).withColumn("short", F.substring("full", 1, PREFIX_HEX))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT) -> DataFrame:
    """Judge every url of pages(page_id, url): page_id, host, path, rule and verdict, one row per row of ``pages``.

    ``rules`` has host, path and verdict; a rule fits its host and all subdomains if the path starts with the rule's,
    and the longest rule wins (of equally long ones the greater in string order). A url that no rule fits has a null
    rule and the ``default`` verdict. A null url, or one without ``://``, has empty host and path, which no rule with
    a host fits. Rules with a null host or path are ignored. Repeated rows and repeated page ids keep a row each, null
    page ids too; other columns of ``pages``, whatever their names, are not read. An empty table gives no rows.

    Only the rules' label counts and path lengths come to the driver; both are bounded by the longest rule.
    """
    table, n_rules = cut_counted(rule_table(rules))
    shape = rules.select(F.size(F.split("host", r"\.")).alias("l"), F.length("path").alias("n")).agg(
        F.collect_set("l").alias("labels"), F.collect_set("n").alias("lengths")
    )
    found = shape.first()
    urls = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    if not found or not found["labels"] or not found["lengths"]:
        return urls.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    labels, lengths = ([n for n in sorted(found[k]) if n is not None and n >= 0] for k in ("labels", "lengths"))
    tried = expressions(urls.select("host", "path").distinct(), labels, lengths)
    hits = tried.join(small(table, n_rules), "short").where(F.col("full") == F.col("digest"))
    best = hits.groupBy("host", "path").agg(
        F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("best")
    )
    # Written, so that it doesn't share its exchange with the join: a pair that most urls have is then split.
    best, n_best = cut_counted(best)
    judged = urls.join(small(best, n_best), ["host", "path"], "left")
    return judged.select(
        "page_id", "host", "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
