"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust their score.

Everything is column expressions. A pattern is run once over each text; only texts with a hit are split by it, and the
lengths of hits and of the pieces between them give every span's place in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What each kind looks like. The proposals are written so that no text makes them slow: runs are
# possessive, and a run is entered only at its first character or where the last hit ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])"
SECRET = r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+"

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "secret")

# Score of a proposal, of a passed checksum and of a context word within CONTEXT_CHARS before or behind, 1 at most;
# spans of kinds outside the base are kept from KEEP_SCORE on, so a kind without checksum needs a context word.
PROPOSED, CONFIRMED, CONTEXT = 0.4, 0.4, 0.4
KEEP_SCORE = 0.8
CONTEXT_CHARS = 40
CONTEXT_WORDS = {
    "email": "mail|contact|write",
    "ip": "address|host|server|login",
    "card": "card|visa|credit|payment",
    "phone": "phone|call|tel|mobile",
    "iban": "iban|account|bank|transfer",
    "secret": "token|secret|password|passwd|api.?key|access.?key|bearer",
}


def hits(text: Column, pattern: str) -> Column:
    """struct(start, end, found) of every non-overlapping match, leftmost first, in code points, end exclusive."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,found:string>>").alias("out"))

        def step(state: Column, x: Column) -> Column:
            begin = state["at"] + x["gap"]
            end = begin + F.length(x["found"])
            one = F.array(F.struct(begin.alias("start"), end.alias("end"), x["found"].alias("found")))
            return F.struct(end.alias("at"), F.concat(state["out"], one).alias("out"))

        pairs = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("found"))
        return F.aggregate(pairs, start, step, lambda state: state["out"])

    nothing = F.array().cast("array<struct<start:int,end:int,found:string>>")
    return F.transform(F.array(matches), lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(nothing))[0]


def digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def ip_parts(found: Column) -> Column:
    """All four parts at most 255, leading zeros allowed."""
    part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return found.rlike(rf"^{part}(?:\.{part}){{3}}$")


def luhn(found: Column) -> Column:
    """12 to 19 digits that pass Luhn's sum."""
    number = digits(found)
    return F.length(number).between(12, 19) & F.call_function("luhn_check", number)


def mod97(found: Column) -> Column:
    """The four leading characters moved behind, letters as 10 to 35: remainder 1 by 97."""
    plain = F.replace(found, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    rest = F.aggregate(
        F.split(moved, ""),
        F.lit(0),
        lambda r, c: F.when(c == "", r)
        .when(c.between("0", "9"), (r * 10 + F.ascii(c) - ord("0")) % 97)
        .otherwise((r * 100 + F.ascii(c) - ord("A") + 10) % 97),
    )
    return F.length(plain).between(15, 34) & (rest == 1)


def secret_like(found: Column) -> Column:
    """20 to 128 characters with a letter and a digit."""
    return F.length(found).between(20, 128) & found.rlike("[A-Za-z]") & found.rlike("[0-9]")


def span_columns(text: Column) -> dict[str, Column]:
    """Per kind an array of struct(start, rank, end, kind, score): confirmed proposals only."""
    confirmed = {
        "email": (EMAIL, lambda x: F.lit(True), 0.0),
        "ip": (IP, ip_parts, CONFIRMED),
        "card": (CARD, luhn, CONFIRMED),
        "phone": (PHONE, lambda x: F.length(digits(x)).between(9, 15), 0.0),
        "iban": (IBAN, mod97, CONFIRMED),
        "secret": (SECRET, secret_like, 0.0),
    }

    def spans(rank: int, kind: str) -> Column:
        pattern, check, bonus = confirmed[kind]

        def scored(x: Column) -> Column:
            begin = F.greatest(x["start"] - CONTEXT_CHARS, F.lit(0))
            around = F.substring(text, begin + 1, x["end"] - begin + CONTEXT_CHARS)
            near = F.when(F.lower(around).rlike(CONTEXT_WORDS[kind]), CONTEXT).otherwise(0.0)
            score = F.least(F.lit(PROPOSED + bonus) + near, F.lit(1.0))
            return F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"),
                            F.lit(kind).alias("kind"), score.alias("score"))

        return F.transform(F.filter(hits(text, pattern), lambda x: check(x["found"])), scored)

    return {kind: spans(rank, kind) for rank, kind in enumerate(KINDS)}


def find_pii(docs: DataFrame, keep_score: float = KEEP_SCORE) -> DataFrame:
    """doc_id and ``found``: an array of struct(start, rank, end, kind, score) by start, then kind as in KINDS.

    Per kind, proposals are the leftmost non-overlapping matches; a proposal whose check fails is dropped without
    another try. Base kinds (email, ip, card, phone) always stay; other kinds need ``keep_score``: an IBAN has it by its
    checksum, a secret (a run of letters and digits) only by a context word nearby.

    A null or empty text has no spans. Every row keeps its row, repeated ids included; an empty table gives none.
    Only doc_id and text are read.
    """
    text = F.coalesce("text", F.lit(""))
    found = docs.select("doc_id", text.alias("_text"))
    found = found.select("doc_id", *[c.alias(k) for k, c in span_columns(F.col("_text")).items()])
    extra = [F.filter(k, lambda x: x["score"] >= keep_score) for k in KINDS if k not in BASE_KINDS]
    return found.select("doc_id", F.array_sort(F.concat(*map(F.col, BASE_KINDS), *extra)).alias("found"))


def pii_digest(docs: DataFrame, keep_score: float = KEEP_SCORE) -> DataFrame:
    """Counts per base kind, the hash of base spans, and all spans and scores (percent) as text, for every row of ``docs``.

    Without spans the counts are 0, the texts empty and the hash that of the empty string.
    """

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def base(spans: Column) -> Column:
        return F.filter(spans, lambda x: x["rank"] < len(BASE_KINDS))

    def of_kind(kind: str) -> Column:
        return F.filter("found", lambda x: x["kind"] == kind)

    counts = [F.size(of_kind(k)).cast("bigint").alias(f"n_{k}") for k in BASE_KINDS]
    scores = F.array_join(F.transform("found", lambda x: F.round(x["score"] * 100).cast("int").cast("string")), ",")
    return find_pii(docs, keep_score).select(
        "doc_id", *counts, F.sha2(joined(base(F.col("found"))), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"), scores.alias("scores"),
    )
