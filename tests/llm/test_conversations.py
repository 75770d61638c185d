"""Conversation repair against exhaustive search, in one chunk and in many."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest
from pyspark.sql import functions as F

from depgraph_spark.llm import conversation_repair as repair
from depgraph_spark.llm.queries import damaged

SCHEMA = "conv_id long, turn long, role string, text string"
SOLID = re.compile(r"[^\x20\x09-\x0D]")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20
        if fault == 0:
            continue
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if fault == 3 else 1)
    return out


def brute_edits(rows):
    """(cost, edits, repaired rows) of rows (role, text, fault) by search over all edits."""

    def after(last):
        return "assistant" if last == "u" else "user"

    def fits(last, role):
        return last + role in ("s", "u", "su", "ua", "au")

    @cache
    def best(i, last, inserted):
        ways = []
        if i == len(rows) and last in ("", "a"):
            ways.append((0, "", ()))
        if inserted < 2:
            cost, edits, out = best(i, after(last)[0], inserted + 1)
            ways.append((cost + 3, "I" + edits, (f"{after(last)}:", *out)))
        if i < len(rows):
            role, text, fault = rows[i]
            cost, edits, out = best(i + 1, last, 0)
            ways.append((cost + 4, "D" + edits, out))
            if fault in (None, "truncated"):
                more = 3 if fault else 0
                if role and fits(last, role[0]):
                    cost, edits, out = best(i + 1, role[0], 0)
                    ways.append((cost + more, "K" + edits, (f"{role}:{text}", *out)))
                for new in ("user", "assistant"):
                    if fits(last, new[0]):
                        cost, edits, out = best(i + 1, new[0], 0)
                        ways.append((cost + more + 3, "R" + edits, (f"{new}:{text}", *out)))
        return min(ways, default=(10**9, "", ()))

    for i in range(len(rows), -1, -1):
        for last in ("", "s", "u", "a"):
            for inserted in (2, 1, 0):
                best(i, last, inserted)
    return best(0, "", 0)


def brute(original):
    rows = damage(original)
    out = []
    for conv in {r[0] for r in original}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, faults = set(), []
        for _, _, role, text in mine:
            last = SOLID.findall(text)
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else None
            seen.add((role, text))
            faults.append(fault)
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[2][:1] for r in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, lines = brute_edits(tuple((r[2], r[3], f) for r, f in zip(mine, faults)))
        out.append((
            conv, gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def talks(seed, n, most=9):
    draw = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(draw.randint(1, most)):
            role = draw.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None])
            text = draw.choice(["Hi.", "Hi.", "What?", f"Words {draw.random()}.", "cut off", " \t", "", None, "é漢!\n"])
            rows.append((conv, draw.choice([turn, turn, turn, None, turn + 2]), role, text))
    return rows


def results(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA)
    found = repair.repair_conversations(damaged(table), ids=table.select("conv_id"))
    return sorted((tuple(r) for r in found.digests().collect()), key=repr), found


def test_edits_equal_exhaustive_search(spark):
    rows = talks(1, 400)
    got, _ = results(spark, rows)
    assert got == brute(rows)


@pytest.mark.parametrize("together", ["true", "false"])
def test_conversations_over_many_chunks_and_tasks(spark, together):
    """A conversation with most of all rows over several chunks, in one task or in several, with repeats far apart."""
    draw = random.Random(7)
    rows = talks(2, 40)
    kinds = ["user", "assistant", "assistant", "system"]
    rows += [(77, i, draw.choice(kinds), draw.choice([f"t{i}.", f"t{i}!", f"t{i - 700}.", "cut", "Hi!"])) for i in range(1300)]
    rows += [(None, None, "user", "same.")] * 30
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", together)
    try:
        got, found = results(spark, rows)
        assert got == brute(rows)
        spread = found.shared.where("conv_id = 77").agg(F.count_distinct("part"), F.count("*")).first()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spread[1] > 1 and (spread[0] > 1) == (together == "false")


def test_long_conversation_shares_its_edits_early(spark):
    """Edits that all ways share are put aside, so long conversations are not compared again and again."""
    rows = [(5, i, "user" if i % 2 else "assistant", f"row {i}.") for i in range(20_000)]
    table = spark.createDataFrame(rows, SCHEMA)
    row = repair.repair_conversations(table).digests().first()
    assert row["cost"] == 6 and row["audit"] == "I" + "K" * 20_000 + "I"
    assert row["illegal"] == 0 and row["gaps"] == 0


def test_rules_shorten_sequences_and_share_matrices(spark):
    sequences = spark.createDataFrame([("uaUAua-uaua",), ("uauauaua",), ("su-aua",), ("",), ("u",)], "symbols string")
    grammar = repair.learn_grammar(sequences)
    assert grammar.rules and grammar.rules[0][1] == "ua"
    for row in sequences.select("symbols", grammar.compressed(F.col("symbols")).alias("s")).collect():
        assert len(row["s"]) <= len(row["symbols"])
        plain = repair.Grammar()
        assert grammar.matrix(row["s"]) == plain.matrix(row["symbols"])
    assert repair.learn_grammar(sequences.where("false")).rules == []


def test_rows_after_repair(spark):
    rows = [(1, 0, "system", "S."), (1, 1, "assistant", "A."), (1, 2, "user", ""), (2, 0, None, None)]
    found = repair.repair_conversations(spark.createDataFrame(rows, SCHEMA))
    got = sorted((r["conv_id"], r["place"], r["edit"], r["role"], r["text"]) for r in found.rows().collect())
    assert got == [
        (1, 0, "K", "system", "S."), (1, 1, "I", "user", ""), (1, 2, "K", "assistant", "A."), (1, 3, "D", "user", ""),
        (2, 0, "D", " ", " "),
    ]


def test_empty_and_messy_tables(spark):
    clash = SCHEMA + ", symbol string, seq string, part string, whole int, audit int"
    nothing = spark.createDataFrame([], clash)
    assert repair.repair_conversations(nothing).digests().count() == 0
    rows = [(1, 0, "user", "x" * 500_000 + ".", *[None] * 5), (None, None, None, None, *[None] * 5)] * 2
    got = {r["conv_id"]: r for r in repair.repair_conversations(spark.createDataFrame(rows, clash)).digests().collect()}
    assert got[1]["duplicate"] == 1 and got[1]["audit"] == "KDI" and got[1]["cost"] == 7
    assert got[None]["blank"] == 2 and got[None]["audit"] == "DD"
    empty = repair.repair_conversations(nothing, ids=spark.createDataFrame([(4,)], "conv_id long")).digests().first()
    assert empty["audit"] == "" and empty["cost"] == 0 and empty["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
