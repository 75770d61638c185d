"""Conversation structure repair: the cheapest edits that give alternating roles, by dynamic programming on a grammar.

Every row becomes a symbol of its role and fault. Re-Pair rules, learned from all distinct symbol sequences, stand for
frequent runs of symbols. A rule has one min-plus matrix over the states of the role automaton, whose entries carry the
cost and the edits of the cheapest way, put together bottom-up from the matrices of its two parts and shared by all
conversations. A conversation's matrix is the product of the matrices of its compressed sequence.

Rows are sorted by range, so that a conversation of any size is spread over tasks, and packed into chunks. Conversations
that lie in one chunk are finished where they are; the chunks of the others meet in order, one at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import cut, cut_counted, small

# Costs, states and how a role's initial leads from state to state.
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
KEEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
LEGAL_PAIRS = ("su", "ua", "au")

# Symbols of rows: a role's initial (x: any other), in upper case if the text is truncated, or a row that has to go.
GONE = "-"
SYMBOLS = "suaxSUAX" + GONE

# Rows and characters of text in a chunk; a longer text is a chunk's last.
CHUNK_ROWS, CHUNK_CHARS = 1024, 1 << 18
# Rules of the grammar, at most. More would shorten sequences further and change no result.
MAX_RULES, RULES_PER_ROUND = 48, 6
RULE_CHARS = 0xE000

SPACE = r"[\x20\x09-\x0D]"

# A matrix: (from, to) -> (cost, edits).
Matrix = dict[tuple[int, int], tuple[int, str]]


def _least(entries) -> Matrix:
    out: Matrix = {}
    for key, way in entries:
        if key not in out or way < out[key]:
            out[key] = way
    return out


def times(a: Matrix, b: Matrix) -> Matrix:
    """Min-plus product: least cost, then the ASCII-least edits.

    Comparing edits before what follows is safe: of two equally dear ways over the same rows neither begins the other,
    since the longer one would have more inserts.
    """
    return _least(
        ((i, j), (c + d, x + y)) for (i, k), (c, x) in a.items() for (l, j), (d, y) in b.items() if k == l
    )


def inserts() -> Matrix:
    """Any number of inserted rows."""
    out = [((i, i), (0, "")) for i in STATES]
    for i in STATES:
        at, edits = i, ""
        for _ in range(2):
            at, edits = NEXT[at], edits + "I"
            out.append(((i, at), (INSERT * len(edits), edits)))
    return _least(out)


def symbol_matrix(symbol: str) -> Matrix:
    """Inserts and then the edit of one row."""
    edit = [((i, i), (DELETE, "D")) for i in STATES]
    if symbol != GONE:
        more = TRUNCATED if symbol.isupper() else 0
        edit += [((i, j), (more, "K")) for (i, initial), j in KEEPS.items() if initial == symbol.lower()]
        edit += [((i, j), (REROLE + more, "R")) for i, j in NEXT.items()]
    return times(inserts(), _least(edit))


@dataclass
class Grammar:
    """Rules in the order of their making: (new symbol, its two parts), and the matrix of every symbol."""

    rules: list[tuple[str, str]] = field(default_factory=list)
    matrices: dict[str, Matrix] = field(default_factory=lambda: {s: symbol_matrix(s) for s in SYMBOLS})

    def add(self, pair: str) -> None:
        symbol = chr(RULE_CHARS + len(self.rules))
        self.rules.append((symbol, pair))
        self.matrices[symbol] = times(self.matrices[pair[0]], self.matrices[pair[1]])

    def compressed(self, symbols: Column) -> Column:
        for symbol, pair in self.rules:
            symbols = F.replace(symbols, F.lit(pair), F.lit(symbol))
        return symbols

    def matrix(self, sequence: str) -> Matrix:
        """Product over a compressed sequence, halved so that long sequences stay cheap."""
        parts = [self.matrices[c] for c in sequence]
        while len(parts) > 1:
            parts = [times(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else {(i, i): (0, "") for i in STATES}


def learn_grammar(sequences: DataFrame, max_rules: int = MAX_RULES) -> Grammar:
    """Re-Pair over distinct ``sequences(symbols)``: in each round the most frequent pairs that share no symbol become rules.

    Pairs are counted over all distinct sequences; a handful of counts reach the driver.
    """
    grammar = Grammar()
    while len(grammar.rules) < max_rules:
        packed = sequences.select(grammar.compressed(F.col("symbols")).alias("s"))
        at = F.explode(F.sequence(F.lit(1), F.length("s") - 1)).alias("at")
        pairs = packed.where(F.length("s") > 1).select("s", at).select(F.substring(F.col("s"), F.col("at"), F.lit(2)).alias("pair"))
        found = (
            pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
            .orderBy(F.col("n").desc(), "pair").limit(4 * RULES_PER_ROUND).collect()
        )
        taken: set[str] = set()
        before = len(grammar.rules)
        for row in found:
            if len(grammar.rules) - before < min(RULES_PER_ROUND, max_rules - before) and not taken & set(row["pair"]):
                taken |= set(row["pair"])
                grammar.add(row["pair"])
        if len(grammar.rules) == before:
            break
    return grammar


def best_edits(vector: dict[int, tuple[int, str]]) -> tuple[int, str]:
    """The cheapest way to an end: no row at all, which is the state START, or an assistant's row last."""
    last = times({(START, j): way for j, way in vector.items()}, inserts())
    return min(way for (_, j), way in last.items() if j in (START, ASSISTANT))


def edited_rows(edits: str, at: int, state: int, roles: list, texts: list):
    """Rows (edit, role, text) of a chunk under ``edits`` from place ``at`` on; returns the new place and state.

    Inserts stand before the row that follows them; those behind the last chunk are left to ``closing_rows``.
    """
    out = []
    for role, text in zip(roles, texts):
        while edits[at] == "I":
            state, at = NEXT[state], at + 1
            out.append(("I", NAMES[state], ""))
        edit, at = edits[at], at + 1
        if edit == "D":
            out.append(("D", role, text))
        elif edit == "R":
            state = NEXT[state]
            out.append(("R", NAMES[state], text))
        else:
            state = KEEPS[state, role[0]]
            out.append(("K", role, text))
    return out, at, state


def closing_rows(edits: str, at: int, state: int) -> list[tuple[str, str, str]]:
    out = []
    for _ in edits[at:]:
        state = NEXT[state]
        out.append(("I", NAMES[state], ""))
    return out


# --- rows in order ---

CHUNK_FIELDS = (
    "conv_id bigint, part int, seq bigint, whole boolean, roles array<string>, texts array<string>, symbols string, "
    "blank bigint, duplicate bigint, truncated bigint, illegal bigint, head string, tail string, "
    "turns bigint, first_turn bigint, last_turn bigint"
)


def ordered_rows(conversations: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Rows by conversation and turn (nulls first), then role and text, spread by range.

    Equal rows may stand in either order, so a number within the task splits them over ranges. ``ids(conv_id)`` are
    conversations that count although they may have no row.
    """
    last = F.regexp_extract("text", rf"([^\x20\x09-\x0D]){SPACE}*\z", 1)
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
        F.lit(True).alias("here"),
    )
    if ids is not None:
        listed = ids.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct().withColumn("here", F.lit(False))
        rows = rows.unionByName(listed, allowMissingColumns=True)
    initial = F.substring("role", 1, 1)
    rows = rows.withColumn("blank", ~F.col("text").rlike(r"[^\x20\x09-\x0D]")).withColumn(
        "symbol",
        F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("x")),
    )
    rows = rows.withColumn("symbol", F.when(last.isin(".", "!", "?"), F.col("symbol")).otherwise(F.upper("symbol")))
    spread = rows.withColumn("_start", F.substring("text", 1, 64)).withColumn("_hash", F.xxhash64("text"))
    spread = spread.withColumn("_salt", F.monotonically_increasing_id() % 97)
    order = ["conv_id", "turn", "here", "role", "_start", "_hash"]
    sorted_ = spread.repartitionByRange(*order, "_salt").sortWithinPartitions(*order)
    return sorted_.select("conv_id", "turn", "role", "text", "here", "blank", "symbol", F.spark_partition_id().alias("part"))


def _digest(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()


class _Chunk:
    def __init__(self, conv_id, part: int, seq: int, alone: bool):
        self.conv_id, self.part, self.seq, self.alone = conv_id, part, seq, alone
        self.roles, self.texts, self.symbols, self.turns = [], [], [], []
        self.chars = self.blank = self.duplicate = self.truncated = 0

    def add(self, row: dict, seen: set[bytes]) -> None:
        role, text = row["role"], row["text"]
        symbol = row["symbol"]
        key = _digest(role, text)
        if row["blank"]:
            symbol, self.blank = GONE, self.blank + 1
        elif key in seen:
            symbol, self.duplicate = GONE, self.duplicate + 1
        elif symbol.isupper():
            self.truncated += 1
        seen.add(key)
        self.roles.append(role)
        self.texts.append(text)
        self.symbols.append(symbol)
        if row["turn"] is not None:
            self.turns.append(row["turn"])
        self.chars += len(text)

    @property
    def full(self) -> bool:
        return len(self.roles) >= CHUNK_ROWS or self.chars >= CHUNK_CHARS

    def row(self, whole: bool) -> dict:
        initials = [r[:1] for r in self.roles]
        turns = self.turns
        return {
            "conv_id": self.conv_id, "part": self.part, "seq": self.seq, "whole": whole, "roles": self.roles,
            "texts": self.texts, "symbols": "".join(self.symbols), "blank": self.blank, "duplicate": self.duplicate,
            "truncated": self.truncated,
            "illegal": sum(a + b not in LEGAL_PAIRS for a, b in zip(initials, initials[1:])),
            "head": initials[0] if initials else None, "tail": initials[-1] if initials else None,
            "turns": sum(a != b for a, b in zip(turns, turns[1:])) + bool(turns),
            "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None,
        }


def chunks(rows: DataFrame) -> DataFrame:
    """Ordered rows packed into chunks of one conversation; ``whole`` if nothing of it can be anywhere else.

    Repeated rows are found within a task; a conversation that other tasks may share is looked through again later.
    """
    schema = StructType.fromDDL(CHUNK_FIELDS)
    arrow = to_arrow_schema(schema)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, seen, seq, out, chars = None, set(), 0, [], 0
        for batch in batches:
            for row in batch.to_pylist():
                fresh = chunk is None or row["conv_id"] != chunk.conv_id
                if fresh or chunk.full:
                    if chunk is not None:
                        out.append(chunk.row(fresh and chunk.alone))
                        chars += chunk.chars
                    # The first conversation of a task may have begun in the one before.
                    chunk, seq = _Chunk(row["conv_id"], row["part"], seq, fresh and chunk is not None), seq + 1
                    if fresh:
                        seen = set()
                if row["here"]:
                    chunk.add(row, seen)
                if chars > CHUNK_CHARS or len(out) > 5000:
                    yield pa.RecordBatch.from_pylist(out, arrow)
                    out, chars = [], 0
        if chunk is not None:
            out.append(chunk.row(False))
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    return rows.mapInArrow(packed, schema)


def mark_shared_duplicates(parts: DataFrame) -> DataFrame:
    """``parts``, chunks of conversations in several tasks, with rows that an earlier task has seen counted as duplicates.

    Only digests are compared, first sights by an aggregation; what comes back is a list of places per chunk.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keep = [i for i, s in enumerate(row["symbols"]) if s != GONE]
                rows = [
                    {"conv_id": row["conv_id"], "part": row["part"], "seq": row["seq"], "i": i, "key": _digest(row["roles"][i], row["texts"][i])}
                    for i in keep
                ]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema([
                        ("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("i", pa.int64()), ("key", pa.binary())
                    ]))

    thin = cut(parts.select("conv_id", "part", "seq", "roles", "texts", "symbols").mapInArrow(
        digests, "conv_id bigint, part int, seq bigint, i bigint, key binary"
    ))
    first = thin.groupBy(F.col("conv_id").alias("conv"), F.col("key").alias("same")).agg(
        F.min("part").alias("first"), F.count(F.lit(1)).alias("n")
    )
    again = thin.join(first.where("n > 1"), F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("key") == F.col("same")))
    places, n = cut_counted(again.where("part > first").groupBy("part", "seq").agg(F.collect_list("i").alias("places")))
    found = parts.join(small(places, n), ["part", "seq"], "left")
    at = F.coalesce("places", F.array().cast("array<bigint>"))
    each = F.sequence(F.lit(1), F.length("symbols"))
    new = F.transform(
        each, lambda i: F.when(F.array_contains(at, i.cast("bigint") - 1), F.lit(GONE)).otherwise(F.substring("symbols", i, F.lit(1)))
    )
    cut_off = F.size(F.filter(at, lambda i: F.substring("symbols", (i + 1).cast("int"), F.lit(1)).rlike("[A-Z]")))
    # Counted before the symbols change: in one step they could be looked up by their new name.
    found = found.withColumn("duplicate", F.col("duplicate") + F.size(at)).withColumn("truncated", F.col("truncated") - cut_off)
    marked = F.when(F.col("places").isNull(), F.col("symbols")).otherwise(F.array_join(new, ""))
    return found.withColumn("symbols", marked).select(*parts.columns)


# --- edits ---

REPORT_FIELDS = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


class _Report:
    """What the chunks of a conversation, one after another, add up to."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.tail = None
        # The edits that all ways share so far, and the ways' own ends.
        self.done: list[str] = []
        self.ways: dict[int, tuple[int, str]] = {START: (0, "")}

    def add(self, row: dict, matrix: Matrix) -> None:
        for name in ("blank", "duplicate", "truncated", "illegal", "turns"):
            setattr(self, name, getattr(self, name) + row[name])
        if row["head"] is not None:
            if self.tail is not None and self.tail + row["head"] not in LEGAL_PAIRS:
                self.illegal += 1
            self.tail = row["tail"]
        if row["first_turn"] is not None:
            self.turns -= self.last == row["first_turn"]
            self.first = row["first_turn"] if self.first is None else self.first
            self.last = row["last_turn"]
        ways = times({(START, i): way for i, way in self.ways.items()}, matrix)
        self.ways = {j: way for (_, j), way in ways.items()}
        texts = [w for _, w in self.ways.values()]
        low, high = min(texts), max(texts)
        n = next((i for i, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))
        if n > 1 << 12:
            self.done.append(low[:n])
            self.ways = {j: (c, w[n:]) for j, (c, w) in self.ways.items()}

    def row(self) -> dict:
        cost, edits = best_edits(self.ways)
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return {
            "conv_id": self.conv_id, "gaps": gaps, "blank": self.blank, "duplicate": self.duplicate,
            "truncated": self.truncated, "illegal": self.illegal, "cost": cost, "audit": "".join(self.done) + edits,
        }


@dataclass(frozen=True)
class Repair:
    """Conversations in chunks: those in one chunk, and those in several; with the grammar for their sequences."""

    whole: DataFrame
    shared: DataFrame
    grammar: Grammar

    def _finished(self, emit, schema: str) -> DataFrame:
        """``emit(report, chunks)`` yields rows of ``schema`` for every conversation, from its report and its chunks."""
        spark = self.whole.sparkSession
        target, reports_as = StructType.fromDDL(schema), StructType.fromDDL(REPORT_FIELDS)
        arrow, report_arrow = to_arrow_schema(target), to_arrow_schema(reports_as)
        grammar = spark.sparkContext.broadcast(self.grammar)
        chunk_columns = [c for c in self.whole.columns if c != "whole"]
        packed = self.grammar.compressed(F.col("symbols"))

        def written(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
            out, size = [], 0
            for row in rows:
                out.append(row)
                size += sum(len(v) for v in row.values() if isinstance(v, str))
                if size > CHUNK_CHARS or len(out) >= 5000:
                    yield pa.RecordBatch.from_pylist(out, arrow)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, arrow)

        def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matrices: dict[str, Matrix] = {}

            def rows():
                for batch in batches:
                    for row in batch.to_pylist():
                        sequence = row["sequence"]
                        if sequence not in matrices:
                            if len(matrices) > 20_000:
                                matrices.clear()
                            matrices[sequence] = grammar.value.matrix(sequence)
                        report = _Report(row["conv_id"])
                        report.add(row, matrices[sequence])
                        yield from emit(report.row(), iter([row]))

            yield from written(rows())

        def reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows():
                report = None
                for batch in batches:
                    for row in batch.to_pylist():
                        if report is None or row["conv_id"] != report.conv_id:
                            if report is not None:
                                yield report.row()
                            report = _Report(row["conv_id"])
                        report.add(row, grammar.value.matrix(row["sequence"]))
                if report is not None:
                    yield report.row()

            for row in rows():
                yield pa.RecordBatch.from_pylist([row], report_arrow)

        def followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def stream():
                for batch in batches:
                    yield from (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows))

            def rows():
                source = stream()
                row = next(source, None)
                while row is not None:
                    report, ahead = row, []

                    def mine():
                        for later in source:
                            if later["audit"] is not None:
                                ahead.append(later)
                                return
                            yield later

                    yield from emit(report, mine())
                    row = ahead[0] if ahead else None

            yield from written(rows())

        one = self.whole.select(*chunk_columns, packed.alias("sequence")).mapInArrow(alone, target)
        thin = [c for c in chunk_columns if c not in ("roles", "texts", "symbols")]
        order = ["conv_id", "part", "seq"]
        several = self.shared.select(*thin, packed.alias("sequence"))
        reports = cut(several.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(reported, reports_as))
        # A conversation's report comes first, then its chunks in order.
        texts = self.shared.select("conv_id", "part", "seq", "roles", "texts")
        stream = reports.unionByName(texts, allowMissingColumns=True)
        stream = stream.repartition("conv_id").sortWithinPartitions(F.col("conv_id"), F.col("audit").isNull(), F.col("part"), F.col("seq"))
        return one.unionByName(stream.mapInArrow(followed, target))

    def rows(self) -> DataFrame:
        """(conv_id, place, edit, role, text): all rows of all conversations after the edits, deleted ones marked D."""

        def emit(report: dict, parts: Iterator[dict]) -> Iterator[dict]:
            for place, (edit, role, text) in enumerate(_edited(report["audit"], parts)):
                yield {"conv_id": report["conv_id"], "place": place, "edit": edit, "role": role, "text": text}

        return self._finished(emit, "conv_id bigint, place bigint, edit string, role string, text string")

    def digests(self) -> DataFrame:
        """A row per conversation: its faults, cost and edits, and a SHA-256 of the repaired ``role:text`` lines."""

        def emit(report: dict, parts: Iterator[dict]) -> Iterator[dict]:
            digest, begun = hashlib.sha256(), False
            for edit, role, text in _edited(report["audit"], parts):
                if edit != "D":
                    digest.update((("\n" if begun else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                    begun = True
            names = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
            yield {**{n: report[n] for n in names}, "repaired_sha256": digest.hexdigest()}

        return self._finished(emit, REPORT_FIELDS + ", repaired_sha256 string")


def _edited(edits: str, parts: Iterator[dict]) -> Iterator[tuple[str, str, str]]:
    at, state = 0, START
    for part in parts:
        rows, at, state = edited_rows(edits, at, state, part["roles"], part["texts"])
        yield from rows
    yield from closing_rows(edits, at, state)


def repair_conversations(conversations: DataFrame, ids: DataFrame | None = None) -> Repair:
    """Repair of every conversation of ``conversations(conv_id, turn, role, text)``.

    Null texts and roles are one blank; a null conv_id is a conversation of its own, null turns come first. Rows of one
    turn stand in the order of role and text (of texts that begin alike for 64 characters, of a hash). Repeated rows are
    duplicates. ``ids`` may name conversations without rows: no faults, no cost, no edits. Other columns are not read, and
    an empty table gives an empty result. Texts and conversations may have any length: chunks are bounded, and only a
    conversation's edits, one letter a row, are held whole by a task.
    """
    packed = cut(chunks(ordered_rows(conversations, ids)))
    shared = packed.where("NOT whole")
    spread = shared.groupBy("conv_id").agg(F.count_distinct("part").alias("n")).where("n > 1").select("conv_id")
    spread, n = cut_counted(spread.withColumn("spread", F.lit(True)))
    if n:
        told = shared.join(small(spread.withColumnRenamed("conv_id", "_conv"), n), F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
        inside = told.where(F.col("spread").isNull()).drop("_conv", "spread")
        across = told.where(F.col("spread").isNotNull()).drop("_conv", "spread")
        shared = cut(inside.unionByName(mark_shared_duplicates(across)))
    whole = packed.where("whole")
    sequences = cut(whole.select("symbols").unionByName(shared.select("symbols")).distinct())
    return Repair(whole, shared, learn_grammar(sequences))
