"""Repair of the turns of conversations with the cheapest edits, in pieces of bounded length.

A conversation is cut into pieces by its turns. Each piece is folded on its own: with block tables to costs between the
states at its two ends, later to edits from each state that it may begin in. Between these passes only summaries of
pieces are carried along a conversation, first backward (costs), then forward (states). The texts move once, to meet the
edits; a conversation with very many rows is many pieces in many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DataType, IntegerType, LongType, StringType, StructField, StructType

from corpusmill.llm.repair_tables import BAD, END, EXPECTED, FAR, FORWARD, INITIALS, START, U, A, S, costs_over, edits
from corpusmill.session import scratch_path

PIECE_BITS = 12
"""A piece holds the rows of so many bits of neighbouring turns."""
_GAPS = " \t\n\x0b\x0c\r"
_NO_TURN = -(1 << 60)
_FLUSH = 1000
_FLUSH_CHARS = 1 << 20


def _schema(*parts: StructType | str | tuple[str, DataType]) -> StructType:
    """A schema of ``name type`` words, of typed fields and of other schemas."""
    out = StructType()
    for part in parts:
        if isinstance(part, str):
            words = part.split()
            for name, kind in zip(words[::2], words[1::2]):
                out.add(name, kind)
        else:
            for field in part if isinstance(part, StructType) else [StructField(*part)]:
                out.add(field)
    return out


_LONGS = ArrayType(LongType())
PIECES = _schema(
    "conv string piece long symbols binary blank long duplicate long truncated long illegal long head string tail string",
    "low long high long turns long",
    ("between", _LONGS),
)
_SCANNED = _schema(PIECES, ("after", _LONGS), "first boolean last boolean cost long")
_TRACED = _schema(_SCANNED, ("letters", ArrayType(StringType())), ("leaves", ArrayType(IntegerType())))
REPORT = _schema("conv string gaps long blank long duplicate long truncated long illegal long cost long audit string")
_STATED = _schema(REPORT, "piece long enters integer letters string")


class Repair(NamedTuple):
    reports: DataFrame
    """One row per conversation: ``conv_id`` and the columns of ``REPORT``."""
    rows: DataFrame
    """What is left and what is inserted: ``conv_id, conv, piece, nth, edit, turn, role, text``."""


def conv_key(conv_id: Column) -> Column:
    """A key that is never null; conversations without an id are one."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def repair_conversations(rows: DataFrame, whole: bool = False) -> Repair:
    """Faults, cheapest edits and repaired rows of ``rows(conv_id, turn, role, text)``; other columns are not read.

    Rows stand by turn (null first), those of one turn by the digest of role and text; equal rows are neighbours. A null
    role or text counts as one space. The first fault of a row counts: blank (nothing but 09-0D and 20), duplicate (role
    and text seen before), truncated (its last other character is not one of ``.!?``). Edits: keep (0), rename to user or
    assistant (2), delete (3, a must for blank and duplicate rows), insert an empty row (2); a truncated row that stays
    costs 1. The roles left begin with at most one s and then alternate u, a. ``gaps`` are turns missing between the
    least and the greatest. Texts may have any length; an empty table has no rows in either result.

    ``whole`` deals out ``rows`` by conversation and not by piece, in order within each: for results that need a
    conversation from front to back, such as a digest. They are read as a stream, never held.
    """
    spark = rows.sparkSession
    wide = _keyed(rows)
    narrow = wide.select("conv", "piece", "turn", "key", F.substring("role", 1, 1).alias("initial"), _symbol().alias("symbol"))
    path = scratch_path(spark, "turns")
    narrow.write.parquet(path)
    narrow = spark.read.parquet(path)
    again = narrow.filter(F.col("symbol") != BAD).groupBy("conv", "key").agg(F.min("piece").alias("since"), F.max("piece").alias("until"))
    marked = narrow.join(again.filter("since < until").drop("until"), ["conv", "key"], "left").select(
        *narrow.columns, F.coalesce(F.col("piece") > F.col("since"), F.lit(False)).alias("again")
    )
    pieces = _in_order(marked, ["conv", "piece"], ["turn", "key"]).mapInArrow(_summaries, PIECES)
    scanned = pieces.repartition("conv").sortWithinPartitions("conv", F.col("piece").desc()).mapInArrow(_backward, _SCANNED)
    traced = scanned.repartition("conv", "piece").mapInArrow(_traced, _TRACED)
    stated = traced.repartition("conv").sortWithinPartitions("conv", "piece").mapInArrow(_forward, _STATED)
    path = scratch_path(spark, "edits")
    stated.write.parquet(path)
    stated = spark.read.parquet(path)
    reports = stated.filter("cost IS NOT NULL").drop("piece", "enters", "letters")
    return Repair(reports, _repaired(wide, stated, whole))


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with the key of their conversation, their piece, and the digest of role and text."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    turn = F.col("turn").cast("long")
    key = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    # rows without a turn stand by their digest, whose first digits cut them evenly
    piece = F.coalesce(F.shiftright(turn, PIECE_BITS), F.lit(_NO_TURN) + F.conv(F.substring(key, 1, 2), 16, 10).cast("long"))
    return rows.select("conv_id", conv_key(F.col("conv_id")).alias("conv"), piece.alias("piece"), turn.alias("turn"), key.alias("key"), role.alias("role"), text.alias("text"))


def _symbol() -> Column:
    """The symbol of a row, duplicates apart."""
    said = F.rtrim("text", F.lit(_GAPS))
    initial = F.substring("role", 1, 1)
    role = F.coalesce(*(F.when(initial == c, F.lit(2 * i)) for i, c in enumerate(INITIALS)), F.lit(2 * len(INITIALS)))
    open_end = F.when(F.right(said, F.lit(1)).isin(".", "!", "?"), 0).otherwise(1)
    return F.when(said == "", F.lit(BAD)).otherwise(role + open_end)


def _in_order(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions("conv", "piece", *order)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _written(rows: Iterator[tuple[Any, ...]], schema: StructType, size: int | None = None) -> Iterator[pa.RecordBatch]:
    """Batches of rows, ended by their number or by the characters in column ``size``."""
    arrow = to_arrow_schema(schema)
    held: list[tuple] = []
    chars = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)

    for row in rows:
        held.append(row)
        chars += len(row[size]) if size is not None else 0
        if len(held) >= _FLUSH or chars > _FLUSH_CHARS:
            yield batch()
            held, chars = [], 0
    if held:
        yield batch()


class _Piece:
    """What is known of a piece while its rows come by."""

    def __init__(self, conv: str, piece: int):
        self.conv, self.piece = conv, piece
        self.symbols, self.seen = bytearray(), set()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.head = self.tail = self.low = self.high = None

    def add(self, turn: int | None, key: str, initial: str, symbol: int, again: bool) -> None:
        if symbol == BAD:
            self.blank += 1
        elif again or key in self.seen:
            self.duplicate += 1
            symbol = BAD
        else:
            self.seen.add(key)
            self.truncated += symbol % 2
        self.symbols.append(symbol)
        if self.tail is None:
            self.head = initial
        else:
            self.illegal += self.tail + initial not in _LEGAL
        self.tail = initial
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = (turn if self.low is None else self.low), turn

    def row(self) -> tuple:
        symbols = bytes(self.symbols)
        between = [costs_over(symbols, tuple(0 if q == r else FAR for q in range(4))) for r in range(4)]
        flat = [x for costs in between for x in costs]
        counts = (self.blank, self.duplicate, self.truncated, self.illegal)
        return (self.conv, self.piece, symbols, *counts, self.head, self.tail, self.low, self.high, self.turns, flat)


_LEGAL = {"su", "ua", "au"}


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per piece; the rows of a piece come in order."""

    def rows() -> Iterator[tuple]:
        at = None
        for conv, piece, turn, key, initial, symbol, again in _read(batches):
            if at is None or (conv, piece) != (at.conv, at.piece):
                if at is not None:
                    yield at.row()
                at = _Piece(conv, piece)
            at.add(turn, key, initial, symbol, again)
        if at is not None:
            yield at.row()

    return _written(rows(), PIECES)


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs behind each piece, from the last piece of a conversation to its first."""

    def rows() -> Iterator[tuple]:
        held, costs = None, END
        for row in _read(batches):
            last = held is None or held[0] != row[0]
            if held is not None:
                yield (*held, last, held_last, costs[START] if last else None)
            after = END if last else costs
            between = row[-1]
            costs = tuple(min(FAR, *(between[4 * r + q] + after[r] for r in range(4))) for q in range(4))
            held, held_last = (*row, list(after)), last
        if held is not None:
            yield (*held, True, held_last, costs[START])

    return _written(rows(), _SCANNED)


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of each piece from each state it may begin in, and where they lead."""
    names = _SCANNED.names
    symbols, after, first, last = (names.index(c) for c in ("symbols", "after", "first", "last"))

    def rows() -> Iterator[tuple]:
        for row in _read(batches):
            found = edits(row[symbols], tuple(row[after]), [START] if row[first] else [START, S, U, A], row[last])
            yield (*row, [x for x, _ in found], [q for _, q in found])

    return _written(rows(), _TRACED)


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state each piece begins in and its edits; with the last piece, the report of the conversation."""

    def rows() -> Iterator[tuple]:
        for p in (dict(zip(_TRACED.names, row)) for row in _read(batches)):
            if p["first"]:
                state, audit, cost, tail = START, [], p["cost"], None
                total = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
                low = high = None
            for name in total:
                total[name] += p[name]
            total["illegal"] += tail is not None and tail + p["head"] not in _LEGAL
            tail = p["tail"]
            if p["turns"]:
                low, high = (p["low"] if low is None else low), p["high"]
            audit.append(p["letters"][state])
            stated = (p["piece"], state, p["letters"][state])
            state = p["leaves"][state]
            if p["last"]:
                gaps = high - low + 1 - total["turns"] if high is not None else 0
                counts = [total[c] for c in ("blank", "duplicate", "truncated", "illegal")]
                yield (p["conv"], gaps, *counts, cost, "".join(audit), *stated)
            else:
                yield (p["conv"], *[None] * 7, *stated)

    return _written(rows(), _STATED)


def _repaired(wide: DataFrame, stated: DataFrame, whole: bool) -> DataFrame:
    """The edits of a piece come in front of its rows, in one exchange."""
    letters = stated.select("conv", "piece", F.lit(0).alias("kind"), "letters", "enters")
    both = wide.withColumn("kind", F.lit(1)).unionByName(letters, allowMissingColumns=True).select(*_BOTH, "conv_id")
    dealt = both.repartition("conv") if whole else both.repartition("conv", "piece")
    schema = _schema(_ROWS, ("conv_id", wide.schema["conv_id"].dataType))
    return dealt.sortWithinPartitions("conv", "piece", "kind", "turn", "key").mapInArrow(_edited(schema), schema)


_BOTH = ["conv", "piece", "kind", "turn", "key", "role", "text", "letters", "enters"]
_ROWS = _schema("conv string piece long nth long edit string turn long role string text string")


def _edited(schema: StructType):
    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def inserted(conv: str, piece: int, conv_id: Any) -> Iterator[tuple]:
            nonlocal nth, state
            while nth < len(letters) and letters[nth] == "I":
                yield conv, piece, nth, "I", None, EXPECTED[state], "", conv_id
                nth, state = nth + 1, FORWARD[state]

        def rows() -> Iterator[tuple]:
            nonlocal nth, state, letters
            held = None
            for conv, piece, kind, turn, _, role, text, new, enters, conv_id in _read(batches):
                if kind == 0:
                    if held is not None:
                        yield from inserted(*held)
                    letters, state, nth = new, enters, 0
                    continue
                held = conv, piece, conv_id
                yield from inserted(*held)
                letter, nth = letters[nth], nth + 1
                if letter == "D":
                    continue
                role = EXPECTED[state] if letter == "R" else role
                state = FORWARD[state] if letter == "R" else (S, U, A)[INITIALS.index(role[0])]
                yield conv, piece, nth - 1, letter, turn, role, text, conv_id
            if held is not None:
                yield from inserted(*held)

        letters, state, nth = "", START, 0
        return _written(rows(), schema, size=6)

    return edit


def conversation_digests(rows: DataFrame) -> DataFrame:
    """``conv, repaired_sha256`` of the repaired rows' ``role:text``, one a line; of rows dealt out ``whole``."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            at, state = None, None
            for conv, role, text in _read(batches):
                if state is None or conv != at:
                    if state is not None:
                        yield at, state.hexdigest()
                    at, state = conv, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            if state is not None:
                yield at, state.hexdigest()

        return _written(found(), out)

    out = _schema("conv string repaired_sha256 string")
    return rows.select("conv", "role", "text").mapInArrow(digest, out)
