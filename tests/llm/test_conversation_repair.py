"""Repaired conversations against a search over all edits in Python."""

import hashlib
import random
import zlib

import pytest
from brute import ordered, sha
from pyspark.sql import functions as F

from corpusmill.llm import repair_tables as T
from corpusmill.llm.conversation_repair import repair_conversations
from corpusmill.llm.queries import repair_query

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}


def cheapest(rows):
    """``(cost, audit, lines)`` for rows ``(role, text, must_go, open_end)``, by all edits on (last role, row)."""
    best = {"": (0, "", ())}

    def put(table, state, way):
        if state not in table or way < table[state]:
            table[state] = way

    def insert():
        for _ in range(4):
            for state, (cost, audit, lines) in list(best.items()):
                to = NEXT[state]
                put(best, to, (cost + 2, audit + "I", (*lines, f"{NAMES[to]}:")))

    for role, text, must_go, open_end in rows:
        insert()
        after = {}
        for state, (cost, audit, lines) in best.items():
            put(after, state, (cost + 3, audit + "D", lines))
            if not must_go:
                to = NEXT[state]
                put(after, to, (cost + 2 + open_end, audit + "R", (*lines, f"{NAMES[to]}:{text}")))
                if role[:1] == to or (role[:1] == "s" and state == ""):
                    put(after, role[0], (cost + open_end, audit + "K", (*lines, f"{role}:{text}")))
        best = after
    insert()
    return min(best[q] for q in ("", "a") if q in best)


def plain(rows, damage=True):
    given = {}
    for conv, turn, role, text in rows:
        own = given.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20 if damage else 9
        role, text = (" " if x is None else x for x in (role, text))
        if fault == 1:
            text = ""
        if fault == 2:
            text = text.translate({ord(c): None for c in ".!?"})
        if fault == 4:
            role = "user"
        own += [(turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    for conv, own in given.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).hexdigest()))
        seen, judged, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in own:
            said = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            judged.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        turns = {t for t, _, _ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        cost, audit, lines = cheapest(judged)
        yield conv, gaps, *counts.values(), illegal, cost, audit, sha("\n".join(lines))


def drawn(seed, convs, long_turns):
    """Conversations with every fault; with turns far apart they are cut into many pieces."""
    draw, rows = random.Random(seed), []
    texts = ["Fine.", "Why?", "Broken off", "", " \n", None, "Ünï!\t", "Done.", "one. two", "x" * 3000 + "."]
    for conv in [*range(convs), None]:
        for i in range(draw.choice([1, 2, 3, 5, 8, 30])):
            role = draw.choice(["user", "assistant"] * 6 + ["system", "", None, "tool", "\U0001f600"])
            text = draw.choice(texts) if draw.random() < 0.3 else f"{draw.random()}."
            rows.append((conv, None if draw.random() < 0.05 else draw.randrange(long_turns), role, text))
    return rows


def test_tables_give_the_least_of_the_cheapest():
    draw = random.Random(1)
    names = ("system", "user", "assistant", "tool")
    for n in range(30):
        for _ in range(20):
            symbols = bytes(draw.choice([2, 4] * 3 + list(range(9))) for _ in range(n))
            rows = [("user", "", True, False) if c == T.BAD else (names[c // 2], "", False, c % 2) for c in symbols]
            cost, audit, _ = cheapest(rows)
            assert T.costs_over(symbols, T.END)[T.START] == cost
            assert T.edits(symbols, T.END, [T.START], True)[0][0] == audit


def test_there_are_few_cost_vectors():
    assert len(T.tables().number) < 100 and len(T.tables().blocks[0]) == T.SYMBOLS**T.BLOCK


@pytest.mark.parametrize("seed, long_turns", [(1, 12), (2, 60_000), (3, 10**12)])
def test_query_as_plain(spark, seed, long_turns):
    rows = drawn(seed, 40, long_turns)
    rows += [rows[3]] * 3 + [(1000, 5, "user", "Only."), (1001, None, None, None)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA + ", conv string, piece int").repartition(4)
    assert ordered(map(tuple, repair_query(df).select(COLUMNS).collect())) == ordered(plain(rows))


def test_a_conversation_of_many_rows_and_pieces(spark):
    draw = random.Random(9)
    rows = [(1, i, draw.choice(["user", "assistant"]), f"t{draw.randrange(9000)}{draw.choice(['.', ''])}") for i in range(13_000)]
    rows += [(2, None, "user", f"t{i % 700}.") for i in range(1000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert ordered(map(tuple, repair_query(df).select(COLUMNS).collect())) == ordered(plain(rows))


def test_rows_are_the_same_by_piece_and_by_conversation(spark):
    rows = drawn(4, 30, 30_000)
    df = spark.createDataFrame(rows, SCHEMA)
    columns = ["conv_id", "piece", "nth", "edit", "turn", "role", "text"]
    by_piece, whole = (ordered(map(tuple, repair_conversations(df, whole=w).rows.select(columns).collect())) for w in (False, True))
    assert by_piece == whole
    lines = {}
    for r in sorted(whole, key=lambda r: r[1:3]):
        lines.setdefault(r[0], []).append(f"{r[5]}:{r[6]}")
    want = {r[0]: r[-1] for r in plain(rows, damage=False)}
    assert {c: sha("\n".join(lines.get(c, []))) for c in want} == want


def test_all_dropped_and_none(spark):
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    one = spark.createDataFrame([(dropped, 0, "user", "Gone.")], SCHEMA)
    assert repair_query(one).select(COLUMNS).collect() == [(dropped, 0, 0, 0, 0, 0, 0, "", sha(""))]
    none = one.limit(0)
    assert repair_query(none).count() == 0 and repair_conversations(none).rows.count() == 0


def test_ids_may_be_texts(spark):
    rows = [("a", 0, "user", "Hi."), ("a", 1, "user", "Hi."), (None, 0, "assistant", "Yes.")]
    repair = repair_conversations(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string"))
    assert ordered(repair.reports.select("conv", "audit").collect()) == ordered([("=a", "KDI"), ("", "IK")])
    assert repair.rows.filter(F.col("edit") == "I").count() == 2
