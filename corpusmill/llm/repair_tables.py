"""Cheapest edits of a row of symbols into turns that alternate, by block tables (the method of the Four Russians).

The roles of a repaired conversation read ``(s?(ua)+)?``: an automaton of four states. For the rows from some place to
the end, the cheapest cost from each state is a vector of four numbers. Less its minimum only a few dozen vectors exist,
so what a block of ``BLOCK`` symbols does to a vector is looked up in a table: the vector before it and the amount added.

Vectors are kept at block borders only. To list the edits, blocks are expanded backward symbol by symbol, and the
letters are chosen forward from exact costs, so that of equally cheap lists the ASCII-least is found: the letter and the
state give the next state, hence taking the least letter that loses nothing, one after the other, is right.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np

START, S, U, A = range(4)
"""Nothing yet, after a system row, after a user row, after an assistant row (where the list may end, as at the start)."""
FORWARD = (U, U, A, U)
"""Where the role leads that is expected next; an inserted or renamed row has that role."""
EXPECTED = ("user", "user", "assistant", "user")
DELETE, RENAME, INSERT, OPEN = 3, 2, 2, 1
"""Costs of edits, and of a row that stays although its text breaks off."""
INITIALS = "sua"
BAD = 8
"""Symbol of a row that must go; the others are 2 * (place in ``INITIALS``, 3 for none) + (does the text break off?)."""
SYMBOLS = 9
BLOCK = 4
FAR = 1 << 40
"""More than any cost: such a state cannot be reached."""
END = (0, 4, 2, 0)
"""Cost of what has to be inserted behind the last row."""


def kept(state: int, symbol: int) -> int | None:
    """The state behind a row that stays as it is, if it may."""
    initial = symbol // 2
    if symbol != BAD and ((initial == 0 and state == START) or (initial == 1 and state != U) or (initial == 2 and state == U)):
        return (S, U, A)[initial]
    return None


def costs_before(after: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    """Cheapest cost from each state in front of a row, from those behind it."""
    best = []
    for state in range(4):
        ways = [DELETE + after[state]]
        if symbol != BAD:
            ways.append(RENAME + symbol % 2 * OPEN + after[FORWARD[state]])
            if (to := kept(state, symbol)) is not None:
                ways.append(symbol % 2 * OPEN + after[to])
        best.append(min(ways))
    for _ in range(3):
        best = [min(best[q], INSERT + best[FORWARD[q]]) for q in range(4)]
    return tuple(min(x, FAR) for x in best)


def letters_at(after: tuple[int, ...], symbol: int, state: int) -> tuple[str, int]:
    """The edits in front of and on a row, least letters first among the cheapest, and the state behind it."""
    before, letters = costs_before(after, symbol), ""
    while True:
        if DELETE + after[state] == before[state]:
            return letters + "D", state
        if INSERT + before[FORWARD[state]] == before[state]:
            letters, state = letters + "I", FORWARD[state]
        elif (to := kept(state, symbol)) is not None and symbol % 2 * OPEN + after[to] == before[state]:
            return letters + "K", to
        else:
            return letters + "R", FORWARD[state]


def normal(costs: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    least = min(costs)
    return tuple(FAR if x >= FAR else x - least for x in costs), least


class Tables(NamedTuple):
    number: dict[tuple[int, ...], int]
    """Normalised cost vectors and their numbers."""
    before: np.ndarray
    """Vector in front of a symbol, by vector behind it."""
    added: np.ndarray
    blocks: list[list[int]]
    """The same for whole blocks."""
    block_added: list[list[int]]
    letters: list[list[list[tuple[str, int]]]]
    """Edits and next state by vector behind the row, symbol and state."""


@lru_cache(maxsize=1)
def tables() -> Tables:
    ends = [normal(END)[0], *(tuple(0 if q == r else FAR for q in range(4)) for r in range(4))]
    number = {v: i for i, v in enumerate(ends)}
    found, before, added = list(ends), [], []
    for vector in found:  # grows while it is read
        row = [normal(costs_before(vector, c)) for c in range(SYMBOLS)]
        for v, _ in row:
            if v not in number:
                number[v] = len(found)
                found.append(v)
        before.append([number[v] for v, _ in row])
        added.append([x for _, x in row])
    one, plus = np.array(before), np.array(added)
    blocks, sums = one, plus
    for _ in range(BLOCK - 1):  # one more symbol in front of all shorter blocks
        sums = np.stack([sums + plus[blocks, c] for c in range(SYMBOLS)], axis=1).reshape(len(found), -1)
        blocks = np.stack([one[blocks, c] for c in range(SYMBOLS)], axis=1).reshape(len(found), -1)
    letters = [[[letters_at(v, c, q) for q in range(4)] for c in range(SYMBOLS)] for v in found]
    return Tables(number, one, plus, blocks.tolist(), sums.tolist(), letters)


_WEIGHTS = SYMBOLS ** np.arange(BLOCK - 1, -1, -1)


def _blocks(symbols: bytes) -> tuple[list[int], bytes]:
    """Numbers of the whole blocks, and the symbols behind the last of them."""
    whole = len(symbols) // BLOCK * BLOCK
    return (np.frombuffer(symbols[:whole], np.uint8).reshape(-1, BLOCK) @ _WEIGHTS).tolist(), symbols[whole:]


def costs_over(symbols: bytes, after: tuple[int, ...]) -> tuple[int, ...]:
    """Cheapest cost from each state in front of all these rows."""
    t = tables()
    vector, total = normal(after)
    at = t.number[vector]
    blocks, rest = _blocks(symbols)
    for c in reversed(rest):
        at, total = int(t.before[at, c]), total + int(t.added[at, c])
    for b in reversed(blocks):
        at, total = t.blocks[at][b], total + t.block_added[at][b]
    costs = next(v for v, i in t.number.items() if i == at)
    return tuple(FAR if x >= FAR else x + total for x in costs)


def edits(symbols: bytes, after: tuple[int, ...], states: list[int], last: bool) -> list[tuple[str, int]]:
    """For each state in front of the rows the ASCII-least cheapest edits, and the state behind them.

    ``after`` are the costs from each state behind the rows. Behind the ``last`` ones, the missing rows are inserted.
    """
    t = tables()
    vector = t.number[normal(after)[0]]
    blocks, rest = _blocks(symbols)
    borders = [vector]
    for c in reversed(rest):
        vector = int(t.before[vector, c])
    behind = [vector]
    for b in reversed(blocks):
        behind.append(t.blocks[behind[-1]][b])
    behind.reverse()  # the vector in front of each block and behind the last one
    seen: list[tuple[list[str], int]] = [([], q) for q in states]
    for k in range(len(blocks) + 1):
        part = symbols[k * BLOCK : (k + 1) * BLOCK] if k < len(blocks) else rest
        at, inner = (behind[k + 1] if k < len(blocks) else borders[0]), []
        for c in reversed(part):
            inner.append(at)
            at = int(t.before[at, c])
        inner.reverse()
        for i, (out, state) in enumerate(seen):
            for c, v in zip(part, inner):
                letters, state = t.letters[v][c][state]
                out.append(letters)
            seen[i] = (out, state)
    done = []
    for out, state in seen:
        while last and END[state]:
            out.append("I")
            state = FORWARD[state]
        done.append(("".join(out), state))
    return done
