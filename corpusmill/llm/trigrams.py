"""Boolean trigram queries derived from regular expressions, and inverted indexes over segments of texts."""

from __future__ import annotations

from itertools import product
from re import _constants as sre
from re import _parser as parser

import numpy as np

WIDEST = 64
"""Sets of literal strings are followed up to this size; beyond it, what they demand is written down and they start anew."""

Query = tuple | None
"""``("and", parts)``, ``("or", parts)``, a trigram as bytes, or None for a pattern that demands no trigram."""


def trigram_query(pattern: bytes) -> Query:
    """Trigrams, in lower case, that every match of the pattern holds (in any case of letters)."""
    strings, query = _sequence(parser.parse(pattern))
    return _both(query, _demanded(strings))


def _both(a: Query, b: Query) -> Query:
    return b if a is None else a if b is None or a == b else ("and", (a, b))


def _demanded(strings: set[bytes] | None) -> Query:
    """One of the strings occurs: its trigrams do."""
    if not strings or any(len(s) < 3 for s in strings):
        return None
    each = [tuple(dict.fromkeys(s[i : i + 3] for i in range(len(s) - 2))) for s in sorted(strings)]
    parts = tuple(dict.fromkeys(p[0] if len(p) == 1 else ("and", p) for p in each))
    return parts[0] if len(parts) == 1 else ("or", parts)


def _sequence(items) -> tuple[set[bytes] | None, Query]:
    """The strings that the end of the sequence is, if they are few, and what the rest demands."""
    strings: set[bytes] | None = {b""}
    query: Query = None
    for op, value in items:
        exact, demands = _node(op, value)
        query = _both(query, demands)
        if exact is None or strings is None or len(strings) * len(exact) > WIDEST:
            query = _both(query, _demanded(strings))
            strings = exact if exact is not None else {b""}
        else:
            strings = {a + b for a, b in product(strings, exact)}
    return strings, query


def _node(op, value) -> tuple[set[bytes] | None, Query]:
    if op is sre.LITERAL:
        return {bytes([value]).lower()}, None
    if op is sre.IN:
        chars: set[bytes] = set()
        for kind, x in value:
            if kind is sre.LITERAL:
                chars.add(bytes([x]).lower())
            elif kind is sre.RANGE:
                chars |= {bytes([c]).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None, None
        return (chars if len(chars) <= 8 else None), None
    if op is sre.SUBPATTERN:
        return _closed(value[-1])
    if op is sre.BRANCH:
        parts = [_closed(x) for x in value[1]]
        if all(p[0] is not None for p in parts) and len(union := set().union(*(p[0] for p in parts))) <= WIDEST:
            return union, None
        demands = [_both(q, _demanded(s)) for s, q in parts]
        return None, None if None in demands else ("or", tuple(demands))
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        low, high, item = value
        exact, demands = _closed(item)
        if (low, high) == (0, 1) and exact is not None:
            return exact | {b""}, None
        if low == high and exact is not None and len(exact) ** low <= WIDEST:
            return {b"".join(p) for p in product(exact, repeat=low)}, None
        return None, _both(demands, _demanded(exact)) if low else None
    return ({b""}, None) if op is sre.AT else (None, None)


def _closed(items) -> tuple[set[bytes] | None, Query]:
    """As ``_sequence``; strings only if they are all of it."""
    strings, query = _sequence(items)
    return (strings, None) if query is None and strings is not None and _literal(items) else (None, _both(query, _demanded(strings)))


def _literal(items) -> bool:
    return all(_node(op, value)[0] is not None for op, value in items)


def trigrams_in(query: Query) -> set[bytes]:
    if query is None:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(trigrams_in, query[1]))


class Segment:
    """Inverted index of the wanted trigrams over the texts of one batch: for each the numbers of the texts, in order."""

    def __init__(self, lowered: np.ndarray, offsets: np.ndarray, wanted: np.ndarray, step: int = 1 << 20):
        """``wanted``: the trigrams looked for as ascending numbers; a place is one in this list."""
        texts, places = [], []
        heads = np.zeros(1 << 16, bool)
        heads[wanted >> 8] = True
        for a in range(0, max(len(lowered) - 2, 0), step):
            part = lowered[a : a + step + 2].astype(np.uint32)
            pairs = part[:-1] << np.uint32(8) | part[1:]
            hit = np.flatnonzero(heads[pairs[:-1]])
            number = pairs[hit] << np.uint32(8) | part[hit + 2]
            at = np.searchsorted(wanted, number)
            found = wanted[np.minimum(at, len(wanted) - 1)] == number
            hit, at = hit[found], at[found]
            text = np.searchsorted(offsets, hit + a, "right") - 1
            inside = hit + a + 3 <= offsets[text + 1]
            texts.append(text[inside])
            places.append(at[inside])
        none = np.zeros(0, np.int64)
        pair = np.unique(np.concatenate([none, *places]).astype(np.int64) * len(offsets) + np.concatenate([none, *texts]))
        self.place, self.text = np.divmod(pair, len(offsets))
        self.all = np.arange(len(offsets) - 1)

    def postings(self, place: int) -> np.ndarray:
        a, b = np.searchsorted(self.place, [place, place + 1])
        return self.text[a:b]

    def texts(self, query: Query, places: dict[bytes, int]) -> np.ndarray:
        """Numbers of the texts that fit the query."""
        if query is None:
            return self.all
        if isinstance(query, bytes):
            return self.postings(places[query])
        found = [self.texts(q, places) for q in query[1]]
        out = found[0]
        for other in found[1:]:
            out = np.intersect1d(out, other, assume_unique=True) if query[0] == "and" else np.union1d(out, other)
        return out
