"""Secrets in texts: rules looked up in a trigram inverted index, candidates verified with the regular expression.

Each Arrow batch is one segment of the index, as in a search engine: postings never leave the task that made them, and
nothing is shuffled. Postings of the trigrams that a rule demands are intersected and united; only the texts left are
searched. A rule that demands no trigram is searched for in every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, StructField, StructType

from corpusmill.llm import hashing as H
from corpusmill.llm.trigrams import Segment, trigram_query, trigrams_in


class Rule(NamedTuple):
    kind: str
    pattern: bytes
    fold: bool = False
    """Letters match in either case."""
    group: int = 0
    least: int = 0
    """Matches are dropped whose ``group`` has fewer characters."""


_GAP = rb"(?:\s|\\[nrt]|[\"'>|,;#*\\])"
_PLAIN = rb"(?![A-Za-z]?[a-z]*+(?![A-Za-z0-9+/=]))"
_KEY_HEADS = rb"(?:\s*+[A-Za-z][A-Za-z0-9-]*+:\x20[^\r\n]*+(?=[\r\n]))*+"
_KEY_BODY = (
    _KEY_HEADS
    + rb"(?:(?:" + _GAP + rb"|[A-Za-z0-9+/=])*+-----END [A-Z ]*PRIVATE KEY-----"
    + rb"|(?:" + _GAP + rb"++" + _PLAIN + rb"[A-Za-z0-9+/]{16,}+={0,2}+)++"
    + rb"(?:(?:(?!\x20)" + _GAP + rb")++" + _PLAIN + rb"[A-Za-z0-9+/]++={0,2}+(?=[\x20\t]*+(?:[\r\n\\\"']|\Z))|" + _GAP + rb"++[A-Za-z0-9+/]++={1,2}+)?"
    + rb")?"
)
"""What follows the first line of a private key: headers, then base64 up to the END line. Where that is missing, groups of
16 and more base64 characters that are no plain word, and a shorter last one that has its line for itself or is padded.
Line ends may be escaped, and lines quoted or indented."""
RULES = (
    Rule("assign", rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 6),
    Rule("access", rb"AKIA[A-Z0-9]+", least=20),
    Rule("hex", rb"[0-9a-f]{24,}"),
    Rule("github", rb"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", rb"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", rb"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", rb"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("private_key", rb"-----BEGIN [A-Z ]*PRIVATE KEY-----" + _KEY_BODY),
    Rule("jwt", rb"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
"""In the order in which equal starts are listed; the first three are the base kinds."""
BASE = ("assign", "access", "hex")
SPANS = ArrayType(StructType().add("start", "integer").add("kind", "string").add("end", "integer"))


@lru_cache(maxsize=2)
def _plan(rules: tuple[Rule, ...]):
    """Compiled patterns, trigram queries, the place of each wanted trigram, and their numbers."""
    queries = [trigram_query(r.pattern) for r in rules]
    places = {t: i for i, t in enumerate(sorted(set().union(*map(trigrams_in, queries))))}
    wanted = np.array([int.from_bytes(t, "big") for t in places], np.uint32)
    return [re.compile(r.pattern, re.IGNORECASE if r.fold else 0) for r in rules], queries, places, wanted


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with ``secrets``: array of ``start, kind, end`` by start, then kind in the order of the rules.

    Offsets are code points, the end is exclusive. Matches of one rule are leftmost and do not overlap; those of
    different rules may. Those too short are dropped without another try. A null or empty text has none. All columns
    of ``docs`` stay; a column that is called ``secrets`` is replaced.
    """
    rest = docs.drop("secrets")
    H.bounded_batches(docs.sparkSession)
    schema = StructType([*rest.schema.fields, StructField("secrets", SPANS)])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = pa.array(_spans(batch.column("text"), rules), _ARROW_SPANS)
            yield pa.RecordBatch.from_arrays([*batch.columns, spans], [*batch.schema.names, "secrets"])

    return rest.mapInArrow(find, schema)


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[secret]") -> DataFrame:
    """``docs`` with each secret in ``text`` replaced by ``mark``; overlapping ones by a single one."""
    H.bounded_batches(docs.sparkSession)

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            texts = column.to_pylist()
            for i, spans in enumerate(_spans(column, rules)):
                if spans:
                    texts[i] = _without(texts[i], spans, mark)
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, column.type))

    return docs.mapInArrow(redact, docs.schema)


_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))


def _without(text: str, spans: list[dict], mark: str) -> str:
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            out += [text[at : s["start"]], mark]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def _spans(column: pa.Array, rules: tuple[Rule, ...]) -> list[list[dict]]:
    data, offsets = H.column_bytes(column)
    patterns, queries, places, wanted = _plan(rules)
    segment = Segment(H.lowered(data), offsets, wanted)
    out: list[list[tuple]] = [[] for _ in range(len(offsets) - 1)]
    body, edge = data.tobytes(), offsets.tolist()
    for order, (rule, pattern, query) in enumerate(zip(rules, patterns, queries)):
        for i in segment.texts(query, places).tolist():
            for m in pattern.finditer(body, edge[i], edge[i + 1]):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    out[i].append((m.start() - edge[i], order, rule.kind, m.end() - edge[i]))
    return [_in_code_points(sorted(s), data[a:b]) if s else [] for s, a, b in zip(out, edge, edge[1:])]


def _in_code_points(spans: list[tuple], text: np.ndarray) -> list[dict]:
    before = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
    return [{"start": int(before[a]), "kind": kind, "end": int(before[b])} for a, _, kind, b in spans]
