"""Licence scan: notices and identifier tags found by one Aho-Corasick pass over the words of a text, expressions parsed.

A text is brought to its words, in lower case and with one space between them, so that a notice is found however it is
set and broken into lines. The automaton finds all phrases and tags at once; behind a tag the expression is read from
the text itself. Nothing is shuffled, and memory follows the longest single text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from corpusmill.llm import hashing as H
from corpusmill.llm.license_terms import BASE, BASE_WEIGHT, KNOWN, PHRASES, TAG_WEIGHT, TAGS, read_expression

SLICE = 1 << 22
"""Bytes of words that the automaton is given at a time."""
FOUND = StructType().add("word", "long").add("phrase", "string").add("label", "string").add("weight", "double").add("openness", "double").add("expression", "string")
_ARROW = pa.list_(pa.struct([("word", pa.int64()), ("phrase", pa.string()), ("label", pa.string()), ("weight", pa.float64()), ("openness", pa.float64()), ("expression", pa.string())]))


def _breaks() -> np.ndarray:
    """ASCII characters that are no letter or digit."""
    table = np.zeros(256, bool)
    table[[b for b in range(128) if not chr(b).isalnum()]] = True
    return table


_BREAKS = _breaks()
_PLAIN = bytes(32 if _BREAKS[b] else b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACES = re.compile(rb" {2,}")


@lru_cache(maxsize=1)
def _automaton() -> tuple[ahocorasick.Automaton, int]:
    """All phrases and tags with a space on either side, and the length of the longest."""
    phrases = [*BASE, *PHRASES, *TAGS]
    found = ahocorasick.Automaton()
    for phrase in phrases:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found, max(map(len, phrases)) + 2


def _places(words: bytes) -> Iterator[tuple[int, str]]:
    """Number of the first word, and the phrase, of all places in ``words`` (with a space around each)."""
    automaton, longest = _automaton()
    counted = upto = 0
    for begin in range(0, len(words), SLICE):
        # latin-1 keeps one character a byte; phrases are ASCII
        part = words[begin : begin + SLICE + longest].decode("latin-1")
        hits = [(begin + end + 1 - len(phrase) - 2, phrase) for end, phrase in automaton.iter(part)]
        for start, phrase in sorted(h for h in hits if h[0] < begin + SLICE):
            counted += words.count(b" ", upto, start)
            upto = start
            yield counted, phrase


def _scan(text: np.ndarray) -> tuple[int, list[dict]]:
    """Number of words of a text, and what is found in it."""
    raw = text.tobytes()
    words = _SPACES.sub(b" ", b" " + raw.translate(_PLAIN) + b" ")
    found, ends = [], None
    for word, phrase in _places(words):
        if phrase in TAGS:
            if ends is None:
                _, ends, _ = H.words_of(text, np.array([0, len(text)]), _BREAKS)
            read = read_expression(raw, int(ends[word + phrase.count(" ")]), TAGS[phrase])
            if read is not None:
                found += [(word, phrase, name, TAG_WEIGHT, read.openness, read.text) for name in dict.fromkeys(read.names)]
        else:
            label, weight = (BASE[phrase], BASE_WEIGHT) if phrase in BASE else PHRASES[phrase]
            found.append((word, phrase, label, weight, KNOWN[label], None))
    return words.count(b" ") - 1, [dict(zip(FOUND.names, f)) for f in found]


def find_licenses(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_words`` and ``licenses``: array of ``word, phrase, label, weight, openness, expression``.

    Words are runs of ASCII letters, digits and characters beyond ASCII, A-Z in lower case; ``word`` counts from 0.
    Every place of every phrase is listed, also where phrases share words, by word and then by phrase. A tag gives one
    entry per licence of its expression, whose text and openness each of them carries. A null or empty text has none;
    columns of ``docs`` that are called like the new ones are replaced, all others stay.
    """
    rest = docs.drop("n_words", "licenses")
    schema = StructType([*rest.schema.fields, StructField("n_words", LongType()), StructField("licenses", ArrayType(FOUND))])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = H.column_bytes(batch.column("text"))
            scans = [_scan(data[a:b]) for a, b in zip(offsets, offsets[1:])]
            more = [pa.array([n for n, _ in scans], pa.int64()), pa.array([f for _, f in scans], _ARROW)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], schema.names)

    return rest.mapInArrow(find, schema)


def base_places(licenses: Column) -> Column:
    return F.filter(licenses, lambda x: x["phrase"].isin(*BASE))


def label_list(licenses: Column) -> Column:
    """The different labels, sorted, with commas between."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(licenses, lambda x: x["label"]))), ",")


def certainty(licenses: Column) -> Column:
    """How sure it is that a text is under a licence, from 0 to 1: each kind of evidence leaves less doubt.

    A phrase or tag counts once, with its weight as given.
    """
    kinds = F.array_sort(F.array_distinct(F.transform(licenses, lambda x: F.struct(x["phrase"].alias("phrase"), x["weight"].alias("weight")))))
    return 1 - F.aggregate(kinds, F.lit(1.0), lambda doubt, x: doubt * (1 - x["weight"]))


def openness(licenses: Column) -> Column:
    """What the least open notice or expression grants; null without any."""
    return F.array_min(F.transform(licenses, lambda x: x["openness"]))
