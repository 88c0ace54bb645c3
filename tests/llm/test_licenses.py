"""Licence scan against a plain search over words, and expressions against nested evaluation."""

import random
import re

import pytest
from brute import ITEM_WORD, lower, ordered, pairs

from corpusmill.llm import license_terms as L
from corpusmill.llm.licenses import find_licenses
from corpusmill.llm.queries import license_query

NOTICE = "This file is under the GNU General\n * Public License, version 3. All rights reserved -- ALL RIGHTS RESERVED."
TEXTS = [
    "CC BY CC-BY cc_by cc/by-nc 4.0 ccby cc  by", NOTICE, "general public license " * 5, "", None, "   ", "none of it", "süß general public license ß",
    "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0+ WITH Classpath-exception-2.0 */ more", "license: none", '{"license": "MIT"}', "License = see file",
    "x " * 20_000 + NOTICE + " y" * 20_000, "Licensed under the Lesser General Public License", "all rights\treserved" + " all rights reserved", "cc0", "A" * 100_000,
]


def places(text, phrases):
    words = ITEM_WORD.findall(lower(text))
    for phrase in phrases:
        wanted = phrase.split()
        for i in range(len(words) - len(wanted) + 1):
            if words[i : i + len(wanted)] == wanted:
                yield i, phrase


def plain(docs):
    for doc, text in docs:
        base = sorted(places(text, L.BASE))
        starts = [i for i, _ in base]
        labels = ",".join(sorted({L.BASE[p] for _, p in base}))
        yield doc, len(ITEM_WORD.findall(lower(text))), len(base), min(starts, default=None), max(starts, default=None), labels


def rows_of(df):
    return [(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in license_query(df).collect()]


@pytest.fixture(scope="module")
def notices(spark):
    draw = random.Random(2)
    words = ["all", "rights", "reserved", "cc", "by", "general", "public", "license", "gnu", "mit", "version", "3", "0", "2", "apache", "nc"]
    many = [draw.choice([" ", "-", "\n", ", "]).join(draw.choice(words) for _ in range(draw.randrange(60))) for _ in range(300)]
    rows = [(i if i % 9 else None, t, "clash", 1) for i, t in enumerate([*TEXTS, *many, *TEXTS])]
    return spark.createDataFrame(rows, "doc_id long, text string, licenses string, n_words int").repartition(3)


def test_base_places_as_plain(notices, odd):
    for df in (notices, odd):
        assert ordered(rows_of(df)) == ordered(plain(pairs(df)))


def test_all_phrases_as_plain(notices):
    found = find_licenses(notices).select("text", "licenses").collect()
    for text, licenses in found:
        got = [(x["word"], x["phrase"]) for x in licenses if x["expression"] is None]
        assert got == sorted(places(text, [*L.BASE, *L.PHRASES]))


def test_slices_of_long_texts(monkeypatch):
    from corpusmill.llm import licenses

    words = " " + "a all rights reserved cc by " * 50
    whole = list(licenses._places(words.encode()))
    monkeypatch.setattr(licenses, "SLICE", 7)
    assert list(licenses._places(words.encode())) == whole and len(whole) == 100


def test_labels_and_scores(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in license_query(df).collect()}
    assert rows[0]["labels"] == "cc-by,cc-by-nc" and rows[1]["labels"] == "gpl,gpl-3.0,reserved"
    assert rows[8]["labels"] == "apache-2.0,gpl-2.0-or-later,mit" and rows[8]["openness"] == 0.6 and rows[8]["score"] > 0.98
    assert rows[9]["labels"] == rows[11]["labels"] == "" and rows[9]["score"] == 0 and rows[9]["openness"] is None
    assert rows[10]["labels"] == "mit" and rows[13]["labels"] == "gpl,lgpl"
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    assert license_query(df.limit(0)).collect() == []


@pytest.mark.parametrize(
    "text, want, openness",
    [
        (": MIT", "MIT", 0.8),
        (": MIT OR GPL-3.0-only", "MIT OR GPL-3.0-only", 0.8),
        (": MIT AND GPL-3.0-only OR CC0-1.0", "MIT AND GPL-3.0-only OR CC0-1.0", 1.0),
        (": MIT AND (GPL-3.0-only OR CC0-1.0)", "MIT AND (GPL-3.0-only OR CC0-1.0)", 0.8),
        (": GPL-2.0-only with Classpath-exception-2.0 and MIT", "GPL-2.0-only WITH Classpath-exception-2.0 AND MIT", 0.6),
        (": LicenseRef-Own WITH some-exception", "LicenseRef-Own WITH some-exception", 0.0),
        (" = 'MIT' or more", "MIT", 0.8),
        (": MIT and more to come", "MIT", 0.8),
        (": MIT OR (", "MIT", 0.8),
        (": ((MIT", "((MIT))", 0.8),
        (": MIT) OR CC0-1.0", "MIT", 0.8),
        (": MIT. OR CC0-1.0", "MIT", 0.8),
        (": (MIT) WITH x-1", "(MIT)", 0.8),
        (": MIT WITH (x-1)", "MIT", 0.8),
        (": and MIT", None, None),
        (": words", None, None),
        (": ()", None, None),
        (" MIT", None, None),
        (":\nMIT", None, None),
        ("", None, None),
    ],
)
def test_expressions(text, want, openness):
    read = L.read_expression(text.encode(), 0, True)
    assert (read.text, read.openness) == (want, openness) if want else read is None


def test_expressions_as_nested_evaluation():
    draw = random.Random(4)

    def made(depth):
        if depth == 0 or draw.random() < 0.3:
            name = draw.choice(["MIT", "GPL-3.0-only", "CC0-1.0", "AGPL-3.0-only", "MPL-2.0", "LicenseRef-1"])
            return name, L.KNOWN.get(name.lower(), 0.0)
        kind, parts = draw.choice(["AND", "OR"]), [made(depth - 1) for _ in range(draw.randrange(2, 4))]
        inner = f" {kind} ".join(f"({t})" if " " in t else t for t, _ in parts)
        return inner, (min if kind == "AND" else max)(v for _, v in parts)

    for _ in range(300):
        text, value = made(4)
        read = L.read_expression(f": {text}\n".encode(), 0, True)
        assert (read.text, read.openness) == (text, value)
        assert read.names == [t.lower() for t in re.findall(r"[\w.-]*[A-Z0-9][\w.-]+", text) if t not in ("AND", "OR")]


def test_deep_and_long_expressions():
    deep = ": " + "(" * 50_000 + "MIT" + ")" * 50_000
    assert L.read_expression(deep.encode(), 0, True).openness == 0.8
    long = ": " + " OR ".join(["GPL-2.0-only"] * 50_000)
    assert len(L.read_expression(long.encode(), 0, True).names) == 50_000
