import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.functions import arrays as A
from corpusmill.functions import text as X

BREAKS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85  "
ODD_TEXT = st.lists(st.text(alphabet="ab ." + BREAKS + "\t\xa0　\U0001d4b3", max_size=12), min_size=20, max_size=40)


def column(spark, texts, expr):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, s string")
    return [r[0] for r in df.orderBy("id").select(expr).collect()]


@pytest.mark.parametrize(
    "text, n",
    [("", 0), ("a", 1), ("a\n", 1), ("a\r\nb", 2), ("a\n\n", 2), ("\n", 1), ("x\r\ry", 3), ("\r\n", 1), ("a\n\r\nb", 3)],
)
def test_line_count_edges(spark, text, n):
    assert column(spark, [text], X.line_count("s")) == [n]


@settings(max_examples=5, deadline=None)
@given(ODD_TEXT)
def test_text_functions_agree_with_python(spark, texts):
    assert column(spark, texts, X.line_count("s")) == [len(t.splitlines()) for t in texts]
    assert column(spark, texts, X.content_hash("s")) == [hashlib.md5(re.sub(r"\s+", "", t).encode()).hexdigest() for t in texts]
    assert column(spark, texts, X.ws_tokens("s")) == [t.split() for t in texts]
    assert column(spark, texts, X.strip("s")) == [t.strip() for t in texts]
    assert column(spark, texts, X.flatten_lines("s")) == [" ".join(x.strip() for x in t.split("\n")) for t in texts]


def test_strip_comments(spark):
    cases = {
        "int a=1; // c\nint b;": "int a=1;  \nint b;",
        "String s=\"// no\"; char c='\"'; //e": "String s=\"// no\"; char c='\"';  ",
        "x /* open": "x /* open",
        "don't // a\n isn't /* k */ b": "don't // a\n isn't   b",
        "// only\n\n  \nfoo": "foo",
        "a /* 1 \n 2 */ b // c": "a   b  ",
        r"s='\'//'; // x": r"s='\'//';  ",
        "a / b // c": "a / b  ",
    }
    assert column(spark, list(cases), X.strip_comments("s")) == list(cases.values())


def test_parse_api_seq(spark):
    texts = ["", "A.b 3|", "List <String>.add 12|Map.get  7|", "noDot|", "A.b|", "A.b x|A.c 4"]
    parsed = column(spark, texts, X.parse_api_seq("s"))
    plain = [None if p is None else [tuple(u) for u in p] for p in parsed]
    assert plain == [
        [],
        [("A", "b", 3)],
        [("List", "add", 12), ("Map", "get", None)],
        None,
        None,
        [("A", "b", None), ("A", "c", 4)],
    ]


@pytest.mark.parametrize(
    "code, end, want",
    [
        ("foo(a,(b));x", 3, 10),
        ("foo (a)", 3, 4),
        ("foo(a", 3, None),
        ("\U0001d4b3o(a)z", 2, 5),
        ("f)", 1, None),
        ("foo", 3, 4),
        ("f(" + "x" * 9999 + ")", 1, 10002),
        ("f(" + "x" * 10000 + ")", 1, 10003),
        ("f(" + "(x)" * 300 + ")", 1, 903),
    ],
)
def test_balanced_end(spark, code, end, want):
    assert column(spark, [code], X.balanced_end("s", F.lit(end))) == [want]


def test_balanced_end_within_a_limit(spark):
    """The limit is an option: the closing parenthesis may be its last character."""
    codes = ["f(" + "x" * n + ")" for n in (9999, 10000)]
    assert column(spark, codes, X.balanced_end("s", F.lit(1), max_scan=10001)) == [10002, None]


def test_usage_start(spark):
    df = spark.createDataFrame(
        [("a = List.add(b)", 9, "List", "add"), ("a = x.add(b)", 6, "List", "add"), ("add(1)", 0, "List", "add"), ("t.add(1)", 2, "List", "add")],
        "code string, idx int, cls string, call string",
    )
    rows = df.select(X.usage_start("code", "idx", "cls", "call").alias("u")).select("u.*").collect()
    assert [tuple(r) for r in rows] == [(4, 12), (6, 9), (0, 3), (2, 5)]


def clean(t):
    t = t.strip()
    t = t[: t.rfind(")") + 1]
    extra = t.count(")") - t.count("(")
    return t[:-extra] if extra > 0 and t.endswith(")" * extra) else t


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text(alphabet="a() \n;{.", max_size=14), min_size=30, max_size=60))
def test_predictions(spark, texts):
    stops = ["\n//", "\n@", "\nif", ");", ") {", "\n{", ")\n", ")."]
    done = [(0 < t.count("(") <= t.count(")")) or any(s in t for s in stops) for t in texts]
    assert column(spark, texts, X.clean_prediction("s")) == [clean(t) for t in texts]
    assert column(spark, texts, X.is_complete("s")) == done


def test_is_autogenerated(spark):
    late = "\n" * 5 + "// autogenerated"
    texts = ["// Auto-Generated\nx", "a\nb\nAUTOMATICALLY generated", late, "plain"]
    assert column(spark, texts, X.is_autogenerated("s")) == [True, True, False, False]


def test_ngrams(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5],), ([1],), ([],)], "a array<int>")
    plain = [r[0] for r in df.select(A.ngrams("a", 3)).collect()]
    assert plain == [[[1, 2, 3], [2, 3, 4], [3, 4, 5]], [], []]
    padded = [r[0] for r in df.select(A.ngrams("a", 2, right_pad=F.lit(0))).collect()]
    assert padded == [[[1, 2], [2, 3], [3, 4], [4, 5], [5, 0]], [[1, 0]], []]
    left = df.select(A.ngrams("a", 2, left_pad=F.lit(0))).first()[0]
    assert left == [[0, 1], [1, 2], [2, 3], [3, 4], [4, 5]]


def test_completion_features(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], [8, 9]), ([], [8, 9])], "c array<int>, g array<int>")
    rows = df.select(A.completion_features("c", "g", 5, 0).alias("f")).select("f.*").collect()
    assert tuple(rows[0]) == ([2, 3, 4, 8, 9], [-100, -100, -100, 8, 9])
    assert tuple(rows[1]) == ([8, 9, 0, 0, 0], [8, 9, -100, -100, -100])
    with pytest.raises(Exception, match="does not fit"):
        df.select(A.completion_features("c", "g", 1, 0)).collect()


def test_mlm_mask_shares_and_special_tokens(spark):
    df = spark.range(200).select(
        F.col("id").alias("row_id"),
        F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: i + 1000).alias("ids"),
        F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: (i == 0).cast("int")).alias("special"),
    )
    masked = df.select("ids", A.mlm_mask("ids", "row_id", 0.15, 1, 4, 500, "special").alias("m"))
    flat = masked.select(F.explode(F.arrays_zip("ids", F.col("m.input_ids").alias("new"), F.col("m.labels").alias("lab"))).alias("z"))
    rows = [tuple(r) for r in flat.select("z.ids", "z.new", "z.lab").collect()]
    chosen = [r for r in rows if r[2] != -100]
    assert all(old == lab for old, _, lab in chosen)
    assert all(old == new for old, new, lab in rows if lab == -100)
    assert not any(old == 1000 for old, _, _ in chosen)
    assert 0.13 < len(chosen) / len(rows) < 0.17
    assert 0.75 < sum(new == 4 for _, new, _ in chosen) / len(chosen) < 0.85
    assert 0.07 < sum(new == old for old, new, _ in chosen) / len(chosen) < 0.13
