import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusmill.functions.scores import brevity_penalty, closest_ref_len
from corpusmill.operators import bleu as B
from corpusmill.operators.hits import hits_at_k
from corpusmill.sources.lines import read_line_pairs, read_lines, write_line_pairs
from corpusmill.sources.reference_lists import keyword_list

H1 = "It is a guide to action which ensures that the military always obeys the commands of the party"
H2 = "It is to insure the troops forever hearing the activity guidebook that party direct"
R1 = "It is a guide to action that ensures that the military will forever heed Party commands"
R2 = "It is the guiding principle which guarantees the military forces always being under the command of the Party"
R3 = "It is the practical guide for the army always to heed the directions of the party"
HYP = "he read the book because he was interested in world history"
REF = "he was interested in world history because he read the book"
SCHEMA = "pair_id long, refs array<string>, hyp string"


def frame(spark, *rows):
    return spark.createDataFrame([(i, list(refs), hyp) for i, (refs, hyp) in enumerate(rows)], SCHEMA)


def scores(df):
    return [r["bleu"] for r in df.orderBy("pair_id").collect()]


def test_sentence_bleu_golden(spark):
    rows = frame(spark, ([R1, R2, R3], H1), ([R1, R2, R3], H2), ([R1], H1))
    assert scores(B.sentence_bleu(rows)) == pytest.approx([0.504567, 0.037031, 0.411804], abs=1e-6)
    assert scores(B.sentence_bleu(rows, weights=(0.2,) * 5))[0] == pytest.approx(0.392026, abs=1e-6)


def test_corpus_bleu_golden(spark):
    rows = frame(spark, ([R1, R2, R3], H1), ([REF], HYP))
    assert B.corpus_bleu(rows).first()["bleu"] == pytest.approx(0.592078, abs=1e-6)
    assert sum(scores(B.sentence_bleu(rows))) / 2 == pytest.approx(0.622325, abs=1e-6)


@pytest.mark.parametrize("method, want", [(0, 0.4118), (1, 0.4118), (2, 0.4490), (3, 0.4118), (4, 0.4118), (5, 0.4905), (6, 0.4136), (7, 0.4905)])
def test_smoothing_golden(spark, method, want):
    assert scores(B.sentence_bleu(frame(spark, ([R1], H1)), method=method)) == pytest.approx([want], abs=1e-4)


def test_modified_precision_golden(spark):
    the, of = ["the cat is on the mat", "there is a cat on the mat"], [R1, R2, R3]
    rows = frame(spark, (the, "the the the the the the the"), (of, "of the"), (of, H1), (of, H2))
    got = {n: [r["numerator"] / r["denominator"] for r in B.modified_precision(rows, n).orderBy("pair_id").collect()] for n in (1, 2)}
    assert got[1] == pytest.approx([2 / 7, 1.0, 0.944444, 0.571429], abs=1e-6)
    assert got[2][1:] == pytest.approx([1.0, 0.588235, 0.076923], abs=1e-6)


@pytest.mark.parametrize(
    "refs, hyp, want",
    [([12, 15, 17], 12, 1.0), ([28, 28], 12, 0.263597), ([13, 2], 12, 0.920044), ([13, 11], 12, 1.0), ([11, 13], 12, 1.0), ([11, 8], 7, 0.866878), ([11, 8, 6, 7], 7, 1.0), ([3], 0, 0.0)],
)
def test_brevity_golden(spark, refs, hyp, want):
    lens = F.array(*[F.lit(r) for r in refs])
    got = spark.range(1).select(brevity_penalty(closest_ref_len(lens, F.lit(hyp)), F.lit(hyp))).first()[0]
    assert got == pytest.approx(want, abs=1e-6)


def test_edges(spark):
    rows = frame(spark, (["a b"], ""), ([""], "a b"), (["a b"], "a b"), (["a b c d e"], "a b c d e"))
    assert scores(B.sentence_bleu(rows)) == pytest.approx([0.0, 0.0, math.exp(0.5 * math.log(0.1)), 1.0])
    assert scores(B.sentence_bleu(rows, auto_reweigh=True))[2] == pytest.approx(1.0)
    same = B.corpus_bleu_smooth(rows.filter("pair_id = 3"), smooth=False).first()
    assert (same["bleu"], same["bp"], same["ratio"]) == (1.0, 1.0, 1.0)
    assert B.corpus_bleu_smooth(rows.filter("pair_id = 0")).first()["bleu"] == 0.0


def test_no_pairs_score_zero(spark):
    assert B.corpus_bleu(frame(spark, (["a"], "a")).filter("pair_id > 9")).first()["bleu"] == 0.0


def brute_recall(refs, hyp, keywords, n):
    """Clipped matches and totals of the references, summed over them."""
    grams = lambda t: Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1))
    have, num, den = grams(hyp.split()), 0.0, 0.0
    for ref in refs:
        counts = grams(ref.split())
        weight = lambda g: 1.0 if n > 1 or g[0] in keywords else 0.2
        num += sum(weight(g) * min(c, have[g]) for g, c in counts.items())
        den += max(1, sum(weight(g) * c for g, c in counts.items()))
    return num, den


ROWS = [(["int a = b ;", "long a = b ;"], "int a = c ; int a"), (["return x"], "return x"), (["for while if", ""], "x")]


def test_recall_terms_brute_force(spark):
    keys = keyword_list("java")
    got = B.recall_terms(frame(spark, *ROWS), keys).orderBy("pair_id").collect()
    for row, (refs, hyp) in zip(got, ROWS):
        for n in range(1, 5):
            assert (row[f"m{n}"], row[f"d{n}"]) == pytest.approx(brute_recall(refs, hyp, keys, n))


def test_weighted_bleu_takes_references_as_two_long(spark):
    # three tokens in two rows: shorter than 2 per row, so the penalty is exp(1 - 4/3)
    keys, rows = keyword_list("java"), [(["return x"], "return x"), (["if y z"], "y")]
    sums = [[sum(v) for v in zip(*(brute_recall(r, h, keys, n) for r, h in rows))] for n in range(1, 5)]
    p = [(m if m else 0.1) / d for m, d in sums]
    want = math.exp(1 - 4 / 3) * math.exp(sum(0.25 * math.log(x) for x in p))
    assert B.weighted_bleu(frame(spark, *rows), keys).first()["bleu"] == pytest.approx(want)
    by_tokens = B.weighted_bleu(frame(spark, *rows), keys, ref_len_mode="tokens").first()["bleu"]
    assert by_tokens == pytest.approx(want / math.exp(1 - 4 / 3) * math.exp(1 - 5 / 3))


def test_hits_at_k(spark):
    rows = [("A", "x", ["x", "y"]), ("A", "x", ["y"] * 9 + ["x"]), ("A", "x", ["y"]), ("B", "z", ["y", "z"])]
    report = hits_at_k(spark.createDataFrame(rows, "api string, call string, preds array<string>"))
    got = {(r["api"], r["call"]): (r["hit_1"], r["hit_5"], r["hit_10"], r["n_test"]) for r in report.collect()}
    assert got == {("A", "x"): (1, 1, 2, 3), ("B", "z"): (0, 1, 1, 1), ("A", None): (1, 1, 2, 3), ("B", None): (0, 1, 1, 1), (None, None): (1, 2, 3, 4)}


def test_keyword_lists():
    assert [len(keyword_list(x)) for x in ("java", "c_sharp", "python")] == [50, 107, 35]
    with pytest.raises(ValueError):
        keyword_list("ruby")


def test_line_files(spark, tmp_path):
    (tmp_path / "r1.txt").write_text("a b \n c\n\n")
    (tmp_path / "r2.txt").write_text("1\n2\n3\n")
    (tmp_path / "h.txt").write_text("x\ny\nz\n")
    (tmp_path / "short.txt").write_text("x\ny\n")
    rows = read_line_pairs(spark, [str(tmp_path / "r1.txt"), str(tmp_path / "r2.txt")], str(tmp_path / "h.txt"))
    assert [tuple(r) for r in rows.orderBy("pair_id").collect()] == [(0, ["a b", "1"], "x"), (1, ["c", "2"], "y"), (2, ["", "3"], "z")]
    with pytest.raises(Exception, match="differ in length"):
        read_line_pairs(spark, [str(tmp_path / "r1.txt")], str(tmp_path / "short.txt")).collect()


def test_lines_keep_order_over_blocks_and_part_files(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 50) for i in range(2000)]
    (tmp_path / "big.txt").write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = read_lines(spark, str(tmp_path / "big.txt"))
        assert [r["value"] for r in rows.orderBy("line_no").collect()] == lines
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    samples = spark.range(5000).repartition(7).select(
        F.col("id").alias("sample_id"), F.concat(F.lit("p"), "id").alias("prediction"), F.concat(F.lit("g"), "id").alias("ground_truth")
    )
    write_line_pairs(samples, str(tmp_path / "out"))
    back = read_lines(spark, str(tmp_path / "out" / "gt")).orderBy("line_no").collect()
    assert [tuple(r) for r in back] == [(i, f"g{i}") for i in range(5000)]


def test_missing_texts_and_references_lose_no_pair(spark):
    """A missing text counts as empty, no reference as one empty reference; several references keep their lengths."""
    rows = [(0, ["a b c d e"], "a b c d e"), (1, [], "a b"), (2, None, "c"), (3, ["x y"], None), (4, [None, "p q r"], "p q"), (5, ["k l", "k l m n"], "k l m n")]
    df = spark.createDataFrame(rows, "pair_id long, refs array<string>, hyp string")
    filled = spark.createDataFrame([(i, [x or "" for x in r or []] or [""], h or "") for i, r, h in rows], df.schema)
    terms = B.bleu_terms(df).orderBy("pair_id").collect()
    assert terms == B.bleu_terms(filled).orderBy("pair_id").collect()
    assert [(r["m1"], r["h1"], r["min_ref_len"], r["closest_ref_len"]) for r in terms] == [(5, 5, 5, 5), (0, 2, 0, 0), (0, 1, 0, 0), (0, 0, 2, 2), (2, 2, 0, 3), (4, 4, 2, 4)]
    assert B.exact_match(df).first()[0] == round(100 / 6, 2)
    assert B.corpus_bleu(df).first() == B.corpus_bleu(filled).first()


def test_terms_stay_in_the_row(spark):
    """Neither texts nor n-grams are exchanged or grouped; repeated n-grams are clipped; equal ids are two pairs."""
    refs, hyp = ["a b a b a : 2", "1:a a a a a 2:a"], "a a a b a a a b a 2:a : 2 1:a"
    df = spark.createDataFrame([(1, refs, hyp), (1, ["x y"], "x y"), (2, ["x"], "")], SCHEMA)
    grams = lambda text, n: Counter(tuple(text.split()[i : i + n]) for i in range(len(text.split()) - n + 1))
    want = [sum((grams(hyp, n) & (grams(refs[0], n) | grams(refs[1], n))).values()) for n in range(1, 5)]
    got = B.bleu_terms(df)
    assert sorted([r[f"m{n}"] for n in range(1, 5)] for r in got.collect()) == sorted([want, [2, 1, 0, 0], [0, 0, 0, 0]])
    recalled = B.recall_terms(df, ["a"])
    row = recalled.filter("m1 > 2").first()
    for n in range(1, 5):
        assert (row[f"m{n}"], row[f"d{n}"]) == pytest.approx(brute_recall(refs, hyp, ["a"], n))
    for terms in (got, recalled):
        plan = terms._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Aggregate" not in plan
