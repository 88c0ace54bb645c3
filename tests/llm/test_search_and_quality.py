import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import ann, byte_cnn
from corpusmill.llm.ann import nearest
from corpusmill.llm.quality import fit_quality, held_out, score_quality
from corpusmill.llm.queries import QUERIES


def brute(rows, k):
    out = {}
    good = [(i, np.array(v)) for i, v in rows if i is not None and v and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for i, v in good:
        if i % 5 == 0:
            best = {}
            for j, w in good:
                if j != i:
                    best[j] = max(best.get(j, -1e9), float((w * v).sum()))
            out[i] = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(3)
    points = np.round(draw.standard_normal((300, 8)), 3).astype(np.float32).astype(float).tolist()
    rows = list(enumerate(points)) + [(400 + i, points[0]) for i in range(60)]
    return rows + [(500, None), (505, [0.0] * 8), (510, [None] * 8), (515, [float("nan")] * 8), (520, [float("inf")] * 8), (525, [1.0] * 3), (None, points[3]), (10, points[10])]


def test_the_whole_forest_gives_the_exact_result(spark, rows):
    df = spark.createDataFrame([(*r, "v") for r in rows], "vec_id long, embedding array<float>, vector string")
    found = nearest(df, F.col("vec_id") % 5 == 0, k=7, share=1.0, leaves=8).collect()
    expect = brute(rows, 7)
    assert {r["query_id"] for r in found} == set(expect)
    for q, best in expect.items():
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == q)
        assert [m[0] for m in mine] == list(range(1, len(best) + 1))
        assert [m[1] for m in mine] == [b[0] for b in best]
        assert np.allclose([m[2] for m in mine], [b[1] for b in best], atol=1e-12)


def test_a_part_of_the_forest_in_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(ann, "CELL_ROWS", 10)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = nearest(df, F.col("vec_id") % 5 == 0, k=7, share=0.5, leaves=8).collect()
    expect = brute(rows, 7)
    hits = sum(len({b[0] for b in best} & {r["vec_id"] for r in found if r["query_id"] == q}) for q, best in expect.items())
    assert hits >= 0.85 * sum(map(len, expect.values()))


@pytest.mark.parametrize("n", [5, 12, 22, 26])
def test_few_vectors_have_all_neighbours(spark, n):
    points = np.random.default_rng(n).standard_normal((n, 64)).tolist()
    # repeated rows and a second vector of one id are no further candidates
    df = spark.createDataFrame([*enumerate(points), (1, points[1]), (1, points[2])], "vec_id long, embedding array<double>")
    found = nearest(df, F.col("vec_id") % 2 == 0).groupBy("query_id").agg(F.countDistinct("vec_id").alias("n"), F.max("rank").alias("top")).collect()
    assert {r["query_id"] for r in found} == set(range(0, n, 2))
    assert all(r["n"] == r["top"] == min(20, n - 1) for r in found)


def test_recall_of_the_query(spark):
    """Production parameters over the whole table against brute force."""
    held = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    good = {r["vec_id"]: np.array(r["embedding"], float) for r in held if r["embedding"] and all(x is not None and np.isfinite(x) for x in r["embedding"]) and any(r["embedding"])}
    found = {}
    for r in QUERIES["op7_ann"](spark, "/root/testdata/sf0.01").collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = total = 0
    for q in (i for i in good if i % 20 == 0):
        best = sorted((-float((good[q] * v).sum()), i) for i, v in good.items() if i != q)[:20]
        hits += len({i for _, i in best} & found[q])
        total += len(best)
    print("recall", hits / total)
    assert hits >= 0.9 * total > 0


def test_no_vectors_few_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert nearest(spark.createDataFrame([], schema), F.col("vec_id") % 5 == 0).collect() == []
    two = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 1.0])], schema)
    assert [tuple(r) for r in nearest(two, F.col("vec_id") % 5 == 0).collect()] == [(0, 1, 1, 0.5)]


def test_the_network_by_numbers():
    """The layout over blocks gives what a plain loop over all positions and chunks gives."""
    w = byte_cnn.start(3)
    texts = [b"", b"abc", b"x" * 128, bytes(range(1, 200)), b"hello world " * 90]

    def plain(t):
        data = np.frombuffer(t + b"\0" * (byte_cnn.BLOCK * 2), np.uint8)
        blocks = (len(t) + byte_cnn.WIDTH - 1 + byte_cnn.BLOCK - 1) // byte_cnn.BLOCK
        conv = [sum(w["table"][k][data[i + k]] for k in range(byte_cnn.WIDTH)) for i in range(max(len(t), 1))]
        top = [np.max(conv[b * byte_cnn.BLOCK : (b + 1) * byte_cnn.BLOCK], axis=0) if conv[b * byte_cnn.BLOCK :] else np.full(byte_cnn.FILTERS, -1e9) for b in range(blocks)]
        top = np.maximum(np.array(top) + w["bias"], 0)
        chunks = top if blocks == 1 else np.maximum(top[:-1], top[1:])
        hidden = np.maximum(chunks @ w["hidden"] + w["hidden_bias"], 0)
        z = np.concatenate([hidden.max(axis=0), hidden.mean(axis=0)]) @ w["out"] + w["out_bias"][0]
        return 1 / (1 + np.exp(-z))

    assert np.allclose(byte_cnn.probabilities(w, texts), [plain(t) for t in texts], atol=1e-5)
    assert np.allclose(byte_cnn.probabilities(w, texts[3:]), byte_cnn.probabilities(w, texts)[3:], atol=1e-6)


def test_gradients_by_differences():
    w = {k: v.astype(np.float64) for k, v in byte_cnn.start(1).items()}
    texts, labels = [b"good words here", b"BAD!! BAD!! " * 20], np.array([1.0, 0.0])

    def loss(w):
        p = byte_cnn.probabilities(w, texts)
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    g = byte_cnn._gradients(w, texts, labels)
    draw = np.random.default_rng(0)
    for name in w:
        places = np.argwhere(np.abs(g[name]) > 1e-4)
        for at in draw.permutation(places)[:4]:
            up, down = {**w, name: w[name].copy()}, {**w, name: w[name].copy()}
            up[name][tuple(at)] += 1e-5
            down[name][tuple(at)] -= 1e-5
            assert (loss(up) - loss(down)) / 2e-5 == pytest.approx(g[name][tuple(at)], rel=0.05, abs=1e-4)


def test_held_out_rows_are_not_learned_from(spark):
    ids = list(range(40)) + [None]
    got = {r[0]: r[1] for r in spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", held_out()).collect()}
    assert all(got[i] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in ids if i is not None)
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string")
    labels = [(i, i % 2) for i in range(40)] + [(None, 1), (3, None), (99, 1)]
    flipped = [(i, q if i is None or q is None or not got.get(i) else 1 - q) for i, q in labels]
    one, two = (fit_quality(docs, spark.createDataFrame(x, "doc_id long, quality int"), epochs=1) for x in (labels, flipped))
    assert all(np.array_equal(one[k], two[k]) for k in one)


def test_scores_are_good_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    scored = score_quality(docs.join(labels.drop("toxic"), "doc_id").filter(held_out()), fit_quality(docs, labels)).toPandas()
    right = (scored["score"] >= 0.7) == (scored["quality"] == 1)
    assert len(scored) > 500 and right.mean() > 0.97 and right[scored["quality"] == 1].mean() > 0.98


def test_scores_of_odd_rows(spark, odd, none):
    weights = byte_cnn.start(2)
    rows = score_quality(odd.withColumn("score", F.lit("x")), weights).select("text", "score", "key").collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    by_text = {}
    assert all(abs(by_text.setdefault(r["text"] or "", r["score"]) - r["score"]) < 1e-6 for r in rows)
    assert score_quality(none, weights).collect() == []
