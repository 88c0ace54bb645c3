import math
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import continual as C
from corpusmill.operators import ngram_model as N
from corpusmill.operators import runlog as G


def brute_stop(series, patience, mode, margin):
    """One run, step by step."""
    better = (lambda a, b: a < b) if mode == "min" else (lambda a, b: a > b)
    best = at = None
    for step, value in series:
        if best is None:
            best, at = value, 0
            continue
        if better(value, best) and better(value - best, margin):
            best, at = value, step
        if step - at >= patience:
            return at, best, step
    return at, best, None


SERIES = {
    0: [5.0, 4.0, 4.0, 4.0, 4.0, 3.0],
    1: [9.0, 8.0, 7.0, 6.0, 5.0, 4.0],
    2: [1.0, 2.0, 3.0, 4.0, 5.0, 6.0],
    3: [2.0, 2.25, 2.5, 2.75, 3.0, 1.0],
}


@pytest.mark.parametrize("mode, margin", [("min", 0.0), ("max", 0.0), ("max", 0.5), ("min", 0.5), ("min", -0.5), ("max", -0.5)])
@pytest.mark.parametrize("patience", [1, 2, 4])
def test_early_stop(spark, mode, margin, patience):
    rng = random.Random(1)
    series = {e: list(enumerate(v)) for e, v in SERIES.items()}
    series |= {e: [(s + 3, round(rng.random(), 2)) for s in range(40)] for e in range(4, 9)}
    rows = [(e, s, v) for e, pairs in series.items() for s, v in pairs]
    log = spark.createDataFrame(rows, "exp_id long, step long, loss double").repartition(3)
    got = {r["exp_id"]: (r["best_step"], r["best_value"], r["stop_step"]) for r in G.early_stop(log, patience, mode, margin).collect()}
    assert got == {e: brute_stop(pairs, patience, mode, margin) for e, pairs in series.items()}


def test_early_stop_over_the_stream(spark):
    log = spark.createDataFrame([(0, 0, 3.0), (0, 1, 2.0), (1, 2, 2.5), (1, 3, 2.6)], "exp_id long, step long, loss double")
    assert [tuple(r) for r in G.early_stop(log, 2, criteria="stream").collect()] == [(0, 1, 2.0, 3)]


def test_perplexity(spark):
    log = spark.createDataFrame([(0, 4, 1.0), (1, 4, 2.0), (2, 1, 8.0)], "batch long, n_rows long, loss double")
    assert G.perplexity(log).first()["loss"] == pytest.approx(20 / 9)
    cut = G.perplexity(log, batch_size=4, n_rows=6).first()
    assert cut["loss"] == pytest.approx((4 * 1 + 2 * 2) / 6) and cut["perplexity"] == pytest.approx(math.exp(8 / 6))
    huge = spark.createDataFrame([(0, 1, 1e4)], "batch long, n_rows long, loss double")
    assert G.perplexity(huge).first()["perplexity"] == math.inf


def test_best_checkpoint_is_the_first_minimum(spark):
    log = spark.createDataFrame([(10, 3.0), (20, 2.0), (30, 2.0)], "step long, perplexity double")
    assert tuple(G.best_checkpoint(log).first()) == (20, 2.0)
    steps = spark.range(0, 200, 10).withColumnRenamed("id", "step")
    assert [r["step"] for r in G.thin_log(steps, 50, skip_zero=True).orderBy("step").collect()] == [50, 100, 150]


def test_ngram_model(spark):
    train = spark.createDataFrame([(0, [1, 2, 1, 2, 1, 3]), (1, [])], "row_id long, input_ids array<int>")
    model = N.train_ngram(train, 2)
    assert {(r["ctx"], r["next"]): (r["cnt"], r["ctx_cnt"]) for r in model.collect()} == {
        ("-1", 1): (1, 1), ("1", 2): (2, 3), ("2", 1): (2, 2), ("1", 3): (1, 3)
    }
    test = spark.createDataFrame([(7, [1, 2, 4, 1])], "row_id long, input_ids array<int>")
    p = [(1 + 1) / (1 + 5), (2 + 1) / (3 + 5), (0 + 1) / (2 + 5), 1 / 5]
    want = -sum(math.log(x) for x in p) / 4
    assert N.score_ngram(test, model, 5, 2).first()["loss"] == pytest.approx(want)
    by_row = N.score_ngram(test, model, 5, 2, keys=["row_id"]).first()
    assert (by_row["row_id"], by_row["n_tokens"]) == (7, 4) and by_row["loss"] == pytest.approx(want)
    assert {r["ctx"]: r["preds"] for r in N.topk_next(model, 1).collect()} == {"-1": [1], "1": [2], "2": [1]}
    unigram = N.train_ngram(train, 1)
    assert {r["next"]: r["cnt"] for r in unigram.collect()} == {1: 3, 2: 2, 3: 1}


def tasks(spark, n=300):
    return spark.range(n).select(F.col("id").alias("row_id"), (F.col("id") % 3).cast("int").alias("task_id"))


def test_reservoirs_of_parts_merge(spark):
    rows = tasks(spark)
    whole = {r["row_id"] for r in C.reservoir(rows, 20).collect()}
    state = C.reservoir(rows.filter("task_id = 0"), 20)
    for t in (1, 2):
        state = C.reservoir(state.unionByName(rows.filter(f"task_id = {t}")), 20)
    assert {r["row_id"] for r in state.collect()} == whole and len(whole) == 20


def test_strategy_sets(spark):
    rows = tasks(spark)
    sizes = lambda df: {r["exp_id"]: r["count"] for r in df.groupBy("exp_id").count().collect()}
    assert sizes(C.strategy_sets(rows, "naive", 3)) == {0: 100, 1: 100, 2: 100}
    assert sizes(C.strategy_sets(rows, "joint", 3)) == {0: 300}
    assert sizes(C.strategy_sets(rows, "cumulative", 3)) == {0: 100, 1: 200, 2: 300}
    replay = C.strategy_sets(rows, "replay", 3, mem_size=30)
    assert sizes(replay.filter("from_memory")) == {1: 30, 2: 30}
    assert replay.filter("from_memory AND task_id >= exp_id").count() == 0
    with pytest.raises(ValueError):
        C.strategy_sets(rows, "other")


@pytest.mark.parametrize("n_cur, n_mem", [(11, 4), (4, 11), (5, 0), (6, 6)])
def test_replay_batches(spark, n_cur, n_mem):
    cur = spark.range(n_cur).withColumnRenamed("id", "row_id")
    mem = spark.range(100, 100 + n_mem).withColumnRenamed("id", "row_id")
    rows = C.replay_batches(cur, mem, 2, 2).collect()
    n_batches = max(-(-n_cur // 2), -(-n_mem // 2))
    assert {r["batch"] for r in rows} == set(range(n_batches))
    for from_memory, n in ((False, n_cur), (True, n_mem)):
        side = [r for r in rows if r["from_memory"] is from_memory]
        assert len({r["row_id"] for r in side}) == n
        first = -(-n // 2)
        for r in side:
            again = [x["row_id"] for x in side if x["batch"] == r["batch"] % first and x["slot"] == r["slot"]]
            assert again == [r["row_id"]]
        assert {r["batch"] for r in side} == (set(range(n_batches)) if n else set())


def test_balanced_sample(spark):
    mem = tasks(spark, 30).filter("task_id <> 2 OR row_id < 9").withColumnRenamed("task_id", "exp_id")
    rows = C.balanced_sample(mem, sample_size=7, steps=6).collect()
    assert len(rows) == 6 * 3 * 2
    per_step = {(r["step"], r["exp_id"]) for r in rows}
    assert len(per_step) == 18
    small = [r["row_id"] for r in sorted(rows, key=lambda r: (r["step"], r["slot"])) if r["exp_id"] == 2]
    assert small[:3] == small[3:6] == small[6:9] and set(small) == {2, 5, 8}
    big = [r["row_id"] for r in rows if r["exp_id"] == 0 and r["step"] < 5]
    assert len(set(big)) == 10


def test_eval_matrix_leaves_later_domains_empty(spark):
    preds = spark.createDataFrame([(e, d, 1.0 * e) for e in (0, 1) for d in ("a", "b")], "exp_id int, domain string, v double")
    matrix = C.eval_matrix(preds, lambda df, keys: df.groupBy(*keys).agg(F.sum("v").alias("s")), "s", ["a", "b"])
    assert [tuple(r) for r in matrix.orderBy("exp_id").collect()] == [(0, 0.0, None), (1, 1.0, 1.0)]
