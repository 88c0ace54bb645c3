import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import position as P
from corpusmill.operators import split as S
from corpusmill.operators.rows import head_rows


def ids_of(kind):
    rng = random.Random(3)
    return {
        "dense": list(range(200)),
        "sparse": rng.sample(range(1 << 62), 200),
        "blocks": [p << 33 | i for p in range(4) for i in range(50)],
    }[kind]


@pytest.mark.parametrize("kind", ["dense", "sparse", "blocks"])
@pytest.mark.parametrize("bits", [3, 21])
def test_dense_position(spark, kind, bits):
    ids = ids_of(kind)
    df = spark.createDataFrame([(i, i % 3) for i in ids], "row_id long, g long").repartition(5)
    placed = P.dense_position(df, P.by_id(bits=bits), ["g"], total="n")
    want = {}
    for g in range(3):
        members = sorted(i for i in ids if i % 3 == g)
        want |= {i: (pos, len(members)) for pos, i in enumerate(members)}
    assert {r["row_id"]: (r["pos"], r["n"]) for r in placed.collect()} == want
    whole = P.dense_position(df, P.by_id(bits=bits))
    assert [r["row_id"] for r in whole.orderBy("pos").collect()] == sorted(ids)


@pytest.mark.parametrize("k", [0, 1, 57, 200, 999])
@pytest.mark.parametrize("kind", ["dense", "sparse"])
def test_rank_cut(spark, kind, k):
    ids = ids_of(kind)
    df = spark.createDataFrame([(i,) for i in ids], "row_id long")
    cut = [r["cut0"] for r in P.rank_cut(df, P.by_id(bits=4), [lambda n: F.lit(k)]).collect()]
    assert cut == ([] if k == 0 else [sorted(ids)[min(k, 200) - 1]])


@pytest.mark.parametrize("before", [False, True])
def test_running(spark, before):
    rng = random.Random(5)
    rows = [(g, step, rng.randrange(50)) for g in range(3) for step in range(0, 60, 2)]
    df = spark.createDataFrame(rows, "g int, step long, v int").repartition(4)
    outs = {"low": P.running_min(F.col("v"), before), "high": P.running_max(F.col("v"))}
    got = P.running(df, ["g"], "step", outs, bits=3)
    for r in got.collect():
        seen = [v for g, s, v in rows if g == r["g"] and (s < r["step"] or (s == r["step"] and not before))]
        assert r["low"] == (min(seen) if seen else None)
        assert r["high"] == max(v for g, s, v in rows if g == r["g"] and s <= r["step"])


def test_splits_are_exact_and_complete(spark):
    df = spark.createDataFrame(
        [(i, api) for api, n, start in (("a", 9, 0), ("b", 10, 100), ("c", 29, 200), ("d", 200, 1000)) for i in range(start, start + n)],
        "row_id long, api string",
    )
    split = S.stratified_split(df)
    counts = {(r["api"], r["split"]): r["count"] for r in split.groupBy("api", "split").count().collect()}
    assert {a: counts.get((a, "test"), 0) for a in "abcd"} == {"a": 0, "b": 1, "c": 2, "d": 20}
    assert split.count() == split.select("row_id").distinct().count() == 248
    exact = S.random_split_exact(df).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in exact} == {"test": 24, "train": 224}


def test_slices_clamp_to_what_there_is(spark):
    df = spark.range(20).withColumnRenamed("id", "row_id")
    split = {r["row_id"]: r["split"] for r in S.slice_splits(df, 15, 10).collect()}
    assert split == {i: "ft" if i < 15 else "valid" for i in range(20)}
    assert {r["split"] for r in S.slice_splits(df, 0, 5).filter("row_id < 5").collect()} == {"valid"}
    assert head_rows(df, 7, batch=5).count() == 10
    assert head_rows(df, 100, batch=5).count() == 20


def test_same_result_for_any_partitioning(spark):
    df = spark.range(3000).select(F.col("id").alias("row_id"), (F.col("id") % 7).cast("string").alias("api"))
    results = []
    for n in (1, 8):
        rows = S.stratified_split(df.repartition(n)).filter("split = 'test'").select("row_id").collect()
        results.append(sorted(r[0] for r in rows))
    assert results[0] == results[1]
