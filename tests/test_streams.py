import pytest
from pyspark.sql import functions as F

from corpusmill.operators.continual import reservoir
from corpusmill.streaming.experiences import consume, dedup_stream, feed, reservoir_stream, reservoir_update


def rows(spark):
    return spark.range(600).select(F.col("id").alias("row_id"), (F.col("id") % 4).alias("exp_id"))


def test_reservoir_stream_equals_batch(spark, tmp_path):
    got = reservoir_stream(rows(spark), 4, str(tmp_path), k=30)
    assert {r["row_id"] for r in got.collect()} == {r["row_id"] for r in reservoir(rows(spark), 30).collect()}


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    update = reservoir_update(str(tmp_path), k=10)
    for batch in (0, 1, 1):
        update(rows(spark).filter(F.col("exp_id") == batch), batch)
    want = {r["row_id"] for r in reservoir(rows(spark).filter("exp_id < 2"), 10).collect()}
    assert {r["row_id"] for r in spark.read.parquet(f"{tmp_path}/1").collect()} == want


def test_mixed_experiences_are_an_error(spark, tmp_path):
    feed(rows(spark), f"{tmp_path}/in")
    with pytest.raises(Exception, match="mixes experiences"):
        consume(spark, f"{tmp_path}/in", rows(spark).schema, f"{tmp_path}/offsets", lambda df, i: None)


def test_dedup_stream_keeps_hashes_between_batches(spark, tmp_path):
    texts = spark.createDataFrame([(0, "a b"), (1, "c")], "row_id long, source_code string")
    more = spark.createDataFrame([(2, "ab"), (3, "d")], "row_id long, source_code string")
    for part in (texts, more):
        feed(part, f"{tmp_path}/in")
        dedup_stream(spark, f"{tmp_path}/in", texts.schema, f"{tmp_path}/out", f"{tmp_path}/offsets")
    assert sorted(r["row_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [0, 1, 3]


def test_an_experience_without_rows_keeps_the_reservoir(spark, tmp_path):
    rows = spark.createDataFrame([(i, 2 * (i % 2)) for i in range(20)], "row_id long, exp_id int")
    found = reservoir_stream(rows, 3, str(tmp_path), k=5)
    assert sorted(r["row_id"] for r in found.collect()) == sorted(r["row_id"] for r in reservoir(rows, 5).collect())
    assert reservoir_stream(rows.limit(0), 2, str(tmp_path / "none"), k=5).count() == 0
