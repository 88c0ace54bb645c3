import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.sources import corpus as C
from corpusmill.sources import shards as S


def written(spark, folder):
    """Names of the folders, and all rows as they are read back."""
    names = sorted(str(p.relative_to(folder)) for p in folder.rglob("*=*") if p.is_dir())
    back = spark.read.parquet(str(folder))
    return names, back.dtypes, sorted(map(repr, back.collect()))


def test_a_shard_starts_no_process_and_is_no_file_on_the_driver(spark, tmp_path, monkeypatch):
    # Hadoop's local file system leaves a .crc beside each file, and starts chmod for both and for each folder
    df = spark.range(500).selectExpr("id AS row_id", "repeat('x', 100) AS source_code")
    C.write_corpus(df, str(tmp_path / "out"), max_bytes=1000)
    assert not list((tmp_path / "out").rglob(".part-*.crc"))
    monkeypatch.setattr(type(spark), "read", None)
    sizes = C.read_shards(spark, str(tmp_path / "out"), "source_code string").groupBy("shard").agg(F.sum(F.length("source_code")).alias("n")).collect()
    assert len(sizes) == len(list((tmp_path / "out").glob("shard=*"))) and max(r["n"] for r in sizes) <= 1000 and sum(r["n"] for r in sizes) == 50_000


def test_a_row_is_compared_with_few_shards_and_moved_once(spark, monkeypatch):
    df = spark.range(5000).selectExpr("id AS row_id", "repeat('x', 100) AS source_code")
    sharded = C.with_shards(df, 300)
    assert "BroadcastHashJoin" in (plan := sharded._jdf.queryExecution().executedPlan().toString()) and "hashpartitioning" not in plan
    sizes = df.select(F.col("row_id").alias("_id"), F.lit(100).cast("long").alias("_size"))
    starts = C.bucket_starts(sizes, C.by_id("_id"), [], "_size", 201).collect()
    assert max(len(r["_starts"]) for r in starts) <= 64
    want = {i: 100 * i // 201 for i in range(5000)}
    assert {r["row_id"]: r["shard"] for r in sharded.collect()} == want
    monkeypatch.setattr(C, "BROADCAST_STARTS", 0)
    assert {r["row_id"]: r["shard"] for r in C.with_shards(df, 300).collect()} == want


@pytest.mark.parametrize("by", [None, "domain"])
def test_folders_and_rows_are_those_of_spark(spark, tmp_path, monkeypatch, by):
    domains = [None, "", "a/b", "ü %=:", "x y", "{q}[1]^", "'\"#*?\\\t"]
    lengths = [0, 10, 120, 499, 500, 501, 3000, None]
    rows = [(i, None if (n := lengths[i % 8]) is None else "é" * (n // 2) + "x" * (n % 2), domains[i % 7], i % 3 == 0, i / 7) for i in range(300)]
    rows += [(5, "x" * 90, "twice", None, None), (5, "x" * 90, "twice", None, None), (None, "no id", "a/b", True, 0.5), (None, "y" * 900, None, False, None)]
    df = spark.createDataFrame(rows, "row_id long, source_code string, domain string, flag boolean, score double").repartition(3)
    C.write_corpus(df, str(tmp_path / "own"), max_bytes=1000, partition_by=by and [by])
    monkeypatch.setattr(C, "writes_folders", lambda *a: False)
    C.write_corpus(df, str(tmp_path / "spark"), max_bytes=1000, partition_by=by and [by])
    assert written(spark, tmp_path / "own") == written(spark, tmp_path / "spark")
    assert C.read_corpus(spark, str(tmp_path / "own")).count() == len(rows)
    if by is None:
        own = C.read_shards(spark, str(tmp_path / "own"), "score double, row_id long, source_code string")
        monkeypatch.setattr(S, "local_folder", lambda *a: None)
        plain = C.read_shards(spark, str(tmp_path / "own"), "score double, row_id long, source_code string")
        assert own.dtypes == plain.dtypes and sorted(map(repr, own.collect())) == sorted(map(repr, plain.collect()))


def test_a_corpus_written_again_replaces_the_first(spark, tmp_path):
    df = spark.range(40).selectExpr("id AS row_id", "repeat('x', 100) AS source_code")
    C.write_corpus(df, str(tmp_path / "out"), max_bytes=1000)
    C.write_corpus(df.filter("row_id < 7"), str(tmp_path / "out"), max_bytes=1000, max_records=3)
    assert sorted(p.name for p in (tmp_path / "out" / "shard=0").glob("*.parquet")) == ["part-00000.parquet", "part-00001.parquet", "part-00002.parquet"]
    assert C.read_shards(spark, str(tmp_path / "out"), "row_id long").count() == 7
    C.write_corpus(df.limit(0), str(tmp_path / "none"), max_bytes=1000)
    assert C.read_shards(spark, str(tmp_path / "none"), "row_id long").count() == 0


def test_a_failed_write_leaves_no_mark_of_success(spark, tmp_path):
    df = spark.range(40).selectExpr("id AS row_id", "repeat('x', 100) AS source_code", "if(id = 39, raise_error('broken'), 'a') AS note")
    with pytest.raises(Exception, match="broken"):
        C.write_corpus(df, str(tmp_path / "out"), max_bytes=1000)
    assert not (tmp_path / "out" / "_SUCCESS").exists() and not (tmp_path / "out" / "_temporary").exists()


def test_of_two_attempts_the_first_stays_and_large_folders_are_written_in_parts(tmp_path, monkeypatch):
    monkeypatch.setattr(S, "GROUP_BYTES", 100)
    write = S._writer(str(tmp_path / "root"), str(tmp_path / "aside"), ["d", "shard"], "{}", 25, {"compression": "snappy"})
    for text in ("first", "second"):
        batches = [pa.RecordBatch.from_pydict({"t": [f"{text} {i}" for i in range(a, a + 20)], "d": ["a"] * 20, "s": [str(i // 60) for i in range(a, a + 20)]}) for a in range(0, 80, 20)]
        assert next(write(iter(batches))).column(0).to_pylist() == [2]
    found = {p.parent.name: [] for p in (tmp_path / "root").rglob("*.parquet")}
    for p in sorted((tmp_path / "root").rglob("*.parquet")):
        found[p.parent.name].append(pa.parquet.read_table(p, partitioning=None).column("t").to_pylist())
    assert [len(x) for x in found["shard=0"]] == [25, 25, 10] and sum(found["shard=0"], []) == [f"first {i}" for i in range(60)]
    assert sum(found["shard=1"], []) == [f"first {i}" for i in range(60, 80)]
