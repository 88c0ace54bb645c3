import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.operators import labels as L
from corpusmill.operators import lookup as K
from corpusmill.operators import rows as R
from corpusmill.operators import usages as U
from corpusmill.operators.dedup import dedup_first
from corpusmill.plans.prepare import prepare_corpus
from corpusmill.plans.split import split_corpus
from corpusmill.sources.corpus import read_corpus, read_json_corpus, read_raw_corpus, write_corpus
from corpusmill.sources.lines import read_line_pairs, write_line_pairs


def test_a_long_first_copy_takes_shorter_ones_with_it(spark):
    rows = [(0, "a\n\n\n\nb"), (1, "a b"), (2, "c"), (3, "c "), (4, "d\ne")]
    kept = prepare_corpus(spark.createDataFrame(rows, "row_id long, source_code string"), line_max=2)
    assert [tuple(r) for r in kept.orderBy("row_id").collect()] == [(2, "c"), (4, "d\ne")]
    again = prepare_corpus(kept, line_max=2)
    assert again.count() == 2


def test_dedup_with_one_hot_key(spark):
    df = spark.range(4000).select(
        F.col("id").alias("row_id"), F.when(F.col("id") % 3 > 0, "same").otherwise(F.col("id").cast("string")).alias("t")
    )
    kept = dedup_first(df.repartition(8), "t")
    assert kept.count() == 1334 + 1 and kept.filter("t = 'same'").first()["row_id"] == 1


def test_generated_files_can_be_dropped(spark):
    df = spark.createDataFrame([(0, "// auto-generated\nx"), (1, "y")], "row_id long, source_code string")
    assert [r["row_id"] for r in prepare_corpus(df, drop_generated=True).collect()] == [1]


def test_json_reads_only_json_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"row_id": 1, "source_code": "x"}\n{"row_id": 2, "source_code": "y\\n"}\n')
    (tmp_path / "b.txt").write_text("no")
    back = read_json_corpus(spark, str(tmp_path), "row_id long, source_code string")
    assert sorted(tuple(r) for r in back.collect()) == [(1, "x"), (2, "y\n")]


def test_shards_are_bounded(spark, tmp_path):
    write_corpus(spark.range(100).coalesce(1), str(tmp_path / "out"), max_records=30)
    files = list((tmp_path / "out").glob("*.parquet"))
    assert len(files) == 4 and spark.read.parquet(str(tmp_path / "out")).count() == 100


def test_columns(spark):
    df = spark.range(1).withColumn("domain", F.lit("web"))
    with pytest.raises(ValueError, match="absent"):
        R.drop_columns(df, ["absent"])
    assert R.drop_columns(df, ["absent", "id"], strict=False).columns == ["domain"]
    assert R.ensure_labels(df).columns == ["id", "domain"]
    assert R.ensure_labels(df.drop("domain")).columns == ["id", "domain", "api"]
    assert R.filter_domain(df, "all").count() == 1


def test_labels(spark):
    corpus = spark.createDataFrame([(i, f"t{i}") for i in range(6)], "row_id long, source_code string")
    labels = spark.createDataFrame(
        [("web", "B", 1, 0), ("web", "A", 0, 0), ("web", "B", 1, 1), ("guava", "C", 0, 1)],
        "domain string, api string, api_order int, row_id long",
    )
    found = L.attach_api(L.select_ood(corpus, labels), labels).select("domain", "row_id", "api")
    assert sorted(tuple(r) for r in found.collect()) == [("guava", 1, "C"), ("web", 0, "A"), ("web", 1, "B")]
    orphan = L.select_ood(corpus, labels).withColumn("domain", F.lit("none"))
    assert L.attach_api(orphan, labels).filter("api IS NULL").count() == 3
    with pytest.raises(Exception, match="no API"):
        L.attach_api(orphan, labels, strict=True).collect()
    split = split_corpus(corpus, labels, 1, 2)
    got = sorted((r["row_id"], r["domain"], r["split"]) for r in split.collect())
    assert got == [(0, "web", "ood"), (1, "guava", "ood"), (1, "web", "ood"), (2, "NaN", "ft"), (3, "NaN", "valid"), (4, "NaN", "valid"), (5, "NaN", "train")]


def test_samples(spark):
    code = "void m() {\n  List.add(a, f(1));\n  x.add(2);\n  y.add(3;\n}"
    seq = f"List.<init> 0|List.add {code.index('add')}|List.add {code.index('add(2')}|List.add {code.index('add(3')}|List.add 1|List.add -3|Map.get 2|"
    rows = [(0, code, seq, "general", "List"), (1, code, seq, "NaN", "NaN"), (2, code, "broken|", "NaN", "NaN")]
    df = spark.createDataFrame(rows, "row_id long, source_code string, api_seq string, domain string, api string")
    catalog = spark.createDataFrame([("Map.get",)], "fqn string")
    usage = U.usage_samples(df, catalog).orderBy("row_id", "usage_no").collect()
    assert [r["ground_truth"] for r in usage] == ["List.add(a, f(1))", "add(2)"]
    assert [r["context"] for r in usage] == [code[: code.index("List")], code[: code.index("add(2")]]
    assert U.call_samples(df, catalog).count() == 3
    assert U.call_samples(df, spark.createDataFrame([("List.add",)], "fqn string")).count() == 6
    assert U.valid_samples(df).count() == 3
    assert U.malformed_count(df).first()[0] == 1


def test_lookups_with_hot_keys(spark):
    left = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    right = left.groupBy("k").agg(F.count("*").alias("n")).filter("k % 5 <> 2").withColumn("v", F.col("k") * 10)
    joined = K.spread_lookup(left, right, ["k"], "n", F.col("id"), hot_share=10)
    assert joined.columns == ["id", "k", "v"] and joined.count() == 3000
    assert joined.filter("k % 5 <> 2 AND (v IS NULL OR v <> k * 10)").count() == 0
    assert joined.filter("k % 5 = 2 AND v IS NOT NULL").count() == 0
    listed = right.select("k", "v")
    found = K.lookup(left, listed, ["k"])
    assert found.count() == 3000 and found.filter("k % 5 <> 2 AND (v IS NULL OR v <> k * 10)").count() == 0


def test_the_catalogue_join_moves_no_text_per_usage(spark):
    rows = [(i, "List.add(1); Map.get(2)", "List.add 5|Map.get 17|", "NaN", "NaN") for i in range(3)]
    df = spark.createDataFrame(rows, "row_id long, source_code string, api_seq string, domain string, api string")
    catalog = spark.createDataFrame([("Map.get",)], "fqn string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        samples = U.call_samples(df, catalog)
        plan = samples._jdf.queryExecution().optimizedPlan().toString()
        assert samples.count() == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joined = plan[plan.index("LeftSemi") :].splitlines()[1]
    assert "Project" in joined and "usage_no" in joined and "source_code" not in joined


def test_a_long_argument_list_keeps_its_sample(spark):
    code = "x.add(" + "a" * 20_000 + ");"
    df = spark.createDataFrame([(0, code, "List.add 2|", "general", "List")], "row_id long, source_code string, api_seq string, domain string, api string")
    assert U.usage_samples(df).first()["ground_truth"] == code[2:-1]
    assert df.select(X.balanced_end("source_code", F.lit(5), max_scan=10)).first()[0] is None


def test_a_raw_corpus_gets_ids_in_file_order(spark, tmp_path):
    for n in (0, 9, 99999, 100000):
        (tmp_path / f"part-{n:05d}-x.json").write_text("".join(f'{{"source_code": "{n} {i % 2}"}}\n' for i in range(3)))
    raw = read_raw_corpus(spark, str(tmp_path), "source_code string").orderBy("row_id").collect()
    assert [tuple(r) for r in raw] == [(3 * k + i, f"{n} {i % 2}") for k, n in enumerate((0, 9, 99999, 100000)) for i in range(3)]
    assert prepare_corpus(read_raw_corpus(spark, str(tmp_path), "source_code string")).count() == 8


def test_a_broken_line_and_a_null_id_are_errors(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"source_code": "x"}\n{"source_code": \n')
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        read_json_corpus(spark, str(tmp_path), "source_code string").collect()
    kept = read_json_corpus(spark, str(tmp_path), "source_code string, _corrupt_record string", mode="PERMISSIVE").collect()
    assert [r["_corrupt_record"] for r in kept if r["source_code"] is None] == ['{"source_code": ']
    with pytest.raises(Exception, match="a row has no id"):
        prepare_corpus(spark.createDataFrame([(None, "x")], "row_id long, source_code string")).collect()


def test_lines_that_would_not_be_read_back_are_errors(spark, tmp_path):
    schema = "sample_id long, prediction string, ground_truth string"
    for bad in ("a\nb", "a\rb", None):
        with pytest.raises(Exception, match="line break"):
            write_line_pairs(spark.createDataFrame([(0, bad, "x")], schema), str(tmp_path / "bad"))
    write_line_pairs(spark.createDataFrame([(1, "p\x0b", "q"), (0, "", "é")], schema), str(tmp_path / "good"))
    back = read_line_pairs(spark, [str(tmp_path / "good/gt")], str(tmp_path / "good/predictions")).orderBy("pair_id").collect()
    assert [tuple(r) for r in back] == [(0, ["é"], ""), (1, ["q"], "p")]


def sizes_of(spark, path):
    shards = {}
    for r in spark.read.parquet(str(path)).collect():
        shards.setdefault((r["domain"], r["shard"]), []).append((r["row_id"], len((r["source_code"] or "").encode())))
    return shards


def test_no_shard_is_larger_than_asked_for(spark, tmp_path):
    lengths = [100] * 50 + [999, 1000, 1001, 5000, 0, 500, 501, 1] * 10
    rows = [(37 * i % 20_011, "é" * (n // 2) + "x" * (n % 2) if n else None, [None, "a", "b"][i % 3]) for i, n in enumerate(lengths)]
    df = spark.createDataFrame(rows, "row_id long, source_code string, domain string").repartition(3)
    write_corpus(df, str(tmp_path / "c"), max_bytes=1000, partition_by=["domain"])
    shards = sizes_of(spark, tmp_path / "c")
    assert all(len(rows) == 1 or sum(n for _, n in rows) <= 1000 for rows in shards.values())
    small = {k: v for k, v in shards.items() if k[1] >= 0}
    for domain in (None, "a", "b"):
        # ids ascend from shard to shard, and no two neighbours would fit together twice over
        own = [sorted(small[k]) for k in sorted(k for k in small if k[0] == domain)]
        assert all(x[-1][0] < y[0][0] for x, y in zip(own, own[1:]))
    back = read_corpus(spark, str(tmp_path / "c"))
    assert sorted(back.columns) == sorted(df.columns) and back.exceptAll(df.select(back.columns)).isEmpty() and back.count() == len(rows)
    assert len(list((tmp_path / "c").rglob("*.parquet"))) == len(shards)


def test_shards_of_large_rows_only_and_of_none(spark, tmp_path):
    df = spark.createDataFrame([(i, "x" * 800, "a") for i in range(5)], "row_id long, source_code string, domain string")
    write_corpus(df, str(tmp_path / "c"), max_bytes=1000)
    assert len(sizes_of(spark, tmp_path / "c")) == 5
    write_corpus(df.limit(0), str(tmp_path / "d"), max_bytes=1000)


def test_numbering_moves_no_text(spark, tmp_path):
    (tmp_path / "a.json").write_text("".join(f'{{"source_code": "{i}"}}\n' for i in range(9)))
    plan = read_raw_corpus(spark, str(tmp_path), "source_code string")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_shards_are_moved_into_place_by_their_tasks(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrameWriter

    set_, option = {}, DataFrameWriter.option
    monkeypatch.setattr(DataFrameWriter, "option", lambda self, k, v: (set_.__setitem__(k, v), option(self, k, v))[1])
    df = spark.range(40).selectExpr("id AS row_id", "repeat('x', 100) AS source_code")
    write_corpus(df, str(tmp_path / "out"), max_bytes=1000)
    assert set_["mapreduce.fileoutputcommitter.algorithm.version"] == "2"
    assert read_corpus(spark, str(tmp_path / "out")).count() == 40
    assert (tmp_path / "out" / "_SUCCESS").exists() and not (tmp_path / "out" / "_temporary").exists()
