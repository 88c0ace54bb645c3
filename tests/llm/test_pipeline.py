"""Registered queries against SQL or plain Python on a small data set, and the stages of the pipeline."""

import os

import brute
import corpus_pipeline
import duckdb
import pytest
from brute import ordered, pairs

from corpusmill.llm.queries import CHECKS, ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [*ORACLES, *CHECKS])
def test_query_as_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{FOLDER}/{t}'")
    cursor = con.execute(ORACLES.get(name) or CHECKS[name])
    columns = [c[0] for c in cursor.description]
    rows = QUERIES[name](spark, FOLDER).select(*columns).collect()
    assert ordered(map(tuple, rows)) == ordered(cursor.fetchall())


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, out = pairs(docs), stage(spark, docs, FOLDER)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        sizes.append(docs.count())
        if name != "tokens":
            assert docs.columns == columns
            after = pairs(docs)
        if name == "near_dedup":
            firsts = {d for d, _, c in brute.near(before, percent=corpus_pipeline.NEAR_PERCENT) if d == c}
            assert ordered(after) == ordered(p for p in before if p[0] in firsts)
        if name == "decontamination":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
            clean = {d for d, _, hit, _ in brute.contaminated(before, items, 10) if not hit}
            assert ordered(after) == ordered(p for p in before if p[0] in clean)
        if name == "secrets":
            assert len(after) == len(before) and not any(brute.secrets(t) for _, t in after)
            same = dict(after)
            assert all(same[d] == t for d, t in before if not brute.secrets(t) and "[secret]" not in same[d])
    assert docs.filter("same_text AND n_tokens = size(tokens)").count() == docs.count() > 0
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] == sizes[4] == sizes[5]


def test_run_gives_the_rows_of_the_last_stage(spark):
    assert corpus_pipeline.run(spark, FOLDER).columns == ["doc_id", "lang", "source", "n_tokens", "tokens", "same_text"]


def test_stages_take_odd_rows(spark, odd, none):
    docs = odd.selectExpr("doc_id", "text", "key AS lang", "found AS source", "cast(length(text) AS long) AS n_chars")
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs, FOLDER).count() <= docs.count()
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
    kept = corpus_pipeline.near_dedup_stage(spark, docs, FOLDER)
    assert kept.count() == kept.distinct().count()
