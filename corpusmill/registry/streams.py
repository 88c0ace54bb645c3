"""Structured Streaming over the experiences and over the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.registry.base import documents, register
from corpusmill.registry.continual import HASHED, NAIVE, TASKED, tasked
from corpusmill.registry.corpus import MARKED
from corpusmill.session import scratch_path
from corpusmill.streaming.experiences import dedup_stream, feed, reservoir_stream, run_experience_stream


def experiences(spark, folder):
    return tasked(spark, folder).select("row_id", "domain", F.col("task_id").cast("long").alias("exp_id"))


@register("run_experience_stream", f"SELECT exp_id AS batch_id, exp_id, count(*) AS n_rows, CAST(sum(row_id) AS BIGINT) AS id_sum FROM ({NAIVE}) GROUP BY exp_id")
def _(spark, folder):
    path = scratch_path(spark, "experiences")

    def on_batch(rows, batch_id):
        report = rows.groupBy("exp_id").agg(F.count("*").alias("n_rows"), F.sum("row_id").alias("id_sum"))
        report.write.mode("overwrite").parquet(f"{path}/out/batch_id={batch_id}")

    run_experience_stream(experiences(spark, folder), 5, path, on_batch)
    return spark.read.parquet(f"{path}/out").withColumn("batch_id", F.col("batch_id").cast("long"))


@register("reservoir_stream", f"SELECT row_id, domain, CAST(task_id AS BIGINT) AS exp_id FROM ({TASKED}) ORDER BY {HASHED} LIMIT 200")
def _(spark, folder):
    return reservoir_stream(experiences(spark, folder), 5, scratch_path(spark, "reservoir"))


@register("dedup_stream", f"SELECT DISTINCT hash FROM ({MARKED})")
def _(spark, folder):
    path, docs = scratch_path(spark, "dedup"), documents(spark, folder)
    for part in (0, 1):
        feed(docs.filter(F.col("row_id") % 2 == part), f"{path}/in")
        dedup_stream(spark, f"{path}/in", docs.schema, f"{path}/out", f"{path}/offsets")
    return spark.read.parquet(f"{path}/out").select("hash")
