"""Experiences as a stream of files: each one is consumed once, in order, with state kept between."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusmill.functions.text import content_hash
from corpusmill.operators.continual import reservoir


def feed(rows: DataFrame, folder: str) -> None:
    """Add the files of one experience to the stream's folder."""
    rows.write.mode("append").parquet(folder)


def consume(
    spark: SparkSession,
    folder: str,
    schema: StructType | str,
    checkpoint: str,
    on_batch: Callable[[DataFrame, int], None],
    max_files: int | None = None,
) -> None:
    """Run ``on_batch(rows, batch_id)`` on all files that came since the last call, then return.

    The checkpoint remembers what was consumed. After a failure a batch comes again with the
    same id, so ``on_batch`` must write by that id. A batch is one experience, or with
    ``max_files`` a part of one; a mixed batch is an error.
    """
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)

    def checked(rows: DataFrame, batch_id: int) -> None:
        seen = rows.agg(F.min("exp_id").alias("lo"), F.max("exp_id").alias("hi")).first()
        if seen["lo"] is None:
            return
        if seen["lo"] != seen["hi"]:
            raise ValueError(f"batch {batch_id} mixes experiences {seen['lo']} to {seen['hi']}")
        on_batch(rows, batch_id)

    query = (
        reader.parquet(folder)
        .writeStream.foreachBatch(checked)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_experience_stream(
    rows: DataFrame, n_exp: int, folder: str, on_batch: Callable[[DataFrame, int], None]
) -> None:
    """Feed the experiences of a table with ``exp_id`` one after the other and consume each."""
    spark = rows.sparkSession
    for exp_id in range(n_exp):
        feed(rows.filter(F.col("exp_id") == exp_id), f"{folder}/in")
        consume(spark, f"{folder}/in", rows.schema, f"{folder}/offsets", on_batch)


def reservoir_update(state: str, k: int = 200, seed: int = 42, id_col: str = "row_id") -> Callable[[DataFrame, int], None]:
    """Batch handler that keeps a reservoir; version ``n`` is the state after batch ``n``."""

    held: list[int] = []

    def update(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        earlier = [n for n in held if n < batch_id]
        if earlier:  # a batch without rows has written no state
            rows = spark.read.schema(rows.schema).parquet(f"{state}/{earlier[-1]}").unionByName(rows)
        elif batch_id > 0 and not held:  # a new process: the newest state there is
            rows = _newest(spark, state, batch_id, rows.schema).unionByName(rows)
        reservoir(rows, k, seed, id_col).write.mode("overwrite").parquet(f"{state}/{batch_id}")
        held.append(batch_id)

    return update


def _newest(spark: SparkSession, state: str, before: int, schema: StructType) -> DataFrame:
    """The state of the last batch before ``before`` that wrote one, or no rows."""
    for batch_id in range(before - 1, -1, -1):
        try:
            return spark.read.schema(schema).parquet(f"{state}/{batch_id}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    return spark.createDataFrame([], schema)


def reservoir_stream(rows: DataFrame, n_exp: int, folder: str, k: int = 200, seed: int = 42) -> DataFrame:
    """The reservoir after all experiences; equals :func:`reservoir` over the whole table."""
    update = reservoir_update(f"{folder}/state", k, seed)
    last = []

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        update(batch, batch_id)
        last.append(batch_id)

    run_experience_stream(rows, n_exp, folder, on_batch)
    if not last:
        return rows.limit(0)
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/state/{last[-1]}")


def dedup_stream(spark: SparkSession, folder: str, schema: StructType | str, out: str, checkpoint: str, text: str = "source_code") -> None:
    """Append each text not seen before to ``out``; the hashes seen are the stream's state.

    The first batch with a text wins; which of its copies stays is open, so use the batch
    form where the row matters.
    """
    fresh = spark.readStream.schema(schema).parquet(folder).withColumn("hash", content_hash(text)).dropDuplicates(["hash"])
    query = (
        fresh.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()
