"""Line-aligned text files: row ``n`` of every file belongs together."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.text import strip
from corpusmill.session import cut_lineage
from corpusmill.sources.corpus import with_row_ids


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(line_no, value)`` with 0-based numbers, for a file or a folder of ordered part files.

    Rows are numbered inside each file block and shifted by the lines of the blocks before,
    so a file is read by as many tasks as it has blocks.
    """
    return with_row_ids(spark.read.option("lineSep", "\n").text(path), "line_no")


def zip_lines(**columns: DataFrame) -> DataFrame:
    """Join numbered lines on their number; files of unequal length are an error."""
    named = [df.select("line_no", F.col("value").alias(name)) for name, df in columns.items()]
    joined = reduce(lambda a, b: a.join(b, "line_no", "full_outer"), named)
    uneven = F.raise_error(F.concat(F.lit("files differ in length at line "), F.col("line_no").cast("string")))
    return joined.select("line_no", *[F.coalesce(F.col(c), uneven.cast("string")).alias(c) for c in columns])


def read_line_pairs(spark: SparkSession, ref_paths: Sequence[str], hyp_path: str) -> DataFrame:
    """``(pair_id, refs, hyp)`` from any number of reference files and one file of hypotheses."""
    files = {f"ref{i}": read_lines(spark, p) for i, p in enumerate(ref_paths)}
    rows = zip_lines(**files, hyp=read_lines(spark, hyp_path))
    return rows.select(
        F.col("line_no").alias("pair_id"),
        F.array(*[strip(c) for c in files]).alias("refs"),
        strip("hyp").alias("hyp"),
    )


def write_line_pairs(df: DataFrame, folder: str, order: str = "sample_id") -> None:
    """Write ``predictions`` and ``gt`` below ``folder``, one line per sample in sample order.

    The sort ranges over the part files, so their names in order give the samples in order.
    Predictions may be costly or drawn at random, so they are computed once for both files.
    A value with a line break, or a null, would put the files out of step and is an error.
    """

    def one_line(name: str) -> Column:
        bad = F.concat(F.lit(f"{name} is null or holds a line break at {order} "), F.col(order).cast("string"))
        fine = F.col(name).isNotNull() & ~F.col(name).rlike("[\\r\\n]")
        return F.when(fine, F.col(name)).otherwise(F.raise_error(bad).cast("string")).alias(name)

    ordered = cut_lineage(df.select(order, one_line("prediction"), one_line("ground_truth"))).orderBy(order)
    ordered.select(F.col("prediction").alias("value")).write.mode("overwrite").option("lineSep", "\n").text(f"{folder}/predictions")
    ordered.select(F.col("ground_truth").alias("value")).write.mode("overwrite").option("lineSep", "\n").text(f"{folder}/gt")
