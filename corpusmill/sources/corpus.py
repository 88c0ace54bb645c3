"""Corpus tables in JSON and Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusmill.operators.position import Order, by_id, running_sum
from corpusmill.session import cut_lineage
from corpusmill.sources.shards import read_folders, write_folders, writes_folders


def read_json_corpus(spark: SparkSession, folder: str, schema: StructType | str, mode: str = "FAILFAST") -> DataFrame:
    """All ``*.json`` files of a folder, one object per line; large files are split between tasks.

    A line that cannot be read is an error. With ``mode="PERMISSIVE"`` and a string column
    ``_corrupt_record`` in the schema it is kept there instead.
    """
    return spark.read.schema(schema).option("pathGlobFilter", "*.json").option("mode", mode).json(folder)


def file_order(file: str = "_file") -> list[Column]:
    """Files by name, numbers of part files as numbers."""
    part = F.regexp_extract(file, r"part-(\d+)[^/]*$", 1)
    return [F.regexp_replace(file, r"part-\d+[^/]*$", ""), part.try_cast("long"), F.col(file)]


BROADCAST_BLOCKS = 1 << 18
"""Up to so many file blocks, their offsets are sent to all tasks: some 50 MB."""


def with_row_ids(df: DataFrame, id_col: str = "row_id") -> DataFrame:
    """Number the rows of a table just read from files: by file, block of the file and place in the block.

    A block is read by one task, which numbers its rows as they come; the first number of each block and its rows, one
    small row, are gathered beforehand and give the shift. The rows themselves are not moved, unless there are more
    blocks than fit a broadcast. Read the same files again and the numbers are the same. An id column that is there
    already is replaced.
    """
    columns = [c for c in df.columns if c != id_col]
    block = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")]
    placed = df.select(*columns, *block, F.monotonically_increasing_id().alias("_seq"))
    blocks = placed.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_seq").alias("_first"))
    # one row per file block
    before = Window.orderBy(*file_order(), "_block").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")
    offsets = cut_lineage(blocks.select("_file", "_block", shift.alias("_shift")))
    if offsets.count() <= BROADCAST_BLOCKS:
        offsets = F.broadcast(offsets)
    return placed.join(offsets, ["_file", "_block"]).select((F.col("_seq") + F.col("_shift")).alias(id_col), *columns)


def read_raw_corpus(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """A JSON corpus without ids, numbered as it stands in its files."""
    return with_row_ids(read_json_corpus(spark, folder, schema))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet corpus; column pruning and filters reach the files. The folders of shards are no column."""
    return spark.read.parquet(path).drop(SHARD)


def write_corpus(
    df: DataFrame,
    path: str,
    max_records: int = 1_000_000,
    partition_by: list[str] | None = None,
    max_bytes: int | None = None,
    text: str = "source_code",
    id_col: str = "row_id",
) -> None:
    """Write Parquet shards of at most ``max_records`` rows.

    With ``max_bytes`` no shard holds more bytes of ``text``, unless it is a single row: see ``with_shards``. Each shard
    is a folder then, below those of ``partition_by``; tasks write them without Spark's writer where they can.
    """
    folders = list(partition_by or [])
    if max_bytes is not None:
        df = with_shards(df, max_bytes, text, id_col, folders)
        folders.append(SHARD)

    def to_folders(rows: DataFrame) -> None:
        writer = rows.write.mode("overwrite").option("maxRecordsPerFile", max_records)
        if folders:
            # there may be very many: the tasks move theirs into place, the driver does not move all one by one
            writer = writer.partitionBy(*folders).option("mapreduce.fileoutputcommitter.algorithm.version", "2")
        writer.parquet(path)

    if max_bytes is None:
        to_folders(df)
    elif writes_folders(df, folders, path):
        to_folders(df.limit(0))
        write_folders(df, folders, path, max_records)
    else:
        to_folders(df.repartition(*folders))


def read_shards(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The columns of ``schema`` and ``shard`` of a corpus written with ``max_bytes`` and without ``partition_by``."""
    return read_folders(spark, path, SHARD, schema)


SHARD = "shard"


def with_shards(df: DataFrame, max_bytes: int, text: str = "source_code", id_col: str = "row_id", groups: list[str] | None = None) -> DataFrame:
    """Add ``shard``: rows in the order of their unique ids, at most ``max_bytes`` of ``text`` together, by group.

    The bytes before a row are a prefix sum: inside buckets of neighbouring ids, shifted by the sums of the buckets
    before. A shard begins where that sum passes a multiple of a step, which is ``max_bytes`` less what the last row may
    reach beyond. Rows of more than half a shard would make the step small; each is a shard of its own, numbered
    ``-1 - id``. Ids and sizes are read once and only they are sorted; the rows look up the few shards that begin in
    their bucket, and are not moved for it unless there are more shards than fit a broadcast. A null text has no bytes.
    """
    groups = list(groups or [])
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    sizes = df.select(*(F.struct(g).alias(g) for g in groups), F.col(id_col).alias("_id"), size.alias("_size")).filter(F.col("_size") * 2 <= max_bytes)
    sizes = cut_lineage(sizes)
    most = sizes.agg(F.max("_size")).first()[0] or 0
    starts = cut_lineage(bucket_starts(sizes, by_id("_id"), groups, "_size", max_bytes - most + 1))
    if (starts.agg(F.sum(F.size("_starts") + 8)).first()[0] or 0) <= BROADCAST_STARTS:
        starts = F.broadcast(starts)
    bucket = F.shiftright(F.col(id_col).cast("long"), NEAR_BITS).alias("_bucket")
    keyed = df.select("*", *(F.struct(g).alias(f"_in_{g}") for g in groups), bucket)
    found = keyed.join(starts.withColumnsRenamed({g: f"_in_{g}" for g in groups}), [*(f"_in_{g}" for g in groups), "_bucket"], "left")
    mine = F.col("_first") + F.size(F.filter("_starts", lambda s: s <= F.col(id_col))) - 1
    return found.select(*df.columns, F.when(size * 2 > max_bytes, -1 - F.col(id_col)).otherwise(mine).alias(SHARD))


NEAR_BITS = 6
"""A row is compared with the shards that begin among so few neighbours, ``2**6``."""
BROADCAST_STARTS = 1 << 22
"""Up to so many numbers, the ids at which shards begin are sent to all tasks: some 50 MB."""


def bucket_starts(sizes: DataFrame, order: Order, groups: list[str], size: str, step: int) -> DataFrame:
    """``_bucket, _first, _starts`` by group: of each bucket of near ids the first shard, and the ids at which its shards begin.

    No row is as large as a step, so the shards of a bucket follow one another without a gap.
    """
    summed = running_sum(sizes, order, size, groups, "_before")
    shard = F.floor(F.col("_before") / step).cast("long")
    firsts = summed.groupBy(*groups, F.shiftright(F.col("_id").cast("long"), NEAR_BITS).alias("_bucket"), shard.alias("shard")).agg(F.min("_id").alias("id"))
    return firsts.groupBy(*groups, "_bucket").agg(F.min("shard").alias("_first"), F.collect_list("id").alias("_starts"))
