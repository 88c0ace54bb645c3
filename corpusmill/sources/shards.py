"""Very many small folders of Parquet on a file system that Python reaches.

Hadoop's local file system starts a ``chmod`` process for every file and folder that it makes, and Spark's reader holds every
file on the driver. Here tasks write the folders by pyarrow, and list and read those they are given by name.
"""

from __future__ import annotations

import errno
import itertools
import os
import re
import shutil
import sys
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusmill.session import shuffles_released

NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
TEMPORARY = "_temporary"
PLAIN = (T.StringType, T.BinaryType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DateType)
"""Columns of these types are the same in files of pyarrow and of Spark."""
CODECS = {"none": "none", "uncompressed": "none", "snappy": "snappy", "gzip": "gzip", "zstd": "zstd"}
GROUP_BYTES = 32 << 20
"""Of a large folder so much is held and written at a time."""
EMIT_BYTES = 6 << 20
FOLDERS_PER_TASK = 1024


def local_folder(spark: SparkSession, path: str) -> str | None:
    """The path as Python's own functions know it, if it is on a file system that they reach."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = found.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return store.makeQualified(found).toUri().getPath() if store.getUri().getScheme() == "file" else None


def writes_folders(df: DataFrame, folders: list[str], path: str) -> bool:
    """Can :func:`write_folders` write this table there as Spark would?"""
    kinds = [f.dataType for f in df.schema.fields if f.name not in folders]
    codec = df.sparkSession.conf.get("spark.sql.parquet.compression.codec").lower()
    return set(folders) < set(df.columns) and codec in CODECS and all(type(k) in PLAIN for k in kinds) and local_folder(df.sparkSession, path) is not None


def write_folders(df: DataFrame, folders: list[str], path: str, max_records: int) -> None:
    """Add to ``path`` a folder for each combination of values of ``folders``, named as by ``partitionBy``, in files of at most ``max_records`` rows.

    The rows of a folder go to one task. It writes its folders aside and moves them into place when it is done; of a
    folder that two attempts of a task have made, the first to come stays. ``_SUCCESS`` waits until all are there.
    """
    spark = df.sparkSession
    root = local_folder(spark, path)
    aside = f"{root}/{TEMPORARY}/{uuid.uuid4().hex}"
    schema = T.StructType([f for f in df.schema.fields if f.name not in folders])
    keys = [f"_folder{i}" for i in range(len(folders))]
    values = [F.nullif(F.col(c).cast("string"), F.lit("")).alias(k) for c, k in zip(folders, keys)]
    rows = df.select(*schema.names, *values).repartition(*keys).sortWithinPartitions(*keys)
    codec = CODECS[spark.conf.get("spark.sql.parquet.compression.codec").lower()]
    options = {"compression": codec, "store_schema": False, "write_page_checksum": True}
    write = _writer(root, aside, folders, schema.json(), max_records if max_records > 0 else sys.maxsize, options)
    marker = f"{root}/_SUCCESS"
    try:
        os.makedirs(aside)
        if marked := os.path.exists(marker):
            os.rename(marker, f"{aside}/_SUCCESS")
        with shuffles_released(spark):
            rows.mapInArrow(write, "folders long").agg(F.sum("folders")).collect()
        if marked:
            os.rename(f"{aside}/_SUCCESS", marker)
    finally:
        shutil.rmtree(f"{root}/{TEMPORARY}", ignore_errors=True)


def folder_name(column: str, value: str | None) -> str:
    """``column=value``, escaped as Spark does."""
    return f"{_escaped(column)}={NO_VALUE if value is None else _escaped(value)}"


def _escaped(name: str) -> str:
    return re.sub(r"""[\x01-\x1f\x7f"#%'*/:=?\\{[\]^]""", lambda m: f"%{ord(m[0]):02X}", name)


def _writer(root: str, aside: str, folders: list[str], schema: str, max_records: int, options: dict) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, made = f"{aside}/{uuid.uuid4().hex}", []
        for key, parts in itertools.groupby(_runs(batches, len(folders)), key=lambda part: part[0]):
            made.append("/".join(folder_name(c, v) for c, v in zip(folders, key)))
            os.makedirs(f"{own}/{made[-1]}")
            _write_parts(f"{own}/{made[-1]}", (part for _, part in parts), schema, max_records, options)
        for folder in made:
            _move(f"{own}/{folder}", f"{root}/{folder}")
        yield pa.RecordBatch.from_pydict({"folders": [len(made)]})

    return write


def _runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """The values of the last ``n_keys`` columns, and the other columns of the neighbouring rows that have them."""
    for batch in batches:
        n, at = batch.num_columns - n_keys, 0
        rest = pa.Table.from_batches([batch.select(range(n))])
        for key, run in itertools.groupby(zip(*(batch.column(n + i).to_pylist() for i in range(n_keys)))):
            size = sum(1 for _ in run)
            yield key, rest.slice(at, size)
            at += size


def _write_parts(folder: str, parts: Iterator[pa.Table], schema: str, max_records: int, options: dict) -> None:
    writer, room, number = None, 0, 0
    for table in _gathered(parts, GROUP_BYTES):
        at = 0
        while at < len(table):
            if writer is None:
                # Spark takes the types, and whether they may be null, from this entry
                kept = table.schema.with_metadata({"org.apache.spark.sql.parquet.row.metadata": schema})
                writer, room, number = pq.ParquetWriter(f"{folder}/part-{number:05d}.parquet", kept, **options), max_records, number + 1
            n = min(room, len(table) - at)
            writer.write_table(table.slice(at, n).replace_schema_metadata(kept.metadata))
            at, room = at + n, room - n
            if not room:
                writer.close()
                writer = None
    if writer is not None:
        writer.close()


def _gathered(parts: Iterator[pa.Table], most: int) -> Iterator[pa.Table]:
    """The parts, joined until they have ``most`` bytes."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += part.nbytes
        if size >= most:
            yield pa.concat_tables(held)
            held, size = [], 0
    if held:
        yield pa.concat_tables(held)


def _move(source: str, target: str) -> None:
    os.makedirs(os.path.dirname(target), exist_ok=True)
    try:
        os.rename(source, target)
    except OSError as e:
        if e.errno not in (errno.EEXIST, errno.ENOTEMPTY):
            raise


def read_folders(spark: SparkSession, path: str, column: str, schema: str) -> DataFrame:
    """The columns of ``schema`` from the files in all folders ``column=value`` below ``path``, and the value, a number.

    Only the names of the folders are on the driver. Tasks list and read them, so many at a time.
    """
    kind = T.StructType.fromDDL(schema)
    root, before = local_folder(spark, path), f"{column}="
    if root is None:
        return spark.read.parquet(path).select(*kind.names, F.col(column).cast("long").alias(column))
    names = sorted(entry for entry in os.listdir(root) if entry.startswith(before))
    out = T.StructType([*kind.fields, T.StructField(column, T.LongType())])
    want = to_arrow_schema(kind)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (table for batch in batches for name in batch.column(0).to_pylist() for table in _tables(f"{root}/{name}", name.removeprefix(before), column, want))
        for table in _gathered(found, EMIT_BYTES):
            yield from table.combine_chunks().to_batches()

    listed = spark.createDataFrame(pa.table({"name": pa.array(names, pa.string())}))
    return listed.repartition(max(1, len(names) // FOLDERS_PER_TASK)).mapInArrow(read, out)


def _tables(folder: str, value: str, column: str, schema: pa.Schema) -> Iterator[pa.Table]:
    value = None if value == NO_VALUE else int(value)
    for name in sorted(os.listdir(folder)):
        if not name.startswith(("_", ".")):
            with pq.ParquetFile(f"{folder}/{name}", page_checksum_verification=True) as file:
                for group in range(file.num_row_groups):
                    table = file.read_row_group(group, columns=schema.names, use_threads=False).select(schema.names).cast(schema)
                    yield table.append_column(pa.field(column, pa.int64()), pa.repeat(pa.scalar(value, pa.int64()), len(table)))
