"""Declared schemas of the tables the jobs read and write."""

from pyspark.sql import types as T

METHODS = T.StructType(
    [
        T.StructField("row_id", T.LongType()),
        T.StructField("source_code", T.StringType()),
        T.StructField("api_seq", T.StringType()),
        T.StructField("repo_name", T.StringType()),
        T.StructField("method_path", T.StringType()),
        T.StructField("method_name", T.StringType()),
        T.StructField("docstring", T.StringType()),
    ]
)

LABELLED_METHODS = T.StructType(
    METHODS.fields + [T.StructField("domain", T.StringType()), T.StructField("api", T.StringType())]
)

OOD_LABELS = T.StructType(
    [
        T.StructField("domain", T.StringType()),
        T.StructField("api", T.StringType()),
        T.StructField("api_order", T.IntegerType()),
        T.StructField("row_id", T.LongType()),
    ]
)

MERGES = T.StructType(
    [
        T.StructField("rank", T.IntegerType()),
        T.StructField("left", T.StringType()),
        T.StructField("right", T.StringType()),
        T.StructField("cnt", T.LongType()),
    ]
)

VOCAB = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("token", T.StringType())])
