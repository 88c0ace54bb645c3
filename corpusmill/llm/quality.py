"""Quality of whole documents by a byte-level convolutional network that is fitted on a bounded sample of labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from corpusmill.llm import byte_cnn
from corpusmill.llm import hashing as H

SAMPLE_ROWS = 2000
"""Labelled documents that the network is fitted on, at most, whatever their lengths; all are scored whole."""
_PIECE = 1 << 20


def held_out() -> Column:
    """Whether a row is kept from the fit: crc32 of ``doc_id`` as text, modulo 4, is 2."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, **options) -> byte_cnn.Weights:
    """Weights from ``docs(doc_id, text)`` and ``labels(doc_id, quality)``: at most ``rows`` labelled documents.

    The sample is the one with the least hashes of ``doc_id``, without held-out rows and nulls; its texts are taken
    whole. It alone comes to the driver. Contradicting labels of one document both count.
    """
    chosen = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").filter(~held_out()).select("doc_id", F.col("quality").cast("double").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows)
    sample = docs.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")
    found = sample.orderBy(F.xxhash64("doc_id"), "text", "quality").limit(rows).collect()
    return byte_cnn.fit([r["text"].encode() for r in found], np.array([r["quality"] for r in found], float), **options)


def score_quality(docs: DataFrame, weights: byte_cnn.Weights, column: str = "score") -> DataFrame:
    """``docs`` with the probability of a good label of each whole ``text``; null counts as the empty text.

    All columns of ``docs`` stay; a column of the name of the score is replaced. Equal texts have equal scores.
    """
    rest = docs.drop(column)
    H.bounded_batches(docs.sparkSession)
    schema = StructType([*rest.schema.fields, StructField(column, DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = H.column_bytes(batch.column("text"))
            body, edge = memoryview(np.ascontiguousarray(data)), offsets.tolist()
            texts, scores, size = [], [], 0
            for a, b in zip(edge, edge[1:]):
                texts.append(body[a:b])
                size += b - a
                if size >= _PIECE:
                    scores.append(byte_cnn.probabilities(weights, texts))
                    texts, size = [], 0
            scores.append(byte_cnn.probabilities(weights, texts))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores))], [*batch.schema.names, column])

    return rest.mapInArrow(score, schema)
