"""Groups of rows in tasks, and connected components as Spark joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.session import cut_lineage


def runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """The rows of each value of an integer column; equal values follow each other, also across batches."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        values = np.asarray(batch.column(column))
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        if held and held[-1].column(column)[-1].as_py() != values[0]:
            yield pa.concat_tables(held)
            held = []
        for a, b in zip(cuts, cuts[1:]):
            held.append(table.slice(a, b - a))
            if b < len(values):
                yield pa.concat_tables(held)
                held = []
    if held:
        yield pa.concat_tables(held)


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for ``edges(a, b)`` with a < b: the smallest node that links lead to, for all nodes but it.

    While larger ends have several smaller ones, small and large stars in turn: the smaller neighbours of a node are
    pointed at the least of them, then each larger end at the least neighbour of its smaller one. Once all have one, links
    are trees, whose nodes are pointed at the parents of their parents. Minima are aggregated before they are joined back,
    so a node with very many links is no single task's work. Each round is checkpointed; about the logarithm of the
    longest chain of them is needed. ``edges`` are read twice: pass written ones.
    """
    up = _least(edges)
    while not up.filter("most > a").isEmpty():
        several = up.filter("most > a").select("b", F.col("a").alias("least"))
        rest = edges.join(several, "b").filter("a > least").select(F.col("least").alias("a"), F.col("a").alias("b"))
        small = cut_lineage(up.select("a", "b").union(rest.distinct()))
        least = small.groupBy(F.col("b").alias("a")).agg(F.min("a").alias("least"))
        edges = cut_lineage(small.join(least, "a", "left").select(F.coalesce("least", "a").alias("a"), "b").distinct())
        up = _least(edges)
    while True:
        parents = up.select(F.col("b").alias("a"), F.col("a").alias("parent"))
        up = up.join(parents, "a", "left").select(F.coalesce("parent", "a").alias("a"), "b", F.col("parent").isNotNull().alias("moved"))
        up = cut_lineage(up)
        if up.filter("moved").isEmpty():
            return up.select(F.col("b").alias("node"), F.col("a").alias("component"))


def _least(edges: DataFrame) -> DataFrame:
    """Of each larger end the smallest and the largest of its smaller ones."""
    return cut_lineage(edges.groupBy("b").agg(F.min("a").alias("a"), F.max("a").alias("most")))
