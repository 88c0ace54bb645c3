"""Subtrees of syntax trees given as a node table ``(pair_id, side, node, parent, type)``."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

TREE = ("pair_id", "side")
EMIT_ROWS = 10_000


class Tree:
    """One tree in memory: children in node order, depth from the root, text from the leaves up."""

    def __init__(self, nodes: list[int], parents: list[int | None], types: list[str]):
        self.place = {n: i for i, n in enumerate(nodes)}
        self.types, self.roots, self.kids = types, [], [[] for _ in nodes]
        for i, parent in enumerate(parents):
            if parent is None:
                self.roots.append(i)
            elif parent in self.place:
                self.kids[self.place[parent]].append(i)
            else:
                raise ValueError(f"node {nodes[i]} has a parent {parent} that is not in its tree")
        self.depth = [0] * len(nodes)
        self.order = list(self.roots)
        for i in self.roots:
            self.depth[i] = 1
        for i in self.order:
            for k in self.kids[i]:
                self.depth[k] = self.depth[i] + 1
            self.order += self.kids[i]
        if len(self.order) < len(nodes):
            raise ValueError("the node table holds a cycle")

    def texts(self, digest: bool) -> list[str]:
        """Bracketed pre-order text of each subtree, or a hash that is equal for equal ones."""
        out = [""] * len(self.order)
        for i in reversed(self.order):
            text = " ".join([f"({self.types[i]}", *(out[k] for k in self.kids[i])]) + ")"
            out[i] = hashlib.md5(text.encode()).hexdigest() if digest else text
        return out


def _each_tree(nodes: DataFrame, tree: Sequence[str], schema: StructType, rows_of) -> DataFrame:
    """One shuffle by tree; the nodes of a tree then follow each other and are folded as they come.

    A task holds one tree at a time. ``rows_of(tree, node ids)`` gives the rows behind the keys.
    """
    keys = list(tree)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current, out = ([], [], []), None, []

        def close() -> None:
            if held[0]:
                out.extend((*current, *row) for row in rows_of(Tree(*held), held[0]))

        def emit() -> pa.RecordBatch:
            arrays = [pa.array([r[i] for r in out], t) for i, t in enumerate(types)]
            return pa.RecordBatch.from_arrays(arrays, schema.names)

        types = None
        for batch in batches:
            types = types or [*(batch.schema.field(k).type for k in keys), *extra(batch)]
            columns = [batch.column(c).to_pylist() for c in (*keys, "node", "parent", "type")]
            for *key, node, parent, kind in zip(*columns):
                if key != current:
                    close()
                    held, current = ([], [], []), key
                    if len(out) >= EMIT_ROWS:
                        yield emit()
                        out = []
                for part, value in zip(held, (node, parent, kind)):
                    part.append(value)
        close()
        if out:
            yield emit()

    def extra(batch: pa.RecordBatch) -> list[pa.DataType]:
        kinds = {"node": batch.schema.field("node").type, "sexp": pa.string(), "depth": pa.int32(), "parent": batch.schema.field("parent").type, "type": pa.string()}
        return [kinds[n] for n in schema.names[len(keys) :]]

    ordered = nodes.select(*keys, "node", "parent", "type").repartition(*keys).sortWithinPartitions(*keys, "node")
    return ordered.mapInArrow(fold, schema)


def _fields(nodes: DataFrame, names: Sequence[str]) -> list[StructField]:
    return [StructField(n, nodes.schema[n].dataType) for n in names]


def node_depth(nodes: DataFrame, tree: Sequence[str] = TREE) -> DataFrame:
    """``(*tree, node, parent, type, depth)``, 1 for a root; a missing parent or a cycle is an error."""
    schema = StructType([*_fields(nodes, (*tree, "node", "parent", "type")), StructField("depth", IntegerType())])

    def rows(t: Tree, ids: list) -> Iterator[tuple]:
        up = {k: i for i, kids in enumerate(t.kids) for k in kids}
        for i, node in enumerate(ids):
            yield node, ids[up[i]] if i in up else None, t.types[i], t.depth[i]

    return _each_tree(nodes, tree, schema, rows)


def subtrees(nodes: DataFrame, tree: Sequence[str] = TREE, digest: bool = False) -> DataFrame:
    """``(*tree, node, sexp, depth)`` of each root and of each node that has children.

    ``sexp`` is the bracketed pre-order text, or with ``digest`` a fixed-size hash that is
    equal for equal subtrees, which keeps deep trees from growing quadratic text. One shuffle
    for trees of any depth; memory is bounded by one tree.
    """
    schema = StructType([*_fields(nodes, (*tree, "node")), StructField("sexp", StringType()), StructField("depth", IntegerType())])

    def rows(t: Tree, ids: list) -> Iterator[tuple]:
        texts = t.texts(digest)
        for i, node in enumerate(ids):
            if t.kids[i] or t.depth[i] == 1:
                yield node, texts[i], t.depth[i]

    return _each_tree(nodes, tree, schema, rows)


def subtree_matches(trees: DataFrame, keys: Sequence[str] = ("pair_id",)) -> DataFrame:
    """``(*keys, matched, total)``: each reference subtree counts if the candidate has it anywhere."""
    counts = trees.groupBy(*keys, "sexp").agg(
        F.count_if(F.col("side") == "ref").alias("in_ref"), F.count_if(F.col("side") == "hyp").alias("in_hyp")
    )
    return counts.groupBy(*keys).agg(
        F.sum(F.when(F.col("in_hyp") > 0, F.col("in_ref")).otherwise(0)).alias("matched"), F.sum("in_ref").alias("total")
    )


def syntax_match(nodes: DataFrame, keys: Sequence[str] = ("pair_id",), by: Sequence[str] = ()) -> DataFrame:
    """``(*by, score)``: matched share of all reference subtrees, 0 without any; ``by`` are columns among ``keys``."""
    trees = subtrees(nodes, (*keys, "side"), digest=True)
    score = F.try_divide(F.sum("matched").cast("double"), F.sum("total"))
    return subtree_matches(trees, keys).groupBy(*by).agg(F.coalesce(score, F.lit(0.0)).alias("score"))
