"""Merkle manifest of a dataset: postorder append logs, written by aligned builders, and proofs read from them.

Leaves of one tree stand in order; runs of ``RUN`` neighbours are hashed level by level until one node is left. A
builder owns an aligned stretch of ``BUILDER`` leaves and appends every node of its subtree to its log the moment it is
complete. Roots of the stretches are the leaves of the next tier. Where a node stands in a log follows in closed form
from the sizes of the subtrees before it, so a proof is read by address, without an index. Logs of full stretches never
change when leaves are added at the end.

Places come from one range sort, which cuts a hot tree into many partitions. No task sees more than a partition of that
sort or one stretch, however many leaves a tree has, and only digests move, never texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from corpusmill.session import scratch_path

RUN = 16
"""Children of a full node."""
LEVELS = 3
BUILDER = RUN**LEVELS
"""Leaves of a builder's stretch."""
STEPS = ArrayType(StructType().add("at", "integer").add("others", "string"))
"""A proof: per level the place of the node in its run and the digests of the others in it, from left to right."""
_AT_ONCE = 256
_DIGEST = 32


def leaf_digest(*columns: Column) -> Column:
    """SHA-256 of the fields one after the other: ``-`` for null, else the UTF-8 byte count, ``:`` and the value."""

    def field(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(field, columns)), 256)


def levels_over(leaves: int) -> int:
    """Levels above so many leaves, at most ``LEVELS``."""
    return next((k for k in range(LEVELS) if RUN**k >= leaves), LEVELS)


def position(level: int, index: int, leaves: int, levels: int) -> int:
    """Where node ``index`` of ``level`` stands in the postorder log of a subtree.

    Before it, and it included: all nodes up to its level that are complete when its last leaf is in, and of the levels
    above it those that were complete before its first leaf.
    """
    end, begin = min(leaves, (index + 1) * RUN**level), index * RUN**level
    return sum(-(-end // RUN**k) for k in range(level + 1)) + sum(begin // RUN**k for k in range(level + 1, levels + 1)) - 1


def _parent(digests: list[bytes]) -> bytes:
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def postorder_log(leaves: list[bytes], levels: int) -> bytes:
    """All nodes of the subtree over ``leaves`` in the order in which they are complete; its root is the last."""
    log: list[bytes] = []
    open_runs: list[list[bytes]] = [[] for _ in range(levels)]

    def write(node: bytes, level: int, end: bool) -> None:
        log.append(node)
        if level < levels:
            open_runs[level].append(node)
            if not end and len(open_runs[level]) == RUN:
                close(level, end)

    def close(level: int, end: bool) -> None:
        run, open_runs[level] = open_runs[level], []
        write(_parent(run), level + 1, end)

    for leaf in leaves:
        write(leaf, 0, False)
    for level in range(levels):
        if open_runs[level]:
            close(level, True)
    return b"".join(log)


def proof_steps(log: bytes, leaves: int, levels: int, first: int, last: int) -> tuple[np.ndarray, list[str]]:
    """Place in the run and siblings of each level for the leaves from ``first`` up to ``last``, leaf by leaf."""
    at = np.empty((last - first, levels), np.int32)
    others: list[list[str]] = [[""] * levels for _ in range(last - first)]
    for level in range(levels):
        width, span = -(-leaves // RUN**level), RUN**level
        for run in range(first // span // RUN, (last - 1) // span // RUN + 1):
            nodes = range(run * RUN, min(width, run * RUN + RUN))
            places = [position(level, i, leaves, levels) * _DIGEST for i in nodes]
            digests = [log[p : p + _DIGEST].hex() for p in places]
            for k, i in enumerate(nodes):
                siblings = "".join(digests[:k] + digests[k + 1 :])
                for leaf in range(max(first, i * span), min(last, (i + 1) * span)):
                    at[leaf - first, level] = k
                    others[leaf - first][level] = siblings
    return at.ravel(), [s for steps in others for s in steps]


def ranked(rows: DataFrame, group: str, *order: Column) -> DataFrame:
    """``rows`` with ``pos`` in their group and its ``total``; one range sort, written to the scratch folder.

    Sorted partitions are numbered as they are; what each holds of a group is counted, and those counts are summed over
    partitions. Rows that are equal in the whole order take their places in any order.
    """
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, "ranked")
    rows.orderBy(group, *order).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    placed = spark.read.parquet(path).withColumn("_part", F.shiftrightunsigned("_at", 33))
    parts = placed.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(group)
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        group,
        "_part",
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(whole).alias("total"),
    )
    return placed.join(offsets, [group, "_part"]).select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("pos"), "total")


@dataclass(frozen=True)
class Manifest:
    """Logs of all trees, tier by tier: ``tree, block, total, leaves, log``; ``leaves`` of the first hold the items."""

    tiers: list[DataFrame]

    def roots(self) -> DataFrame:
        """``tree, root`` of each tree."""
        tops = [t.filter(F.col("total") <= BUILDER).select("tree", _top().alias("root")) for t in self.tiers]
        out = tops[0]
        for more in tops[1:]:
            out = out.union(more)
        return out

    def proofs(self, above: DataFrame) -> DataFrame:
        """Per leaf ``tree, pos, digest``, its item's columns, the columns of ``above`` and ``steps``.

        ``above`` has one row per tree with ``steps`` from its root on; those below are put before them.
        """
        carried = [c for c in above.columns if c not in ("tree", "steps")]
        upper = None
        for tier in reversed(self.tiers):
            rows = tier.filter(F.col("total") <= BUILDER).join(above, "tree")
            if upper is not None:
                below = upper.select("tree", F.col("pos").alias("block"), *carried, "steps")
                rows = rows.unionByName(tier.filter(F.col("total") > BUILDER).join(below, ["tree", "block"]))
            upper = _expanded(rows, carried)
        return upper


def _top() -> Column:
    """The last digest of a log."""
    log = F.col("log")
    return F.lower(F.hex(F.substring(log, F.octet_length(log) - (_DIGEST - 1), F.lit(_DIGEST))))


def build_manifest(leaves: DataFrame) -> Manifest:
    """The logs of ``leaves(tree, pos, total, digest, ...)``, where ``pos`` counts from 0 to ``total`` - 1 in each tree.

    Further columns go with their leaf. Each tier is written to the scratch folder; a tree of up to 4096 leaves has one,
    of up to 16 million two. A single leaf is its own root; no leaves give no rows.
    """
    spark, tiers, nodes = leaves.sparkSession, [], leaves
    while True:
        path = scratch_path(spark, "merkle")
        _logged(nodes).write.parquet(path)
        tiers.append(spark.read.parquet(path))
        more = tiers[-1].filter(F.col("total") > BUILDER)
        if more.isEmpty():
            return Manifest(tiers)
        total = F.ceil(F.col("total") / BUILDER).cast("long")
        nodes = more.select("tree", F.col("block").alias("pos"), total.alias("total"), _top().alias("digest"))


def _logged(nodes: DataFrame) -> DataFrame:
    items = [c for c in nodes.columns if c not in ("tree", "pos", "total", "digest")]
    leaves = F.array_sort(F.collect_list(F.struct("pos", "digest", *items)))
    block = F.floor(F.col("pos") / BUILDER).cast("long").alias("block")
    blocks = nodes.groupBy("tree", block).agg(F.first("total").alias("total"), leaves.alias("leaves"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                digests = [bytes.fromhex(d) for d in row.column("leaves").flatten().field("digest").to_pylist()]
                log = postorder_log(digests, levels_over(row.column("total")[0].as_py()))
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([log], pa.binary())], [*row.schema.names, "log"])

    return blocks.mapInArrow(build, StructType([*blocks.schema.fields]).add("log", "binary"))


def _expanded(rows: DataFrame, carried: list[str]) -> DataFrame:
    """One row per leaf of each log, with its steps up to the root of its tree and beyond."""
    leaf = rows.schema["leaves"].dataType.elementType
    schema = StructType([rows.schema["tree"], *leaf.fields, *(rows.schema[c] for c in carried)]).add("steps", STEPS)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from _leaf_rows(batch.slice(i, 1), leaf.names, carried, schema.names)

    return rows.mapInArrow(expand, schema)


def _leaf_rows(row: pa.RecordBatch, names: list[str], carried: list[str], columns: list[str]) -> Iterator[pa.RecordBatch]:
    log, leaves = row.column("log")[0].as_py(), row.column("leaves").flatten()
    levels = levels_over(row.column("total")[0].as_py())
    upper = row.column("steps").flatten()
    upper_at, upper_others = upper.field("at").to_pylist(), upper.field("others").to_pylist()
    for first in range(0, len(leaves), _AT_ONCE):
        last = min(first + _AT_ONCE, len(leaves))
        n, width = last - first, levels + len(upper)
        at, others = proof_steps(log, len(leaves), levels, first, last)
        all_at = np.concatenate([at.reshape(n, levels), np.tile(np.array(upper_at, np.int32), (n, 1)).reshape(n, len(upper))], axis=1)
        texts = [s for k in range(n) for s in (*others[k * levels : (k + 1) * levels], *upper_others)]
        steps = pa.StructArray.from_arrays([pa.array(all_at.ravel(), pa.int32()), pa.array(texts, pa.string())], ["at", "others"])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), steps)
        part = leaves.slice(first, n)
        same = [pa.concat_arrays([row.column(c)] * n) for c in ("tree", *carried)]
        yield pa.RecordBatch.from_arrays([same[0], *(part.field(c) for c in names), *same[1:], lists], columns)


def proof_digest(steps: Column) -> Column:
    """SHA-256 of all siblings of a proof, level by level, from left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: s["others"]), ""), 256)


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its proof give."""

    def up(node: Column, step: Column) -> Column:
        cut = step["at"] * 64
        others = step["others"]
        return F.sha2(F.concat(F.substring(others, F.lit(1), cut), node, F.substring(others, cut + 1, F.octet_length(others))), 256)

    return F.aggregate(steps, leaf, up)


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
"""What a leaf is made of."""


def dataset_proofs(docs: DataFrame, **items: Column) -> DataFrame:
    """``doc_id, leaf, subroot, root, steps`` and ``items`` per row of ``docs(doc_id, source, lang, n_chars, text)``.

    A leaf is the digest of these fields in this order. Each source is a tree, its leaves ascending by ``doc_id`` (null
    first; rows of one id by their digests, equal rows in any order); the roots of the sources, ascending by name in
    UTF-8 bytes (null first), are the leaves of the dataset's tree. ``items`` are computed from ``docs`` and carried
    along. A null field has its own mark in the leaf, unlike an empty one; a text may have any length; further columns
    are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    # the sign before each name keeps null apart and first
    tree = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source")))
    path = scratch_path(spark, "leaves")
    docs.select(tree.alias("tree"), "doc_id", leaf_digest(*map(F.col, FIELDS)).alias("digest"), *(c.alias(f"item_{n}") for n, c in items.items())).write.parquet(path)
    trees = build_manifest(ranked(spark.read.parquet(path), "tree", F.col("doc_id").asc_nulls_first(), F.col("digest")))
    roots = trees.roots().select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest"))
    dataset = build_manifest(ranked(roots, "tree", F.col("name")))
    top = dataset.roots().withColumn("steps", F.array().cast(STEPS))
    above = dataset.proofs(top).select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), "root", "steps")
    proofs = trees.proofs(above)
    return proofs.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", "steps", *(F.col(f"item_{n}").alias(n) for n in items))
