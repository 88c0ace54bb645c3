"""Nearest neighbours by inner product: a forest of random-projection trees, one queue for all trees, exact reranking.

The trees are fitted on a bounded sample and sent to all tasks; every vector is put into its leaf of each tree. A
search takes leaves from one priority queue over all trees, by the squared distance to the half-spaces it has left,
until it has visited ``share`` of all leaves and enough candidates are in them. Leaves and the searches that visit them meet by shuffle; there, original
vectors are compared in double precision.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.groups import runs

SAMPLE_ROWS = 20_000
"""Vectors that the trees are fitted on, at most."""
TREES, LEAVES, SHARE = 3, 64, 0.5
CELL_ROWS = 20_000
"""Vectors of a leaf that are compared in one task, about; larger leaves are dealt out in blocks."""


class Tree(NamedTuple):
    normals: np.ndarray
    cuts: np.ndarray
    below: np.ndarray
    """Of each inner node the nodes on its lower and upper side; a leaf is given as -1 - its number."""
    held: list[np.ndarray]
    """Of each leaf the ids of its rows of the sample."""


def fit_tree(sample: np.ndarray, ids: np.ndarray, leaves: int, draw: np.random.Generator) -> Tree:
    """Halve by the projection on the difference of two random rows, until a part holds its share of the leaves."""
    normals, cuts, below, held = [], [], [], []
    least = max(2, len(sample) // leaves)

    def grow(rows: np.ndarray) -> int:
        for _ in range(4 if len(rows) >= 2 * least else 0):
            a, b = draw.choice(len(rows), 2, replace=False)
            normal = sample[rows[a]] - sample[rows[b]]
            if not (size := np.linalg.norm(normal)) > 0:
                continue
            along = sample[rows] @ (normal / size)
            cut = np.median(along)
            if 0 < (low := along <= cut).sum() < len(rows):
                me = len(normals)
                normals.append(normal / size)
                # between two rows, so that rounding leaves none on the other side
                cuts.append((along[low].max() + along[~low].min()) / 2)
                below.append(None)
                below[me] = (grow(rows[low]), grow(rows[~low]))
                return me
        held.append(np.unique(ids[rows]))
        return -len(held)

    top = grow(np.arange(len(sample)))
    if top < 0:
        return Tree(np.zeros((0, sample.shape[1])), np.zeros(0), np.zeros((0, 2), np.int64), held)
    return Tree(np.array(normals), np.array(cuts), np.array(below), held)


def leaf_of(tree: Tree, vectors: np.ndarray) -> np.ndarray:
    """Number of the leaf of each vector."""
    node = np.zeros(len(vectors), np.int64) if len(tree.cuts) else np.full(len(vectors), -1)
    upper = vectors @ tree.normals.T > tree.cuts
    while (open_ := np.flatnonzero(node >= 0)).size:
        node[open_] = tree.below[node[open_], upper[open_, node[open_]].astype(int)]
    return -1 - node


def visited(forest: list[Tree], vector: np.ndarray, share: float, least: int) -> list[tuple[int, int]]:
    """``(tree, leaf)`` in the order in which one queue over all trees gives them.

    It goes on beyond ``share`` until the leaves hold ``least`` different ids of the sample, or none is left.
    """
    gaps = [tree.normals @ vector - tree.cuts for tree in forest]
    total = sum(len(tree.cuts) + 1 for tree in forest)
    queue = [(0.0, t, 0 if len(tree.cuts) else -1) for t, tree in enumerate(forest)]
    heapq.heapify(queue)
    out: list[tuple[int, int]] = []
    seen: set[int] = set()
    while queue and (len(out) < max(len(forest), share * total) or len(seen) < least):
        far, t, node = heapq.heappop(queue)
        if node < 0:
            out.append((t, -1 - node))
            if len(seen) < least:
                seen.update(forest[t].held[-1 - node][:least].tolist())
            continue
        gap = float(gaps[t][node])
        side = int(gap > 0)
        heapq.heappush(queue, (far, t, int(forest[t].below[node, side])))
        heapq.heappush(queue, (far + gap * gap, t, int(forest[t].below[node, 1 - side])))
    return out


def usable(vector: str) -> Column:
    """Not null, not all zero, and neither null nor non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def nearest(vectors: DataFrame, searches: Column, k: int = 20, share: float = SHARE, trees: int = TREES, leaves: int = LEAVES, seed: int = 11) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows of ``vectors(vec_id, embedding)`` where ``searches`` holds.

    All rows but the search's own id are candidates; the ``k`` nearest found in the leaves visited are ranked from 1 by
    inner product, ties by the smaller ``vec_id``. All candidates come out if there are no more than ``k``. Rows without id or ``usable`` vector, and vectors of another length than the commonest
    one, take no part. Of equal vectors the ``k + 1`` smallest ids are compared, which loses nothing. Repeated rows
    count once; an id with several vectors is ranked by its nearest. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.filter(F.col("vec_id").isNotNull() & usable("embedding"))
    lengths = rows.groupBy(F.size("embedding").alias("length")).count().orderBy(F.desc("count"), F.desc("length"))
    total = lengths.first() or {"length": 1, "count": 0}
    rows = rows.filter(F.size("embedding") == total["length"])
    asked = rows.filter(searches)
    rows = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    asked = asked.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    first = F.dense_rank().over(Window.partitionBy("vector").orderBy("vec_id"))
    distinct = rows.withColumn("n", first).filter(F.col("n") <= k + 1).groupBy("vector").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("vec_id", "vector").toArrow()
    ids, sample = np.asarray(sample.column("vec_id")), sample.column("vector")
    points = np.asarray(sample.combine_chunks().flatten()).reshape(-1, total["length"]) if len(sample) else np.zeros((0, total["length"]))
    draw = np.random.default_rng(seed)
    forest = spark.sparkContext.broadcast([fit_tree(points, ids, leaves, draw) for _ in range(trees)])
    blocks = max(1, -(-total["count"] // (leaves * CELL_ROWS)))
    schema = "cell long, id long, vector array<double>, ids array<long>"
    cells = distinct.mapInArrow(_placed(forest, blocks, leaves), schema)
    cells = cells.union(asked.mapInArrow(_searching(forest, blocks, share, k + 1, leaves), schema))
    dealt = cells.repartition("cell").sortWithinPartitions("cell", F.col("ids").isNull())
    found = dealt.mapInArrow(_compared(k), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _points(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("vector").flatten()).reshape(batch.num_rows, -1)


def _rows(cell: np.ndarray, take: np.ndarray, ids: pa.Array, batch: pa.RecordBatch, lists: pa.Array | None) -> pa.RecordBatch:
    at = pa.array(take)
    some = pa.nulls(len(take), pa.list_(pa.int64())) if lists is None else lists.cast(pa.list_(pa.int64())).take(at)
    columns = [pa.array(cell, pa.int64()), ids.cast(pa.int64()).take(at), batch.column("vector").cast(pa.list_(pa.float64())).take(at), some]
    return pa.RecordBatch.from_arrays(columns, ["cell", "id", "vector", "ids"])


def _placed(forest, blocks: int, leaves: int):
    """Each distinct vector once for each tree."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                points = _points(batch)
                ids = pa.array([x[0] for x in batch.column("ids").to_pylist()], pa.int64())
                block = np.asarray(ids) % blocks
                for t, tree in enumerate(forest.value):
                    cell = (t * 2 * leaves + leaf_of(tree, points)) * blocks + block
                    yield _rows(cell, np.arange(batch.num_rows), ids, batch, batch.column("ids"))

    return place


def _searching(forest, blocks: int, share: float, least: int, leaves: int):
    """Each search once for each leaf and block that it visits."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                batch = whole.slice(a, 256)
                cells = [[(t * 2 * leaves + leaf) * blocks + b for t, leaf in visited(forest.value, v, share, least) for b in range(blocks)] for v in _points(batch)]
                take = np.repeat(np.arange(batch.num_rows), [len(c) for c in cells])
                yield _rows(np.concatenate(cells), take, batch.column("vec_id"), batch, None)

    return search


def _compared(k: int):
    """The ``k`` nearest of each search in each cell; the vectors of a cell come before its searches."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "cell"):
            asks = table.column("ids").is_null()
            held, asked = table.filter(pa.compute.invert(asks)), table.filter(asks)
            if not held.num_rows or not asked.num_rows:
                continue
            points = np.asarray(held.column("vector").combine_chunks().flatten()).reshape(held.num_rows, -1)
            lists = [np.array(x) for x in held.column("ids").to_pylist()]
            for a in range(0, asked.num_rows, 512):
                part = asked.slice(a, 512)
                wanted = np.asarray(part.column("vector").combine_chunks().flatten()).reshape(part.num_rows, -1)
                rough = wanted @ points.T
                yield _best(part.column("id").to_pylist(), wanted, rough, points, lists, k)

    return compare


def _best(queries: list[int], wanted: np.ndarray, rough: np.ndarray, points: np.ndarray, lists: list[np.ndarray], k: int) -> pa.RecordBatch:
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    keep = min(k + 1, rough.shape[1])
    edge = np.partition(rough, -keep, axis=1)[:, -keep]
    for q, vector, row, least in zip(queries, wanted, rough, edge):
        near = np.flatnonzero(row >= least - 1e-9 * max(1.0, abs(least)))
        ids, score = _ranked(q, vector, near, points, lists, k)
        if len(ids) < k and len(near) < len(points):  # ids with several vectors took the places of others
            ids, score = _ranked(q, vector, np.arange(len(points)), points, lists, k)
        out.append((np.full(len(ids), q), ids, score))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[c] for x in out])) for c in range(3)], ["query_id", "vec_id", "score"])


def _ranked(q: int, vector: np.ndarray, near: np.ndarray, points: np.ndarray, lists: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best ids but ``q`` of the vectors at ``near``, each by its nearest vector, and their scores."""
    ids = np.concatenate([lists[i] for i in near])
    score = np.repeat((points[near] * vector).sum(axis=1), [len(lists[i]) for i in near])
    order = np.lexsort((ids, -score))
    order = order[ids[order] != q]
    first = np.sort(np.unique(ids[order], return_index=True)[1])[:k]
    return ids[order][first], score[order][first]
