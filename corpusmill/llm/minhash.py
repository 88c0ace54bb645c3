"""Near-duplicate documents: MinHash signatures joined by Hamming distance, links confirmed on whole shingle sets.

A signature has ``PARTS`` values of 16 bits; two sets of similarity s differ in a share 1 - s of them. All pairs that
differ in at most ``errors`` values are found: the values are cut into ``chunks`` chunks, and as
``errors < 2 * chunks`` one chunk has at most one wrong value, so the keys that leave out one value of one chunk each
contain a common one. Both numbers follow from the similarity asked for: of pairs that just reach it, at most one in a
million (``MISSED``) differs in more values (13 chunks and 25 errors at 0.85, 16 and 31 at 0.8).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import hashing as H
from corpusmill.llm.groups import components, runs
from corpusmill.session import cut_lineage

PARTS = 64
MISSED = 1e-6
"""Share of pairs at the similarity asked for that may differ in more values than keys allow for, at most."""
BLOCK = 512
"""Nodes of one key, or partners of one node, that meet in one task; more are dealt out in blocks."""
STARS = 3
"""Times that the nodes of each key are compared with one of them before pairs are looked for, at most."""
_SEEDS = np.random.default_rng(64).integers(0, 2**64, (2, PARTS), dtype=np.uint64) | np.uint64(1)
_BREAKS = H.white_space()


class Layout(NamedTuple):
    errors: int
    """Pairs that differ in so many values share a key."""
    cuts: np.ndarray
    """Where chunks begin, and ``PARTS``."""
    chunk: np.ndarray
    """Of each value the number of its chunk."""


@lru_cache(maxsize=8)
def layout(percent: int) -> Layout:
    """The fewest chunks with which at most ``MISSED`` of the pairs at the similarity share no key."""
    wrong = 1 - percent / 100
    more = lambda e: sum(comb(PARTS, n) * wrong**n * (1 - wrong) ** (PARTS - n) for n in range(e + 1, PARTS + 1))
    chunks = next(c for c in range(1, PARTS + 1) if more(2 * c - 1) <= MISSED)
    cuts = np.linspace(0, PARTS, chunks + 1).astype(int)
    return Layout(2 * chunks - 1, cuts, np.repeat(np.arange(chunks), np.diff(cuts)))


def near_duplicates(docs: DataFrame, percent: int = 85, words: int = 5) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, text_key, first`` per row of ``docs(doc_id, text)``; other columns are not read.

    A-Z is lower-cased; words are runs of bytes other than 09-0D and 20. A document's set holds its distinct runs of
    ``words`` words, or its whole sequence if that is shorter; no words or no text give an empty set, linked with
    nothing. Documents are linked when ``100 * common >= percent * union`` (``percent`` at least 80). A component is
    named after its smallest ``doc_id``, which alone is kept. Repeated rows have equal results. Rows that share an id
    but not their text are compared like any others. A row without ``doc_id`` names no component; it is kept if its
    component would be null.

    ``text_key`` is the 64-bit hash of the text. ``first`` marks the one text of a component to keep, also where its id
    has other texts: of its smallest id the one with the least ``text_key`` (rows with empty sets are all first).
    """
    if percent < 80:
        raise ValueError("keys are sized for similarities of 0.8 and more")
    H.bounded_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    sets = cut_lineage(texts.mapInArrow(_signer(words), f"doc_id {id_type}, text_key long, n_shingles long, h1 long, h2 long, signature binary"))
    same = sets.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2")
    top = F.min(F.struct("doc_id", "text_key")).alias("top")
    classes = same.agg(top, F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    classes = cut_lineage(classes.select("h1", "h2", "top", "n_shingles", "signature", F.monotonically_increasing_id().alias("node")))
    labelled = classes.select("h1", "h2", "top", F.col("node").alias("part"))
    for wider in _parts(texts, classes, percent, words):
        labelled = _relabelled(labelled, wider)
    least = labelled.groupBy("part").agg(F.min("top").alias("least"))
    named = labelled.join(least, "part").select("h1", "h2", "least")
    out = sets.join(named, ["h1", "h2"], "left").withColumn("component_id", F.coalesce("least.doc_id", "doc_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    first = F.when(F.col("least").isNull(), True).otherwise(F.struct("doc_id", "text_key").eqNullSafe(F.col("least")))
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "text_key", first.alias("first"))


def _parts(texts: DataFrame, classes: DataFrame, percent: int, words: int) -> list[DataFrame]:
    """Tables ``node, component`` that connect, one after the other, all that links connect: nodes to parts, and parts to wider ones.

    Nodes that share a key are first compared with one of them, so that a group of copies is connected by as many
    comparisons as it has members; again with other ones, while many nodes are apart and a quarter of those compared
    were links. Only then, and only between parts, all pairs that share a key are looked for.
    """
    nodes = classes.select("node", "n_shingles", "signature")
    keys = nodes.select("node", "signature").mapInArrow(_keys(percent), "node long, key long, place int")
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").drop("times")
    members = cut_lineage(keys.join(shared, "key"))
    wanted = classes.join(members.select("node").distinct(), "node").select("node", "top.*")
    # by the columns of the join as well, so that texts are not shuffled again
    bodies = texts.join(wanted, ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key", "node"]).select("node", "text")
    bodies = cut_lineage(bodies.mapInArrow(_valued(words), "node long, shingles binary"))
    members = members.withColumn("part", F.col("node"))
    parts: list[DataFrame] = []
    for turn in range(STARS):
        spokes = cut_lineage(_nearest(_measured(_spokes(members, turn), nodes, percent)))
        compared = spokes.count()
        if compared < (BLOCK if parts else 1):
            break
        found = cut_lineage(_confirmed(spokes, bodies, percent))
        parts.append(components(found))
        members = cut_lineage(_relabelled(members, parts[-1]))
        if found.count() < compared / 4:
            break
    return [*parts, components(cut_lineage(_apart(members, nodes, bodies, percent)))]


def _relabelled(rows: DataFrame, wider: DataFrame) -> DataFrame:
    """``rows`` with ``part`` as the one that it is connected to by ``wider``, itself if to none."""
    named = wider.select(F.col("node").alias("part"), F.col("component").alias("_wider"))
    return rows.join(named, "part", "left").withColumn("part", F.coalesce("_wider", "part")).drop("_wider")


def _spokes(members: DataFrame, turn: int) -> DataFrame:
    """``a, own, b, part``: for each key whose nodes are apart, one of them with all others of other parts, and the parts of both.

    That is the smallest in the first turn, so that links are trees already, and another one in each later turn.
    """
    draw = F.xxhash64("node", F.lit(turn)) if turn else F.col("node")
    hub = F.min(F.struct(draw.alias("draw"), "node", "part")).alias("hub")
    hubs = members.groupBy("key").agg(hub, F.min("part").alias("low"), F.max("part").alias("high")).filter("low < high").drop("low", "high")
    pairs = members.join(hubs, "key").filter(F.col("part") != F.col("hub.part"))
    return pairs.select(F.col("hub.node").alias("a"), F.col("hub.part").alias("own"), F.col("node").alias("b"), "part").distinct()


def _measured(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs within the distance, with it."""
    for side in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("signature").alias(f"signature_{side}")), side)
    return pairs.mapInArrow(_distances(percent), "a long, own long, b long, part long, distance int")


def _nearest(pairs: DataFrame) -> DataFrame:
    """Of the pairs of a ``b`` the nearest."""
    near = F.min(F.struct("distance", "a", "own", "part")).alias("near")
    return pairs.groupBy("b").agg(near).select("near.a", "near.own", "b", "near.part", "near.distance")


def _apart(members: DataFrame, nodes: DataFrame, bodies: DataFrame, percent: int) -> DataFrame:
    """``a, b``: linked parts, out of all pairs of nodes of different ones that share a key and are within the distance.

    The nodes of a key outside its largest part visit all of it, block by block. A cell holds a block of each; the sets
    of those that have a partner in it follow them there, and of its links enough come out to connect what they connect.
    """
    sizes = members.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"))
    keys = sizes.groupBy("key").agg(F.max(F.struct("n", "part")).alias("most"), F.sum("n").alias("n"))
    keys = keys.filter("n > most.n").select("key", F.col("most.part").alias("major"), F.ceil(F.col("n") / BLOCK).cast("int").alias("homes"), F.ceil((F.col("n") - F.col("most.n")) / BLOCK).cast("int").alias("tours"))
    rows = members.join(keys, "key").withColumn("minor", F.col("part") != F.col("major"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    at = lambda visits, tour, home: F.struct(F.lit(visits).alias("visits"), tour.alias("tour"), home.alias("home"))
    own_home, own_tour = F.pmod(F.xxhash64("node"), "homes").cast("int"), F.pmod(F.xxhash64("node", F.lit(1)), "tours").cast("int")
    stays = F.transform(upto("tours"), lambda tour: at(False, tour, own_home))
    visits = F.transform(upto("homes"), lambda home: at(True, own_tour, home))
    both = rows.withColumn("at", F.explode(F.when(F.col("minor"), F.concat(stays, visits)).otherwise(stays))).select("key", "place", "node", "part", "minor", "at.*")
    cells = both.withColumn("cell", F.xxhash64("key", "tour", "home")).select("cell", "place", "node", "part", "minor", "visits").join(nodes, "node")
    schema = "cell long, place int, node long, part long, minor boolean, visits boolean, n_shingles long, signature binary"
    near = _by_cell(cells).mapInArrow(_near(percent), schema)
    return _by_cell(near.join(bodies, "node")).mapInArrow(_joined(percent), "a long, b long")


def _by_cell(rows: DataFrame) -> DataFrame:
    return rows.repartition("cell").sortWithinPartitions("cell")


def _confirmed(pairs: DataFrame, bodies: DataFrame, percent: int) -> DataFrame:
    """``a, b``: the parts of the pairs that are links by their whole sets; of the pairs of ``a`` with a ``part``, up to the first.

    The partners of ``a`` come by as a stream, nearest first; many of them are dealt out in blocks.
    """
    blocks = pairs.groupBy("a", "own").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = pairs.join(blocks.drop("own"), "a").withColumn("block", F.pmod(F.xxhash64("b"), "blocks").cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    heads = blocks.select("a", each.alias("block"), F.col("a").alias("node"), F.col("own").alias("part"), F.lit(-1).alias("distance"))
    rows = heads.union(dealt.select("a", "block", F.col("b").alias("node"), "part", "distance")).join(bodies, "node")
    dealt = rows.repartition("a", "block").sortWithinPartitions("a", "block", "distance", "node")
    return dealt.select("a", "block", "part", "distance", "shingles").mapInArrow(_linked(percent), "a long, b long")


def shingles(batch: pa.RecordBatch | pa.Table, words: int) -> Iterator[np.ndarray]:
    """The set of each text as sorted distinct 64-bit hashes."""
    data, offsets = H.column_bytes(batch.column("text"), lower=True)
    starts, ends, first = H.words_of(data, offsets, _BREAKS)
    hashes = H.word_hashes(data, starts, ends)
    for a, b in zip(first.tolist(), first[1:].tolist()):
        if a == b:
            yield np.zeros(0, np.uint64)
        else:
            size = min(words, b - a)
            yield np.unique(H.window_hashes(hashes[a:b], np.arange(b - a - size + 1), size) + np.uint64(words - size))


def _signature(values: np.ndarray) -> bytes:
    """The lowest 16 bits of the least hash, for each of the hash functions."""
    least = np.full(PARTS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(values), 4096):
        least = np.minimum(least, ((values[a : a + 4096, None] * _SEEDS[0] + _SEEDS[1]) >> np.uint64(24)).min(axis=0))
    return least.astype(np.uint16).tobytes()


def _signer(words: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, one, two, signatures = [], [], [], []
            for s in shingles(batch, words):
                sizes.append(len(s))
                one.append(int(s.sum(dtype=np.uint64)))
                two.append(int(H.mixed(s ^ np.uint64(len(s))).sum(dtype=np.uint64)))
                signatures.append(_signature(s))
            longs = [H.signed(np.array(x, np.uint64)) for x in (one, two)]
            columns = [batch.column("doc_id"), batch.column("text_key"), pa.array(sizes, pa.int64()), *map(pa.array, longs), pa.array(signatures, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "n_shingles", "h1", "h2", "signature"])

    return sign


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, PARTS)


def _keys(percent: int):
    """One key for each left-out value: the hash of the other values of its chunk."""
    _, cuts, chunk = layout(percent)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = _matrix(batch.column("signature")).astype(np.uint64)
            valued = H.mixed(parts + (np.arange(PARTS, dtype=np.uint64) + np.uint64(1)) * np.uint64(1 << 20))
            whole = np.add.reduceat(valued, cuts[:-1], axis=1)[:, chunk]
            keys = H.mixed(whole - valued + np.arange(PARTS, dtype=np.uint64))
            ids = batch.column("node").take(pa.array(np.repeat(np.arange(len(parts)), PARTS)))
            place = np.tile(np.arange(PARTS, dtype=np.int32), len(parts))
            yield pa.RecordBatch.from_arrays([ids, pa.array(H.signed(keys.ravel())), pa.array(place)], ["node", "key", "place"])

    return keyed


def _distances(percent: int):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        errors = layout(percent).errors
        for batch in batches:
            size, other = (np.asarray(batch.column(c)) for c in ("n_a", "n_b"))
            distance = (_matrix(batch.column("signature_a")) != _matrix(batch.column("signature_b"))).sum(axis=1).astype(np.int32)
            ok = pa.array((distance <= errors) & (np.minimum(size, other) * 100 >= percent * np.maximum(size, other)))
            found = batch.select(["a", "own", "b", "part"]).add_column(4, "distance", pa.array(distance))
            yield found.filter(ok)

    return measure


def _met(table: pa.Table, percent: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each visitor of a cell the rows at home in other parts within the distance, at their first common key, and the distances."""
    errors, cuts, chunks = layout(percent)
    parts, size = _matrix(table.column("signature")), np.asarray(table.column("n_shingles"))
    node, part = np.asarray(table.column("node")), np.asarray(table.column("part"))
    visits, minor = (np.asarray(table.column(c)).astype(bool) for c in ("visits", "minor"))
    place = table.column("place")[0].as_py()
    chunk, home = chunks[place], np.flatnonzero(~visits)
    for i in np.flatnonzero(visits).tolist():
        # two visitors meet at the home of either; the one with the larger number counts
        near = home[(part[home] != part[i]) & (~minor[home] | (node[i] < node[home])) & (np.minimum(size[i], size[home]) * 100 >= percent * np.maximum(size[i], size[home]))]
        if not len(near):
            continue
        wrong = parts[near] != parts[i]
        distance = wrong.sum(axis=1)
        by_chunk = np.add.reduceat(wrong, cuts[:-1], axis=1, dtype=np.int64)
        first = (by_chunk <= 1).argmax(axis=1)
        left_out = np.where(by_chunk[:, chunk] == 1, wrong[:, cuts[chunk] : cuts[chunk + 1]].argmax(axis=1), 0) + cuts[chunk]
        ok = (distance <= errors) & (first == chunk) & (left_out == place)
        if ok.any():
            yield i, near[ok], distance[ok]


def _near(percent: int):
    """The rows of a cell that have a partner in it."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "cell"):
            some = np.zeros(table.num_rows, bool)
            for i, found, _ in _met(table, percent):
                some[i] = some[found] = True
            if some.any():
                columns = ["cell", "place", "node", "part", "minor", "visits", "n_shingles", "signature"]
                yield from table.select(columns).filter(pa.array(some)).combine_chunks().to_batches()

    return near


def _joined(percent: int):
    """Linked parts of a cell: pairs of nodes are taken nearest first and skipped once links connect their parts."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "cell"):
            found = list(_met(table, percent))
            if not found:
                continue
            part = np.asarray(table.column("part")).tolist()
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
            parent = {p: p for p in part}

            def root(x: int) -> int:
                while parent[x] != x:
                    parent[x] = x = parent[parent[x]]
                return x

            left = np.concatenate([np.full(len(j), i) for i, j, _ in found])
            right = np.concatenate([j for _, j, _ in found])
            order = np.argsort(np.concatenate([d for _, _, d in found]), kind="stable")
            links = []
            for i, j in zip(left[order].tolist(), right[order].tolist()):
                a, b = root(part[i]), root(part[j])
                if a != b:
                    common = _common(sets[i], sets[j])
                    if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                        parent[a] = b
                        links.append((min(part[i], part[j]), max(part[i], part[j])))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    return join


def _valued(words: int):
    """The whole set of each text, as hashes in order."""

    def value(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array([s.tobytes() for s in shingles(batch, words)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("node"), sets], ["node", "shingles"])

    return value


def _linked(percent: int):
    """Rows of one ``a`` and block: its own set first, then its partners."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, home, own, done = None, None, None, set()
        for batch in batches:
            left, right = [], []
            heads, blocks, parts, distances = (batch.column(c).to_pylist() for c in ("a", "block", "part", "distance"))
            for i, values in enumerate(batch.column("shingles")):
                if distances[i] < 0:
                    at, home, own, done = (heads[i], blocks[i]), parts[i], np.frombuffer(values.as_buffer(), np.uint64).copy(), set()
                elif (heads[i], blocks[i]) == at and parts[i] not in done:
                    values = np.frombuffer(values.as_buffer(), np.uint64)
                    common = _common(own, values)
                    if 100 * common >= percent * (len(own) + len(values) - common):
                        done.add(parts[i])
                        left.append(min(home, parts[i]))
                        right.append(max(home, parts[i]))
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return link


def _common(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))
