"""The manifest against a plain tree in Python."""

import hashlib
import random
import zlib

import pytest
from brute import ordered, sha
from pyspark.sql import functions as F

from corpusmill.llm import merkle
from corpusmill.llm.queries import merkle_query

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long"


def leaf(doc, text, source, lang, n):
    fields = (doc, source, lang, n, text)
    return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def proof(tree, p):
    for nodes in tree[:-1]:
        run = nodes[p // 16 * 16 : p // 16 * 16 + 16]
        yield p % 16, run[: p % 16] + run[p % 16 + 1 :]
        p //= 16


def plain(rows):
    """The rows of the query, without Spark."""
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append((leaf(*r), r))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        trees[s].sort(key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
    below = {s: levels([x for x, _ in trees[s]]) for s in names}
    top = levels([below[s][-1][0] for s in names])
    for q, s in enumerate(names):
        for p, (own, r) in enumerate(trees[s]):
            steps = [*proof(below[s], p), *proof(top, q)]
            node = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None:
                node = leaf(r[0], "".join(c.lower() if c.isascii() else c for c in r[1]), *r[2:])
            for k, others in steps:
                node = sha("".join([*others[:k], node, *others[k:]]))
            yield r[0], own, below[s][-1][0], top[-1][0], sha("".join(x for _, o in steps for x in o)), node, node == top[-1][0]


def got(df):
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return ordered(map(tuple, merkle_query(df).select(columns).collect()))


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 256, 257, 300, 4095, 4096])
def test_log_is_in_postorder_and_addressed_by_its_sizes(n):
    leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    tree, height = levels([x.hex() for x in leaves]), merkle.levels_over(n)
    assert len(tree) == height + 1
    log = merkle.postorder_log(leaves, height)
    places = {(level, i): merkle.position(level, i, n, height) for level, nodes in enumerate(tree) for i in range(len(nodes))}
    assert sorted(places.values()) == list(range(len(log) // 32))
    assert all(log[32 * at : 32 * at + 32].hex() == tree[level][i] for (level, i), at in places.items())
    # a node comes after all nodes below it
    assert all(places[level, i] < places[level + 1, i // 16] for level, i in places if level < height)


def test_logs_of_complete_stretches_stay_when_leaves_are_added():
    leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(600)]
    assert merkle.postorder_log(leaves, 3).startswith(merkle.postorder_log(leaves[:512], 3)[: 32 * (512 + 32 + 2)])


def test_large_and_odd_trees(spark):
    draw = random.Random(3)
    rows = [(i, f"Text {i}", "big", "en", i) for i in range(5000)]
    rows += [(draw.randrange(10**12), draw.choice(["", None, "A b", "É" * 5000]), draw.choice([None, "", "é", "z", "Z", "\U0001f600", "￿"]), None, None) for _ in range(120)]
    rows += [(None, "x", "big", "en", 1), (None, None, None, None, None), *rows[-3:], (7, "one more", "alone", None, -1)]
    draw.shuffle(rows)
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA + ", tree string, pos int").repartition(5)
    assert got(df) == ordered(plain(rows))


def test_one_row_and_none(spark):
    row = (3, "A", "s", None, 1)
    one = spark.createDataFrame([row], SCHEMA)
    assert got(one) == ordered(plain([row]))
    assert merkle.dataset_proofs(one).first()["steps"] == []
    assert got(one.limit(0)) == []


def test_a_proof_fits_its_leaf_only(spark):
    docs = spark.createDataFrame([(i, f"t{i}", f"s{i % 3}", "en", 2) for i in range(60)], SCHEMA)
    rows = merkle.dataset_proofs(docs, wrong=merkle.leaf_digest(F.lit("x"))).cache()
    fits = rows.select((merkle.folded(F.col("leaf"), F.col("steps")) == F.col("root")).alias("own"), (merkle.folded(F.col("wrong"), F.col("steps")) == F.col("root")).alias("other"))
    assert fits.distinct().collect() == [(True, False)]
