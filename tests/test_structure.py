import random
from collections import Counter

import pytest

from corpusmill.operators import dataflow as D
from corpusmill.operators import trees as T


def random_tree(rng, n):
    return [(i, None if i == 0 else rng.randrange(max(0, i - 3), i), rng.choice("abc")) for i in range(n)]


def brute_subtrees(tree):
    kids = {i: [j for j, p, _ in tree if p == i] for i, _, _ in tree}
    label = {i: t for i, _, t in tree}
    sexp = lambda i: "(" + " ".join([label[i]] + [sexp(k) for k in kids[i]]) + ")"
    depth = lambda i: 1 if tree[i][1] is None else 1 + depth(tree[i][1])
    return [(i, sexp(i), depth(i)) for i, p, _ in tree if kids[i] or p is None]


def test_subtrees_and_match(spark):
    rng = random.Random(2)
    trees = {(p, s): random_tree(rng, rng.choice([1, 5, 14])) for p in range(8) for s in ("ref", "hyp")}
    trees[(8, "ref")] = [(i, i - 1 if i else None, "x") for i in range(12)]
    rows = [(p, s, *node) for (p, s), tree in trees.items() for node in tree]
    nodes = spark.createDataFrame(rows, "pair_id long, side string, node long, parent long, type string").repartition(3)
    got = {(r["pair_id"], r["side"], r["node"]): (r["sexp"], r["depth"]) for r in T.subtrees(nodes).collect()}
    want = {(p, s, i): (x, d) for (p, s), tree in trees.items() for i, x, d in brute_subtrees(tree)}
    assert got == want
    matched = total = 0
    for p in range(9):
        have = {x for _, x, _ in brute_subtrees(trees[(p, "hyp")])} if (p, "hyp") in trees else set()
        refs = [x for _, x, _ in brute_subtrees(trees[(p, "ref")])]
        matched, total = matched + sum(x in have for x in refs), total + len(refs)
    assert T.syntax_match(nodes).first()["score"] == pytest.approx(matched / total)


def brute_dataflow(tokens):
    """Edges, kept if connected, merged by position, renamed by first appearance."""
    edges = []
    for pos, stmt, name, is_def in tokens:
        if is_def:
            used = [(n, p) for p, s, n, d in tokens if s == stmt and not d]
            edges += [(name, pos, "computedFrom", [n], [p]) for n, p in used] or [(name, pos, "comesFrom", [], [])]
        else:
            before = [p for p, s, n, d in tokens if d and n == name and s < stmt]
            edges.append((name, pos, "comesFrom", [name] if before else [], before[-1:]))
    used = {e[1] for e in edges if e[4]} | {p for e in edges for p in e[4]}
    merged = {}
    for e in edges:
        if e[1] in used:
            old = merged.get(e[1], (None, None, None, [], []))
            merged[e[1]] = (e[0], e[1], e[2], sorted(set(old[3] + e[3])), sorted(set(old[4] + e[4])))
    names, out = {}, []
    for pos in sorted(merged):
        name, _, relation, parents, _ = merged[pos]
        for n in [*parents, name]:
            names.setdefault(n, f"var_{len(names)}")
        out.append((pos, names[name], relation, tuple(names[n] for n in parents)))
    return out


def test_dataflow(spark):
    rng = random.Random(4)
    docs = {}
    for p in range(12):
        for s in ("ref", "hyp"):
            docs[(p, s)] = [(i, i // 3, rng.choice("abcd"), i % 3 == 0) for i in range(rng.choice([3, 12, 20]))]
    rows = [(p, s, *t) for (p, s), toks in docs.items() for t in toks]
    tokens = spark.createDataFrame(rows, "pair_id long, side string, pos long, stmt_id long, name string, is_def boolean").repartition(3)
    edges = D.def_use_edges(tokens)
    got = {}
    for r in D.normalized(edges).orderBy("pos").collect():
        got.setdefault((r["pair_id"], r["side"]), []).append((r["pos"], r["var"], r["relation"], tuple(r["par_vars"])))
    want = {k: brute_dataflow(v) for k, v in docs.items()}
    assert got == {k: v for k, v in want.items() if v}
    # the other order of the two steps gives the same edges
    other = D.normalize_edges(D.merge_edges(D.connected_edges(edges)))
    assert other.count() == sum(len(v) for v in want.values())
    matched = total = 0
    for p in range(12):
        ref, hyp = (Counter(e[1:] for e in want[(p, s)]) for s in ("ref", "hyp"))
        matched, total = matched + sum((ref & hyp).values()), total + sum(ref.values())
    assert D.dataflow_match(edges).first()["score"] == pytest.approx(matched / total)


def test_a_variable_does_not_come_from_its_own_statement(spark):
    tokens = spark.createDataFrame(
        [(0, "ref", 0, 0, "x", True), (0, "ref", 1, 1, "x", True), (0, "ref", 2, 1, "x", False)],
        "pair_id long, side string, pos long, stmt_id long, name string, is_def boolean",
    )
    use = D.def_use_edges(tokens).filter("pos = 2").first()
    assert (use["parents"], use["parent_pos"]) == (["x"], [0])


def test_no_reference_edges_score_zero(spark):
    edges = spark.createDataFrame(
        [(0, "hyp", "a", 1, "computedFrom", ["b"], [0], 0)],
        "pair_id long, side string, name string, pos long, relation string, parents array<string>, parent_pos array<long>, ord long",
    )
    assert D.dataflow_match(edges).first()["score"] == 0.0


def node_table(spark, rows):
    return spark.createDataFrame(rows, "pair_id long, side string, node long, parent long, type string")


def test_trees_without_root_parent_or_nodes(spark):
    with pytest.raises(Exception, match="not in its tree"):
        T.subtrees(node_table(spark, [(0, "ref", 0, None, "a"), (0, "ref", 2, 1, "b")])).collect()
    with pytest.raises(Exception, match="cycle"):
        T.node_depth(node_table(spark, [(0, "ref", 0, 1, "a"), (0, "ref", 1, 0, "b")])).collect()
    none = node_table(spark, [])
    assert T.subtrees(none).collect() == [] and T.syntax_match(none).first()["score"] == 0.0


def test_a_wide_and_a_deep_tree(spark):
    wide = [(0, "ref", i, 0 if i else None, "w") for i in range(5000)]
    deep = [(1, "ref", i, i - 1 if i else None, "d") for i in range(20_000)]
    found = {(r["pair_id"], r["node"]): r["sexp"] for r in T.subtrees(node_table(spark, wide + deep), digest=True).collect()}
    assert len(found) == 1 + 19_999 and len(set(found.values())) == 20_000
    depths = T.node_depth(node_table(spark, deep)).agg({"depth": "max"}).first()[0]
    assert depths == 20_000
