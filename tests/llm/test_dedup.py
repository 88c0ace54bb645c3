import math

import brute
import corpus_pipeline
import pytest
from brute import ordered, pairs

from corpusmill.llm import minhash as M
from corpusmill.llm import substring_dedup as S
from corpusmill.llm.groups import components
from corpusmill.llm.minhash import near_duplicates
from corpusmill.llm.substring_dedup import remove_repeats


def test_the_cover_brings_any_two_positions_together():
    for i in range(S.PERIOD):
        for j in range(S.PERIOD):
            assert any((i + d) % S.PERIOD in S.COVER and (j + d) % S.PERIOD in S.COVER for d in range(S.PERIOD))


def test_repeats_as_brute_force(odd):
    rows = [tuple(r) for r in remove_repeats(odd, length=35).collect()]
    assert ordered(rows) == ordered(brute.repeats(pairs(odd), 35))


def test_other_lengths_and_small_arrow_batches(spark, docs):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        rows = [tuple(r) for r in remove_repeats(docs.repartition(1), length=25).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert ordered(rows) == ordered(brute.repeats(pairs(docs), 25))
    with pytest.raises(ValueError):
        remove_repeats(docs, length=10)


def test_repeats_of_string_ids_and_of_nothing(docs, none):
    rows = remove_repeats(docs.withColumn("doc_id", docs["doc_id"].cast("string"))).collect()
    assert ordered((int(r[0]), *r[1:]) for r in rows) == ordered(brute.repeats(pairs(docs), 35))
    assert remove_repeats(none).collect() == []


def test_near_duplicates_as_brute_force(docs):
    rows = [tuple(r)[:4] for r in near_duplicates(docs).collect()]
    assert ordered(rows) == ordered((d, n, c, d == c) for d, n, c in brute.near(pairs(docs)))


def test_near_duplicates_of_odd_rows(odd, none):
    rows = near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by_id = {d: (n, c) for d, n, c in brute.near([p for p in pairs(odd) if p[0] is not None])}
    assert all((r["n_shingles"], r["component_id"]) == by_id[r["doc_id"]] for r in rows if r["doc_id"] is not None)
    nameless = [r for r in rows if r["doc_id"] is None]
    assert [(r["component_id"], r["kept"]) for r in nameless] == [(35, False)]
    assert near_duplicates(none).collect() == []


def test_a_chain_and_a_large_group_in_blocks(spark, monkeypatch):
    """Neighbours of a chain are linked, its ends are not; blocks of a key give what one block gives."""
    monkeypatch.setattr(M, "BLOCK", 4)
    base = [f"t{i}" for i in range(100)]
    texts = []
    for i in range(24):
        w = list(base)
        w[: i // 2] = [f"n{j}" for j in range(i // 2)]
        w[60] = f"own{i}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = [tuple(r)[:4] for r in near_duplicates(df).collect()]
    assert ordered(rows) == ordered((d, n, c, d == c) for d, n, c in brute.near(list(enumerate(texts))))


def test_pairs_between_80_and_85_percent(spark):
    """A run of m changed words changes m + 4 of 96 five-word runs; the stage of the pipeline links such pairs too."""
    texts = []
    for i in range(60):
        words = [f"t{i}x{j}" for j in range(100)]
        changed = list(words)
        changed[40 : 40 + 4 + i % 4] = [f"n{i}x{j}" for j in range(4 + i % 4)]
        texts += [" ".join(words), " ".join(changed)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(*r, "en", "s", len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    expect = brute.near(rows, percent=80)
    assert len({c for _, _, c in expect}) < len({c for _, _, c in brute.near(rows, percent=85)})
    assert ordered(tuple(r)[:4] for r in near_duplicates(df, percent=80).collect()) == ordered((d, n, c, d == c) for d, n, c in expect)
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup_stage(spark, df, "").collect()}
    assert kept == {d for d, _, c in expect if d == c}


@pytest.mark.parametrize("percent", [80, 85, 90, 97, 100])
def test_keys_are_sized_for_the_similarity(percent):
    errors, cuts, chunk = M.layout(percent)
    missed = sum(math.comb(M.PARTS, n) * (1 - percent / 100) ** n * (percent / 100) ** (M.PARTS - n) for n in range(errors + 1, M.PARTS + 1))
    assert missed <= 1e-6 and errors < 2 * (len(cuts) - 1) and len(chunk) == cuts[-1] == M.PARTS


def test_components_of_a_path_a_star_and_a_ring(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(30)] + [(200, 201), (201, 202), (200, 202)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(1, 41)}, **{101 + i: 100 for i in range(30)}, 201: 200, 202: 200}


def test_components_of_random_links(spark):
    import random

    draw = random.Random(7)
    edges = [tuple(sorted(draw.sample(range(400), 2))) for _ in range(330)]
    root = {n: n for e in edges for n in e}
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    found = [tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()]
    assert ordered(found) == ordered((n, c) for n, c in root.items() if n != c)


def test_components_of_trees_take_two_shuffles_a_round(spark):
    """A round over links that are trees already is one join of them with themselves, whose stages 211 partitions make dear."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    spark.sparkContext.setJobGroup("trees", "components of a path")
    try:
        made = components(edges)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("trees") for s in tracker.getJobInfo(j).stageIds}
    assert {tuple(r) for r in made.collect()} == {(i, 0) for i in range(1, 41)}
    assert len(stages) <= 60


def test_rows_that_share_an_id(spark):
    """Texts of one id are compared like any others, and one row of each group stays."""
    base = [f"t{i}" for i in range(60)]
    near = [*base[:59], "other"]
    texts = [(3, " ".join(base)), (5, " ".join(near)), (5, "something else"), (6, " ".join(near[::-1])), (6, " ".join(base[::-1])), (7, "A b"), (7, "a  B"), (7, "A b"), (8, None), (8, None), (8, "")]
    df = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    found = {(r["doc_id"], r["text_key"]): r for r in near_duplicates(df).collect()}
    names = {t: found[d, k]["component_id"] for d, t, k in df.selectExpr("doc_id", "text", "xxhash64(text)").collect()}
    assert names == {" ".join(base): 3, " ".join(near): 3, "something else": 5, " ".join(near[::-1]): 6, " ".join(base[::-1]): 6, "A b": 7, "a  B": 7, None: 8, "": 8}
    kept = ordered((r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup_stage(spark, df, "").collect())
    reversed_pair = {" ".join(near[::-1]), " ".join(base[::-1])}
    assert [d for d, _ in kept] == [3, 5, 6, 7, 8, 8] and kept[0][1] == " ".join(base) and kept[1][1] == "something else"
    assert kept[2][1] in reversed_pair and kept[3][1] in ("A b", "a  B") and {t for _, t in kept[4:]} == {None, ""}


def test_scattered_groups_need_more_than_their_hubs(spark, monkeypatch):
    """Groups in which most pairs are no links, in small blocks: whatever hub is drawn, the rest must be found."""
    monkeypatch.setattr(M, "BLOCK", 3)
    rows = []
    for g in range(3):
        base = [f"g{g}t{i}" for i in range(300)]
        for i in range(12):
            words = list(base)
            for j in range(10 + 21 * i, 10 + 21 * i + (11, 12, 13, 17)[i % 4]):
                words[j] = f"own{g}x{i}x{j}"
            rows.append((len(rows), " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expect = brute.near(rows, percent=80)
    assert 3 < len({c for _, _, c in expect}) < len(rows)
    assert ordered(tuple(r)[:4] for r in near_duplicates(df, percent=80).collect()) == ordered((d, n, c, d == c) for d, n, c in expect)


def test_rounds_of_components_leave_no_shuffle_files(spark):
    import time
    from pathlib import Path

    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {p.name for folder in manager.localDirsString() for p in Path(folder).rglob("shuffle_*.data")}
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = files(), spark.conf.get(key)
    made = components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long"))
    waited = time.time() + 15
    while (left := files() - before) and time.time() < waited:  # they are deleted in the background
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(key) == setting
    assert {tuple(r) for r in made.collect()} == {(i, 0) for i in range(1, 41)}
