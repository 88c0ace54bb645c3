"""The plans that lead from methods to training sets and from predictions to scores."""

from pyspark.sql import functions as F

from corpusmill.functions.arrays import IGNORED
from corpusmill.operators.bpe import encode, train_bpe
from corpusmill.plans import training as P


def methods(spark):
    code = "void m() {{ List.add(a{0}); x.get({0}); }}"
    rows = [(i, code.format(i), f"List.add {code.format(i).index('add')}|List.get {code.format(i).index('get')}|", "web" if i % 3 else "android", "List") for i in range(30)]
    return spark.createDataFrame(rows, "row_id long, source_code string, api_seq string, domain string, api string")


def test_pretraining_blocks_hold_all_tokens_once(spark):
    df = methods(spark)
    bpe = train_bpe(df, 270)
    blocks = P.pretraining_blocks(df, bpe, length=16, group_size=10, batch_size=4).collect()
    total = encode(df, bpe).agg(F.sum(F.size("input_ids"))).first()[0]
    assert all(len(b["input_ids"]) == 16 and b["labels"] == b["input_ids"] for b in blocks)
    assert total - 3 * 15 <= 16 * len(blocks) <= total
    places = sorted((b["batch"], b["slot"]) for b in blocks)
    assert places == [divmod(i, 4) for i in range(len(blocks))]
    masked = {b["block_id"]: b for b in P.pretraining_blocks(df, bpe, 16, 10, 4, mlm=0.3, mask_id=1).collect()}
    plain = {b["block_id"]: b["input_ids"] for b in blocks}
    assert masked.keys() == plain.keys()
    for k, b in masked.items():
        assert all(y == IGNORED and x == o or y == o for x, y, o in zip(b["input_ids"], b["labels"], plain[k]))


def test_finetuning_features(spark):
    df = methods(spark)
    bpe = train_bpe(df, 270)
    blocks, valid = P.finetuning_features(df, bpe, length=32, valid_share=0.2, group_size=100)
    assert {b["domain"] for b in blocks.collect()} == {"web", "android"}
    rows = valid.collect()
    assert sorted({r["row_id"] for r in rows}) == [0, 1, 2, 3, 4, 5] and len(rows) == 12
    for r in rows:
        assert len(r["input_ids"]) == len(r["labels"]) == 32
        target = bytes(int(h, 16) for i in r["labels"] if i != IGNORED for h in [bpe.tokens[i][j : j + 2] for j in range(0, len(bpe.tokens[i]), 2)])
        assert target.decode() == ("add", "get")[r["usage_no"]]


def test_predictions_are_scored_with_missing_ones(spark):
    df = methods(spark)
    samples = P.completion_contexts(df, train_bpe(df, 270), length=8)
    assert samples.count() == 60 and samples.filter(F.size("input_ids") > 8).count() == 0
    given = spark.createDataFrame([(0, 0, " List.add(a0))) {"), (1, 0, "no")], "row_id long, usage_no int, prediction string")
    pairs = {(r["row_id"], r["usage_no"]): (r["refs"], r["hyp"]) for r in P.completion_pairs(samples, given).collect()}
    assert pairs[0, 0] == (["List.add(a0)"], "List.add(a0)") and pairs[2, 1][1] == "" and len(pairs) == 60


def test_samples_keep_columns_and_scores_count_their_rows(spark):
    from corpusmill.operators.bleu import exact_match
    from corpusmill.operators.usages import valid_samples

    row = (1, "web", "A", "A.f(x)", "A.f 2|")
    df = spark.createDataFrame([row, row], "row_id long, domain string, api string, source_code string, api_seq string")
    assert [tuple(r) for r in valid_samples(df, ["domain"]).collect()] == [(1, 0, "A.", "f", "web")] * 2
    scored = spark.createDataFrame([("web", ["a"], "a"), ("web", ["a"], "b"), ("app", [], None)], "domain string, refs array<string>, hyp string")
    assert {tuple(r) for r in exact_match(scored, ["domain"], "n").collect()} == {("web", 2, 50.0), ("app", 1, 0.0)}


def test_the_model_is_counted_once_and_samples_are_made_once(spark):
    from corpusmill.registry import QUERIES

    plan = lambda name: QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan("ngram_perplexity").count("Generate explode") == 1  # the tested turns
    assert "ArrowEvalPython" not in plan("completion_scores")
