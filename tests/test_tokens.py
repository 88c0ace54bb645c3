import random
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from corpusmill.operators import pair_index
from corpusmill.operators.blocks import assign_batches, pack_blocks
from corpusmill.operators.bpe import Bpe, encode, load_bpe, merge_symbols, sure_merges, train_bpe, write_vocab

TEXTS = [
    "public static void main(String[] args) { return; }",
    "for (int i = 0; i < n; i++) {\n\tsum += array[i];\n}",
    "it's  the\n\n  café \U0001d4b3 we'll see aaaa aaa aa",
    "public int getValue() { return value; } public void setValue(int value)",
    "",
] * 3
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def corpus(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "row_id long, source_code string")


def merge_word(symbols, pair):
    out, i = [], 0
    while i < len(symbols):
        if tuple(symbols[i : i + 2]) == pair:
            out.append("".join(pair))
            i += 2
        else:
            out.append(symbols[i])
            i += 1
    return out


def brute_bpe(texts, n_merges):
    words = Counter(w for t in texts for w in WORD.findall(t))
    split = {w: [f"{b:02X}" for b in w.encode()] for w in words}
    merges = []
    for _ in range(n_merges):
        pairs = Counter()
        for w, c in words.items():
            for p in zip(split[w], split[w][1:]):
                pairs[p] += c
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p], p))
        merges.append((*best, pairs[best]))
        split = {w: merge_word(s, best) for w, s in split.items()}
    return merges


def test_training_with_several_merges_per_round_is_exact(spark):
    bpe = train_bpe(corpus(spark), 257 + 40, n_rows=None)
    want = brute_bpe(TEXTS, len(bpe.merges))
    assert bpe.merges == want and len(bpe.tokens) == 297


@pytest.mark.parametrize("seed", [1, 2])
def test_training_on_random_text_is_exact(spark, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 7))) for _ in range(60)]
    texts = [" ".join(rng.choices(words, weights=range(60), k=50)) for _ in range(12)]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, source_code string")
    bpe = train_bpe(df, 257 + 60, n_rows=None)
    assert bpe.merges == brute_bpe(texts, len(bpe.merges))


def test_recounting_gives_the_merges_of_the_index(spark):
    assert train_bpe(corpus(spark), 257 + 40, index=False) == train_bpe(corpus(spark), 257 + 40)


def test_index_over_long_and_repeated_words_and_several_levels(spark, monkeypatch):
    monkeypatch.setattr(pair_index, "ROUNDS_PER_LEVEL", 2)
    rng = random.Random(5)
    # longer than the limit of the index, equal letters, words that come in many rows
    texts = ["".join(rng.choices("ab", k=pair_index.LONG_WORD + 50)), "aaaaaaa aaa aaaa", "abab abba baab"] * 3 + ["a" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, source_code string")
    bpe = train_bpe(df, 257 + 12)
    assert bpe.merges == brute_bpe(texts, len(bpe.merges)) and len(bpe.tokens) == 269


def test_training_without_words(spark):
    none = spark.createDataFrame([(1, None), (2, "")], "row_id long, source_code string")
    assert train_bpe(none, 300).merges == train_bpe(none.limit(0), 300).merges == []


def test_merges_wait_for_their_turn():
    merges = [("b", "c", 1), ("a", "b", 1), ("b", "c", 1)]
    ranks = pair_index.turns_of(merges)
    for text in ("abcbc", "aabbcc", "bcabc", "", "a"):
        for first in range(3):
            want = list(text)
            for left, right, _ in merges[first:]:
                want = merge_word(want, (left, right))
            assert pair_index.apply_merges(list(text), ranks, first, 3) == want


def test_sure_merges():
    top = [("a", "b", 9), ("c", "d", 8), ("b", "x", 7), ("e", "f", 6)]
    assert sure_merges(top, set(), True, 9) == [("a", "b", 9), ("c", "d", 8)]
    # sharing a left or a right symbol does no harm
    assert sure_merges([("a", "b", 9), ("a", "d", 8), ("c", "b", 7)], set(), True, 9) == [("a", "b", 9), ("a", "d", 8), ("c", "b", 7)]
    assert sure_merges([("a", "a", 9), ("c", "d", 8)], set(), True, 9) == [("a", "a", 9)]
    assert sure_merges([("a", "b", 9), ("c", "d", 8)], {"ab"}, True, 9) == [("a", "b", 9)]
    # a tie behind the chosen pair that shares a symbol, or that may go on out of sight
    assert sure_merges([("a", "b", 9), ("c", "d", 8), ("e", "a", 8)], set(), True, 9) == [("a", "b", 9)]
    assert sure_merges([("a", "b", 9), ("c", "d", 8)], set(), False, 9) == [("a", "b", 9)]


def test_encode(spark):
    bpe = Bpe([("61", "61", 0), ("61", "62", 0)], ["<|endoftext|>"] + [f"{b:02X}" for b in range(256)] + ["6161", "6162"])
    df = spark.createDataFrame([(0, "aaab"), (1, "abab"), (2, ""), (3, None)], "row_id long, source_code string")
    rows = encode(df, bpe, bos_id=0, eos_id=0, masks=True).orderBy("row_id").collect()
    assert [r["input_ids"] for r in rows[:3]] == [[0, 257, 258, 0], [0, 258, 258, 0], [0, 0]]
    assert rows[0]["special_tokens_mask"] == [1, 0, 0, 1] and rows[0]["attention_mask"] == [1] * 4


def test_encoding_is_reversible_and_follows_the_merges(spark, tmp_path):
    bpe = train_bpe(corpus(spark), 257 + 30, n_rows=None)
    write_vocab(bpe, spark, str(tmp_path / "vocab"))
    back = load_bpe(spark.read.parquet(str(tmp_path / "vocab" / "merges")), spark.read.parquet(str(tmp_path / "vocab" / "vocab")))
    assert back == bpe
    rows = encode(corpus(spark), back).orderBy("row_id").collect()
    for row, text in zip(rows, TEXTS):
        assert bytes.fromhex("".join(bpe.tokens[i] for i in row["input_ids"])).decode() == text
        want = []
        for word in WORD.findall(text):
            symbols = [f"{b:02X}" for b in word.encode()]
            for left, right, _ in bpe.merges:
                symbols = merge_word(symbols, (left, right))
            want += symbols
        assert [bpe.tokens[i] for i in row["input_ids"]] == want


def test_pack_blocks_edges(spark):
    rows = [(0, [1, 2, 3]), (1, [4, 5]), (2, [6, 7, 8, 9]), (3, [1, 2]), (4, []), (5, [])]
    df = spark.createDataFrame(rows, "row_id long, input_ids array<int>")
    packed = pack_blocks(df, 4, group_size=3).orderBy("block_group", "block_no").collect()
    assert [tuple(r) for r in packed] == [(0, 0, [1, 2, 3, 4]), (0, 1, [5, 6, 7, 8]), (1, 0, [1, 2])]


@pytest.mark.parametrize("length", [1, 3, 7, 50])
def test_pack_blocks_brute_force(spark, length):
    lists = [[(i * 7 + j) % 11 for j in range(i % 9)] for i in range(40)]
    df = spark.createDataFrame([(i * 5, ids, ids[::-1]) for i, ids in enumerate(lists)], "row_id long, input_ids array<int>, other array<int>")
    packed = pack_blocks(df.repartition(3), length, group_size=8, cols=["input_ids", "other"]).orderBy("block_group", "block_no").collect()
    want = []
    for g in range(5):
        a = [x for ids in lists[g * 8 : g * 8 + 8] for x in ids]
        b = [x for ids in lists[g * 8 : g * 8 + 8] for x in ids[::-1]]
        n = len(a) // length * length if len(a) >= length else len(a)
        want += [(g, k // length, a[k : k + length][: n - k], b[k : k + length][: n - k]) for k in range(0, n, length)]
    assert [tuple(r) for r in packed] == want


def test_batches(spark):
    df = spark.range(10, 33).withColumnRenamed("id", "row_id")
    plain = assign_batches(df, 5).orderBy("row_id").collect()
    assert [(r["batch"], r["slot"]) for r in plain] == [(i // 5, i % 5) for i in range(23)]
    shuffled = assign_batches(df, 5, seed=1).groupBy("batch").agg(F.count("*").alias("n")).orderBy("batch").collect()
    assert [r["n"] for r in shuffled] == [5, 5, 5, 5, 3]


def test_a_very_long_word_is_merged_as_by_the_plain_loop():
    draw = random.Random(2)
    rank = {p: i for i, p in enumerate([("a", "b"), ("b", "a"), ("ab", "a"), ("a", "a"), ("aa", "aa"), ("ba", "b"), ("ab", "ab")])}

    def plain(symbols):
        while len(symbols) > 1:
            best = min(zip(symbols, symbols[1:]), key=lambda p: rank.get(p, len(rank)))
            if best not in rank:
                break
            out, i = [], 0
            while i < len(symbols):
                hit = symbols[i : i + 2] == list(best)
                out.append("".join(best) if hit else symbols[i])
                i += 2 if hit else 1
            symbols = out
        return symbols

    for n in (0, 1, 2, 3, 5, 8, 40, 200):
        for _ in range(20):
            word = draw.choices("ab", k=n)
            assert merge_symbols(list(word), rank) == plain(list(word))
    assert len(merge_symbols(["a"] * 1_000_000, rank)) == 250_000


def test_a_batch_is_encoded_a_few_words_at_a_time(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    from corpusmill.operators import bpe as module

    made = module.Bpe([("61", "62", 1)], [module.END_OF_TEXT, *(f"{b:02X}" for b in range(256)), "6162"])
    rows = [["ab", "abc"], None, [], ["x"] * 7, ["ab"], [], None, ["é", "ab"]]
    words = pa.array(rows, pa.list_(pa.string()))
    whole = module.word_encoder(made)(words)
    assert whole.to_pylist()[3:5] == [[121] * 7, [257]]
    monkeypatch.setattr(module, "WORDS_AT_ONCE", 3)
    for part in (words, words.slice(2, 4), words.slice(0, 0)):
        want = [[i for w in row or [] for i in ([257] + [b + 1 for b in w[2:].encode()] if w[:2] == "ab" else [b + 1 for b in w.encode()])] for row in part.to_pylist()]
        assert module.word_encoder(made)(part).to_pylist() == want
    monkeypatch.undo()
    many = pa.array([["some", "words", "here"] * 100] * 4000, pa.list_(pa.string()))
    encode_batch = module.word_encoder(made)
    tracemalloc.start()
    encode_batch(many)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20  # 5.2 million tokens; at once they took several times as much


def test_words_are_encoded_side_by_side(monkeypatch):
    import pyarrow as pa

    from corpusmill.operators import bpe as module

    monkeypatch.setattr(module, "LONG_WORD", 12)
    draw = random.Random(15)
    for _ in range(60):
        tokens, symbols, merges = [module.END_OF_TEXT, *(f"{b:02X}" for b in range(256))], ["61", "62", "C3", "A9"], []
        for _ in range(draw.randrange(12)):
            left, right = draw.choice(symbols), draw.choice(symbols)
            merges.append((left, right, 1))
            if left + right not in tokens:
                tokens.append(left + right)
                symbols.append(left + right)
        made, rank = module.Bpe(merges, tokens), {}
        for i, (left, right, _) in enumerate(merges):
            rank.setdefault((left, right), i)
        words = ["".join(draw.choices("abé", k=draw.choice([0, 1, 2, 5, 12, 13, 30]))) for _ in range(40)]
        want = [[tokens.index(s) for s in module.merge_symbols([f"{b:02X}" for b in w.encode()], rank)] if w else [] for w in words]
        monkeypatch.setattr(module, "BYTES_AT_ONCE", draw.choice([1, 20, 1 << 18]))
        flat, sizes = module.distinct_encoder(made)(pa.array(words))
        ends = sizes.cumsum().tolist()
        assert [flat[b - n : b].tolist() for b, n in zip(ends, sizes.tolist())] == want
    with pytest.raises(KeyError):
        module.distinct_encoder(module.Bpe([("61", "62", 1)], tokens[:257]))(pa.array(["ab"]))


def test_pairs_of_words_are_counted_by_batch(monkeypatch):
    import pyarrow as pa

    from corpusmill.operators import pair_index as module

    draw = random.Random(16)
    words = [["".join(draw.choices(["61", "62", "6162"], k=1)) for _ in range(draw.randrange(1, 9))] for _ in range(50)]
    times = [draw.randrange(1, 1 << 55) for _ in words]  # more than a float holds
    want = Counter()
    for word, n in zip(words, times):
        for pair in zip(word, word[1:]):
            want[pair] += n
    rows = pa.RecordBatch.from_arrays([pa.array(["<" + "><".join(w) + ">" for w in words]), pa.array(times)], ["symbols", "cnt"])
    for size in (1, 60, 1 << 21):
        monkeypatch.setattr(module, "BYTES_AT_ONCE", size)
        got = Counter()
        for batch in module._pair_counts([rows, rows.slice(0, 0)]):
            for row in batch.to_pylist():
                got[row["left"], row["right"]] += row["cnt"]
        assert got == want
