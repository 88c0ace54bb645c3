"""Byte-level byte-pair encoding: training on word counts and encoding of a corpus.

A word is held as text of its byte symbols in hex, ``<61><6263>``; a merge is then a literal
``replace`` of two neighbouring symbols.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.pair_index import PairIndex, PairScan
from corpusmill.operators.rows import head_rows
from corpusmill.schemas import MERGES, VOCAB

# Fixed value: how text is cut into words before any merge.
WORD = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Fixed value: the one token that stands for no text.
END_OF_TEXT = "<|endoftext|>"

CANDIDATES = 1024
MERGES_PER_ROUND = 128
WORDS_AT_ONCE = 1 << 17
BYTES_AT_ONCE = 1 << 18
LONG_WORD = 64
"""Longer words are merged one by one: each pass over many words makes one merge in each of them."""


@dataclass(frozen=True)
class Bpe:
    """A trained vocabulary. Its size is set by ``vocab_size``, not by the corpus."""

    merges: list[tuple[str, str, int]]
    tokens: list[str]

    def merge_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, l, r, n) for i, (l, r, n) in enumerate(self.merges)], MERGES)

    def vocab_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(enumerate(self.tokens)), VOCAB)


def pre_tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def word_counts(df: DataFrame, text: str = "source_code") -> DataFrame:
    """``(word, symbols, cnt)`` of the distinct words."""
    counts = df.select(F.explode(pre_tokens(text)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))
    symbols = F.regexp_replace(F.hex(F.encode("word", "UTF-8")), "(..)", "<$1>")
    return counts.select("word", symbols.alias("symbols"), "cnt")


def neighbours(symbols: str = "symbols") -> Column:
    """All neighbours of a word in order, as an array of ``(left, right)``."""
    held = F.split(F.substring(F.col(symbols), F.lit(2), F.length(symbols) - 2), "><", -1)
    return F.zip_with(
        F.slice(held, F.lit(1), F.size(held) - 1),
        F.slice(held, F.lit(2), F.size(held) - 1),
        lambda left, right: F.struct(left.alias("left"), right.alias("right")),
    )


def sure_merges(top: list[tuple[str, str, int]], known: set[str], complete: bool, most: int) -> list[tuple[str, str, int]]:
    """The leading pairs that one-at-a-time merging would choose in this order.

    Merging ``(l, r)`` changes the counts of pairs that start with ``r`` or end with ``l``, and
    of no others: the symbol of any other pair has a different neighbour there. The pairs it
    creates come from those same pairs and cannot exceed their counts. So the next pair is
    sure while no pair of at least its count starts with a chosen ``r`` or ends with a chosen
    ``l``. A pair of equal symbols, or one whose joint symbol exists already, can raise others
    and ends the list, as does a tie that reaches the end of an incomplete ``top``.
    """
    chosen: list[tuple[str, str, int]] = []
    lefts: set[str] = set()
    rights: set[str] = set()
    made: set[str] = set()
    for left, right, count in top:
        if chosen:
            if not complete and top[-1][2] == count:
                break
            if any(n >= count and (x in rights or y in lefts) for x, y, n in top):
                break
        chosen.append((left, right, count))
        lefts.add(left)
        rights.add(right)
        if left == right or left + right in known | made or len(chosen) == most:
            break
        made.add(left + right)
    return chosen


def train_bpe(
    df: DataFrame,
    vocab_size: int = 32_768,
    n_rows: int | None = None,
    text: str = "source_code",
    id_col: str = "row_id",
    min_count: int = 1,
    merges_per_round: int = MERGES_PER_ROUND,
    index: bool = True,
) -> Bpe:
    """Merge the most frequent pair until the vocabulary is full; ties by symbol text.

    All rows are counted; ``n_rows`` limits that to the first rows by id.

    Pair counts of the distinct words are taken once and then follow the merges by the words
    that each round changes. For a few merges the tables this takes do not pay; without
    ``index`` every round counts all words, with the same result. The top candidates, a bounded number, reach the driver, which
    takes as many merges from them as are sure.
    """
    rows = df if n_rows is None else head_rows(df.select(id_col, text), n_rows, id_col=id_col)
    counted = word_counts(rows, text)
    pairs = PairIndex(counted, neighbours) if index else PairScan(counted)
    tokens = [END_OF_TEXT] + [f"{b:02X}" for b in range(256)]
    known, merges = set(tokens), []
    while len(tokens) < vocab_size:
        top = pairs.top(CANDIDATES, min_count)
        if not top:
            break
        new = sure_merges(top, known, len(top) < CANDIDATES, min(merges_per_round, vocab_size - len(tokens)))
        for left, right, _ in new:
            if left + right not in known:
                known.add(left + right)
                tokens.append(left + right)
        if len(tokens) < vocab_size:
            pairs.merge(merges, new)
        merges += new
    return Bpe(merges, tokens)


def load_bpe(merges: DataFrame, vocab: DataFrame) -> Bpe:
    """Read a vocabulary back; both tables have at most ``vocab_size`` rows."""
    return Bpe(
        [(r["left"], r["right"], r["cnt"]) for r in merges.orderBy("rank").collect()],
        [r["token"] for r in vocab.orderBy("id").collect()],
    )


def write_vocab(bpe: Bpe, spark: SparkSession, path: str) -> None:
    """Write ``merges`` and ``vocab`` below ``path``."""
    bpe.merge_table(spark).write.mode("overwrite").parquet(f"{path}/merges")
    bpe.vocab_table(spark).write.mode("overwrite").parquet(f"{path}/vocab")


def merge_symbols(symbols: list[str], rank: dict[tuple[str, str], int]) -> list[str]:
    """Merge neighbours, best rank first and from the left, until no pair has a rank.

    Pairs wait in a heap and symbols in a linked list, so a word of n symbols takes about
    n log n steps. A pair that one of its symbols has left meanwhile is passed over.
    """
    after = [*range(1, len(symbols)), -1]
    before = list(range(-1, len(symbols) - 1))
    waiting = [(rank[p], i, *p) for i, p in enumerate(zip(symbols, symbols[1:])) if p in rank]
    heapify(waiting)
    while waiting:
        _, i, left, right = heappop(waiting)
        j = after[i]
        if symbols[i] != left or j < 0 or symbols[j] != right:
            continue
        symbols[i], symbols[j] = left + right, ""
        after[i] = after[j]
        if after[i] >= 0:
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b >= 0 and (pair := (symbols[a], symbols[b])) in rank:
                heappush(waiting, (rank[pair], a, *pair))
    return [s for s in symbols if s]


def distinct_encoder(bpe: Bpe):
    """Function from an array of words to the token ids of all of them, one after the other, and their number for each word.

    Words are merged side by side: a pass makes in each word the merge that :func:`merge_symbols` would make next.
    """
    rank: dict[tuple[str, str], int] = {}
    for i, (left, right, _) in enumerate(bpe.merges):
        rank.setdefault((left, right), i)
    ids = {token: i for i, token in enumerate(bpe.tokens)}
    n_tokens = len(bpe.tokens)
    for pair in rank:
        for symbol in (*pair, "".join(pair)):
            ids.setdefault(symbol, n_tokens + len(ids))  # no token; an error if it is left
    base = n_tokens + len(ids) + 1
    codes, ranks, joint = np.array(sorted((ids[x] * base + ids[y], r, ids[x + y]) for (x, y), r in rank.items()), np.int64).reshape(-1, 3).T.copy()
    of_rank = np.zeros(len(bpe.merges), np.int64)
    of_rank[ranks] = joint
    of_byte = np.array([ids.get(f"{b:02X}", n_tokens + len(ids)) for b in range(256)], np.int64)

    def side_by_side(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        symbols, word = of_byte[data], np.repeat(np.arange(len(sizes)), sizes)
        alive, at = np.ones(len(symbols), bool), np.arange(len(symbols) if len(codes) else 0)
        while len(at):
            s, w = symbols[at], word[at]
            code = s[:-1] * base + s[1:]
            place = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            found = np.flatnonzero((codes[place] == code) & (w[:-1] == w[1:]))
            if not len(found):
                break
            # the best rank of each word, and of its places the first
            order = found[np.lexsort((found, ranks[place[found]], w[found]))]
            best = order[np.flatnonzero(np.diff(w[order], prepend=-1))]
            symbols[at[best]] = of_rank[ranks[place[best]]]
            alive[at[best + 1]] = False
            busy = np.zeros(len(sizes), bool)
            busy[w[best]] = True
            at = at[alive[at] & busy[w]]
        return symbols[alive], np.bincount(word[alive], minlength=len(sizes))

    def one_by_one(word: bytes) -> np.ndarray:
        return np.array([ids[s] for s in merge_symbols([f"{b:02X}" for b in word], rank)], np.int64)

    def encode_distinct(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words = words.cast(pa.large_binary())
        offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        data, lengths = np.frombuffer(words.buffers()[2] or b"", np.uint8), np.diff(offsets)
        flat, sizes, at = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
        long = np.append(np.flatnonzero(lengths > LONG_WORD), len(lengths))
        while at < len(lengths):
            if lengths[at] > LONG_WORD:
                stop = at + 1
                pieces = one_by_one(data[offsets[at] : offsets[stop]].tobytes())
                n = np.array([len(pieces)], np.int64)
            else:
                stop = max(int(np.searchsorted(offsets, offsets[at] + BYTES_AT_ONCE, "right")) - 1, at + 1)
                stop = min(stop, int(long[np.searchsorted(long, at)]))
                pieces, n = side_by_side(data[offsets[at] : offsets[stop]], lengths[at:stop])
            if len(pieces) and pieces.max() >= n_tokens:
                raise KeyError("a merge makes a symbol that is no token")
            flat.append(pieces.astype(np.int32))
            sizes.append(n)
            at = stop
        return np.concatenate(flat), np.concatenate(sizes)

    return encode_distinct


def word_encoder(bpe: Bpe):
    """Arrow function from arrays of words to arrays of token ids.

    Each distinct word is encoded once in ``8 * WORDS_AT_ONCE`` words; the rest is index arithmetic. It takes several wide
    numbers for a token, so it is done for ``WORDS_AT_ONCE`` words at a time, whole rows each.
    """
    encode_distinct = distinct_encoder(bpe)

    def row_spans(n_words: np.ndarray, most: int) -> Iterator[slice]:
        upto, done = np.cumsum(n_words), 0
        while done < len(n_words):
            before = upto[done - 1] if done else 0
            end = max(int(np.searchsorted(upto, before + most, side="right")), done + 1)
            yield slice(done, end)
            done = end

    def encode_rows(at: np.ndarray, n_words: np.ndarray, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum(sizes[at])])
        source = np.repeat(starts[at] - ends[:-1], sizes[at]) + np.arange(ends[-1])
        offsets = ends[np.concatenate([[0], np.cumsum(n_words)])]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat[source], pa.int32()))

    def encode_batch(words: pa.Array) -> pa.Array:
        n_words = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        parts = [pa.array([], pa.list_(pa.int32()))]
        for span in row_spans(n_words, 8 * WORDS_AT_ONCE):
            distinct = words.slice(span.start, span.stop - span.start).flatten().dictionary_encode()
            flat, sizes = encode_distinct(distinct.dictionary)
            starts, at, own = np.cumsum(sizes) - sizes, distinct.indices.to_numpy(zero_copy_only=False), n_words[span]
            before = np.concatenate([[0], np.cumsum(own)])
            for rows in row_spans(own, WORDS_AT_ONCE):
                parts.append(encode_rows(at[before[rows.start] : before[rows.stop]], own[rows], flat, starts, sizes))
        return pa.concat_arrays(parts)

    return encode_batch


def encode(
    df: DataFrame, bpe: Bpe, text: str = "source_code", out: str = "input_ids",
    bos_id: int | None = None, eos_id: int | None = None, masks: bool = False,
) -> DataFrame:
    """Add the token ids of a text column, in one pass without a shuffle.

    ``bos_id`` and ``eos_id`` are added where given; ``masks`` adds ``attention_mask`` and
    ``special_tokens_mask``.
    """
    encode_batch = word_encoder(bpe)

    def encode_words(words: pa.Array) -> pa.Array:
        return encode_batch(words)

    ids = F.arrow_udf(encode_words, "array<int>")(pre_tokens(text))
    encoded = df.withColumn("_ids", ids)

    def framed(inner: Column, bos: int | None, eos: int | None) -> Column:
        parts = [F.array(F.lit(bos))] if bos is not None else []
        parts.append(inner)
        parts += [F.array(F.lit(eos))] if eos is not None else []
        return F.concat(*parts) if len(parts) > 1 else inner

    encoded = encoded.withColumn(out, framed(F.col("_ids"), bos_id, eos_id))
    if masks:
        flag = lambda i: None if i is None else 1
        encoded = encoded.withColumns(
            {
                "attention_mask": F.array_repeat(F.lit(1), F.size(out)),
                "special_tokens_mask": framed(F.array_repeat(F.lit(0), F.size("_ids")), flag(bos_id), flag(eos_id)),
            }
        )
    return encoded.drop("_ids")
