"""Counts of neighbouring symbols that follow the merges, by an inverted table from pairs to words.

A merge changes only words that hold its pair. They are found by the pair, their pairs before and after the merge are
compared, and the differences are kept as a log: counts to add, and the words that came to hold a pair. The state
is a pure function of the words and the merges so far, so tables are only ever appended to and a lost task is run again.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.session import cut_lineage, scratch_path

Merge = tuple[str, str, int]

LONG_WORD = 256
"""Longer words are not in the inverted table, where each pair repeats its words; they are looked at in every round."""
BYTES_AT_ONCE = 1 << 21
ROUNDS_PER_CHECKPOINT = 4
ROUNDS_PER_LEVEL = 16
"""The logs of so many rounds are then written as one sorted part of the tables."""
POSTINGS = "left string, right string, word binary, word_cnt long"
COUNTS = "left string, right string, cnt long"
BYTES = [f"{b:02X}" for b in range(256)]
LOG = "left string, right string, cnt long, word binary, word_cnt long"


def apply_merges(symbols: list[str], ranks: dict[tuple[str, str], list[int]], first: int, last: int) -> list[str]:
    """Merges ``first`` to ``last - 1``, each over the whole word before the next, in n log n steps.

    Unlike encoding, a pair that appears after its turn waits until it is chosen again.
    """
    symbols = list(symbols)
    after = [*range(1, len(symbols)), -1]
    before = list(range(-1, len(symbols) - 1))
    waiting: list[tuple[int, int, str, str]] = []

    def turn(i: int, j: int, least: int) -> tuple[int, int, str, str] | None:
        turns = ranks.get((symbols[i], symbols[j]), ())
        at = bisect_left(turns, least)
        return (turns[at], i, symbols[i], symbols[j]) if at < len(turns) and turns[at] < last else None

    waiting += filter(None, (turn(i, i + 1, first) for i in range(len(symbols) - 1)))
    heapify(waiting)
    while waiting:
        rank, i, left, right = heappop(waiting)
        j = after[i]
        if symbols[i] != left or j < 0 or symbols[j] != right:
            continue
        symbols[i], symbols[j] = left + right, ""
        after[i] = after[j]
        if after[i] >= 0:
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b >= 0 and (found := turn(a, b, rank + 1)):
                heappush(waiting, found)
    return [s for s in symbols if s]


def turns_of(merges: list[Merge]) -> dict[tuple[str, str], list[int]]:
    """At which places of the list a pair is merged."""
    ranks: dict[tuple[str, str], list[int]] = {}
    for i, (left, right, _) in enumerate(merges):
        ranks.setdefault((left, right), []).append(i)
    return ranks


def _differences(merges, done: int):
    """What the merges from ``done`` on change: counts, added up per batch, and the words that come to hold a pair."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = turns_of(merges.value)
        for batch in batches:
            change: Counter[tuple[str, str]] = Counter()
            found: list[tuple[str, str, int, bytes | None, int]] = []
            for word, cnt in zip(batch.column("word").to_pylist(), batch.column("word_cnt").to_pylist()):
                old = apply_merges([BYTES[b] for b in word], ranks, 0, done)
                new = apply_merges(old, ranks, done, len(merges.value))
                if len(new) == len(old):
                    continue
                was, now = list(zip(old, old[1:])), list(zip(new, new[1:]))
                for pair in was:
                    change[pair] -= cnt
                for pair in now:
                    change[pair] += cnt
                if len(word) <= LONG_WORD:
                    found += [(*pair, 0, word, cnt) for pair in set(now).difference(was)]
            rows = [(*pair, n, None, 0) for pair, n in change.items() if n] + found
            columns = list(zip(*rows)) if rows else [()] * 5
            types = [pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["left", "right", "cnt", "word", "word_cnt"])

    return compare


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``left, right, cnt``: the neighbours of all words, summed over ``BYTES_AT_ONCE`` of their text, whole words each."""
    for batch in batches:
        upto = np.cumsum(pc.binary_length(batch.column("symbols")).to_numpy(zero_copy_only=False), dtype=np.int64)
        done = 0
        while done < batch.num_rows:
            end = max(int(np.searchsorted(upto, (upto[done - 1] if done else 0) + BYTES_AT_ONCE, side="right")), done + 1)
            part = batch.slice(done, end - done)
            held = pc.split_pattern(pc.utf8_trim(part.column("symbols"), "<>"), "><")
            symbols = held.flatten().dictionary_encode()
            word = np.repeat(np.arange(len(held)), pc.list_value_length(held).to_numpy(zero_copy_only=False))
            at = symbols.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            first = np.flatnonzero(word[:-1] == word[1:])
            code = at[first] * len(symbols.dictionary) + at[first + 1]
            order = np.argsort(code, kind="stable")
            starts = np.flatnonzero(np.diff(code[order], prepend=-1))
            if len(starts):
                sums = np.add.reduceat(part.column("cnt").to_numpy(zero_copy_only=False)[word[first[order]]], starts)
                left, right = np.divmod(code[order[starts]], len(symbols.dictionary))
                take = lambda i: symbols.dictionary.take(pa.array(i))
                yield pa.RecordBatch.from_arrays([take(left), take(right), pa.array(sums, pa.int64())], ["left", "right", "cnt"])
            done = end


class PairScan:
    """Pair counts of ``words(symbols, cnt)`` taken anew from all words in every round.

    Without the tables of :class:`PairIndex` the first rounds come sooner; the work is words times rounds.
    """

    def __init__(self, words: DataFrame) -> None:
        self.rounds = 0
        # the rounds are bound by computation, so the words are spread over all cores
        cores = words.sparkSession.sparkContext.defaultParallelism
        self.words = cut_lineage(words.select("symbols", "cnt").repartition(cores))

    def top(self, n: int, min_count: int) -> list[Merge]:
        """The ``n`` most frequent pairs, ties by symbol text."""
        pairs = self.words.filter(F.col("symbols").contains("><")).select("symbols", "cnt").mapInArrow(_pair_counts, COUNTS)
        counts = pairs.groupBy("left", "right").agg(F.sum("cnt").alias("cnt")).filter(F.col("cnt") >= min_count)
        return [tuple(r) for r in counts.orderBy(F.desc("cnt"), "left", "right").limit(n).collect()]

    def merge(self, done: list[Merge], new: list[Merge]) -> None:
        """Go from the state after ``done`` to that after ``done + new``."""
        symbols = F.col("symbols")
        for left, right, _ in new:
            symbols = F.replace(symbols, F.lit(f"<{left}><{right}>"), F.lit(f"<{left}{right}>"))
        self.words = self.words.withColumn("symbols", symbols)
        self.rounds += 1
        if self.rounds % ROUNDS_PER_CHECKPOINT == 0:
            # words that are one symbol have no pairs left
            self.words = cut_lineage(self.words.filter(F.col("symbols").contains("><")))


class PairIndex:
    """Pair counts of ``words(word, symbols, cnt)`` that are kept up to date while pairs are merged.

    ``neighbours`` gives the column of all neighbours of a word as an array of ``(left, right)``. Tables are written below
    the shared scratch folder, ordered by pair, so a search for some pairs reads the row groups that hold them; a
    pair with very many words is spread over as many files as they fill. Over a whole training each posting is read
    about once, when its pair is merged. A round costs the words it changes and one sum over the distinct pairs.
    """

    def __init__(self, words: DataFrame, neighbours: Callable[[], Column]) -> None:
        self.spark = words.sparkSession
        self.root = scratch_path(self.spark, "pairs")
        self.written = 0
        self.logs: list[str] = []
        held = self._write("words", words.select(F.col("word").cast("binary").alias("word"), F.col("cnt").alias("word_cnt"), neighbours().alias("pairs")))
        rows = self.spark.read.parquet(held).filter(F.size("pairs") > 0)
        counts = rows.select(F.explode("pairs").alias("p"), "word_cnt").groupBy("p.left", "p.right").agg(F.sum("word_cnt").alias("cnt"))
        self.counts = self._write("counts", counts)
        short = rows.filter(F.octet_length("word") <= LONG_WORD)
        found = short.select(F.explode(F.array_distinct("pairs")).alias("p"), "word", "word_cnt").select("p.left", "p.right", "word", "word_cnt")
        self.postings = [self._write("postings", found.orderBy("left", "right", "word"))]
        long = rows.filter(F.octet_length("word") > LONG_WORD).select("word", "word_cnt")
        self.long = self._write("long", long)
        self.any_long = not self.spark.read.parquet(self.long).isEmpty()

    def _write(self, name: str, rows: DataFrame) -> str:
        self.written += 1
        path = f"{self.root}/{name}-{self.written}"
        rows.write.parquet(path)
        return path

    def _read(self, paths: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths)

    def current(self) -> DataFrame:
        """``(left, right, cnt)`` of the pairs that are left."""
        parts = self._read([self.counts, *self.logs], COUNTS)
        return parts.groupBy("left", "right").agg(F.sum("cnt").alias("cnt")).filter(F.col("cnt") > 0)

    def top(self, n: int, min_count: int) -> list[Merge]:
        """The ``n`` most frequent pairs, ties by symbol text."""
        ranked = self.current().filter(F.col("cnt") >= min_count).orderBy(F.desc("cnt"), "left", "right")
        return [tuple(r) for r in ranked.limit(n).collect()]

    def merge(self, done: list[Merge], new: list[Merge]) -> None:
        """Go from the state after ``done`` to that after ``done + new``."""
        wanted = reduce(lambda a, b: a | b, [(F.col("left") == l) & (F.col("right") == r) for l, r, _ in new])
        held = self._read(self.postings + self.logs, POSTINGS)
        hit = held.filter(wanted & F.col("word").isNotNull()).select("word", "word_cnt")
        if self.any_long:
            hit = hit.union(self._read([self.long], "word binary, word_cnt long"))
        merges = self.spark.sparkContext.broadcast(done + new)
        log = hit.dropDuplicates(["word"]).mapInArrow(_differences(merges, len(done)), LOG)
        self.logs.append(self._write("log", log))
        merges.destroy()
        if len(self.logs) == ROUNDS_PER_LEVEL:
            self._write_level()

    def _write_level(self) -> None:
        counts = self._write("counts", self.current())
        found = self._read(self.logs, POSTINGS).filter(F.col("word").isNotNull())
        self.postings.append(self._write("postings", found.orderBy("left", "right", "word")))
        self.counts, self.logs = counts, []
