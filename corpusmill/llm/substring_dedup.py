"""Removal of word passages that occur more than once, found by difference-cover anchors.

``COVER`` is a difference cover of ``PERIOD``: for any two positions i and j one shift below ``PERIOD`` brings both onto
cover positions. Of each text only the short windows (anchors) at cover positions are hashed; two equal windows of
``length`` words therefore share an anchor at the same place inside them. Only windows around anchors that occur
again are extended: they are hashed whole, with 96 bits, and counted. Of equal whole texts only the first is extended.

A hash that occurs several times in one Arrow batch is known to be repeated at once and leaves the batch as one row,
so a passage found in a third of all texts puts at most one row per batch on the partition of its hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from corpusmill.llm import hashing as H

PERIOD = 21
COVER = (0, 1, 4, 14, 16)
SURE, SILENT, WHOLE = 1, 2, 4
"""Of a hash: known to be repeated; not to be reported back; that of a whole text."""
COPY = 0x2545F4914F6CDD1D
_ROWS = "hash long, hash2 int, key long, value long, flags int"
_BREAKS = H.white_space()


def remove_repeats(docs: DataFrame, length: int = 35) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` per row of ``docs(doc_id, text)``; other columns are not read.

    Words are runs of bytes other than 09-0D and 20. Each word covered by a window of ``length`` words whose sequence
    also starts anywhere else (same text included) is removed; windows are judged on the input. ``kept`` holds the
    other words joined by one space. A null text has no words. Repeated rows are texts of their own, and so repeats
    of each other; a null ``doc_id`` is a value like any other. ``length`` must be at least ``PERIOD + 4``.
    """
    if length < PERIOD + 4:
        raise ValueError(f"length must be at least {PERIOD + 4}")
    H.bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)) if isinstance(kind, IntegralType) else F.xxhash64("doc_id")
    texts = docs.select("doc_id", "text", key.alias("key")).repartition("key")
    hits = _repeated(texts.mapInArrow(_finder(length, _anchors), _ROWS))
    candidates = texts.join(hits.hint("shuffle_hash"), "key").select("doc_id", "text", "key", "found")
    repeats = _repeated(candidates.mapInArrow(_finder(length, _windows), _ROWS))
    marked = texts.join(repeats.hint("shuffle_hash"), "key", "left").select("doc_id", "text", "found")
    return marked.mapInArrow(_remover(length), f"doc_id {kind.simpleString()}, n_words long, n_removed long, kept string")


def _repeated(rows: DataFrame) -> DataFrame:
    """``key, found``: for each text the hashes that occur more than once.

    A text that is a copy as a whole gets its hash if it is the first of its copies, else the hash marked as copy.
    """
    same = Window.partitionBy("hash", "hash2")
    rows = rows.withColumn("times", F.count("*").over(same)).withColumn("least", F.min("key").over(same))
    flag = F.col("flags").bitwiseAND
    copy = (flag(WHOLE) > 0) & (F.col("key") > F.col("least"))
    found = F.coalesce("value", F.when(copy, F.col("hash").bitwiseXOR(F.lit(COPY))).otherwise(F.col("hash")))
    back = rows.filter((flag(SILENT) == 0) & ((flag(SURE) > 0) | (F.col("times") > 1)))
    return back.select("key", found.alias("found")).groupBy("key").agg(F.collect_list("found").alias("found"))


def _prepared(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, number of words before each text, and the text that each word is in."""
    data, offsets = H.column_bytes(batch.column("text"))
    starts, ends, first = H.words_of(data, offsets, _BREAKS)
    return H.word_hashes(data, starts, ends), first, np.repeat(np.arange(len(first) - 1), np.diff(first))


def _whole(words: np.ndarray, first: np.ndarray, length: int, second: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The texts that have a window, and the hash of their whole word sequence."""
    texts = np.flatnonzero(np.diff(first) >= length)
    return texts, H.mixed(H.window_hashes(words, first[texts], np.diff(first)[texts], second))


def _anchor_places(first: np.ndarray, text: np.ndarray, length: int) -> np.ndarray:
    """Cover positions at which an anchor fits into a text that has a window."""
    on = np.zeros(PERIOD, bool)
    on[list(COVER)] = True
    place = np.arange(len(text)) - first[text]
    size = np.diff(first)[text]
    return np.flatnonzero(on[place % PERIOD] & (place + length - PERIOD + 1 <= size) & (size >= length))


def _around(hit: np.ndarray, first: np.ndarray, text: np.ndarray, length: int) -> np.ndarray:
    """Starts of the windows that hold one of these anchors at a shift below ``PERIOD``."""
    step = np.zeros(len(text) + 1, np.int64)
    np.add.at(step, np.maximum(hit - PERIOD + 1, first[text[hit]]), 1)
    np.add.at(step, hit + 1, -1)
    near = np.flatnonzero(np.cumsum(step)[:-1] > 0)
    return near[near + length <= first[text[near] + 1]]


def _found(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("found")
    return np.unique(H.unsigned(column.flatten()))


def _anchors(batch: pa.RecordBatch, length: int) -> list[np.ndarray]:
    """Hash, second hash, text, flags and value of all anchors and of all whole texts."""
    words, first, text = _prepared(batch)
    at = _anchor_places(first, text, length)
    one = H.window_hashes(words, at, length - PERIOD + 1)
    texts, whole = _whole(words, first, length)
    second = _whole(words, first, length, second=True)[1] | np.uint64(1)
    return [
        np.concatenate([one, whole]),
        np.concatenate([np.zeros(len(one), np.int32), second.astype(np.int32)]),
        np.concatenate([text[at], texts]),
        np.concatenate([np.zeros(len(one), np.int32), np.full(len(texts), WHOLE, np.int32)]),
    ]


def _windows(batch: pa.RecordBatch, length: int) -> list[np.ndarray]:
    """The windows around repeated anchors; of copies of a whole text, those of the first only."""
    words, first, text = _prepared(batch)
    found = _found(batch)
    texts, whole = _whole(words, first, length)
    role = np.zeros(len(first) - 1, np.int8)
    role[texts[np.isin(whole ^ np.uint64(COPY), found)]] = 2
    role[texts[np.isin(whole, found)]] = 1
    at = _anchor_places(first, text, length)
    hit = at[(role[text[at]] < 2) & np.isin(H.window_hashes(words, at, length - PERIOD + 1), found)]
    at = _around(hit, first, text, length)
    return [
        H.window_hashes(words, at, length),
        H.window_hashes(words, at, length, second=True).astype(np.int32),
        text[at],
        (role[text[at]] == 1) * np.int32(SURE | SILENT),
        texts[role[texts] > 0],
        whole[role[texts] > 0],
    ]


def _finder(length: int, hashed):
    """Rows of ``_ROWS``: each hash of a batch once, and again for each further text it is in.

    The further rows are known to be repeats; they are dealt by their text, not by their hash.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two, text, flags, *copies = hashed(batch, length)
            keys = H.unsigned(batch.column("key"))
            order = np.lexsort((text, two, one))
            one, two, text, flags = one[order], two[order], text[order], flags[order]
            new = np.ones(len(one), bool)
            new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
            run, begin = np.cumsum(new) - 1, np.flatnonzero(new)
            if len(one):
                many = np.diff(np.append(begin, len(one))) > 1
                flags = flags | (many | (np.bitwise_or.reduceat(flags, begin) & SURE > 0)).astype(np.int32)[run] * np.int32(SURE)
            further = ~new & ((flags & SILENT) == 0)
            further[1:] &= text[1:] != text[:-1]
            value = np.where(flags & WHOLE > 0, one ^ np.uint64(COPY), one)
            parts = [(one[new], two[new], keys[text[new]], flags[new], None), _dealt(keys[text[further]], value[further])]
            if copies:
                parts.append(_dealt(keys[copies[0]], copies[1]))
            for hash1, hash2, key, flag, back in parts:
                columns = [pa.array(H.signed(hash1)), pa.array(hash2), pa.array(H.signed(key)), pa.nulls(len(key), pa.int64()) if back is None else pa.array(H.signed(back)), pa.array(flag)]
                yield pa.RecordBatch.from_arrays(columns, ["hash", "hash2", "key", "value", "flags"])

    return find


def _dealt(key: np.ndarray, value: np.ndarray) -> tuple:
    """Rows that only carry a value back to its text."""
    return H.mixed(key ^ H.mixed(value)), np.full(len(key), -1, np.int32), key, np.full(len(key), SURE, np.int32), value


def _remover(length: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, first, text = _prepared(batch)
            inside = np.flatnonzero(np.arange(len(words)) + length <= first[text + 1]) if len(words) else np.zeros(0, np.int64)
            again = np.zeros(len(words) + 1, np.int64)
            found = _found(batch)
            if len(found) and len(inside):
                texts, whole = _whole(words, first, length)
                copy = np.zeros(len(first), bool)
                copy[texts[np.isin(whole, found)]] = True
                at = inside[copy[text[inside]] | np.isin(H.window_hashes(words, inside, length), found)]
                np.add.at(again, at, 1)
                np.add.at(again, at + length, -1)
            gone = np.cumsum(again)[:-1] > 0
            counts, kept = np.diff(first), []
            removed = np.add.reduceat(np.append(gone, False).astype(np.int64), first[:-1]) * (counts > 0) if len(counts) else counts
            for i, value in enumerate(batch.column("text")):
                parts = (value.as_buffer().to_pybytes() if value.is_valid else b"").split()
                if removed[i]:
                    parts = [w for w, out in zip(parts, gone[first[i] : first[i + 1]].tolist()) if not out]
                kept.append(b" ".join(parts))
            columns = [batch.column("doc_id"), pa.array(counts.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept"])

    return remove
