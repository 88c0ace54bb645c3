"""Benchmark decontamination by winnowing, in DataFrame functions only.

A fingerprint is the least hash of the ``gram``-word runs inside a window of ``window`` words. Equal windows choose
equal fingerprints, so every window shared with an item is found by joining fingerprints; runs of neighbouring windows
with one fingerprint are one row. Around the hits the windows themselves are compared, as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, GRAM = 10, 5
LOOKUP_BYTES = 16 << 20
"""A side of a join that measures at most so much is sent to all tasks; a larger one is shuffled."""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _parts(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), _BREAKS), lambda w: w != "")


def words(text: Column) -> Column:
    """Runs of ASCII letters, digits and characters beyond ASCII, with A-Z lower-cased; null has none."""
    ascii_only = lambda w: F.octet_length(w) == F.char_length(w)
    return F.transform(_parts(text), lambda w: F.when(ascii_only(w), F.lower(w)).otherwise(F.translate(w, _UPPER, _LOWER)))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, item_ids, contaminated`` per row of ``docs(doc_id, text)``.

    A window is ``window`` consecutive words of an item of ``items(item_id, text)``; an item of fewer words, but not
    none, is one window. Each document word inside any occurrence of a window is hit. ``item_ids`` are the items with
    such windows, as strings in order. Null texts have no words, a null ``item_id`` is not listed or counted but its
    words hit; equal items are all listed. Repeated rows have equal results. Other columns are not read.
    """
    wanted = _item_windows(items, window)
    lengths = sorted(r[0] for r in wanted.select("size").distinct().collect())  # at most ``window`` numbers
    prints = wanted.select("size", _print(window, gram).alias("print")).distinct()
    keys = [F.xxhash64("doc_id").alias("id_key"), F.xxhash64("text").alias("text_key")]
    found = _spans(docs.select(*keys, words(F.col("text")).alias("ws")), lengths, window, gram)
    found = found.join(_lookup(prints, F.lit(16)), ["size", "print"], "left_semi")
    spans = found.groupBy("id_key", "text_key").agg(F.collect_list(F.struct("size", "low", "high")).alias("spans"))
    hits = _covered(docs.select(*keys, "text").join(spans, ["id_key", "text_key"]), wanted)
    sizes = docs.select("doc_id", *keys, F.size(_parts(F.col("text"))).cast("long").alias("n_words"))
    out = sizes.join(hits, ["id_key", "text_key"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), (n_hit > 0).alias("contaminated"))


def _item_windows(items: DataFrame, window: int) -> DataFrame:
    """``size, words, item_ids``: the distinct windows, with the items that hold them."""
    ws = items.select("item_id", words(F.col("text")).alias("ws")).filter("size(ws) > 0")
    sized = ws.withColumn("size", F.least(F.size("ws"), F.lit(window)))
    starts = F.sequence(F.lit(1), F.size("ws") - F.col("size") + 1)
    cut = sized.select("item_id", "size", F.explode(F.transform(starts, lambda i: F.slice("ws", i, F.col("size")))).alias("words"))
    ids = F.array_distinct(F.collect_list(F.col("item_id").cast("string")))
    return cut.groupBy("size", "words").agg(ids.alias("item_ids"))


def _hashes(ws: Column, gram: int) -> Column:
    """Hash of each run of ``gram`` words; no words, no runs."""
    last = F.size(ws) - gram + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(ws, i, gram)))).otherwise(F.array().cast("array<bigint>"))


def _least(hashes: Column, span: int) -> Column:
    """The least of each ``span`` neighbouring hashes."""
    last = F.size(hashes) - span + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.array_min(F.slice(hashes, i, span)))).otherwise(F.array().cast("array<bigint>"))


def _print(window: int, gram: int) -> Column:
    """Fingerprint of a window of ``words``; one of fewer words than ``window`` is hashed whole."""
    return F.when(F.col("size") == window, F.array_min(_hashes(F.col("words"), gram))).otherwise(F.xxhash64("words"))


def _spans(texts: DataFrame, lengths: list[int], window: int, gram: int) -> DataFrame:
    """``id_key, text_key, size, print, low, high``: the windows ``low`` to ``high`` of a text have this fingerprint."""
    none = F.array()
    out = None
    for size in lengths or [window]:
        hashes = _hashes(F.col("ws"), gram if size == window else size)
        least = texts.select("id_key", "text_key", hashes.alias("m"))
        if size == window:
            least = least.select("id_key", "text_key", _least(F.col("m"), window - gram + 1).alias("m"))
        new = F.filter(F.sequence(F.lit(1), F.size("m")), lambda i: (i == 1) | (F.get("m", i - 1) != F.get("m", i - 2)))
        begun = least.select("id_key", "text_key", "m", F.when(F.size("m") > 0, new).otherwise(none.cast("array<int>")).alias("b"))
        span = lambda k: F.struct(
            F.get("m", F.get("b", k) - 1).alias("print"),
            F.get("b", k).alias("low"),
            (F.coalesce(F.get("b", k + 1), F.size("m") + 1) - 1).alias("high"),
        )
        spans = F.when(F.size("b") > 0, F.transform(F.sequence(F.lit(0), F.size("b") - 1), span))
        part = begun.select("id_key", "text_key", F.lit(size).alias("size"), F.explode(spans).alias("s")).select("id_key", "text_key", "size", "s.*")
        out = part if out is None else out.unionByName(part)
    return out


def _lookup(rows: DataFrame, width: Column) -> DataFrame:
    """A side of a join, sent to all tasks if it measures little."""
    return F.broadcast(rows) if (rows.agg(F.sum(width)).first()[0] or 0) <= LOOKUP_BYTES else rows


def _covered(marked: DataFrame, wanted: DataFrame) -> DataFrame:
    """Compare the windows around the hits with those of the items, and count the words that equal ones cover."""
    marked = marked.select("id_key", "text_key", "spans", words(F.col("text")).alias("ws"))
    starts = lambda s: F.transform(F.sequence(s["low"], s["high"]), lambda i: F.struct(i.alias("start"), s["size"].alias("size")))
    cut = lambda x: F.struct(x["start"].alias("start"), x["size"].alias("size"), F.slice("ws", x["start"], x["size"]).alias("words"))
    near = marked.select("id_key", "text_key", F.explode(F.transform(F.array_distinct(F.flatten(F.transform("spans", starts))), cut)).alias("w"))
    sure = near.select("id_key", "text_key", "w.*").join(_lookup(wanted, F.octet_length(F.array_join("words", " ")) + 64), ["size", "words"])
    hits = sure.groupBy("id_key", "text_key").agg(
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("end")))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"),
    )
    total = F.aggregate(
        "hits",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], a["to"]))).alias("n"), F.greatest(a["to"], x["end"]).alias("to")),
        lambda a: a["n"],
    )
    return hits.select("id_key", "text_key", total.cast("long").alias("n_hit"), "item_ids")
