"""Main text of web pages: site templates are found by counting element subtrees per host, and removed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import hashing as H
from corpusmill.llm.html_tree import Block, Page, blocks_of, text_without
from corpusmill.session import cut_lineage

MIN_PAGES = 5
"""A subtree is a template of its host if it is on so many different pages of it, however many pages the host has."""
_BLOCKS = pa.list_(pa.struct([("text", pa.string()), ("inside", pa.int32())]))
_SUBTREES = pa.list_(pa.struct([("digest", pa.int64()), ("inside", pa.int32())]))


def main_text(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """``page_id, url, text`` per row of ``pages(page_id, url, html)``; other columns are not read.

    Text blocks are those of the ``article``, else of the main part, else of the page, without elements that are
    boilerplate by name, class, id or role. Subtrees on ``min_pages`` pages of a host are then deleted: any block
    element, or containers only inside an article, whose paragraphs always stay. Pages with the same text blocks count
    as one there, so that copies of a page do not make its content a template. White space inside a block becomes
    one space (a line break counts as white space), blocks are joined by line ends. A null or empty ``html`` has an
    empty text. Pages with a null ``url`` count as one host. Each row has a result of its own.
    """
    H.bounded_batches(pages.sparkSession)
    kind = pages.schema["page_id"].dataType.simpleString()
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select("page_id", "url", F.xxhash64("page_id", "url").alias("key"), F.xxhash64(host).alias("site"), "html")
    # pages are read twice, so that only digests are kept between and only texts are shuffled, once
    subtrees = cut_lineage(rows.select("key", "site", "html").mapInArrow(_subtrees, "key long, site long, page long, digest long"))
    read = rows.mapInArrow(_read, f"page_id {kind}, url string, key long, blocks array<struct<text:string,inside:int>>, subtrees array<struct<digest:long,inside:int>>")
    on = subtrees.groupBy("site", "digest").agg(F.countDistinct("page").alias("pages"))
    templates = on.filter(F.col("pages") >= min_pages).select("site", "digest")
    flagged = subtrees.join(templates, ["site", "digest"]).groupBy("key").agg(F.collect_set("digest").alias("gone"))
    return read.join(flagged, "key", "left").mapInArrow(_without, f"page_id {kind}, url string, text string")


def _pages(batch: pa.RecordBatch) -> list[Page]:
    return [blocks_of(page) if page else Page([], []) for page in batch.column("html").to_pylist()]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages = _pages(batch)
        blocks = pa.array([[b._asdict() for b in p.blocks] for p in pages], _BLOCKS)
        subtrees = pa.array([[t._asdict() for t in p.subtrees] for p in pages], _SUBTREES)
        names = ["page_id", "url", "key"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), blocks, subtrees], [*names, "blocks", "subtrees"])


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for blocks, subtrees, gone in zip(*(batch.column(n).to_pylist() for n in ("blocks", "subtrees", "gone"))):
            page = Page([(b["text"], b["inside"]) for b in blocks], [(t["digest"], t["inside"]) for t in subtrees])
            texts.append(text_without(page, set(gone or ())))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each digest of a page once, with that of the page."""
    for batch in batches:
        read = _pages(batch)
        found = [sorted({t.digest for t in page.subtrees}) for page in read]
        at = pa.array([i for i, digests in enumerate(found) for _ in digests], pa.int64())
        whole = pa.array([_page_digest(page.blocks) for page in read], pa.int64()).take(at)
        digests = pa.array([d for digests in found for d in digests], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("key").take(at), batch.column("site").take(at), whole, digests], ["key", "site", "page", "digest"])


def _page_digest(blocks: list[Block]) -> int:
    """Signed 64 bits of the texts of a page's blocks."""
    joined = "\n".join(b.text for b in blocks).encode("utf-8", "replace")
    return int.from_bytes(hashlib.blake2b(joined, digest_size=8).digest(), "little", signed=True)
