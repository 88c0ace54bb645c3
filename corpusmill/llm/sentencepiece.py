"""SentencePiece models run by the ``tokenizers`` library: read from the model file, rebuilt, checked against it.

The protobuf is parsed here: pieces with scores and types, model type, normaliser. Unigram models keep their scores;
of BPE models the merges are all splits of a piece into two pieces, best score first. Then: normaliser, the mark for
white space with its dummy prefix, byte fallback, decoder.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType
from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

from corpusmill.llm import hashing as H

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
_WORD = f"{MARK}*[^{MARK}]+|{MARK}+"
_PIECE = 1 << 18
"""Bytes of text that one call encodes: bounds the encodings held at a time."""


class Model(NamedTuple):
    pieces: list[tuple[str, float, int]]
    kind: int
    byte_fallback: bool
    charsmap: bytes
    dummy_prefix: bool
    squeeze: bool
    """Leading, trailing and repeated spaces are dropped."""
    escape: bool
    suffix: bool


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protobuf message: integers, or bytes for all else."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = varint()
        wire = key & 7
        if wire == 0:
            yield key >> 3, varint()
            continue
        size = varint() if wire == 2 else {1: 8, 5: 4}[wire]
        yield key >> 3, message[at : at + size]
        at += size


def parse_model(data: bytes) -> Model:
    pieces, trainer, normalizer = [], {}, {}
    for number, value in fields(data):
        if number == 1:
            piece = dict(fields(value))
            pieces.append((piece[1].decode(), struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0], piece.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(fields(value))
        elif number == 3:
            normalizer = dict(fields(value))
    kind = trainer.get(3, UNIGRAM)
    if kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models are supported")
    flags = [bool(normalizer.get(n, 1)) for n in (3, 4, 5)]
    return Model(pieces, kind, bool(trainer.get(35, 0)), normalizer.get(2, b""), *flags, bool(trainer.get(24, 0)))


def build_tokenizer(model: Model) -> Tokenizer:
    if not model.escape or model.suffix:
        raise ValueError("models that do not mark white space before words are not supported")
    ids = {piece: i for i, (piece, _, _) in enumerate(model.pieces)}
    unknown = next((i for i, p in enumerate(model.pieces) if p[2] == UNKNOWN), None)
    if model.kind == UNIGRAM:
        core = models.Unigram([(piece, score) for piece, score, _ in model.pieces], unk_id=unknown, byte_fallback=model.byte_fallback)
    else:
        name = None if unknown is None else model.pieces[unknown][0]
        core = models.BPE(ids, _merges(model, ids), unk_token=name, fuse_unk=True, byte_fallback=model.byte_fallback, cache_capacity=100_000)
    out = Tokenizer(core)
    steps: list = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    out.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    if not any(MARK in piece.lstrip(MARK) for piece, _, kind in model.pieces if kind in (NORMAL, USER)):
        # no piece goes on beyond a mark that follows something else: words can be encoded apart
        out.pre_tokenizer = pre_tokenizers.Split(Regex(_WORD), "isolated")
    out.add_tokens([AddedToken(piece, normalized=True) for piece, _, kind in model.pieces if kind == USER])
    parts: list = [decoders.Replace(MARK, " "), *([decoders.ByteFallback()] if model.byte_fallback else []), decoders.Fuse()]
    out.decoder = decoders.Sequence([*parts, *([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])])
    return out


def _merges(model: Model, ids: dict[str, int]) -> list[tuple[str, str]]:
    """Two parts of each piece, the pieces by falling score."""
    usable = {piece for piece, _, kind in model.pieces if kind in (NORMAL, UNUSED)}
    ranked = sorted((p for p in model.pieces if p[0] in usable and len(p[0]) > 1), key=lambda p: -p[1])
    out = []
    for piece, _, _ in ranked:
        splits = [(piece[:i], piece[i:]) for i in range(1, len(piece)) if piece[:i] in usable and piece[i:] in usable]
        out += sorted(splits, key=lambda s: (ids[s[0]], ids[s[1]]))
    return out


class _Lists:
    """Integer lists one after the other in one array that grows by doubling."""

    def __init__(self, kind: type):
        self.values, self.begin, self.size = np.zeros(1024, kind), np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.lists = self.used = 0

    def extend(self, values: np.ndarray, sizes: np.ndarray) -> None:
        for name, count in (("values", self.used + len(values)), ("begin", self.lists + len(sizes)), ("size", self.lists + len(sizes))):
            have = getattr(self, name)
            if count > len(have):
                setattr(self, name, np.concatenate([have, np.zeros(count, have.dtype)]))
        self.values[self.used : self.used + len(values)] = values
        self.begin[self.lists : self.lists + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.size[self.lists : self.lists + len(sizes)] = sizes
        self.used, self.lists = self.used + len(values), self.lists + len(sizes)

    def joined(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of these numbers one after the other, and where each of them ends."""
        sizes = self.size[which]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.values[np.repeat(self.begin[which] - ends + sizes, sizes) + np.arange(total)], ends


class Encoder:
    """Encodes with ``threads`` threads; where words are encoded apart, each distinct word once while it is remembered."""

    REMEMBERED_BYTES = 40 << 20
    """What the remembered words may take, estimated by their number and length."""
    TOGETHER = 64
    """New words that one string of a batch holds; each begins with the mark, so none runs into the next."""

    def __init__(self, definition: str, threads: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        self.tokenizer = Tokenizer.from_str(definition)
        steps = json.loads(definition)["normalizer"]["normalizers"]
        self.prefix = MARK if any(x["type"] == "Prepend" for x in steps) else ""
        self.plain = all(x["type"] == "Prepend" or (x["type"], x.get("content")) == ("Replace", MARK) for x in steps)
        self.apart = self.tokenizer.pre_tokenizer is not None and not self.tokenizer.get_added_tokens_decoder()
        self.normalizer = self.tokenizer.normalizer
        if self.apart:  # it is given normalised words
            self.tokenizer.normalizer = normalizers.Sequence([])
        self.split, self.whole = re.compile(_WORD, re.S), re.compile(f"{MARK}+[^{MARK}]+", re.S)
        self.known: dict[str, int] = {}
        self.held = 0
        self.ids = _Lists(np.int32)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        pieces = [b""] * (1 + max(vocabulary.values(), default=0))
        for piece, i in vocabulary.items():
            code = re.fullmatch("<0x([0-9A-F]{2})>", piece)
            pieces[i] = bytes([int(code[1], 16)]) if code else piece.replace(MARK, " ").encode()
        self.bytes = _Lists(np.uint8)
        self.bytes.extend(np.frombuffer(b"".join(pieces), np.uint8), np.array([len(p) for p in pieces]))

    def normalized(self, text: str) -> str:
        if self.plain:
            return self.prefix + text.replace(" ", MARK) if text else ""
        return self.normalizer.normalize_str(text)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.apart:
            return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        words = [self.split.findall(self.normalized(t)) for t in texts]
        counts = np.cumsum([0, *map(len, words)])
        flat = list(chain.from_iterable(words))
        which = np.fromiter(map(self.known.get, flat, repeat(-1)), np.int64, len(flat))
        missing = np.flatnonzero(which < 0)
        new = list(dict.fromkeys(flat[i] for i in missing.tolist()))
        size = 200 * len(new) + 2 * sum(map(len, new))
        if self.held + size > self.REMEMBERED_BYTES and self.known:
            self.known, self.ids, self.held = {}, _Lists(np.int32), 0
            return self.encode(texts)
        self.held += size
        marked = list(map(self.whole.fullmatch, new))
        self._learn([w for w, m in zip(new, marked) if m], self.TOGETHER)
        self._learn([w for w, m in zip(new, marked) if not m], 1)
        which[missing] = [self.known[flat[i]] for i in missing.tolist()]
        ids, ends = self.ids.joined(which)
        at = np.concatenate([[0], ends])[counts].tolist()
        return [ids[a:b] for a, b in zip(at, at[1:])]

    def _learn(self, new: list[str], together: int) -> None:
        """Encode words, several to a string; which word a token is of tells them apart again."""
        parts = ["".join(new[i : i + together]) for i in range(0, len(new), together)]
        found = self.tokenizer.encode_batch(parts, add_special_tokens=False)
        of = [np.array(e.word_ids, np.int64) + i * together for i, e in enumerate(found)]
        sizes = np.bincount(np.concatenate([np.zeros(0, np.int64), *of]), minlength=len(new))
        values = np.fromiter(chain.from_iterable(e.ids for e in found), np.int32)
        self.known.update(zip(new, range(self.ids.lists, self.ids.lists + len(new))))
        self.ids.extend(values, sizes)

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """The bytes of the pieces; the library decides what becomes of bytes that are no text."""
        data, ends = self.bytes.joined(np.concatenate([np.zeros(0, np.int64), *ids]))
        at = np.concatenate([[0], ends])[np.cumsum([0, *map(len, ids)])].tolist()
        body, out = data.tobytes(), []
        for x, a, b in zip(ids, at, at[1:]):
            try:
                text = body[a:b].decode()
            except UnicodeDecodeError:
                out.append(self.tokenizer.decode(x.tolist(), skip_special_tokens=False))
                continue
            out.append(text[1:] if self.prefix and text[:1] == " " else text)
        return out

    def shown(self, text: str) -> str:
        """The text as the normaliser leaves it, which is what decoding should give."""
        out = self.normalized(text).replace(MARK, " ")
        return out[1:] if self.prefix and out[:1] == " " else out


@lru_cache(maxsize=2)
def _loaded(definition: str, threads: int) -> Encoder:
    return Encoder(definition, threads)


def definition_of(path: str | Path) -> str:
    """The rebuilt tokenizer as text that is sent to the tasks; the model file is read on the driver only."""
    return build_tokenizer(parse_model(Path(path).read_bytes())).to_str()


def encode_texts(docs: DataFrame, path: str, threads: int = 2) -> DataFrame:
    """``docs`` with ``tokens`` (array of ids) and ``decoded`` (their text), both of the whole ``text``.

    A null text counts as empty; an empty text has no tokens. Words that spell control pieces are ordinary text. All
    columns stay; columns called ``tokens`` or ``decoded`` are replaced. ``threads`` encode a batch in one task.
    """
    return _encoded(docs.drop("tokens", "decoded"), path, threads, [StructField("tokens", ArrayType(IntegerType())), StructField("decoded", StringType())])


def round_trip(docs: DataFrame, path: str, threads: int = 2) -> DataFrame:
    """``docs`` with ``tokens`` and ``same``: whether decoding gives the text again, as the normaliser leaves it."""
    return _encoded(docs.drop("tokens", "same"), path, threads, [StructField("tokens", ArrayType(IntegerType())), StructField("same", BooleanType())])


def _encoded(rest: DataFrame, path: str, threads: int, more: list[StructField]) -> DataFrame:
    H.bounded_batches(rest.sparkSession)
    definition, names = definition_of(path), [f.name for f in more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _loaded(definition, threads)
        for batch in batches:
            ids, shown = [np.zeros(0, np.int32)], []
            for part in _pieces(batch.column("text").to_pylist()):
                found = encoder.encode(part)
                back = encoder.decode(found)
                ids += found
                shown += back if names[1] == "decoded" else [a == encoder.shown(b) for a, b in zip(back, part)]
            offsets = np.cumsum([len(x) for x in ids]).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
            more = pa.array(shown, pa.string() if names[1] == "decoded" else pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns, tokens, more], [*batch.schema.names, *names])

    return rest.mapInArrow(run, StructType([*rest.schema.fields, *more]))


def _pieces(texts: list[str | None]) -> Iterator[list[str]]:
    held: list[str] = []
    size = 0
    for text in texts:
        held.append(text or "")
        size += len(held[-1])
        if size >= _PIECE:
            yield held
            held, size = [], 0
    if held:
        yield held
