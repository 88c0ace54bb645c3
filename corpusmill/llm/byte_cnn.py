"""A byte-level convolutional network in numpy: one probability for a whole text of any length.

A text is cut into blocks of ``BLOCK`` bytes. Each filter is a sum of one learned value per byte and offset, so a
convolution is ``WIDTH`` table lookups per byte. Filters are max-pooled over chunks of two neighbouring blocks, which
overlap by one; a chunk's maxima give hidden units, and their maximum and mean over all chunks give the probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WIDTH, FILTERS, HIDDEN, BLOCK = 6, 16, 16, 128
PIECE = 256
"""Blocks that are convolved at a time."""
Weights = dict[str, np.ndarray]


def start(seed: int = 7) -> Weights:
    draw = np.random.default_rng(seed)
    normal = lambda *shape, scale: (draw.standard_normal(shape) * scale).astype(np.float32)
    return {
        "table": normal(WIDTH, 256, FILTERS, scale=0.4),
        "bias": np.zeros(FILTERS, np.float32),
        "hidden": normal(FILTERS, HIDDEN, scale=FILTERS**-0.5),
        "hidden_bias": np.full(HIDDEN, 0.1, np.float32),
        "out": normal(2 * HIDDEN, scale=HIDDEN**-0.5),
        "out_bias": np.zeros(1, np.float32),
    }


def _laid_out(texts: list[bytes | memoryview]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with each text on whole blocks, zeros behind it; number of its blocks; where its positions end."""
    sizes = np.array([len(t) for t in texts])
    blocks = (sizes + WIDTH - 1 + BLOCK - 1) // BLOCK
    begin = np.concatenate([[0], np.cumsum(blocks)]) * BLOCK
    data = np.zeros(begin[-1] + WIDTH, np.uint8)
    for t, a, n in zip(texts, begin.tolist(), sizes.tolist()):
        data[a : a + n] = np.frombuffer(t, np.uint8)
    return data, blocks, begin[:-1] + np.maximum(sizes, 1)


def _convolved(w: Weights, data: np.ndarray, blocks: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
    """Filter values as (blocks, BLOCK, FILTERS), piece by piece; positions behind a text are far below all others."""
    total, first = int(blocks.sum()), 0
    lasts = np.cumsum(blocks) * BLOCK
    for a in range(0, total, PIECE):
        b = min(total, a + PIECE)
        lo, hi = a * BLOCK, b * BLOCK
        out = np.take(w["table"][0], data[lo:hi], axis=0)
        for k in range(1, WIDTH):
            out += np.take(w["table"][k], data[lo + k : hi + k], axis=0)
        while first < len(blocks) and ends[first] < hi:
            out[max(ends[first] - lo, 0) : max(min(lasts[first], hi) - lo, 0)] = -1e9
            if lasts[first] > hi:
                break
            first += 1
        yield out.reshape(b - a, BLOCK, FILTERS)


def _chunked(values: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maxima of neighbouring blocks of one text; first chunk of each text; the later block of each chunk."""
    chunks = np.maximum(blocks - 1, 1)
    first = np.concatenate([[0], np.cumsum(chunks)])[:-1]
    left = np.repeat(np.cumsum(blocks) - blocks - first, chunks) + np.arange(chunks.sum())
    right = np.where(np.repeat(blocks > 1, chunks), left + 1, left)
    return np.maximum(values[left], values[right]), first, np.stack([left, right])


def _head(w: Weights, chunks: np.ndarray, first: np.ndarray):
    hidden = np.maximum(chunks @ w["hidden"] + w["hidden_bias"], 0)
    count = np.diff(np.append(first, len(hidden)))[:, None].astype(np.float32)
    joined = np.concatenate([np.maximum.reduceat(hidden, first), np.add.reduceat(hidden, first) / count], axis=1)
    return hidden, joined, count, joined @ w["out"] + w["out_bias"][0]


def probabilities(w: Weights, texts: list[bytes | memoryview]) -> np.ndarray:
    if not texts:
        return np.zeros(0)
    data, blocks, ends = _laid_out(texts)
    best = np.concatenate([v.max(axis=1) for v in _convolved(w, data, blocks, ends)])
    chunks, first, _ = _chunked(np.maximum(best + w["bias"], 0), blocks)
    return 1 / (1 + np.exp(-np.clip(_head(w, chunks, first)[3].astype(np.float64), -30, 30)))


def _gradients(w: Weights, texts: list[bytes], labels: np.ndarray) -> Weights:
    data, blocks, ends = _laid_out(texts)
    best, at = [], []
    for v in _convolved(w, data, blocks, ends):
        k = v.argmax(axis=1)
        at.append(k)
        best.append(np.take_along_axis(v, k[:, None], axis=1)[:, 0])
    best, at = np.concatenate(best), np.concatenate(at)
    values = np.maximum(best + w["bias"], 0)
    chunks, first, sides = _chunked(values, blocks)
    hidden, joined, count, logit = _head(w, chunks, first)
    text = np.repeat(np.arange(len(texts)), count[:, 0].astype(int))
    d_logit = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels) / len(labels)).astype(np.float32)
    d_joined = d_logit[:, None] * w["out"]
    top = joined[:, :HIDDEN][text] == hidden
    d_hidden = (d_joined[:, HIDDEN:] / count)[text] + top * d_joined[:, :HIDDEN][text]
    d_hidden *= hidden > 0
    d_chunks = d_hidden @ w["hidden"].T
    d_values = np.zeros_like(values)
    from_left = values[sides[0]] >= values[sides[1]]
    np.add.at(d_values, sides[0], d_chunks * from_left)
    np.add.at(d_values, sides[1], d_chunks * ~from_left)
    d_values *= values > 0
    d_table = np.zeros_like(w["table"])
    place = np.arange(len(at))[:, None] * BLOCK + at
    each = np.broadcast_to(np.arange(FILTERS), place.shape)
    for k in range(WIDTH):
        np.add.at(d_table[k], (data[place + k], each), d_values)
    return {
        "table": d_table,
        "bias": d_values.sum(axis=0),
        "hidden": chunks.T @ d_hidden,
        "hidden_bias": d_hidden.sum(axis=0),
        "out": joined.T @ d_logit,
        "out_bias": d_logit.sum(keepdims=True),
    }


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = 10, rate: float = 0.01, batch: int = 32, seed: int = 7) -> Weights:
    """Adam on the log-loss; the same rows in the same order give the same weights."""
    w = start(seed)
    if not texts:
        return w
    draw = np.random.default_rng(seed)
    steps, moment, square = 0, {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
    rounds = max(epochs, -(-60 * batch // len(texts)))
    for r in range(rounds):
        order = draw.permutation(len(texts))
        for a in range(0, len(order), batch):
            some = order[a : a + batch]
            g = _gradients(w, [texts[i] for i in some], labels[some])
            steps += 1
            pace = rate * (0.5 * (1 + np.cos(np.pi * r / rounds))) + 1e-4
            for k in w:
                moment[k] = 0.9 * moment[k] + 0.1 * g[k]
                square[k] = 0.999 * square[k] + 0.001 * g[k] ** 2
                step = (moment[k] / (1 - 0.9**steps)) / (np.sqrt(square[k] / (1 - 0.999**steps)) + 1e-8)
                w[k] = (w[k] - pace * step).astype(np.float32)
    return w
