"""Hashed word and character n-gram features, computed for Arrow batches with numpy.

Features of a text: words and word pairs (white space separated), and characters in windows of 1, 3
and 5, letters in their case, hashed into 2**BITS places; and the text's shape: steps of its shares
of distinct words, capitals, digits and signs, its mean word length and its number of words. Each
hashed kind is divided by its count in the text, so long and short texts weigh alike. A linear score is a gather and a segmented sum; no
feature matrix is built for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BITS = 16
KINDS = 6
#: Statistics of a whole text, each as one of 16 steps.
SHAPES = 6
#: Characters handled at once, but for a longer single text.
BLOCK_CHARS = 1 << 18
#: Texts handled at once.
BLOCK_TEXTS = 512


def _mixed(h: np.ndarray, kind: int) -> np.ndarray:
    """Places of the hashes h of one kind."""
    h = (h + np.uint32(0x9E3779B9 * (kind + 1) & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
    return ((h ^ (h >> np.uint32(15))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - BITS)).astype(np.int32)


def _hashed(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind: (places, number of them in each text), texts one after another."""
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(len(chars))  # characters to the text's end, this one included
    h = np.zeros(len(chars), np.uint32)
    for width in range(1, 6):
        h[: max(0, len(chars) - width + 1)] += chars[width - 1 :] * np.uint32((0x01000193, 0x0100A3F5, 0x27D4EB2F, 0x165667B1, 0x2545F491)[width - 1])
        if width in (1, 3, 5):
            yield _mixed(h[left >= width], width), np.maximum(sizes - width + 1, 0)
    space = (chars == 32) | ((chars >= 9) & (chars <= 13))
    begins = ~space
    begins[1:] &= space[:-1]
    begins[(ends - sizes)[sizes > 0]] = ~space[(ends - sizes)[sizes > 0]]
    first = np.flatnonzero(begins)
    number = np.cumsum(begins) - 1
    inside = np.flatnonzero(~space)
    place = (inside - first[number[inside]]).astype(np.uint32) if len(first) else inside.astype(np.uint32)
    part = (chars[inside] + np.uint32(1)) * (place * np.uint32(0x9E3779B1) | np.uint32(1))
    word = np.add.reduceat(part, np.flatnonzero(begins[inside]), dtype=np.uint32) if len(first) else part
    text_of = np.searchsorted(ends, first, side="right")
    counts = np.bincount(text_of, minlength=len(texts))
    yield _mixed(word, 7), counts
    pair = (word[:-1] * np.uint32(0x27D4EB2F) + word[1:])[text_of[:-1] == text_of[1:]]
    yield _mixed(pair, 9), np.maximum(counts - 1, 0)
    own = np.sort(text_of.astype(np.uint64) << np.uint64(32) | word) if len(first) else np.zeros(0, np.uint64)
    fresh = np.append(True, own[1:] != own[:-1])[: len(own)]
    distinct = np.bincount((own[fresh] >> np.uint64(32)).astype(np.int64), minlength=len(texts))
    which = np.repeat(np.arange(len(texts)), sizes)
    share = lambda mask: np.bincount(which[mask], minlength=len(texts)) / np.maximum(sizes, 1)
    letters = (chars | np.uint32(32)) - np.uint32(97) < 26
    capitals, digits = letters & (chars < 97), chars - np.uint32(48) < 10
    steps = [distinct / np.maximum(counts, 1), share(capitals) * 2, share(digits) * 2, share((chars > 32) & (chars < 127) & ~letters & ~digits) * 3, share(~space) * sizes / np.maximum(counts, 1) / 24, np.log2(counts + 1) / 16]
    yield (np.minimum(np.stack(steps, 1) * 16, 15).astype(np.int32) + 16 * np.arange(SHAPES, dtype=np.int32)).ravel(), np.full(len(texts), SHAPES)


def blocks(texts: list[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        if held and (size + len(t) > BLOCK_CHARS or len(held) == BLOCK_TEXTS):
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def linear_scores(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """The mean weight of each hashed kind's features and the weights of the shape, summed; weights: KINDS x 2**BITS."""
    out = []
    for block in blocks(texts):
        score = np.zeros(len(block))
        for kind, (places, counts) in enumerate(_hashed(block)):
            full = np.flatnonzero(counts)
            if len(full):
                begin = np.cumsum(counts) - counts
                total = np.add.reduceat(weights[kind][places], begin[full], dtype=np.float64)
                score[full] += total if kind == KINDS - 1 else total / counts[full]
        out.append(score)
    return np.concatenate(out) if out else np.zeros(0)


def sparse_features(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text: (places over all kinds, sorted and distinct; values, each hashed kind summing to 1)."""
    for text in texts:
        places, values = [], []
        for kind, (p, _) in enumerate(_hashed([text])):
            if len(p):
                at, n = np.unique(p, return_counts=True)
                places.append(at + (kind << BITS))
                values.append(n / (1 if kind == KINDS - 1 else len(p)))
        yield (np.concatenate(places).astype(np.int32), np.concatenate(values).astype(np.float32)) if places else (np.zeros(0, np.int32), np.zeros(0, np.float32))
