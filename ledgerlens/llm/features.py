"""Text statistics and hashed n-gram features of a block of texts."""

from __future__ import annotations

import numpy as np

from .kernels import SPACE, Block, mix, same_row, windows

BITS = 16  # buckets of one feature family: 2 ** BITS
FAMILIES = ("chars3", "word", "word2")
WIDTH = len(FAMILIES) << BITS
WINDOW = 5  # words of a window that counts as repeated

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[list(b".,;:!?")] = True
_ROW = np.uint64(0x9FB21C651E98DF25)


def _twice(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    order = np.argsort(keys, kind="stable")
    equal = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][equal]] = True
    out[order[:-1][equal]] = True
    return out


def text_stats(block: Block) -> dict[str, np.ndarray]:
    """Per text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and, for models,
    n_bytes, n_lines, n_upper, n_punct, n_distinct (different words) and n_stutter (words equal to the one before)."""
    space = SPACE[block.buf]
    starts, ends = block.spans(~space)
    hashes = block.hashes(starts, ends)
    bounds = block.per_row(starts)
    row = block.rows(starts)
    out = {
        "n_words": np.diff(bounds),
        "word_chars": block.counted(~space & ((block.buf & 0xC0) != 0x80)),
        "n_symbols": block.counted(_SYMBOL[block.buf]),
        "n_upper": block.counted(_UPPER[block.buf]),
        "n_punct": block.counted(_PUNCT[block.buf]),
        "n_bytes": np.diff(block.off) - 1,
    }
    line_starts, line_ends = block.lines()
    first_word = np.searchsorted(starts, line_starts)
    full = (first_word < len(starts)) & (np.append(starts, np.int64(1) << 62)[first_word] < line_ends)
    line_row = block.rows(line_starts)
    out["n_lines"] = np.bincount(line_row, minlength=block.n)
    keys = mix(block.hashes(line_starts[full], line_ends[full]) ^ (line_row[full].astype(np.uint64) * _ROW))
    distinct, at = np.unique(keys, return_index=True)
    of = np.bincount(line_row[full], minlength=block.n)
    out["n_dup_lines"] = of - np.bincount(line_row[full][at], minlength=block.n)
    word_keys = mix(hashes ^ (row.astype(np.uint64) * _ROW))
    _, at = np.unique(word_keys, return_index=True)
    out["n_distinct"] = np.bincount(row[at], minlength=block.n)
    beside = same_row(bounds, len(hashes), 2) & (hashes[1:] == hashes[:-1]) if len(hashes) > 1 else np.zeros(0, bool)
    out["n_stutter"] = np.bincount(row[:-1][beside] if len(beside) else row[:0], minlength=block.n)
    inside = np.flatnonzero(same_row(bounds, len(hashes), WINDOW))
    again = inside[_twice(mix(windows(hashes, WINDOW)[inside] ^ (row[inside].astype(np.uint64) * _ROW)))]
    change = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(change, again, 1)
    np.add.at(change, again + WINDOW, -1)
    covered = np.cumsum(change)[:-1] > 0
    total = np.concatenate(([0], np.cumsum(covered)))
    out["n_repeat_words"] = np.diff(total[bounds])
    return out


def dense(stats: dict[str, np.ndarray]) -> np.ndarray:
    """Shape of a text as a few numbers between about -1 and 1 (one row per text)."""
    words, size = np.maximum(stats["n_words"], 1), np.maximum(stats["n_bytes"], 1)
    return np.stack(
        [
            np.log1p(stats["n_words"]) / 10,
            stats["word_chars"] / words / 10,
            stats["n_symbols"] / size * 5,
            stats["n_upper"] / size * 5,
            stats["n_punct"] / size * 5,
            3 * stats["n_distinct"] / words,
            3 * stats["n_repeat_words"] / words,
            stats["n_dup_lines"] / np.maximum(stats["n_lines"], 1),
            stats["n_lines"] / words,
            np.minimum(stats["n_words"], 10) / 10,
            10 * stats["n_stutter"] / words,
        ],
        axis=1,
    )


N_DENSE = 11


def _chars(buf: np.ndarray, n: int) -> np.ndarray:
    value = np.zeros(max(0, len(buf) - n + 1), np.uint64)
    for k in range(n):
        value = value << np.uint64(8) | buf[k : k + len(value)]
    return (value * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int64)


def hashed(block: Block):
    """Per family: bucket of each n-gram, and first and last-plus-one index of each text's n-grams."""
    for buckets, lo, hi in _ngrams(block):
        lo = np.minimum(lo, len(buckets))  # texts at the end that are too short for one
        yield buckets, lo, np.maximum(lo, hi)


def _ngrams(block: Block):
    lo, end = block.off[:-1], block.off[1:] - 1
    yield _chars(block.buf, 3), lo, end - 2
    starts, ends = block.words()
    hashes, bounds = block.hashes(starts, ends), block.per_row(starts)
    top = np.uint64(64 - BITS)
    yield (hashes >> top).astype(np.int64) + (1 << BITS), bounds[:-1], bounds[1:]
    pairs = (windows(hashes, 2) >> top).astype(np.int64) + (2 << BITS)
    yield pairs, bounds[:-1], bounds[1:] - 1


SCALE = 10.0  # a family's frequencies of one text add up to this


def linear_scores(block: Block, weights: np.ndarray) -> np.ndarray:
    """Sum of weight x frequency over the n-grams of each whole text."""
    out = np.zeros(block.n)
    for buckets, lo, hi in hashed(block):
        total = np.concatenate(([0.0], np.cumsum(weights[buckets])))
        out += (total[hi] - total[lo]) * (SCALE / np.maximum(hi - lo, 1))
    return out


def sparse_rows(block: Block) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, frequencies) of each text, as ``linear_scores`` weighs them."""
    parts: list[list] = [[] for _ in range(block.n)]
    for buckets, lo, hi in hashed(block):
        for r in range(block.n):
            at, count = np.unique(buckets[lo[r] : hi[r]], return_counts=True)
            parts[r].append((at, count * (SCALE / max(hi[r] - lo[r], 1))))
    return [(np.concatenate([p[0] for p in x]).astype(np.int32), np.concatenate([p[1] for p in x]).astype(np.float32)) for x in parts]
