"""Array kernels for blocks of UTF-8 text, used inside Arrow batches.

A ``Block`` is the bytes of several texts, each followed by one newline, so
neither a word nor a line runs over from one text to the next. Blocks are cut
by bytes: what a task holds at once depends on the block size and the longest
single text, not on the number of rows in a batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import xxhash

BLOCK_BYTES = 1_000_000
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_SHORT = 64  # bytes up to which spans are hashed together, eight bytes of all at a time
_SEED, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xA24BAED4963EE407)


_kept: dict[str, object] = {}  # what this worker remembers for its next task


def remembered(key: str, make: Callable[[], object]):
    """The object that this worker keeps under ``key``, made when first asked for."""
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def give_back(*keep: str) -> None:
    """End of a task: forget all that is remembered but ``keep``, and hand free memory back to the
    system. Python workers outlive their tasks and serve other stages; what each of them kept would
    add up on an executor over the stages of a job."""
    for key in [k for k in _kept if k not in keep]:
        del _kept[key]
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only some C libraries have it
        pass


def blocks(texts, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first row, row after the last, encoded texts) of runs of about ``limit`` bytes; null: empty."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        raw = t.encode() if isinstance(t, str) else b""
        if held and size + len(raw) > limit:
            yield first, i, held
            first, held, size = i, [], 0
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield first, first + len(held), held


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (one-to-one)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Block:
    def __init__(self, raws: list[bytes]):
        self.buf = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
        self.off = np.zeros(len(raws) + 1, np.int64)
        np.cumsum(np.fromiter((len(r) + 1 for r in raws), np.int64, len(raws)), out=self.off[1:])
        self.n = len(raws)
        self._words: np.ndarray | None = None

    def counted(self, flags: np.ndarray) -> np.ndarray:
        """Per text: how many bytes are flagged."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return np.diff(total[self.off])

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of flagged bytes."""
        edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
        return edge[::2], edge[1::2]

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        return self.spans(~SPACE[self.buf])

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        ends = np.flatnonzero(self.buf == 10)
        return np.concatenate(([0], ends[:-1] + 1)), ends

    def rows(self, starts: np.ndarray) -> np.ndarray:
        """The text that each position belongs to."""
        return np.searchsorted(self.off, starts, "right") - 1

    def per_row(self, starts: np.ndarray) -> np.ndarray:
        """First index of each text in sorted ``starts``, and the length at the end."""
        return np.searchsorted(starts, self.off)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hash of each span of bytes, equal wherever the bytes are equal.

        Eight bytes at a time go through ``mix``, which is not linear: no two spans
        agree for a reason other than chance. Spans over ``_SHORT`` bytes, of which
        there are few, are hashed one by one."""
        if self._words is None:
            padded = np.zeros(len(self.buf) + 8, np.uint8)
            padded[: len(self.buf)] = self.buf
            # eight bytes from each position on, as a number
            self._words = np.ndarray(len(self.buf) + 1, "<u8", padded, strides=(1,))
        size = (ends - starts).astype(np.int64)
        out = size.astype(np.uint64) * _STEP + _SEED
        at, left, index = starts.astype(np.int64), np.where(size <= _SHORT, size, 0), None
        while len(at):
            whole = left >= 8
            part = self._words[at]
            rest = np.uint64(64) - np.uint64(8) * np.minimum(left, 8).astype(np.uint64)
            part = np.where(whole, part, (part << np.minimum(rest, np.uint64(63))) >> np.minimum(rest, np.uint64(63)))
            if index is None:
                used = left > 0
                out = np.where(used, mix(out ^ part) + _STEP, out)
            else:
                out[index] = mix(out[index] ^ part) + _STEP
            more = np.flatnonzero(left > 8)
            index = more if index is None else index[more]
            at, left = at[more] + 8, left[more] - 8
        if len(long := np.flatnonzero(size > _SHORT)):
            data = self.buf.data
            spans = zip(starts[long].tolist(), ends[long].tolist())
            out[long] = np.fromiter((xxhash.xxh3_64_intdigest(data[a:b]) for a, b in spans), np.uint64, len(long))
        return mix(out)


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` neighbouring hashes (runs over text borders included)."""
    n = max(0, len(hashes) - width + 1)
    out = hashes[:n].copy()
    for k in range(1, width):
        out = mix(out) + hashes[k : k + n] * np.uint64(2 * k + 1)
    return mix(out)


def same_row(bounds: np.ndarray, n: int, width: int) -> np.ndarray:
    """Which of the first ``n - width + 1`` windows of ``width`` lie in one text."""
    ok = np.ones(max(0, n - width + 1), bool)
    for k in range(1, width):
        at = bounds[1:-1] - k
        ok[at[(at >= 0) & (at < len(ok))]] = False
    return ok
