"""Token counts by a finite-state transducer compiled from a byte-level BPE.

Method: finite-state tokenizer compilation. Two deterministic machines are
compiled from the vocabulary file, and every transition is annotated with what
it emits:

* the *splitter* reads one symbol per code point (its class and as much
  lookahead as contractions and white space need) and emits a mark where a new
  piece begins. It has nine states, so a chunk of text is a map from nine entry
  states to nine exit states. All chunks of a block are mapped side by side,
  the maps are composed by a parallel prefix scan (``scan``), and a second pass
  from the now known entry states emits the marks;
* the *counter* reads the bytes of a piece and emits, on each transition, by
  how much the number of tokens of the piece grows. Its state holds, for each
  suffix of the bytes read that is also a prefix of some vocabulary entry,
  where that suffix stands in the trie of entries, the last token in front of
  it and how many tokens that front has fewer. The number of tokens follows
  because a sequence is what the merges produce if and only if each two
  neighbours are (``_Merges.adjacent``). States and transitions are added when
  first met and kept by the Python worker (a bounded number, see
  ``MOST_STATES``), in an open-addressing table that numpy searches for all
  pieces at once.

Texts of any length: a text is cut in front of white space that follows other
characters - always the border of a piece - into parts of a bounded size.
Nothing is shuffled; a row's count depends on that row alone.

Defined results: null text counts as empty (0 bytes, 0 tokens, not over the
limit); one output row per input row, repeated rows and null ids included;
only ``doc_id`` and ``text`` are read, other columns may have any name.
An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .frames import sliced
from .kernels import give_back, remembered

CHUNK = 256  # symbols of a chunk whose state map is composed
PART = 1_000_000  # code points handled at once
LONG_PIECE = 400  # bytes; longer pieces are walked one by one
MOST_STATES = 400_000  # compiled states kept between blocks; with more, compiling starts anew
# bits of a packed entry of a counter state: trie node, token + 1, difference of counts
_FEWER_0, _FEWER_MASK, _TOKEN, _TOKEN_MASK, _NODE = 1 << 11, (1 << 12) - 1, 12, (1 << 20) - 1, 32


# ------------------------------------------------------------ the splitter
# states: what the piece that is being read consists of
(S_NONE, S_LETTER, S_NUMBER, S_OTHER, S_BLANK, S_SPACE, S_ONE, S_TWO, S_DONE) = range(9)
# symbols: class of the code point; white space also says whether it ends its run before a character
(A_LETTER, A_NUMBER, A_OTHER, A_BLANK_LAST, A_BLANK, A_SPACE_LAST, A_SPACE, A_QUOTE_ONE, A_QUOTE_TWO, A_RESET) = range(10)


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """next state and mark by [state, symbol]. S_BLANK: a single blank that joins the next piece;
    S_SPACE: other white space; S_ONE, S_TWO: letters of a contraction still to come."""
    to = np.zeros((9, 10), np.uint8)
    mark = np.zeros((9, 10), np.uint8)
    kind = {A_LETTER: S_LETTER, A_NUMBER: S_NUMBER, A_OTHER: S_OTHER}
    for s in range(9):
        for a in range(10):
            if a == A_RESET:
                to[s, a], mark[s, a] = S_NONE, 1
            elif s == S_TWO:
                to[s, a] = S_ONE
            elif s == S_ONE:
                to[s, a] = S_DONE
            elif a in kind:
                to[s, a], mark[s, a] = kind[a], s not in (kind[a], S_BLANK)
            elif a in (A_QUOTE_ONE, A_QUOTE_TWO):
                if s in (S_BLANK, S_OTHER):  # inside a run of symbols a quote is one of them
                    to[s, a] = S_OTHER
                else:
                    to[s, a], mark[s, a] = (S_ONE if a == A_QUOTE_ONE else S_TWO), 1
            elif a == A_SPACE_LAST:  # alone, or the last of a run: joins what follows
                to[s, a], mark[s, a] = S_BLANK, 1
            elif a == A_BLANK_LAST:  # a line break etc. before a character stands alone
                to[s, a], mark[s, a] = S_SPACE, 1
            else:
                to[s, a], mark[s, a] = S_SPACE, s != S_SPACE
    return to, mark


_TO, _MARK = _splitter()
_FLAT = _TO.reshape(-1)
_classes: list[np.ndarray] = []


def _class_table() -> np.ndarray:
    """Class of every code point: 0 letter, 1 number, 2 other, 3 white space."""
    if not _classes:
        import regex

        table = np.full(0x110000, 2, np.uint8)
        plain = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
        for value, pattern in ((0, r"\p{L}+"), (1, r"\p{N}+"), (3, r"\s+")):
            for m in regex.finditer(pattern, plain):
                a, b = m.span()
                shift = 0x800
                table[a + (shift if a >= 0xD800 else 0) : b + (shift if b > 0xD800 else 0)] = value
        table[0x1C:0x20] = 2  # separators that the pattern's \s leaves out
        _classes.append(table)
    return _classes[0]


def scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of state maps (rows), in log2(n) steps: row i becomes maps 0..i applied in order."""
    out, step = maps.copy(), 1
    while step < len(out):
        out[step:] = np.take_along_axis(out[step:], out[:-step].astype(np.intp), 1)
        step *= 2
    return out


def marks(symbols: np.ndarray) -> np.ndarray:
    """Where pieces begin, by chunk maps, their prefix scan and a second pass."""
    n = len(symbols)
    rows = -(-n // CHUNK)
    padded = np.full(rows * CHUNK, A_RESET, np.uint8)
    padded[:n] = symbols
    lanes = np.ascontiguousarray(padded.reshape(rows, CHUNK).T)
    maps = np.broadcast_to(np.arange(9, dtype=np.uint8)[:, None], (9, rows)).copy()
    for column in lanes:
        maps = _FLAT[maps * np.uint8(10) + column]
    entry = np.zeros(rows, np.uint8)
    entry[1:] = scan(np.ascontiguousarray(maps.T))[:-1, S_NONE]
    out = np.empty((CHUNK, rows), np.uint8)
    flat_mark = _MARK.reshape(-1)
    for k, column in enumerate(lanes):
        at = entry * np.uint8(10) + column
        out[k] = flat_mark[at]
        entry = _FLAT[at]
    return out.T.reshape(-1)[:n]


def symbols(points: np.ndarray, resets: np.ndarray) -> np.ndarray:
    """Splitter symbols of code points; ``resets``: positions that stand between two texts."""
    kinds = _class_table()[points]
    kinds[resets] = 4
    after = np.append(kinds[1:], np.uint8(4))
    out = np.array([A_LETTER, A_NUMBER, A_OTHER, A_BLANK, A_RESET], np.uint8)[kinds]
    space = kinds == 3
    blank = points == 32
    last = space & (after < 3)
    out[space & blank] = A_SPACE
    out[last] = A_BLANK_LAST
    out[last & blank] = A_SPACE_LAST
    quote = np.flatnonzero(points == 39)
    if len(quote):
        ahead = np.append(points, np.zeros(2, points.dtype))
        one, two = ahead[quote + 1], ahead[quote + 2]
        pair = ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))
        out[quote[np.isin(one, (115, 116, 109, 100))]] = A_QUOTE_ONE
        out[quote[pair]] = A_QUOTE_TWO
    return out


# ------------------------------------------------------------- the counter
def _byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class _Merges:
    """Which two tokens may stand side by side."""

    def __init__(self, model: dict):
        self.id = model["vocab"]
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right = self.id[a], self.id[b]
            self.rank[left, right] = r
            made = self.id[a + b]
            if made not in self.parts:
                self.parts[made], self.born[made] = (left, right), r
        self._edges: dict[tuple[int, int], list] = {}
        self._known: dict[int, bool] = {}

    def _edge(self, token: int, side: int) -> list[tuple[int, int, float]]:
        """Pieces at one edge of a token while it is built: (piece, merge that makes it, merge that takes it)."""
        if (got := self._edges.get((token, side))) is None:
            got, piece, ends = [], token, float("inf")
            while True:
                begins = self.born.get(piece, -1)
                got.append((piece, begins, ends))
                if piece not in self.parts:
                    break
                piece, ends = self.parts[piece][side], begins
            self._edges[token, side] = got
        return got

    def adjacent(self, left: int, right: int) -> bool:
        """False if some merge joins the right edge of ``left`` with the left edge of ``right``
        before both have grown past it; merges of one rank go from left to right."""
        if (known := self._known.get(left << 20 | right)) is None:
            known = True
            for p, _, p_ends in self._edge(left, 1):
                for q, _, q_ends in self._edge(right, 0):
                    r = self.rank.get((p, q))
                    if r is not None and r < p_ends and r <= q_ends:
                        known = False
            self._known[left << 20 | right] = known
        return known


class Transducer:
    """The counter: transitions on bytes, each with the change of the token count."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], _byte_alphabet()
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.merges = _Merges(model)
        self.trie: dict[int, int] = {}  # node * 256 + byte -> node; 0 is the root
        self.token: dict[int, int] = {}
        self.inner: set[int] = {0}
        for text, token in model["vocab"].items():
            node = 0
            for byte in (alphabet[c] for c in text):
                self.inner.add(node)
                node = self.trie.setdefault(node * 256 + byte, len(self.trie) + 1)
            self.token[node] = token
        self._forget()

    def _forget(self) -> None:
        """Start with the first state only."""
        # a state: for each open suffix, longest first, its trie node, the last token before it plus 1
        # (0: none) and the tokens before it less tokens in all, packed into one number
        self.states: list[tuple[int, ...]] = [(_FEWER_0,)]
        self.number = {self.states[0]: 0}
        self.used = 0
        self._table(1 << 16)

    def _table(self, size: int) -> None:
        self.mask = size - 1
        self.keys = np.full(size, -1, np.int64)
        self.next = np.zeros(size, np.int32)
        self.gain = np.zeros(size, np.int16)

    @staticmethod
    def _slot(key):
        return (key * 0x9E3779B1 >> 7) ^ (key >> 3)

    def _place(self, key: int) -> int:
        """Slot that holds ``key``, or the empty one where it belongs."""
        at = self._slot(key) & self.mask
        while self.keys[at] not in (key, -1):
            at = (at + 1) & self.mask
        return at

    def _add(self, key: int, to: int, gain: int) -> None:
        if 3 * self.used > self.mask:
            old = self.keys, self.next, self.gain
            self._table(2 * len(self.keys))
            for k, n, g in zip(*(x[old[0] >= 0].tolist() for x in old)):
                at = self._place(k)
                self.keys[at], self.next[at], self.gain[at] = k, n, g
        at = self._place(key)
        self.keys[at], self.next[at], self.gain[at] = key, to, gain
        self.used += 1

    def step(self, key: int) -> tuple[int, int]:
        """Transition of state ``key // 256`` on byte ``key % 256``, compiled when first asked for."""
        at = self._place(key)
        if self.keys[at] == key:
            return int(self.next[at]), int(self.gain[at])
        byte = key & 255
        kept, last, count = [], 0, 0
        for entry in self.states[key >> 8]:
            child = self.trie.get((entry >> _NODE) << 8 | byte)
            if child is None:
                continue
            before, fewer = entry >> _TOKEN & _TOKEN_MASK, (entry & _FEWER_MASK) - _FEWER_0
            kept.append((child, before, fewer))
            token = self.token.get(child)
            if not last and token is not None and (not before or self.merges.adjacent(before - 1, token)):
                last, count = token + 1, fewer + 1
        new = (*(n << _NODE | b << _TOKEN | f - count + _FEWER_0 for n, b, f in kept if n in self.inner), last << _TOKEN | _FEWER_0)
        to = self.number.setdefault(new, len(self.states))
        if to == len(self.states):
            self.states.append(new)
        self._add(key, to, count)
        return to, count

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Slots of transitions; those met for the first time are compiled."""
        while True:
            at = self._slot(keys) & self.mask
            there = self.keys[at]
            wrong = np.flatnonzero(there != keys)
            missing = []
            while len(wrong):
                empty = there[wrong] < 0
                if empty.any():
                    missing.append(keys[wrong[empty]])
                wrong = wrong[~empty]
                at[wrong] = (at[wrong] + 1) & self.mask
                there[wrong] = self.keys[at[wrong]]
                wrong = wrong[there[wrong] != keys[wrong]]
            if not missing:
                return at
            for key in np.unique(np.concatenate(missing)).tolist():
                self.step(key)

    def counts(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of each piece ``data[start : start + length]``."""
        if len(self.states) > MOST_STATES:
            self._forget()
        out = np.zeros(len(starts), np.int64)
        for i in np.flatnonzero(lengths > LONG_PIECE):
            state = 0
            for byte in data[starts[i] : starts[i] + lengths[i]].tolist():
                state, gain = self.step(state << 8 | byte)
                out[i] += gain
        order = np.flatnonzero(lengths <= LONG_PIECE)
        order = order[np.argsort(-lengths[order].astype(np.int16), kind="stable")]
        begin, length = starts[order], lengths[order]
        state, total = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        live, k = len(order), 0
        ends = np.searchsorted(-length, -np.arange(1, int(length[0]) + 1 if live else 1), "right")
        for k, live in enumerate(ends.tolist()):
            at = self._find(state[:live] << 8 | data[begin[:live] + k])
            total[:live] += self.gain[at]
            state[:live] = self.next[at]
        out[order] = total
        return out


def _key(path: str) -> str:
    return f"transducer of {path}"


def compiled(path: str) -> Transducer:
    return remembered(_key(path), lambda: Transducer(path))


def _parts(text: str, size: int) -> Iterator[str]:
    """Cut in front of white space that follows another character; a text without such a place stays whole."""
    while len(text) > size:
        m = re.compile(r"[^\s][\t\n\r ]").search(text, size)
        if m is None:
            break
        yield text[: m.start() + 1]
        text = text[m.start() + 1 :]
    yield text


def count_tokens(texts: list[str], path: str) -> np.ndarray:
    """Tokens of each text. A special string in a text is one token and splits it."""
    machine = compiled(path)
    special = re.compile("|".join(map(re.escape, machine.special))) if machine.special else None
    total = np.zeros(len(texts), np.int64)
    held, rows, size = [], [], 0

    def flush():
        joined = "\0".join(held) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        data = np.frombuffer(joined.encode(), np.uint8)
        border = np.cumsum(np.fromiter((len(h) + 1 for h in held), np.int64, len(held))) - 1
        begins = np.flatnonzero(marks(symbols(points, border)))
        width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        byte_at = np.zeros(len(points) + 1, np.int64)
        np.cumsum(width, out=byte_at[1:])
        starts = byte_at[begins]
        lengths = np.diff(np.append(starts, byte_at[-1]))
        piece_row = np.searchsorted(border, begins, "left")
        real = np.ones(len(begins), bool)
        real[np.searchsorted(begins, border)] = False  # the zero between two texts is no piece
        got = machine.counts(data, starts[real], lengths[real])
        np.add.at(total, np.asarray(rows)[piece_row[real]], got)

    for i, text in enumerate(texts):
        whole = [text]
        if special is not None and any(s in text for s in machine.special):
            whole = special.split(text)
            total[i] += len(whole) - 1
        for part in (p for w in whole if w for p in _parts(w, PART)):
            if held and size + len(part) > PART:
                flush()
                held, rows, size = [], [], 0
            held.append(part)
            rows.append(i)
            size += len(part) + 1
    if held:
        flush()
    return total


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) for every row of ``docs``.

    ``tokenizer``: path of a byte-level BPE vocabulary in the format of the
    ``tokenizers`` library, readable on every executor.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            n = count_tokens(texts, tokenizer)
            size = np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts))
            columns = [batch.column("doc_id"), pa.array(size), pa.array(n), pa.array(n > limit)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens", "over_limit"])
        give_back(_key(tokenizer))

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
