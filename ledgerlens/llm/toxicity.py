"""Toxicity by a weighted lexicon.

Method: a text is folded (lower case; look-alike letters of other scripts and
digits or signs that stand for letters become those letters; anything else that
is no letter becomes a blank), the lexicon is matched on the folded whole text
by an Aho-Corasick automaton, matches inside an exception phrase are left out,
and the summed weights are normalised by the text's length.

Some characters have several readings: 1 is i or l; between letters ! | + (
are a letter or a blank (elsewhere a blank). Around those the lexicon is matched
in every reading, character by character; an entry counts once a place. Entries
are learned from three readings of a text: signs as letters with 1 as i, the
same with 1 as l, and signs as blanks.

Lexicon: a short list of insults and exception phrases (fixed values below),
and entries learned from labelled rows outside the held-out fold: words and word
beginnings of ``STEM`` letters that occur in toxic texts far more often than
chance allows. Near copies would lend chance words false weight, so they count
once: texts whose word sets are alike by ``ALIKE`` or more, as estimated from
``BANDS * BAND`` min-hashes, and those linked through such texts. Weights, and the
logistic curve that maps the normalised sum to a score between 0 and 1, are
fitted on the same rows; an entry of the fixed list that no row holds keeps the
weight it is listed with.

At most ``sample`` labelled rows are used (a hash of the id chooses them) and at
most ``MOST_ENTRIES`` entries learned, those with most evidence first.
Scoring reads each document once and shuffles nothing.

Defined results: null text scores as empty text: no match, the score of a clean
text. Without labels of both classes the fixed list alone decides. One row per
input row, null ids included (a null id counts as empty text in ``held_out``).
An empty table of documents gives an empty result.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import fold, written
from .linear import Sample, descend, labelled_rows, sigmoid

SAMPLE = 8000  # labelled rows that weights are learned from, at most
CUT = 0.7
FOLDS, HELD_OUT = 3, 1
STEM = range(3, 11)  # letters of word beginnings that may become entries
PURITY = 0.2  # least share of toxic texts among those with an entry
MOST_ENTRIES = 3000
RIDGE = 1e-4
BANDS, BAND = 21, 6  # min-hashes of a text; texts with an equal band are compared
ALIKE = 0.8  # share of equal min-hashes from which texts are near copies
CHANCE = 1.0  # accepted number of entries that are there by chance

# fixed values: entries (word beginnings) with the weight they have before labels are seen
INSULTS = {
    "asshole": 4.0, "bastard": 3.5, "bitch": 4.0, "clown": 2.5, "cretin": 3.5, "disgusting": 2.5, "dumbass": 4.0,
    "filth": 2.5, "fuck": 4.0, "garbage human": 4.0, "idiot": 4.0, "imbecile": 4.0, "loser": 3.0, "moron": 4.0,
    "pathetic": 2.5, "retard": 4.0, "scum": 3.5, "shithead": 4.0, "stupid": 3.0, "trash": 2.5, "vermin": 3.0,
    "whore": 4.0, "worthless": 3.0,
}
# fixed values: phrases in which an entry is no insult
EXCEPTIONS = (
    "clown fish", "clownfish", "class clown award", "trash can", "trash bin", "trash bag", "trash collection",
    "idiot proof", "idiot light", "stupid simple", "stupidly simple", "sore loser policy", "pond scum", "soap scum",
    "scumble", "loser bracket", "losers bracket", "filth of ages",
)
# fixed values: letters, digits and signs that look like a Latin letter
LOOKALIKES = {
    "a": "4@αаɑ", "b": "8вβ", "c": "сϲ(", "e": "3еεё€", "g": "9ɡ", "h": "һн", "i": "1!|іιı¡", "j": "јϳ", "k": "кκ",
    "l": "ӏⅼ", "m": "м", "n": "ηո", "o": "0оοօ", "p": "рρ", "r": "гʀ", "s": "5$ѕ", "t": "7+тτ", "u": "υսц",
    "v": "ѵν", "w": "ѡω", "x": "хχ", "y": "уүγ", "z": "2ʐ",
}

# fixed values: what a character may stand for; but for 1 only between letters, and a blank elsewhere
READINGS = {"1": ("i", "l"), "|": ("i", "l", " "), "!": ("i", " "), "+": ("t", " "), "(": ("c", " ")}


class _Fold(dict):
    """Code point -> folded text, worked out when first met."""

    def __missing__(self, point: int) -> str:
        c = chr(point).lower()
        wide = unicodedata.normalize("NFKC", c)
        c = wide if len(wide) == 1 else c[:1]
        out = self[point] = c if c.isalpha() else " "
        return out


def _fold_table() -> _Fold:
    table = _Fold({ord(c): latin for latin, others in LOOKALIKES.items() for c in others})
    for latin, others in LOOKALIKES.items():
        for c in others:
            if c.upper() != c and len(c.upper()) == 1:
                table[ord(c.upper())] = latin
    return table | {ord(c): c for c in READINGS}


_TABLE = _Fold(_fold_table())
_MARK, _SIGNS = re.compile(r"[1!|+(]"), re.compile(r"[!|+(]+")
_AS_I = {ord(c): r[0] for c, r in READINGS.items()}
_AS_L = _AS_I | {ord(c): "l" for c, r in READINGS.items() if "l" in r}
_AS_BLANK = _AS_I | {ord(c): " " for c, r in READINGS.items() if " " in r}


def _inside(signs: re.Match) -> str:
    """Signs between letters as they are, others blank."""
    text, a, b = signs.string, *signs.span()
    return signs[0] if 0 < a and b < len(text) and text[a - 1] != " " != text[b] else " "


def _marked(text: str | None) -> str:
    """`` word word ... ``: folded but for characters with several readings, single blanks between words and at both ends."""
    return " " + " ".join(_SIGNS.sub(_inside, (text or "").translate(_TABLE)).split()) + " "


def folded(text: str | None) -> str:
    """`` word word ... ``: folded, characters with several readings in their first; single blanks between words and at both ends."""
    return _marked(text).translate(_AS_I)


@dataclass
class Lexicon:
    """Entries (word beginnings; with a blank at the end: whole words) and their weights."""

    entries: list[str]
    weights: np.ndarray
    offset: float = -3.0
    exceptions: tuple[str, ...] = EXCEPTIONS
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}

    def _machine(self):
        """The automaton, the same patterns as a tree of letters, and the most blanks inside one."""
        if self._automaton is None:
            patterns = {" " + " ".join(phrase.split()): -1 for phrase in self.exceptions}
            patterns |= {" " + entry: k for k, entry in enumerate(self.entries)}
            automaton, tree = ahocorasick.Automaton(), {}
            for words, k in patterns.items():
                automaton.add_word(words, (len(words), k))
                node = tree
                for c in words[1:]:
                    node = node.setdefault(c, {})
                node[""] = k
            automaton.make_automaton()
            self._automaton = automaton, tree, max(words.count(" ") for words in patterns) - 1
        return self._automaton

    @staticmethod
    def _read(line: str, start: int, tree: dict) -> Iterator[tuple[int, int, int]]:
        """Patterns at ``start`` in any reading: (start, end, number)."""
        nodes = [(tree, True)]  # and whether the character before was read as a blank
        for at in range(start, len(line)):
            further = {}
            for node, blank in nodes:
                for c in READINGS.get(line[at], line[at]):
                    if c == " " and blank:
                        if at > start:
                            further[id(node), True] = node, True
                    elif c in node:
                        further[id(node[c]), c == " "] = node[c], c == " "
                        if "" in node[c]:
                            yield start, at + 1, node[c][""]
            nodes = list(further.values())
            if not nodes:
                break

    def counts(self, text: str | None) -> dict[int, int]:
        """How often each entry occurs in the folded whole text outside exception phrases."""
        if not self.entries:
            return {}
        automaton, tree, blanks = self._machine()
        line = _marked(text)
        got = {(last - size + 2, last + 1, k) for last, (size, k) in automaton.iter(line)}
        done = 0
        for mark in _MARK.finditer(line):
            if mark.start() < done:
                continue
            first, done = line.rfind(" ", 0, mark.start()), line.find(" ", mark.start())
            starts = [first + 1, *(p for p in range(first + 2, done) if " " in READINGS.get(line[p - 1], ""))]
            for _ in range(blanks):
                first = line.rfind(" ", 0, max(first, 0))
                if first >= 0:
                    starts.append(first + 1)
            for start in starts:
                got.update(self._read(line, start, tree))
        spared = [(a, b) for a, b, k in got if k < 0]
        out: dict[int, int] = {}
        for start, k in sorted({(a, k) for a, _, k in got if k >= 0}):
            if not any(a <= start < b for a, b in spared):
                out[k] = out.get(k, 0) + 1
        return out

    def features(self, text: str | None) -> dict[int, float]:
        """Counts normalised by length: a long text needs more, though less than in proportion."""
        got = self.counts(text)
        scale = 10 / math.sqrt(25 + len((text or "").split())) if got else 0.0
        return {k: n * scale for k, n in got.items()}

    def score(self, text: str | None) -> float:
        return float(sigmoid(np.float64(self.offset + sum(x * self.weights[k] for k, x in self.features(text).items()))))


def _words(text: str | None) -> set[str]:
    """Words of a text in all readings that entries are learned from."""
    line = _marked(text)
    readings = [line.translate(r) for r in (_AS_I, _AS_L, _AS_BLANK)] if _MARK.search(line) else [line]
    return {w for r in readings for w in r.split() if len(w) >= STEM[0]}


def _terms(text: str | None) -> tuple[set[str], set[str]]:
    """The words of a text, and its whole words and word beginnings."""
    words = _words(text)
    return words, {w[:k] for w in words for k in STEM if len(w) >= k} | {w + " " for w in words}


_MIX = np.random.default_rng(9).integers(0, 1 << 63, (2, BANDS * BAND), np.uint64) | np.uint64(1)


def _min_hashes(words: set[str]) -> np.ndarray:
    codes = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)[:, None]
    mixed = (codes * _MIX[0] + _MIX[1]) >> np.uint64(32)
    return mixed.min(axis=0, initial=np.iinfo(np.uint32).max).astype(np.uint32)


def _kinds(hashes: np.ndarray) -> np.ndarray:
    """A number for each row of min-hashes, the same for near copies (and those linked through others)."""
    distinct, at = np.unique(hashes, axis=0, return_inverse=True)
    kind = np.arange(len(distinct))
    for band in range(BANDS):
        _, bucket = np.unique(distinct[:, band * BAND : (band + 1) * BAND], axis=0, return_inverse=True)
        order = np.argsort(bucket.reshape(-1), kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(bucket.reshape(-1)[order])) + 1):
            for row in rows if len(rows) > 1 else ():
                others = rows[kind[rows] != kind[row]]
                if len(others):
                    alike = (distinct[others] == distinct[row]).mean(axis=1) >= ALIKE
                    kind[np.isin(kind, kind[others[alike]])] = kind[row]
    return kind[at.reshape(-1)]


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Lexicon:
    """Entries, weights and curve from labelled rows outside the held-out fold."""
    rows = written(labelled_rows(docs, labels, "toxic", sample, where=fold("doc_id", FOLDS) != HELD_OUT))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([_min_hashes(_words(t)).tobytes() for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), made], names=["doc_id", "label", "hashes"])

    # bounded by the sample: half a kilobyte a row
    hashed = rows.mapInArrow(hashes, "doc_id long, label int, hashes binary").collect()
    numbers = _kinds(np.frombuffer(b"".join(r.hashes for r in hashed), np.uint32).reshape(-1, BANDS * BAND))
    kind_of = docs.sparkSession.sparkContext.broadcast({(r.doc_id, r.label): int(k) for r, k in zip(hashed, numbers)})

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, names, toxic = [], [], []
            for doc, label, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "label", "text"))):
                kind, found = kind_of.value[doc, label], _terms(text)[1]
                kinds += [kind] * (len(found) + 1)
                names += ["", *found]  # the empty term counts the texts
                toxic += [label] * (len(found) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int64()), pa.array(names, pa.string()), pa.array(toxic, pa.int32())], names=["kind", "term", "label"])

    found = rows.mapInArrow(terms, "kind long, term string, label int").groupBy("term", "label").agg(F.countDistinct("kind").alias("n"))
    counts = found.groupBy("term").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("c")
    )
    # bounded by the sample: only terms of mostly toxic texts come back
    got = counts.where((F.col("term") == "") | ((F.col("t") >= 3) & (F.col("t") >= PURITY * (F.col("t") + F.col("c"))))).collect()
    whole = next((r for r in got if r.term == ""), None)
    if whole is None or not whole.t or not whole.c:
        return Lexicon(list(INSULTS), np.array(list(INSULTS.values())))
    entries = list(dict.fromkeys([*INSULTS, *_significant([r for r in got if r.term], whole.t, whole.c)]))
    prior = np.array([INSULTS.get(e, 0.0) for e in entries])
    draft = Lexicon(entries, prior)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [draft.features(t) for t in batch.column("text").to_pylist()]
            at = pa.array([list(m) for m in made], pa.list_(pa.int32()))
            x = pa.array([list(m.values()) for m in made], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), at, x], names=["doc_id", "label", "at", "x"])

    seen = rows.mapInArrow(features, "doc_id long, label int, at array<int>, x array<double>").collect()
    seen.sort(key=lambda r: (r.doc_id, r.label))
    first = np.concatenate(([0], np.cumsum([len(r.at) for r in seen])))
    flat = np.array([k for r in seen for k in r.at], np.int64), np.array([v for r in seen for v in r.x])
    data = Sample(first, *flat, np.zeros((len(seen), 0)), np.array([r.label for r in seen]), len(entries))
    start = np.append(prior, -3.0)

    def grad(change: np.ndarray) -> np.ndarray:
        w = start + change
        off = (sigmoid(data.scores(w[:-1]) + w[-1]) - data.label) / len(seen)
        return np.append(data.gradient(off) + RIDGE * change[:-1], off.sum())

    w = start + descend(grad, len(start), 300)
    return Lexicon(entries, w[:-1], float(w[-1]))


def _significant(rows: list, toxic: int, clean: int) -> list[str]:
    """Terms that are in toxic texts far beyond chance, most evidence first; a beginning
    that nearly always goes on in one way gives way to the longer one."""
    base, counts, kept = toxic / (toxic + clean), {r.term: r.t for r in rows}, []
    longer: dict[str, int] = {}
    for term, t in counts.items():
        longer[term[:-1]] = max(longer.get(term[:-1], 0), t)
    for r in rows:
        share = (r.t + 0.5) / (r.t + r.c + 1)
        evidence = r.t * math.log(share / base) + r.c * math.log((1 - share) / (1 - base))
        if share > base and evidence >= math.log(max(len(rows), 1000) / CHANCE) and longer.get(r.term, 0) < 0.95 * r.t:
            kept.append((-evidence, r.term))
    return [term for _, term in sorted(kept)[:MOST_ENTRIES]]


def toxicity(docs: DataFrame, lexicon: Lexicon, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.array([shared.value.score(t.as_py()) for t in batch.column("text")], np.float64)
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= cut).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
