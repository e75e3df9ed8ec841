"""Near-duplicate groups by SimHash, found with a segment-popcount embedding.

Method: a 64-bit fingerprint is mapped to its bit counts in 32 segments of two
bits. The Manhattan distance of two such vectors is a lower bound of the
Hamming distance, so if the latter is at most ``max_bits``, then in two thirds of
the vector (of the three ways to leave one third out, at least one) the former
is at most ``2 * max_bits // 3``. These parts are points of an integer grid; each
point goes to the grid cells within half that distance, so two points within
reach of each other meet in a cell that lies between them (a range join as an
equality join on cells). Pairs that meet are verified exactly, by counting
differing bits. Two thirds of a vector have some 30 bits of information, so
fingerprints that have nothing to do with each other hardly ever meet.

Links in proportion to a cell, not to its square: only distinct fingerprints are
joined, copies never meet. In each cell every fingerprint is first verified
against one hub, the same in all cells where it can be. What is so connected
need not be compared again: only the members of a cell outside its largest
component meet the others of the cell, and these give all links that are left.
It is one way at every size of a cell, and loses no link between two
fingerprints that are not connected already.

Fingerprints: A-Z lower-cased, words between ASCII white space, runs of
``width`` words joined by one space (repeats included; fewer words: the whole
sequence), XXH64 of each; a bit is set if over half the hashes have it. A text
without words has fingerprint 0 and links like any other.

Defined results: null text counts as empty. Rows with a null id belong to
components but never name one unless no member has an id (then it is null).
Repeated rows each give one row. Only ``doc_id`` and ``text`` are read.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .frames import among, free_name, key_list, written
from .kernels import give_back

WIDTH, MAX_BITS, SEED = 4, 4, 42
PART = 20_000  # fingerprints whose cells one task makes, about
_STEP = 65_536  # shingles hashed at once


def fingerprint(text: str | None, width: int = WIDTH, seed: int = SEED) -> int:
    """SimHash of one whole text as an unsigned number."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    first, last = starts[:n], ends[min(width, len(words)) - 1 :]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, n, _STEP):
        spans = zip(first[k : k + _STEP].tolist(), last[k : k + _STEP].tolist())
        h = np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """doc_id, content (a hash of the text) and fp (the fingerprint's 64 bits as a long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py(), width, seed) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("content"), pa.array(_signed(fp))], names=["doc_id", "content", "fp"])
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("content"), "text")
    return rows.mapInArrow(run, "doc_id long, content long, fp long")


_PARTS = ((0, 11), (11, 22), (22, 32))  # segments of each third


def _cells(fp: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell, index into fp): grid cells within ``reach`` of the popcount vector with any third left out."""
    even = np.uint64(0x5555555555555555)
    vector = (fp & even) + (fp >> np.uint64(1) & even)
    cells, rows = [], []
    for a, b in _PARTS:
        left_out = np.uint64(((1 << 2 * (b - a)) - 1) << 2 * a)
        mark = np.uint64(3 << 2 * a)  # no segment counts three bits: tells which third is left out
        at, found = np.arange(len(fp)), vector & ~left_out
        for _ in range(reach):
            more, of = [found], [at]
            for k in (*range(a), *range(b, 32)):
                count = found >> np.uint64(2 * k) & np.uint64(3)
                one = np.uint64(1 << 2 * k)
                for ok, to in ((count < 2, found + one), (count > 0, found - one)):
                    more.append(to[ok])
                    of.append(at[ok])
            at, found = np.concatenate(of), np.concatenate(more)
        if reach > 1:  # more than one way leads to a cell
            pairs = np.unique(np.stack([at.astype(np.uint64), found], 1), axis=0)
            at, found = pairs[:, 0].astype(np.int64), pairs[:, 1]
        cells.append(found | mark)
        rows.append(at)
    return np.concatenate(cells), np.concatenate(rows)


def _spread(fps: DataFrame, reach: int, known=None, at_once: int = 5000) -> DataFrame:
    """``cell, fp`` for every cell (of those in the broadcast list ``known``) that a fingerprint goes to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(0, len(fp), at_once):
                part = fp[k : k + at_once]
                cell, row = _cells(part, reach)
                cell = _signed(cell)
                if known is not None:
                    met = among(cell, known.value)
                    cell, row = cell[met], row[met]
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(_signed(part[row]))], names=["cell", "fp"])
        give_back()

    return fps.select("fp").mapInArrow(run, "cell long, fp long")


def _differing(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def meetings(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``cell, fp``: the cells in which fingerprints meet, written. ``fps``: distinct fingerprints, column ``fp``, written.

    Up to ``KNOWN_KEYS`` cells are picked out by their list while the fingerprints' cells are made a
    second time; more than that are found by a join, for which all cells move once more."""
    reach = (2 * max_bits // 3 + 1) // 2
    fps = fps.repartition(max(1, -(-fps.count() // PART)), "fp")
    cells = _spread(fps, reach)
    often = written(cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").select("cell"))
    known = key_list(often)
    return written(cells.join(often, "cell") if known is None else _spread(fps, reach, known))


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``a, b``: links that join the same fingerprints into components as all pairs within
    ``max_bits`` would. ``fps``: distinct fingerprints, column ``fp``, already written."""
    met = meetings(fps, max_bits)
    hub = written(met.groupBy("cell").agg(F.min(F.struct(F.xxhash64("fp").alias("h"), "fp")).alias("x")).select("cell", F.col("x.fp").alias("b")))
    near = lambda a, b: (F.col(a) != F.col(b)) & (_differing(F.col(a), F.col(b)) <= max_bits)
    first = written(met.join(hub, "cell").where(near("fp", "b")).select(F.col("fp").alias("a"), "b").distinct())
    placed = written(met.join(components(first), met.fp == F.col("node"), "left").select("cell", "fp", F.coalesce("root", "fp").alias("root")))
    parts = placed.groupBy("cell", "root").agg(F.count("*").alias("n"))
    main = parts.groupBy("cell").agg(F.count("*").alias("parts"), F.max(F.struct("n", "root")).alias("m"))
    mixed = written(main.where("parts > 1").select("cell", F.col("m.root").alias("main")))
    left = written(placed.join(mixed, "cell"))
    minor = left.where("root <> main").select("cell", F.col("fp").alias("a"), F.col("root").alias("root_a"))
    all_ = left.select("cell", F.col("fp").alias("b"), F.col("root").alias("root_b"), "main")
    once = (F.col("root_b") == F.col("main")) | (F.col("a") < F.col("b"))
    rest = minor.join(all_, "cell").where((F.col("root_a") != F.col("root_b")) & once & near("a", "b"))
    return first.unionByName(rest.select("a", "b").distinct())


def _groups(docs: DataFrame, width: int, max_bits: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, content, fp of each row; fp, root, component_id of each fingerprint), both written."""
    marked = written(fingerprints(docs, width, seed))
    classes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(classes.select("fp"), max_bits))
    rooted = written(classes.join(roots, classes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return marked, written(rooted.join(written(ids), "root").select("fp", "root", "component_id"))


def near_duplicates(docs: DataFrame, width: int = WIDTH, max_bits: int = MAX_BITS, seed: int = SEED) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of ``docs``."""
    marked, names = _groups(docs, width, max_bits, seed)
    return marked.join(names, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, width: int = WIDTH, max_bits: int = MAX_BITS, seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that stand for their component: the one
    with the smallest id (a null id is greater than any). Of repeated rows one stays."""
    marked, names = _groups(docs, width, max_bits, seed)
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "fp", "content")
    first = marked.join(names.select("fp", "root"), "fp").groupBy("root").agg(F.min(order).alias("w"))
    keys = {k: free_name(docs, k) for k in ("none", "id", "content")}
    stay = written(first.select(*[F.col(f"w.{k}").alias(c) for k, c in keys.items()]))
    id_ = F.col("doc_id").cast("long")
    keyed = docs.withColumns(dict(zip(keys.values(), (id_.isNull(), F.coalesce(id_, F.lit(0)), F.xxhash64("text")))))
    return keyed.join(stay, [*keys.values()], "left_semi").dropDuplicates([*keys.values()]).drop(*keys.values())
