"""Hard-negative mining with an inverted multi-index.

Method: vectors are cut into two halves, and each half has a codebook (k-means
on a bounded sample). The two codes of a vector name its cell. For an anchor,
each code of a half bounds what a row with this code can add to the inner
product: product with the centre, plus the anchor's length times the code's
radius (of the rows that are there). A heap walks through the two lists of
bounds, sorted, and visits cells by the sum of their half bounds (multi-sequence).
It stops when its windows are certified: no cell to come can hold a row that
belongs among the first ``positives`` rows of the anchor's label, or among the
first ``negatives`` rows of a window of scores. The result is exact, so recall
is 1; the codebooks only decide how early the walk can stop.

Up to ``TOGETHER`` anchors of like cells walk together, by the greatest of their
bounds; of the cells visited, each anchor leaves out those that its own bounds
rule out, and the others are scored for all anchors in one matrix product.

Distribution: rows are dealt by a hash into shards of about ``SHARD``
rows, each with its own cells and radii, so that a third of all rows in one
cell, with one label or with one id, is spread like any other. The anchors are the stated
query set; they meet all shards in blocks of about ``ANCHORS``. A task walks
the shards of a part of the files (about ``GROUP`` of them) for the blocks of a
part of the files, read from where they are written (no copies are shuffled). What it
has found in one shard is where it begins in the next, and it gives at most
``positives`` (``negatives``) rows for each anchor (window); these are merged by
anchor (window), first those of each group of ``MERGED`` shards.

Sample: at most ``SAMPLE`` rows, those with the least hash of their id, fit the
codebooks; every row is indexed. The sample is all that the driver gets of the vectors:
executors put it in order, out of the rows whose hash is below a limit.

Defined results: rows with a null id, label or vector, or any component that is
null or not finite, take no part. Rows equal in id, label and vector count once.
An anchor's other rows are those with another id; anchors that
share an id are searched each, and their rows ranked together. Vectors may differ in length:
what the shorter one lacks counts as zero. Anchors without a row of their label
have no result. Equal scores are ranked by the smaller id. Scores must fit 64
bits. Empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from .frames import written
from .kernels import give_back

POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # percent of the positive's score between which a negative's lies
CODES = 16  # of each half
SAMPLE = 4000
SHARD, ANCHORS = 8192, 4096
TOGETHER = 512  # anchors that walk together
VISIT = 256  # rows gathered from cells before they are first scored; then twice as many each time, up to eight times
GROUP = 64  # shards of a task, where there are many
MERGED = 256
_NONE, _ALL = np.iinfo(np.int64).max, np.iinfo(np.int64).min  # as the least score asked for


def usable_rows(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, v (whole numbers) of the rows that take part, once each."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    return rows.select(
        F.col("vec_id").cast("long").alias("vec_id"), moved.cast("long").alias("label"), F.transform(x, lambda c: F.floor(c * 256).cast("long")).alias("v")
    ).distinct()


def codebook(sample: np.ndarray, codes: int, rounds: int = 10) -> np.ndarray:
    """Centres by k-means, begun at rows spread over the sample."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    centre = sample[np.linspace(0, len(sample) - 1, min(codes, len(sample))).astype(int)].copy()
    for _ in range(rounds):
        code = nearest(sample, centre)
        for k in range(len(centre)):
            if len(own := sample[code == k]):
                centre[k] = own.mean(0)
    return centre


def nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.argmin((centre**2).sum(1) - 2 * x @ centre.T, axis=1)


@dataclass
class Index:
    """The inverted multi-index of one shard: rows in the order of their cells."""

    ids: np.ndarray
    labels: np.ndarray
    rows: np.ndarray
    cells: np.ndarray  # [code of the first half, code of the second, first row, row after the last]
    centres: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    most: int  # the greatest absolute value of a component
    _as: dict = field(default_factory=dict)  # rows by type of number

    @staticmethod
    def of(ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, centres: tuple[np.ndarray, np.ndarray]) -> Index:
        half = centres[0].shape[1]
        parts = rows[:, :half].astype(np.float64), rows[:, half:].astype(np.float64)
        codes = [nearest(x, c) for x, c in zip(parts, centres)]
        radii = []
        for x, c, code in zip(parts, centres, codes):
            radius = np.zeros(len(c))
            np.maximum.at(radius, code, np.sqrt(((x - c[code]) ** 2).sum(1)))
            radii.append(radius)
        cell = codes[0] * len(centres[1]) + codes[1]
        order = np.argsort(cell, kind="stable")
        cut = np.flatnonzero(np.diff(cell[order], prepend=-1))
        first, second = np.divmod(cell[order][cut], len(centres[1]))
        cells = np.stack([first, second, cut, np.append(cut[1:], len(order))], 1)
        return Index(ids[order], labels[order], rows[order], cells, centres, (radii[0], radii[1]), _top(rows))

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """For each anchor (row of ``q``) and each code of the two halves: what a row with this code can add at
        most; and the slack of doubles."""
        half = self.centres[0].shape[1]
        one, two = (
            x @ c.T + np.sqrt((x * x).sum(1))[:, None] * r for x, c, r in zip((q[:, :half].astype(np.float64), q[:, half:].astype(np.float64)), self.centres, self.radii)
        )
        return one, two, 1 + 1e-9 * float(np.abs(one).max(initial=0) + np.abs(two).max(initial=0))

    def walk(self, one: np.ndarray, two: np.ndarray, slack: float) -> Iterator[tuple[float, np.ndarray]]:
        """(bound, cells): runs of cells in the order in which the multi-sequence heap visits them;
        ``bound`` is not below the score of any row to come, those of the run included, for any of the anchors."""
        sums = one.max(0), two.max(0)
        order = [np.argsort(-s, kind="stable") for s in sums]
        held = {(a, b): (k, y - x) for k, (a, b, x, y) in enumerate(self.cells.tolist())}
        first, second = (s[o].tolist() for s, o in zip(sums, order))
        code = [o.tolist() for o in order]
        heap, left = [(-first[0] - second[0], 0, 0)], len(held)
        gathered: list[int] = []
        n, most, bound = 0, VISIT, 0.0
        while left:
            minus, i, j = heapq.heappop(heap)
            if j + 1 < len(second):
                heapq.heappush(heap, (-first[i] - second[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(first):
                heapq.heappush(heap, (-first[i + 1] - second[0], i + 1, 0))
            cell = held.get((code[0][i], code[1][j]))
            if cell is not None:
                if not gathered:
                    bound = -minus + slack
                gathered.append(cell[0])
                n, left = n + cell[1], left - 1
                if n >= most or not left:
                    yield bound, np.array(gathered)
                    gathered, n, most = [], 0, min(2 * most, 8 * VISIT)

    def rows_of(self, cells: np.ndarray) -> np.ndarray:
        return np.concatenate([np.arange(a, b) for a, b in self.cells[cells, 2:].tolist()])

    def visits(self, q: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
        """(bound, rows) of the walk for one anchor."""
        for bound, cells in self.walk(*self.bounds(q[None])):
            yield bound, self.rows_of(cells)

    def open_rows(self, q: np.ndarray, least: Callable[[], np.ndarray], begun: bool) -> Iterator[tuple[np.ndarray, np.ndarray | slice]]:
        """(anchors, rows) to be scored, by the walk of all anchors together: no other row has a score of
        ``least()`` or above (for each anchor, asked again at each run). The order of the cells only serves to
        raise ``least()`` early: with lists full from other shards (``begun``), and bounds that rule out less than
        half of the shard, rows are given in the order in which they are stored."""
        one, two, slack = self.bounds(q)
        if begun:
            open_ = one[:, self.cells[:, 0]] + two[:, self.cells[:, 1]] + slack >= least()[:, None]
            if 2 * (open_ @ (self.cells[:, 3] - self.cells[:, 2])).sum() > len(q) * len(self.ids):
                who = np.flatnonzero(open_.any(1))
                yield from ((who, slice(i, i + 8 * VISIT)) for i in range(0, len(self.ids), 8 * VISIT))
                return
        for bound, cells in self.walk(one, two, slack):
            asked = least()
            if bound < asked.min():
                break
            open_ = one[:, self.cells[cells, 0]] + two[:, self.cells[cells, 1]] + slack >= asked[:, None]
            who = np.flatnonzero(open_.any(1))
            if len(who):
                yield who, self.rows_of(cells[open_.any(0)])

    def scores(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Inner products of anchors and rows, as whole numbers: in single or double precision where these are exact."""
        top = self.most * _top(q) * max(q.shape[1], 1)
        kind = np.float32 if top < 2**24 else np.float64 if top < 2**52 else np.int64
        if kind not in self._as:
            self._as[kind] = self.rows.astype(kind)
        return q.astype(kind) @ self._as[kind][at].T


def _top(x: np.ndarray) -> int:
    """The greatest absolute value."""
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


class First:
    """The first ``k`` (score, id) of each of several lists, by falling score, then rising id."""

    def __init__(self, lists: int, k: int):
        self.k, self.n = k, np.zeros(lists, np.int64)
        self.score, self.id_ = np.full((lists, k), _ALL), np.full((lists, k), _NONE)

    def least(self) -> np.ndarray:
        """The score below which a list takes no row."""
        return self.score[:, -1]

    def add(self, at: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        """Rows, each with its list."""
        last = self.score[at, -1]
        in_ = (self.n[at] < self.k) | (score > last) | (score == last) & (id_ < self.id_[at, -1])
        if not in_.any():
            return
        at, score, id_ = at[in_], score[in_], id_[in_]
        lists = np.unique(at)
        held = np.arange(self.k) < self.n[lists][:, None]
        at = np.concatenate([at, np.repeat(lists, self.n[lists])])
        score, id_ = np.concatenate([score, self.score[lists][held]]), np.concatenate([id_, self.id_[lists][held]])
        order = np.lexsort((id_, ~score, at))
        at, score, id_ = at[order], score[order], id_[order]
        begin = np.searchsorted(at, lists)
        rank = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
        in_ = rank < self.k
        self.score[at[in_], rank[in_]], self.id_[at[in_], rank[in_]] = score[in_], id_[in_]
        self.n[lists] = np.minimum(np.diff(np.append(begin, len(at))), self.k)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, score, id) of all rows."""
        held = np.arange(self.k) < self.n[:, None]
        return np.repeat(np.arange(len(self.n)), self.n), self.score[held], self.id_[held]


@dataclass
class Anchors:
    """A block of anchors, with the order in which they walk together: by label (``alike``) or not, then by cell."""

    ids: np.ndarray
    labels: np.ndarray
    q: np.ndarray
    centres: tuple[np.ndarray, np.ndarray]

    def together(self, alike: bool) -> list[np.ndarray]:
        half = self.centres[0].shape[1]
        codes = [nearest(x.astype(np.float64), c) for x, c in zip((self.q[:, :half], self.q[:, half:]), self.centres)]
        labels = self.labels if alike else np.zeros(len(self.ids), np.int64)
        order = np.lexsort((codes[1], codes[0], labels))
        groups = np.split(order, np.flatnonzero(np.diff(labels[order])) + 1) if len(order) else []
        return [g[i : i + TOGETHER] for g in groups for i in range(0, len(g), TOGETHER)]


def _full(found: First, lists: np.ndarray) -> bool:
    """Whether nearly all of the lists are full."""
    return 10 * np.count_nonzero(found.n[lists] == found.k) > 9 * lists.size


def nearest_rows(index: Index, anchors: Anchors, group: np.ndarray, found: First) -> None:
    """Adds the shard's rows to ``found``, the first other rows of the anchors' label; ``group``: anchors of one label."""
    label, ids, q = anchors.labels[group[0]], anchors.ids[group], anchors.q[group]
    if not (index.labels == label).any():
        return
    for who, at in index.open_rows(q, lambda: found.least()[group], _full(found, group)):
        at = np.arange(len(index.ids))[at]
        at = at[index.labels[at] == label]
        if not len(at):
            continue
        score = index.scores(q[who], at)
        least = found.least()[group[who]].astype(score.dtype)
        if len(at) > found.k and (found.n[group[who]] < found.k).any():  # else every row would be sorted in
            other = np.where(index.ids[at] == ids[who][:, None], score.min(initial=0), score)
            least = np.maximum(least, np.partition(other, -found.k, axis=1)[:, -found.k])
        a, r = np.divmod(np.flatnonzero(score >= least[:, None]), len(at))
        other = index.ids[at[r]] != ids[who[a]]
        a, r = a[other], r[other]
        found.add(group[who[a]], score[a, r].astype(np.int64), index.ids[at[r]])


def window_rows(index: Index, anchors: Anchors, group: np.ndarray, cut: np.ndarray, low: np.ndarray, high: np.ndarray, found: First) -> None:
    """Adds the shard's rows to ``found``, the first rows of other labels in each window (``low`` to ``high``, both
    included); the windows of anchor ``k`` are those from ``cut[k]`` to ``cut[k + 1]``."""
    labels, q, first, n = anchors.labels[group], anchors.q[group], cut[group], cut[group + 1] - cut[group]
    n_most = int(n.max(initial=0))
    slot = first[:, None] + np.minimum(np.arange(n_most), np.maximum(n - 1, 0)[:, None])  # of each anchor, the last again
    if not n_most:
        return
    has = n > 0
    slot[~has] = 0
    shut = (low > high)[slot] | ~has[:, None]
    top = np.where(shut, _ALL, high[slot]).max(1)

    def least() -> np.ndarray:
        return np.where(shut, _NONE, np.maximum(low, found.least())[slot]).min(1)

    for who, at in index.open_rows(q, least, _full(found, slot[~shut])):
        score = index.scores(q[who], at)
        inside = score >= least()[who].astype(score.dtype)[:, None]
        if 32 * np.count_nonzero(inside) > inside.size:  # else few are above; they go with the list
            inside &= score <= top[who].astype(score.dtype)[:, None]
        a, r = np.divmod(np.flatnonzero(inside), inside.shape[1])
        s, a, id_, label = score[a, r].astype(np.int64), who[a], index.ids[at][r], index.labels[at][r]
        other = label != labels[a]
        s, a, id_ = s[other], a[other], id_[other]
        k = slot[a]
        x, w = np.nonzero((np.arange(n_most) < n[a][:, None]) & (s[:, None] >= np.maximum(low, found.least())[k]) & (s[:, None] <= high[k]))
        found.add(k[x, w], s[x], id_[x])


def first_rows(index: Index, anchor: int, q: np.ndarray, label: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of the first ``k`` other rows of one anchor's label in this shard."""
    found = First(1, k)
    nearest_rows(index, Anchors(np.array([anchor]), np.array([label]), q[None], index.centres), np.zeros(1, int), found)
    return found.rows()[1:]


# ----------------------------------------------------------------- tables
def _sample(rows: DataFrame, n: int, sample: int) -> list[Row]:
    """``v`` of the ``sample`` rows with the least hash of their id. The limit under which hashes are looked at leaves
    about twice as many rows; where ids repeat it may leave too few, and is raised."""
    hash_, share = F.xxhash64("vec_id"), 2 * sample / n
    while True:
        low = rows if share >= 1 else rows.where(hash_ <= int(2**64 * share) - 2**63)
        some = written(low.orderBy(hash_, "vec_id", "label", "v").limit(sample).select("v")).collect()
        if len(some) == sample or share >= 1:
            return some
        share *= 16


def _packed(rows: DataFrame, n_parts: int, name: str, dim: int, kind: str) -> DataFrame:
    """One row for each of ``n_parts`` parts: its number, and the bytes of its ids, labels and v (vectors one after the
    other, padded with zeros, in numbers of type ``kind``)."""

    def run(table: pa.Table) -> pa.Table:
        v = table.column("v").combine_chunks()
        size = np.diff(v.offsets.to_numpy())
        out = np.zeros((len(size), dim), kind)
        out[np.repeat(np.arange(len(size)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = v.flatten().to_numpy()
        held = [table.column(c).to_numpy().tobytes() for c in ("vec_id", "label")] + [out.tobytes()]
        return pa.table([table.column("part").slice(0, 1), *(pa.array([x], pa.binary()) for x in held)], names=[name, "ids", "labels", "v"])

    part = F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(n_parts)).cast("int").alias("part")
    return rows.select(part, "vec_id", "label", "v").groupBy("part").applyInArrow(run, f"{name} int, ids binary, labels binary, v binary")


def _longs(batch: pa.RecordBatch, at: int, column: str, kind: str = "int64") -> np.ndarray:
    return np.frombuffer(batch.column(column)[at].as_py(), kind)


def _arrays(batch: pa.RecordBatch, at: int, prefix: str, dim: int, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels, v = (_longs(batch, at, prefix + c, t) for c, t in (("ids", "int64"), ("labels", "int64"), ("v", kind)))
    return ids, labels, v.reshape(len(ids), dim)


def _meet(blocks: DataFrame, shards: DataFrame, n_shards: int) -> DataFrame:
    """Every shard with every block of anchors, a row each: one shard after the other, its blocks in a row. Tasks read
    both sides where they are written."""
    tasks = max(-(-n_shards // GROUP), 2 * shards.sparkSession.sparkContext.defaultParallelism)
    held = shards.select("shard", *[F.col(c).alias(f"s_{c}") for c in ("ids", "labels", "v")])
    return held.coalesce(tasks).crossJoin(blocks.hint("shuffle_replicate_nl"))


def _met(batches: Iterator[pa.RecordBatch], dim: int, kind: str, centres: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[int, Index, int, pa.RecordBatch, int]]:
    """(shard, its index, block, batch, place in it) of each row of ``_meet``."""
    shard, index = None, None
    for batch in batches:
        for at in range(batch.num_rows):
            if (k := batch.column("shard")[at].as_py()) != shard:
                shard, index = k, Index.of(*_arrays(batch, at, "s_", dim, kind), centres)
            yield shard, index, batch.column("block")[at].as_py(), batch, at


def _first(df: DataFrame, by: list[str], id_: str, score: str, k: int) -> DataFrame:
    """The first ``k`` rows of each group with their rank, by groups of shards first."""

    def top(df: DataFrame, keys: list[str]) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.desc(score), id_)
        return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    some = df.withColumn("part", F.floor(F.col("shard") / MERGED))
    return top(top(some, [*by, "part"]).drop("rank", "part"), by)


def hard_negatives(embeddings: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, every: int = 100, sample: int = SAMPLE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = embeddings.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = written(usable_rows(embeddings))
    n, dim, n_anchors, least, most = rows.agg(
        F.count("*"), F.max(F.size("v")), F.count_if(F.col("vec_id") % every == 0), F.min(F.array_min("v")), F.max(F.array_max("v"))
    ).first()
    if not n_anchors:
        return spark.createDataFrame([], schema)
    dim, kind = max(dim, 2), "int16" if -(2**15) <= (least or 0) and (most or 0) < 2**15 else "int64"
    n_shards, n_blocks = -(-n // SHARD), -(-n_anchors // ANCHORS)
    some = _sample(rows, n, sample)
    x = np.zeros((len(some), dim))
    for i, r in enumerate(some):
        x[i, : len(r.v)] = r.v
    centres = codebook(x[:, : dim // 2], CODES), codebook(x[:, dim // 2 :], CODES)
    shared = spark.sparkContext.broadcast(centres)
    shards = written(_packed(rows, n_shards, "shard", dim, kind))
    anchors = written(_packed(rows.where(F.col("vec_id") % every == 0), n_blocks, "block", dim, kind))

    def find_positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun: dict[int, tuple[int, Anchors, list[np.ndarray], First]] = {}
        for shard, index, block, batch, at in _met(batches, dim, kind, shared.value):
            if block not in begun:
                own = Anchors(*_arrays(batch, at, "", dim, kind), shared.value)
                begun[block] = shard, own, own.together(alike=True), First(len(own.ids), positives)
            _, own, groups, found = begun[block]
            for group in groups:
                nearest_rows(index, own, group, found)
        for block, (shard, _, _, found) in begun.items():
            place, score, id_ = found.rows()
            same = [pa.array(np.full(len(id_), x, np.int32)) for x in (block, shard)]
            yield pa.RecordBatch.from_arrays([*same, pa.array(place), pa.array(id_), pa.array(score)], names=["block", "shard", "place", "positive_id", "positive_score"])
        give_back()

    near = _meet(anchors, shards, n_shards).mapInArrow(find_positives, "block int, shard int, place long, positive_id long, positive_score long")
    chosen = _first(near, ["block", "place"], "positive_id", "positive_score", positives)

    def listed(table: pa.Table) -> pa.Table:
        table = table.sort_by([("place", "ascending"), ("rank", "ascending")])
        names = ["place", "positive_id", "positive_score"]
        return pa.table([table.column("block").slice(0, 1), *(pa.array([table.column(c).to_numpy().tobytes()], pa.binary()) for c in names)], names=["block", *names])

    lists = chosen.groupBy("block").applyInArrow(listed, "block int, place binary, positive_id binary, positive_score binary")
    asked = written(anchors.join(written(lists), "block").select("block", "ids", "labels", "v", "place", "positive_id", "positive_score"))

    def find_negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun: dict[int, tuple] = {}
        for shard, index, block, batch, at in _met(batches, dim, kind, shared.value):
            if block not in begun:
                own = Anchors(*_arrays(batch, at, "", dim, kind), shared.value)
                place, positive, score = (_longs(batch, at, c) for c in ("place", "positive_id", "positive_score"))
                # least and greatest whole scores with low * positive <= 100 * score <= high * positive
                lows = np.array([-(-low * s // 100) for s in score.tolist()], np.int64)
                highs = np.array([high * s // 100 for s in score.tolist()], np.int64)
                cut = np.searchsorted(place, np.arange(len(own.ids) + 1))
                begun[block] = shard, own, own.together(alike=False), First(len(place), negatives), (cut, lows, highs), (own.ids[place], positive, score)
            _, own, groups, found, windows, _ = begun[block]
            for group in groups:
                window_rows(index, own, group, *windows, found)
        for shard, _, _, found, _, (anchor, positive, score) in begun.values():
            window, s, id_ = found.rows()
            columns = [np.full(len(window), shard, np.int32), anchor[window], positive[window], id_, score[window], s]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["shard", "anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])
        give_back()

    hard = _meet(asked, shards, n_shards).mapInArrow(find_negatives, "shard int, anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    ranked = _first(hard, ["anchor_id", "positive_id", "positive_score"], "negative_id", "negative_score", negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
