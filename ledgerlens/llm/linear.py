"""Linear models over hashed features, fitted on a bounded sample of labelled rows
(``labelled_rows``) or on all of them (``labelled_parts``)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.percentile import percentile_cont
from .features import N_DENSE, WIDTH, dense, sparse_rows, text_stats
from .frames import sliced, written
from .kernels import Block, blocks, give_back


def _known_labels(docs: DataFrame, labels: DataFrame, label: str, where: Column | None) -> DataFrame:
    """doc_id, label: the labels 0 and 1 of documents that are there and have an id."""
    lab = labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("int").alias("label"))
    lab = lab.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    if where is not None:
        lab = lab.where(where)
    return lab.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int, where: Column | None = None) -> DataFrame:
    """doc_id, label, text of at most ``rows`` labelled documents, chosen by a hash of their id.

    The choice is made on the ids alone (a top-k over the labels of documents
    that are there), so the ids that are broadcast and the texts that come back
    are bounded by ``rows`` whatever the size of the tables, and labels of other
    documents take no place. Labels other than 0 and 1, and null ids, are left
    out; of repeated rows of one id the greatest text counts once.
    """
    lab = _known_labels(docs, labels, label, where)
    chosen = lab.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))


@dataclass
class Sample:
    """Features of labelled rows: compressed sparse rows, dense columns and labels."""

    first: np.ndarray
    bucket: np.ndarray
    value: np.ndarray
    dense: np.ndarray
    label: np.ndarray
    width: int = WIDTH

    def _parts(self, rows: int = 250):
        """Some rows at a time, so that a pass over the sample needs little memory besides it."""
        for a in range(0, len(self.label), rows):
            first = self.first[a : a + rows + 1]
            yield a, first - first[0], self.bucket[first[0] : first[-1]], self.value[first[0] : first[-1]]

    def scores(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.label))
        for a, first, bucket, value in self._parts():
            sums = np.concatenate(([0.0], np.cumsum(w[bucket] * value)))
            out[a : a + len(first) - 1] = np.diff(sums[first])
        return out

    def gradient(self, by_row: np.ndarray) -> np.ndarray:
        out = np.zeros(self.width)
        for a, first, bucket, value in self._parts():
            size = np.diff(first)
            out += np.bincount(bucket, value * np.repeat(by_row[a : a + len(size)], size), self.width)
        return out


AT_LEAST = 15  # rows that a bucket has to be met in, or no weight can be learned for it


def sample_of(found: DataFrame, at_least: int = AT_LEAST) -> Sample:
    """Compute the features on the executors and gather them (bounded by the sample's size).
    Buckets met in fewer than ``at_least`` rows are dropped: no weight can be learned for them."""

    def featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b, raws in blocks(batch["text"]):
                block = Block(raws)
                rows = sparse_rows(block)
                yield pd.DataFrame(
                    {
                        "doc_id": batch["doc_id"].iloc[a:b].to_numpy(),
                        "label": batch["label"].iloc[a:b].to_numpy(),
                        "buckets": [r[0].tobytes() for r in rows],
                        "values": [r[1].tobytes() for r in rows],
                        "dense": [d.tobytes() for d in dense(text_stats(block))],
                    }
                )

    got = found.mapInPandas(featurise, "doc_id long, label int, buckets binary, values binary, dense binary").collect()
    got.sort(key=lambda r: (r.doc_id, r.label))
    bucket = np.frombuffer(b"".join(r.buckets for r in got), np.int32)
    value = np.frombuffer(b"".join(r["values"] for r in got), np.float32)
    size = np.fromiter((len(r.buckets) // 4 for r in got), np.int64, len(got))
    wide = np.frombuffer(b"".join(r.dense for r in got), np.float64).reshape(len(got), N_DENSE)
    label = np.fromiter((r.label for r in got), np.int64, len(got))
    del got
    used = np.bincount(bucket, minlength=WIDTH) >= at_least
    keep = used[bucket]
    at = np.flatnonzero(keep)
    first = np.searchsorted(at, np.concatenate(([0], np.cumsum(size))))
    return Sample(first, bucket[at], value[at], wide, label)


FIT, HELD, COPY = 0, 1, 2  # roles of a part's rows: fits weights, calibrates, fits in one more part
RARE = 50  # rows of the rarer class that a part is given, about
CELL = 20_000  # documents of one task that picks labelled texts, about
TASKS = 32  # tasks of a pass over the parts, at most: each sends one array to the driver


@dataclass
class Part(Sample):
    """A part of the labelled rows; ``role``: FIT, HELD or COPY."""

    role: np.ndarray | None = None


def labelled_parts(docs: DataFrame, labels: DataFrame, label: str, rows: int, where: Column) -> RDD | None:
    """Features of all labelled documents, one record per part of about ``rows`` documents, kept on the
    executors' disks until ``unpersist``; None if one class has no document.

    Parts are dealt by a hash of the id. A quarter of each is held for calibration (``held_rows``). Where
    a class is too rare for ``RARE`` rows in each part, those of its rows that fit weights are copied to
    the parts that follow; copies then add about ``RARE / rows`` at most. Labels and repeated documents count as in
    ``labelled_rows``. Texts are shuffled once, with their labels, and leave that task as features."""
    known = _known_labels(docs, labels, label, where).select(F.col("doc_id").cast("long").alias("doc_id"), "label").distinct()
    size = {r.label: r.n for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(size) < 2:
        return None
    rarer = min(size, key=lambda k: (size[k], k))
    parts = -(-sum(size.values()) // rows)
    copies = min(parts, -(-RARE * parts // size[rarer]))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull() & where)
    cells = -(-found.count() // (parts * CELL))  # of each part

    def dealt(n: int) -> Column:
        return F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int")

    def roles(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "label"])
        return group[["doc_id", "label"]].assign(role=np.where(held_rows(len(group)), HELD, FIT))

    known = known.withColumn("part", dealt(parts)).groupBy("part").applyInPandas(roles, "doc_id long, label int, role int")
    both = found.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).unionByName(known, allowMissingColumns=True)
    # the cells decide where rows go, so the texts of one document meet its labels in the task of its part
    both = both.withColumn("cell", dealt(parts * cells)).repartition("cell").groupBy("cell", "doc_id")
    role = [F.max(F.when(F.col("label") == k, F.col("role"))).alias(f"role{k}") for k in (0, 1)]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("label"), F.col(f"role{k}").alias("role")) for k in (0, 1)]))
    both = both.agg(F.max("text").alias("text"), *role).where("role0 is not null or role1 is not null").withColumn("each", each)
    both = both.select((F.col("cell") % parts).alias("part"), "doc_id", "each.label", "each.role", "text").where("role is not null")
    order = ["part", "doc_id", "label"]
    if cells == 1 and copies == 1:  # parts are whole where they are
        made = both.sortWithinPartitions(*order).mapInArrow(lambda batches: _assembled(_featurised(batches)), _PART)
    else:
        places = F.transform(F.sequence(F.lit(0), F.lit(copies - 1)), lambda k: F.struct(F.pmod(F.col("part") + k, F.lit(parts)).alias("part"), k.alias("k")))
        copied = (F.col("label") == rarer) & (F.col("role") == FIT)
        made = both.mapInArrow(_featurised, _ROW).withColumn("at", F.explode(F.when(copied, places).otherwise(F.slice(places, 1, 1))))
        made = made.withColumns({"part": F.col("at.part"), "role": F.when(F.col("at.k") > 0, COPY).otherwise(F.col("role"))}).drop("at")
        made = made.repartition("part").sortWithinPartitions(*order).mapInArrow(_assembled, _PART)
    kept = made.rdd.map(tuple).persist(StorageLevel.DISK_ONLY)
    kept.count()  # made by as many tasks as there are partitions; passes over it take fewer
    return kept


_ROW = "part int, doc_id long, label int, role int, bucket binary, value binary, dense binary"
_PART = "size binary, bucket binary, value binary, dense binary, label binary, role binary"


def _featurised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["part", "doc_id", "label", "role"]
    for batch in sliced(batches):
        for a, b, raws in blocks(batch.column("text").to_pylist()):
            block = Block(raws)
            rows = sparse_rows(block)
            made = [[r[0].tobytes() for r in rows], [r[1].tobytes() for r in rows], [d.tobytes() for d in dense(text_stats(block))]]
            columns = [batch.column(c).slice(a, b - a) for c in names] + [pa.array(x, pa.binary()) for x in made]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "bucket", "value", "dense"])
    give_back()


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per run of rows of one part. Buckets become differences to the one before, which pack well."""

    def packed(rows: list[dict]) -> pa.RecordBatch:
        bucket = np.frombuffer(b"".join(r["bucket"] for r in rows), np.int32)
        made = [
            np.array([len(r["bucket"]) // 4 for r in rows], np.int64).tobytes(),
            pa.compress(np.diff(bucket, prepend=np.int32(0)).tobytes(), "zstd", asbytes=True),
            pa.compress(b"".join(r["value"] for r in rows), "zstd", asbytes=True),
            b"".join(r["dense"] for r in rows),
            np.array([r["label"] for r in rows], np.int8).tobytes(),
            np.array([r["role"] for r in rows], np.int8).tobytes(),
        ]
        return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in made], names=["size", "bucket", "value", "dense", "label", "role"])

    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0]["part"] != row["part"]:
                yield packed(held)
                held = []
            held.append(row)
    if held:
        yield packed(held)
    give_back()


def _parts_of(records: Iterable[tuple]) -> Iterator[Part]:
    for size, bucket, value, wide, label, role in records:
        first = np.concatenate(([0], np.cumsum(np.frombuffer(size, np.int64))))
        unpacked = [np.frombuffer(pa.decompress(x, int(first[-1]) * 4, "zstd"), kind) for x, kind in ((bucket, np.int32), (value, np.float32))]
        yield Part(
            first,
            np.cumsum(unpacked[0], dtype=np.int32),
            unpacked[1],
            np.frombuffer(wide, np.float64).reshape(len(first) - 1, N_DENSE),
            np.frombuffer(label, np.int8).astype(np.int64),
            role=np.frombuffer(role, np.int8),
        )


def summed(parts: RDD, made: Callable[[Part], np.ndarray]) -> np.ndarray:
    """Sum over all parts of the array of doubles that ``made`` gives for each. Tasks add up
    their parts', so at most ``TASKS`` arrays reach the driver whatever the number of parts."""

    def run(records: Iterator[tuple]) -> Iterator[bytes]:
        total = None
        for part in _parts_of(records):
            one = made(part)
            total = one if total is None else total + one
        if total is not None:
            yield total.astype(np.float64).tobytes()

    got = parts.coalesce(min(TASKS, parts.context.defaultParallelism)).mapPartitions(run).collect()
    return np.sum([np.frombuffer(x) for x in got], axis=0)


def met_in(part: Part) -> np.ndarray:
    """In how many documents of the part each bucket is met."""
    row = np.repeat(part.role, np.diff(part.first))
    return np.bincount(part.bucket[row != COPY], minlength=part.width).astype(np.float64)


def held_scores(spark: SparkSession, parts: RDD, scores: Callable[[Part], np.ndarray]) -> DataFrame:
    """u, label of all rows held for calibration, written."""

    def run(records: Iterator[tuple]) -> Iterator[tuple[float, int]]:
        for part in _parts_of(records):
            held = part.role == HELD
            yield from zip(scores(part)[held].tolist(), part.label[held].tolist())
        give_back()

    return written(spark.createDataFrame(parts.mapPartitions(run), "u double, label int"))


def held_rows(n: int) -> np.ndarray:
    """A fixed random quarter of ``n`` rows, for calibration."""
    return np.random.default_rng(0).permutation(n) % 4 == 3


def descend(grad: Callable[[np.ndarray], np.ndarray], size: int, steps: int, rate: float = 0.1) -> np.ndarray:
    """Minimise by full-batch gradient steps with momentum and per-weight scaling, the rate falling to zero."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = grad(w)
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        w -= rate * (1 - (t - 1) / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _newton(sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], steps: int, least: float) -> np.ndarray:
    """Slope and offset where the gradient is zero; ``sums`` gives second derivatives and gradient of all
    rows. Ends after ``steps``, or after a step of less than ``least``."""
    ab = np.array([1.0, 0.0])
    for _ in range(steps):
        h, g = sums(ab)
        step = np.linalg.solve(h + 1e-6 * np.eye(2), g + 1e-6 * ab)
        ab = ab - step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < least:
            break
    return ab


def platt(scores: np.ndarray, label: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and offset of the logistic curve that best turns scores into probabilities
    (Newton steps; targets pulled in from 0 and 1, so separable scores stay finite)."""
    n1, n0 = int(label.sum()), int(len(label) - label.sum())
    if not n1 or not n0:
        return 0.0, 30.0 if n1 else -30.0 if n0 else 0.0
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = max(float(scores.std()), 1e-9)
    x = np.stack([scores / scale, np.ones(len(scores))], 1)

    def sums(ab: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = sigmoid(x @ ab)
        return (x * (p * (1 - p))[:, None]).T @ x, x.T @ (p - target)

    ab = _newton(sums, steps, 0.0)
    return float(ab[0] / scale), float(ab[1])


def platt_of(table: DataFrame, steps: int = 60) -> tuple[float, float | None]:
    """``platt``'s slope for a table of ``u`` and ``label``, and the quantile of ``u`` that leaves as large
    a share above it as is labelled 1. Spark adds up the rows of each step; slope 0 without both classes."""
    n, n1, spread = table.agg(F.count(F.lit(1)), F.sum("label"), F.stddev_pop("u")).first()
    if not n1 or n1 == n:
        return 0.0, None
    scale = max(float(spread), 1e-9)
    x = F.col("u") / scale
    target = F.when(F.col("label") == 1, (n1 + 1) / (n1 + 2)).otherwise(1 / (n - n1 + 2))

    def sums(ab: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = F.greatest(F.least(x * float(ab[0]) + float(ab[1]), F.lit(35.0)), F.lit(-35.0))
        rows = table.select(x.alias("x"), (1 / (1 + F.exp(-z))).alias("p"), target.alias("t"), F.spark_partition_id().alias("at"))
        q, off = F.col("p") * (1 - F.col("p")), F.col("p") - F.col("t")
        made = [F.col("x") * F.col("x") * q, F.col("x") * q, q, F.col("x") * off, off]
        got = rows.groupBy("at").agg(*[F.sum(c) for c in made]).drop("at").collect()
        a, b, c, d, e = (math.fsum(column) for column in zip(*got))  # exact, so the order of the partitions is no matter
        return np.array([[a, b], [b, c]]), np.array([d, e])

    slope = float(_newton(sums, steps, 1e-10)[0] / scale)
    return slope, percentile_cont(table, [], "u", {"q": 1 - n1 / n}).first().q
