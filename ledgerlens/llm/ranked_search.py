"""Ranked lexical search with NRA over impact-sorted lists.

Method: for each query term there is a list of the documents that hold it,
sorted by impact (what the term adds to the score). The lists of an item are
read sequentially, block by block and all to the same depth; there is no random
access. A document met has a lower bound, the sum of the impacts read, and an
upper one, which adds for each list in which it was not met yet the impact at
which that list stands. Reading goes on until no document that was not met can
reach the ``k``-th lower bound, every document whose upper bound reaches it
has met or outrun all its lists (so its score is final), and with it ties are
settled. The result is exact.

Distribution: the lists are held by shards of documents, at most ``SHARD``
documents or about ``POSTINGS`` entries each, in the order in which the table is
read. A shard is one row of a written table, made where its documents are read:
no posting is shuffled, a frequent term is spread over all shards, and a lost
executor repeats its own shards. Statistics (documents, terms, document
frequencies) are sums over all shards. Each task searches its shards one after
the other, the ``k``-th score so far of an item being a lower bound for the
next, and gives ``k`` rows an item; these are merged in two steps.

Only terms of the items are kept in lists. The items are the stated query set;
they are searched in blocks of about ``ITEM_TERMS`` terms, so what goes to every
executor (terms, weights) is bounded whatever the size of the table.

Terms: maximal runs of ASCII letters and digits and of characters beyond ASCII,
A-Z lower-cased. Weights and scores are whole numbers, see ``weight`` and
``impact``. Defined results: null and empty texts, and those without terms, are
not counted and never found; items without terms have no rows. Each row of the
documents is a document of its own, repeated rows too; of equal scores the
smaller doc_id comes first, a null id last. Rows that repeat item_id and text
are one item; a null item_id is an item like any other. An empty table on either
side gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import sliced, written
from .kernels import Block, blocks, give_back

TOP = 20
SHARD = 16_384  # documents
POSTINGS = 1_000_000  # entries of a shard from which the next one begins
ITEM_TERMS = 500_000  # terms of the items searched at a time, about
DEPTH = 128  # entries of each list read first; the next blocks double
MERGED = 256  # tasks whose rows are merged first
_TERM = np.zeros(256, bool)
_TERM[128:] = True
_TERM[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True


def terms(raws: list[bytes]) -> tuple[Block, np.ndarray, np.ndarray]:
    """Block of the texts, hashes of their terms in order, and bounds of each text in them."""
    block = Block([r.lower() for r in raws])
    starts, ends = block.spans(_TERM[block.buf])
    return block, block.hashes(starts, ends), block.per_row(starts)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impact(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What an occurrence count adds to the score, but for the term's weight."""
    m = 75 + (25 * n * n_docs) // max(n_terms, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def shards(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """One row a shard: ids (of its documents), n (their terms with repeats), and doc, term, tf of
    every entry, doc and term as places in ids and ``vocabulary`` (sorted hashes)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        ids: list[pa.Array] = []
        held: list[tuple[np.ndarray, ...]] = []
        n_docs = n_held = 0

        def flush() -> pa.RecordBatch:
            n, doc, term, tf = (np.concatenate(x) for x in zip(*held))
            id_ = pa.concat_arrays(ids).cast(pa.int64())
            one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a if isinstance(a, pa.Array) else pa.array(a))
            return pa.RecordBatch.from_arrays([one(id_), one(n), one(doc), one(term), one(tf)], names=["ids", "n", "doc", "term", "tf"])

        for batch in sliced(batches):
            for a, b, raws in blocks(batch.column("text").to_pylist()):
                block, hashes, bounds = terms(raws)
                place = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
                hit = known[place] == hashes if len(known) else np.zeros(len(hashes), bool)
                row = np.repeat(np.arange(block.n), np.diff(bounds))
                key, tf = np.unique(row[hit] * len(known) + place[hit], return_counts=True)
                doc, term = np.divmod(key, max(len(known), 1))
                held.append((np.diff(bounds).astype(np.int64), (doc + n_docs).astype(np.int32), term.astype(np.int32), tf.astype(np.int64)))
                ids.append(batch.column("doc_id").slice(a, b - a))
                n_docs, n_held = n_docs + b - a, n_held + len(key)
                if n_docs >= SHARD - 500 or n_held >= POSTINGS:
                    yield flush()
                    ids, held, n_docs, n_held = [], [], 0, 0
        if held:
            yield flush()
        give_back()

    schema = "ids array<long>, n array<long>, doc array<int>, term array<int>, tf array<long>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def nra(lists: list[tuple[np.ndarray, np.ndarray]], size: int, k: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of all that reach the ``k``-th score, ties included, and at least ``least``.
    ``lists``: for each term the documents (numbers below ``size``) and impacts, greatest first."""
    lower = np.zeros(size, np.int64)
    met = np.zeros((size, len(lists)), bool)
    depth, step = 0, DEPTH
    while True:
        for t, (docs, impacts) in enumerate(lists):
            part = docs[depth : depth + step]
            lower[part] += impacts[depth : depth + step]
            met[part, t] = True
        depth, step = depth + step, step * 2
        frontier = np.array([x[depth] if depth < len(x) else 0 for _, x in lists], np.float64)  # exact: below 2 ** 53
        found = np.flatnonzero(lower)
        low = lower[found]
        bar = max(least, int(np.partition(low, -k)[-k]) if len(low) >= k else 0)
        upper = low + frontier.sum() - met[found].astype(np.float64) @ frontier
        reach = upper >= bar
        settled = bool(np.all(upper[reach] == low[reach]))
        if settled and (frontier.sum() < bar or not frontier.any()):
            return found[reach], low[reach]


class Items:
    """A block of items: the terms they hold and how often, as places in the sorted vocabulary."""

    def __init__(self, rows: list[tuple[int | None, str | None]]):
        held = [terms([(t or "").encode()])[1] for _, t in rows]
        self.ids = [i for i, _ in rows]
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]))
        self.terms = [np.unique(np.searchsorted(self.vocabulary, h), return_counts=True) for h in held]


def _best(score: np.ndarray, rank_id: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((rank_id, -score))[:k]


def _search(items: Items, weights: np.ndarray, n_docs: int, n_terms: int, k: int):
    """Searches of a task: rows item (number), item_id, task, doc_id, score."""
    schema = pa.schema([("item", pa.int32()), ("item_id", pa.int64()), ("task", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 3 for _ in items.ids]
        for batch in batches:
            for at in range(batch.num_rows):
                ids, n, doc, term, tf = (batch.column(c)[at].values for c in ("ids", "n", "doc", "term", "tf"))
                none = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
                id_ = ids.fill_null(0).to_numpy()
                doc, term = doc.to_numpy(), term.to_numpy()
                x = impact(tf.to_numpy(), n.to_numpy()[doc], n_docs, n_terms)
                order = np.lexsort((-x, term))
                doc, x = doc[order], x[order]
                first = np.searchsorted(term[order], np.arange(len(weights) + 1))
                for i, (held, times) in enumerate(items.terms):
                    lists = []
                    for t, c in zip(held.tolist(), times.tolist()):
                        a, b, w = first[t], first[t + 1], int(weights[t]) * c
                        if a < b and w:
                            lists.append((doc[a:b], w * x[a:b]))
                    if not lists:
                        continue
                    score, known, unknown = top[i]
                    docs, scores = nra(lists, len(id_), k, int(score[k - 1]) if len(score) >= k else 1)
                    score, known, unknown = (np.concatenate(p) for p in ((score, scores), (known, id_[docs]), (unknown, none[docs])))
                    best = np.lexsort((known, unknown, -score))[:k]
                    top[i] = score[best], known[best], unknown[best]
        task = TaskContext.get().partitionId()
        for i, (score, known, unknown) in enumerate(top):
            if len(score):
                doc_id = pa.array(known, mask=unknown.astype(bool))
                same = [pa.array([v] * len(score), f.type) for v, f in zip((i, items.ids[i], task), schema)]
                yield pa.RecordBatch.from_arrays([*same, doc_id, pa.array(score)], schema=schema)
        give_back()

    return run


def _topmost(df: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block(docs: DataFrame, items: Items, k: int) -> DataFrame:
    lists = written(shards(docs, items.vocabulary))
    n = lists.select(F.explode("n").alias("n")).agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    n_docs, n_terms = int(n[0] or 0), int(n[1] or 0)
    df = np.zeros(len(items.vocabulary), np.int64)
    for r in lists.select(F.explode("term").alias("term")).groupBy("term").count().collect():  # a row for each term of the items
        df[r.term] = r["count"]
    weights = np.array([weight(n_docs, x) for x in df.tolist()], np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((items, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _search(*shared.value, n_docs, n_terms, k)(batches)

    found = lists.mapInArrow(run, "item int, item_id long, task int, doc_id long, score long")
    some = found.withColumn("part", F.floor(F.col("task") / MERGED))
    merged = _topmost(_topmost(some, ["item", "part"], k).drop("rank"), ["item"], k)
    return merged.select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, benchmark: DataFrame, k: int = TOP, item_terms: int = ITEM_TERMS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of the ``k`` best documents of every item."""
    spark = docs.sparkSession
    queries = written(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct())
    size = queries.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // (4 * item_terms))  # a term has four bytes and more, with what parts it from the next
    out = []
    for p in range(parts):
        here = queries.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p).collect()
        out.append(_block(docs, Items(sorted(((r.item_id, r.text) for r in here), key=str)), k))
    if not out:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, out)
