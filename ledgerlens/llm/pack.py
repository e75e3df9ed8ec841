"""Packing of tokenised documents into sequences by a grouping genetic algorithm.

Method: documents are tokenised, cut into pieces of at most ``capacity`` tokens
and packed best-fit. A solution is a set of bins; crossover takes whole
well-filled bins of one parent over into the other, drops the bins there that
hold any of the same pieces, and puts the pieces so displaced back by best fit;
mutation dissolves the emptiest bins and some at random. Fitness is the number
of bins, then the sum of squared fill.

Distribution: pieces are dealt by a hash into shards of about ``shard`` pieces
(whatever the size of the table, so a task's share is bounded and has the same
mix of lengths). The first solution of a shard is best fit by decreasing length;
where it needs no more bins than the lengths add up to, nothing can be better and
the shard is settled. Every other shard evolves on ``islands`` islands, one task
each; after an epoch every island passes its elite to the next island of the
ring. Between epochs the elites are written. Badly filled bins of all shards are
then opened and their pieces dealt into fewer shards, until one shard holds them
or ``LEVELS`` times; these hold the pieces that are hardest to place.

Defined results: null text is an empty document, which still has its end token
(one piece of length 1). Every row of ``docs`` is packed, repeated rows and null
ids included; ``row_id`` tells them apart. A row of exactly ``capacity`` tokens
is one full piece. An empty table gives an empty result. Only ``doc_id`` and
``text`` are read.
"""

from __future__ import annotations

import os
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import sliced, written
from .kernels import Block, blocks, give_back, remembered

CAPACITY = 4096
SHARD = 8000  # pieces of a shard, about
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 30
POPULATION = 8
WELL_FILLED = 0.98  # share of the capacity from which crossover takes a bin over, and a level keeps it
MOST_PARTS = 50_000  # tasks that shards are dealt to, at most
LEVELS = 4  # times that badly filled bins are dealt anew
MOST_WORDS = 800_000  # words whose ids a worker remembers, about (some 30 MB)
BLOCK = 2_000_000  # bytes of text whose words are looked up at once
_SIGN, _PLAIN = np.zeros(256, bool), np.zeros(256, bool)
_SIGN[list(b".,;:!?#$%&*|")] = True
_PLAIN[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")] = True


# --------------------------------------------------------------- tokenising
class _Words:
    """A tokenizer and the ids of the words it was asked for, in four arrays sorted by the words' hashes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.hashes, self.begin = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.size, self.ids = np.zeros(0, np.int32), np.zeros(0, "<u4")

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each hash, and whether it is there."""
        at = np.searchsorted(self.hashes, hashes)
        if not len(self.hashes):
            return at, np.zeros(len(at), bool)
        at = np.minimum(at, len(self.hashes) - 1)
        return at, self.hashes[at] == hashes

    def learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        """``hashes``: sorted, none of them known."""
        found = []
        for k in range(0, len(words), 2000):
            batch = self.tokenizer.encode_batch_fast([w.decode() for w in words[k : k + 2000]], add_special_tokens=False)
            found += [np.array(e.ids, "<u4") for e in batch]
        size = np.fromiter(map(len, found), np.int32, len(found))
        begin = np.cumsum(size, dtype=np.int64) - size + len(self.ids)
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.begin, self.size = (np.insert(old, at, new) for old, new in ((self.hashes, hashes), (self.begin, begin), (self.size, size)))
        self.ids = np.concatenate([self.ids, *found])


def _key(path: str) -> str:
    return f"words of {path}"


def _words(path: str) -> _Words:
    return remembered(_key(path), lambda: _Words(path))


def _cut_words(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Spans of the words, with closing ASCII punctuation after a letter or digit as a span of its own
    (a border of pieces for any tokenizer that parts letters from signs)."""
    starts, ends = block.words()
    at = np.arange(len(block.buf))
    solid = np.maximum.accumulate(np.where(_SIGN[block.buf], -1, at))[ends - 1] + 1 if len(ends) else ends
    part = (solid < ends) & (solid > starts) & _PLAIN[block.buf[np.maximum(solid - 1, 0)]]
    k = np.flatnonzero(part)
    return np.insert(starts, k + 1, solid[k]), np.insert(ends, k, solid[k])


def token_ids(texts: list[bytes], path: str, end: int) -> list[memoryview]:
    """Ids of each whole text and the end token, as little-endian unsigned 32-bit numbers.

    For tokenizers that ignore case and whose pieces never hold white space: the
    ids of a text are those of its words, so each different word is encoded once
    and remembered. Texts with marks that may be special strings keep their case."""
    known = _words(path)
    block = Block([t if b"<|" in t else t.lower() for t in texts])
    starts, ends = _cut_words(block)
    distinct, first, word = np.unique(block.hashes(starts, ends), return_index=True, return_inverse=True)
    if len(known.hashes) > MOST_WORDS:
        known.forget()
    new = np.flatnonzero(~known.places(distinct)[1])
    if len(new):
        data = block.buf.data
        spans = zip(starts[first[new]].tolist(), ends[first[new]].tolist())
        known.learn(distinct[new], [bytes(data[a:b]) for a, b in spans])
    place = known.places(distinct)[0]
    bounds = block.per_row(starts)
    at = bounds[1:] + np.arange(block.n)  # places of the end tokens, one after each text's words
    is_end = np.zeros(len(word) + block.n, bool)
    is_end[at] = True
    n = np.ones(len(is_end), np.int64)
    n[~is_end] = known.size[place][word]
    last = np.cumsum(n)
    ids = np.full(last[-1], end, "<u4")
    own, size = known.begin[place][word], n[~is_end]
    inside = np.repeat(~is_end, n)
    ids[inside] = known.ids[np.repeat(own - (np.cumsum(size) - size), size) + np.arange(size.sum())]
    stop = 4 * last[at]
    raw = memoryview(ids.tobytes())
    return [raw[a:b] for a, b in zip([0, *stop[:-1].tolist()], stop.tolist())]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = 1) -> DataFrame:
    """item (a number of its own), row_id, doc_id, piece, start, length, ids_crc32 of every piece of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = row = TaskContext.get().partitionId() << 36
        for batch in sliced(batches):
            out, of = [], []
            texts = blocks(batch.column("text").to_pylist(), BLOCK)
            for i, ids in enumerate(ids for _, _, raws in texts for ids in token_ids(raws, tokenizer, end)):
                for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[a : a + 4 * capacity]
                    out.append((item, row, k, a // 4, len(part) // 4, zlib.crc32(part)))
                    of.append(i)
                    item += 1
                row += 1
            made = np.array(out, np.int64).reshape(-1, 6)
            number = [pa.array(np.ascontiguousarray(c)) for c in made.T]
            columns = [*number[:2], batch.column("doc_id").take(pa.array(of, pa.int64())), number[2].cast(pa.int32()), *number[3:]]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        give_back(_key(tokenizer))

    schema = "item long, row_id long, doc_id long, piece int, start long, length long, ids_crc32 long"
    names = [c.split()[0] for c in schema.split(", ")]
    return docs.select("doc_id", "text").mapInArrow(run, schema)


# ------------------------------------------------------------------- genetics
Bins = list[list[int]]


def best_fit(order: list[int], size: list[int], bins: Bins, capacity: int) -> Bins:
    """Put the pieces of ``order`` one by one into the fullest bin that still takes them."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free space
    free = 0  # bit f is set if some bin has f free
    for k, b in enumerate(bins):
        f = capacity - sum(size[i] for i in b)
        room[f].append(k)
        free |= 1 << f
    for i in order:
        fits = free >> size[i]
        if fits:
            f = size[i] + (fits & -fits).bit_length() - 1
            k = room[f].pop()
            if not room[f]:
                free ^= 1 << f
            bins[k].append(i)
        else:
            k, f = len(bins), capacity
            bins.append([i])
        f -= size[i]
        room[f].append(k)
        free |= 1 << f
    return bins


def _fill(b: list[int], size: list[int]) -> int:
    return sum(size[i] for i in b)


def fitness(bins: Bins, size: list[int]) -> tuple[int, int]:
    """Less is better."""
    return len(bins), -sum(_fill(b, size) ** 2 for b in bins)


def _decreasing(items: list[int], size: list[int], rng: random.Random, blur: float = 0.0) -> list[int]:
    return sorted(items, key=lambda i: (-size[i] * (1 + blur * rng.random()), rng.random()))


def crossover(a: Bins, b: Bins, size: list[int], capacity: int, rng: random.Random) -> Bins:
    """``a`` with some well-filled bins of ``b`` injected, duplicates removed, the rest put back."""
    chosen = [x for x in b if _fill(x, size) >= WELL_FILLED * capacity and rng.random() < 0.4]
    held = {i for x in chosen for i in x}
    kept, loose = [], []
    for x in a:
        if any(i in held for i in x):
            loose += (i for i in x if i not in held)
        else:
            kept.append(list(x))
    return best_fit(_decreasing(loose, size, rng), size, [list(x) for x in chosen] + kept, capacity)


def mutate(bins: Bins, size: list[int], capacity: int, rng: random.Random) -> Bins:
    """Dissolve the emptiest bins and a few others, and put their pieces back."""
    order = sorted(range(len(bins)), key=lambda k: _fill(bins[k], size))
    gone = {*order[: max(2, len(bins) // 50)], *rng.sample(order, min(len(bins), 3))}
    loose = [i for k in gone for i in bins[k]]
    return best_fit(_decreasing(loose, size, rng, 0.1), size, [list(b) for k, b in enumerate(bins) if k not in gone], capacity)


def least_bins(size: list[int], capacity: int) -> int:
    return -(-sum(size) // capacity)


def evolve(size: list[int], start: list[Bins], capacity: int, seed: int, generations: int = GENERATIONS) -> tuple[Bins, int]:
    """The best solution after some generations on one island, and how many it took."""
    rng = random.Random(seed)
    least = least_bins(size, capacity)
    items = list(range(len(size)))
    people = start + [best_fit(_decreasing(items, size, rng, 0.1 * k), size, [], capacity) for k in range(len(start), POPULATION)]
    people.sort(key=lambda x: fitness(x, size))
    for done in range(generations):
        if len(people[0]) == least:
            return people[0], done
        a, b = rng.sample(people[: max(2, POPULATION // 2)], 2)
        child = mutate(crossover(a, b, size, capacity, rng), size, capacity, rng)
        people = sorted([*people, child], key=lambda x: fitness(x, size))[:POPULATION]
    return people[0], generations


# ------------------------------------------------------------------- islands
_SOLUTION = "shard long, island int, item long, length long, bin long, offset long, fill long, bins long, squares long, generations long"


def _solution(shard: int, island: int, items: np.ndarray, size: list[int], best: Bins, generations: int) -> pd.DataFrame:
    order = [i for b in best for i in b]
    n, squares = fitness(best, size)
    return pd.DataFrame(
        {
            "shard": shard,
            "island": island,
            "item": items[order],
            "length": np.array(size, np.int64)[order],
            "bin": [k for k, b in enumerate(best) for _ in b],
            "offset": [o for b in best for o in np.cumsum([0, *(size[i] for i in b[:-1])]).tolist()],
            "fill": [f for b in best for f in [_fill(b, size)] * len(b)],
            "bins": n,
            "squares": -squares,
            "generations": generations,
        }
    )


def _first_solution(capacity: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("item")
        size = rows["length"].tolist()
        rng = random.Random(hash(int(key[0])))
        best = best_fit(_decreasing(list(range(len(size))), size, rng), size, [], capacity)
        out = _solution(int(key[0]), 0, rows["item"].to_numpy(), size, best, 0)
        return out.assign(open=len(best) > least_bins(size, capacity))

    return run


def _evolve_island(capacity: int, epoch: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        shard, island = int(key[0]), int(key[1])
        rows = rows.sort_values(["origin", "item"])
        first = rows[rows["origin"] == rows["origin"].iloc[0]]
        items, size = first["item"].to_numpy(), first["length"].tolist()
        start: list[Bins] = []
        for _, part in rows.groupby("origin"):
            bins: dict[int, list[int]] = {}
            for i, k in enumerate(part["bin"].tolist()):
                bins.setdefault(k, []).append(i)
            start.append(list(bins.values()))
        best, n = evolve(size, start, capacity, seed=hash((shard, island, epoch)))
        return _solution(shard, island, items, size, best, int(rows["generations"].max()) + n)

    return run


def _pack_shards(items: DataFrame, shards: int, capacity: int, islands: int, epochs: int, level: int) -> DataFrame:
    """item, length, shard, bin, offset, fill, generations of the best solution of every shard. ``items``: item, length."""
    shard = F.pmod(F.xxhash64("item", F.lit(level)), F.lit(shards)).alias("shard")
    columns = ["item", "length", "shard", "bin", "offset", "fill", "generations"]
    # a shard is few bytes and much work: the number of tasks follows the shards
    dealt = items.select(shard, "item", "length").repartition(min(shards, MOST_PARTS), "shard")
    first = written(dealt.groupBy("shard").applyInPandas(_first_solution(capacity), f"{_SOLUTION}, open boolean"))
    settled = first.where("not open").select(columns)
    still = first.where("open")
    if still.isEmpty():
        return settled
    every = F.explode(F.array(*[F.lit(k) for k in range(islands)])).alias("island")
    state = still.select("shard", every, "item", "length", "bin", "generations", F.lit(0).alias("origin"))
    for epoch in range(epochs):
        spread = state.repartition(min(shards * islands, MOST_PARTS), "shard", "island")
        state = written(spread.groupBy("shard", "island").applyInPandas(_evolve_island(capacity, epoch), _SOLUTION))
        if epoch + 1 < epochs:
            own = state.select("shard", "island", "item", "length", "bin", "generations", F.lit(0).alias("origin"))
            ring = ((F.col("island") + 1) % islands).cast("int").alias("island")
            state = own.unionByName(state.select("shard", ring, "item", "length", "bin", "generations", F.lit(1).alias("origin")))
    best = state.groupBy("shard").agg(F.min(F.struct("bins", (-F.col("squares")).alias("s"), "island")).alias("w"))
    chosen = best.select("shard", F.col("w.island").alias("island"))
    return settled.unionByName(state.join(chosen, ["shard", "island"]).select(columns))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = 1, shard: int = SHARD, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """row_id, doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece, and the
    generations that its shard evolved for (0: the first solution cannot be bettered)."""
    cut = written(pieces(docs, tokenizer, capacity, end))
    whole = cut.where(F.col("length") == capacity)
    placed = whole.select("item", (F.col("item") + (1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(0).cast("long").alias("generations"))
    part = cut.where(F.col("length") < capacity).select("item", "length")
    for level in range(LEVELS):
        shards = max(1, -(-part.count() // shard))
        solved = written(_pack_shards(part, shards, capacity, islands, epochs, level))
        last = shards == 1 or level == LEVELS - 1
        full = F.lit(True) if last else F.col("fill") >= WELL_FILLED * capacity
        sequence = F.lit(level << 58) + F.shiftleft(F.col("shard"), 20) + F.col("bin")
        placed = placed.unionByName(solved.where(full).select("item", sequence.alias("sequence_id"), "offset", "generations"))
        if last:
            break
        part = solved.where(~full).select("item", "length")
    return cut.join(placed, "item").drop("item")
