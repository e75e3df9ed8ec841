"""Language-model scores by deleted interpolation.

Method: the probability of a token after its predecessor is a mixture of three
maximum-likelihood estimates - pair, single token, uniform - whose weights
depend on how often the predecessor was seen (buckets by powers of two). The
weights are learned by expectation-maximisation on held-out counts: a tenth of
the learning documents is deleted from the counts, and its tokens, as counted
without it, are what the weights are fitted to.

    P(w | v) = l2(b) c(v, w) / c(v) + l1(b) c(w) / N + l0(b) / (V + 1),   b = bucket of c(v)

which sums to one over the known tokens and one unknown (l2 is zero where c(v)
is). Tokens: A-Z lower-cased, words between ASCII white space, then one end
token per text. The predecessor of the first token is a begin mark, counted once
a text.

How counts get to the texts: documents are gathered in blocks of about
``BLOCK`` bytes where they are read. A block lists each of its tokens and pairs
once, as hashes (of pairs 48 bits and the bucket), dealt over ``buckets`` by the
hash; a bucket adds up
all blocks' counts and answers each block in the order it asked. So what is
shuffled is pre-aggregated, a frequent pair is one entry a block like any other,
and a bucket's share is bounded because their number follows the input. Blocks
and answers then meet once more by block to be scored. Counts cover all
learning documents; nothing is sampled. The blocks are written once, as a row
each with its number and its compressed documents, and every pass groups that
table by the number: how Spark splits the input, or that it would split it
otherwise in a later pass, is of no account.

Defined results: null text is empty and has one token, the end. Without
learning documents every probability is 1. Repeated rows each count and each
give one row; a null id counts as empty text when folds are dealt.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import fold, sliced, written
from .kernels import Block, give_back, mix

FOLDS, HELD_OUT = 7, 2
DELETED = 10  # one of so many learning documents is left to the mixture weights
BLOCK = 2_000_000  # bytes of text
FILE = 8  # blocks in a file of the written table
BUCKET = 4_000_000  # bytes of text for each bucket
ROUNDS = 12
_END, _BEGIN = np.uint64(0xE703_7ED1_A0B4_28DB), np.uint64(0x8EBC_6AF0_9C88_C6E3)
LEARN, DELETE, TEST = range(3)  # what a block's documents are for


def _blocked(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, int, pa.Table]]:
    """(block, part, documents): documents of one part in the order they are read, about ``size`` bytes of
    text at a time; they stay in Arrow buffers."""
    number = TaskContext.get().partitionId() << 24
    held: dict[int, tuple[list[pa.RecordBatch], int]] = {}
    for batch in sliced(batches, 100):
        parts = batch.column("part").to_numpy()
        for part in np.unique(parts).tolist():
            rows = batch.filter(pa.array(parts == part)).select(["doc_id", "text"])
            ends = np.cumsum(pc.fill_null(pc.binary_length(rows.column("text")), 0).to_numpy() + 1, dtype=np.int64)
            first, before = 0, 0
            while first < len(ends):
                have, n = held.get(part, ([], 0))
                stop = max(first + 1, int(np.searchsorted(ends, before + size - n, "right")))
                have.append(rows.slice(first, stop - first))
                n, first, before = n + int(ends[stop - 1]) - before, stop, int(ends[stop - 1])
                held[part] = have, n
                if n >= size or first < len(ends):
                    yield number, part, pa.Table.from_batches(held.pop(part)[0])
                    number += 1
    for part in sorted(held):
        yield number, part, pa.Table.from_batches(held[part][0])
        number += 1


class _Tokens:
    """Tokens of a block in order, and where each stands in the block's lists of distinct ones."""

    def __init__(self, texts: pa.ChunkedArray, buckets: int):
        block = Block([(t or b"").lower() for t in texts.cast(pa.binary()).to_pylist()])
        starts, ends = block.words()
        bounds = block.per_row(starts)
        n = np.diff(bounds) + 1
        self.first = np.concatenate(([0], np.cumsum(n)))
        token = np.empty(self.first[-1], np.uint64)
        is_end = np.zeros(len(token), bool)
        is_end[self.first[1:] - 1] = True
        token[is_end] = _END
        token[~is_end] = block.hashes(starts, ends)
        before = np.empty_like(token)
        before[1:] = token[:-1]
        before[self.first[:-1]] = _BEGIN
        self.single, self.at, self.n_single = self._listed(token, buckets)
        self.pair, self.at_pair, self.n_pair = self._listed(mix(mix(before) + token * np.uint64(5)), buckets)
        # a predecessor is a token of the block, or the begin mark, which is as frequent as the end
        self.at_before = np.empty_like(self.at)
        self.at_before[1:] = self.at[:-1]
        self.at_before[self.first[:-1]] = self.at[self.first[1:] - 1]

    @staticmethod
    def _listed(values: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct values by bucket and value, the place of each occurrence, and the counts."""
        distinct, at, n = np.unique(values, return_inverse=True, return_counts=True)
        order = np.argsort(_bucket(distinct, buckets), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return distinct[order], place[at], n[order]


def _bucket(values: np.ndarray, buckets: int) -> np.ndarray:
    return ((values >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def _packed(values: np.ndarray, kind: int) -> bytes:
    """Pairs in six bytes (the bucket stands for some of the others), single tokens in eight."""
    raw = values.astype("<u8").view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(raw[:, : 6 if kind == 2 else 8]).tobytes()


def _unpacked(raw: bytes, kind: int) -> np.ndarray:
    width = 6 if kind == 2 else 8
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view("<u8").reshape(-1)


def _small(counts: np.ndarray) -> bytes:
    """Counts as bytes where they fit, the rest after them."""
    low = np.minimum(counts, 255).astype(np.uint8)
    return low.tobytes() + counts[low == 255].astype("<i8").tobytes()


def _large(raw: bytes, n: int) -> np.ndarray:
    low = np.frombuffer(raw, np.uint8, n)
    out = low.astype(np.int64)
    out[low == 255] = np.frombuffer(raw, "<i8", -1, n)
    return out


_ASK = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("kind", pa.int32()), ("bucket", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
_ANSWER = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("kind", pa.int32()), ("bucket", pa.int64()), ("n", pa.int64()), ("counts", pa.binary()), ("deleted", pa.binary())])
_DOCS = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
_SPARK = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.bool_(): "boolean", pa.float64(): "double"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_SPARK[f.type]}" for f in schema)


def _asked(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct tokens and pairs of each block with their counts, a row for each bucket."""
        for batch in batches:
            for at in range(batch.num_rows):
                block = batch.slice(at, 1)
                number, part = block.column("block")[0].as_py(), block.column("part")[0].as_py()
                tokens = _Tokens(_documents(block).column("text"), buckets)
                for kind, keys, counts in ((1, tokens.single, tokens.n_single), (2, tokens.pair, tokens.n_pair)):
                    of = _bucket(keys, buckets)
                    cut = np.append(np.flatnonzero(np.diff(of, prepend=-1)), len(of)).tolist()
                    for k in range(0, len(cut) - 1, 64):
                        spans = zip(cut[k : k + 64], cut[k + 1 : k + 65])
                        made = [(number, part, kind, int(of[a]), _packed(keys[a:b], kind), _small(counts[a:b])) for a, b in spans]
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), _ASK)], schema=_ASK)
        give_back()

    return run


def _binary(column: pa.ChunkedArray) -> list[memoryview]:
    """The values of a binary column, without copies."""
    out: list[memoryview] = []
    for chunk in column.chunks:
        _, offsets, data = chunk.buffers()
        ends = np.frombuffer(offsets, np.int32)[chunk.offset : chunk.offset + len(chunk) + 1].tolist()
        raw = memoryview(data) if data is not None else memoryview(b"")
        out += [raw[a:b] for a, b in zip(ends, ends[1:])]
    return out


def _answer(table: pa.Table) -> pa.Table:
    """Counts of one bucket's keys over all blocks, given back to each block in its order;
    block -1 holds the bucket's totals: tokens and distinct tokens learned from, and tokens deleted."""
    kind, bucket = table.column("kind")[0].as_py(), table.column("bucket")[0].as_py()
    part, block = table.column("part").to_numpy(), table.column("block").to_numpy()
    keys = [_unpacked(x, kind) for x in _binary(table.column("keys"))]
    size = np.fromiter(map(len, keys), np.int64, len(keys))
    flat = np.concatenate([_large(x, n) for x, n in zip(_binary(table.column("counts")), size.tolist())])
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    del keys
    of = np.repeat(part, size)
    known = np.bincount(at, flat * (of != TEST), len(distinct)).astype(np.int64)
    deleted = np.bincount(at, flat * (of == DELETE), len(distinct)).astype(np.int64)
    del flat, of, distinct
    ends = np.cumsum(size)
    counts = [_small(known[at[b - n : b]]) for b, n in zip(ends, size)]
    # a block of deleted documents is also told what they count among themselves
    own = [_small(deleted[at[b - n : b]]) if p == DELETE else b"" for b, n, p in zip(ends, size, part)]
    if kind == 1:
        total = np.array([known.sum(), (known > 0).sum(), deleted.sum()], np.int64)
        block, part, size = np.append(block, -1), np.append(part, -1), np.append(size, 3)
        counts, own = [*counts, _small(total)], [*own, b""]
    del at, known, deleted
    n = len(block)
    columns = [block, part, np.full(n, kind), np.full(n, bucket), size, counts, own]
    out = pa.table([pa.array(c, f.type) for c, f in zip(columns, _ANSWER)], schema=_ANSWER)
    give_back()
    return out


def _told(tokens: _Tokens, answers: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the block's distinct tokens and pairs, in the block's order."""
    rows = sorted(answers.to_pylist(), key=lambda r: (r["kind"], r["bucket"]))
    out = []
    for kind, keys in ((1, tokens.single), (2, tokens.pair)):
        got = [_large(r[column], r["n"]) for r in rows if r["kind"] == kind]
        got = np.concatenate(got) if got else np.zeros(0, np.int64)
        if len(got) != len(keys):
            raise RuntimeError("a block's counts do not fit it")
        out.append(got)
    return out[0], out[1]


def bucket_of(count: np.ndarray) -> np.ndarray:
    """0 for a predecessor never seen, else 1 + the power of two that its count reaches."""
    return np.where(count > 0, np.frexp(count.astype(np.float64))[1], 0)


_BUCKETS = 64


def _with_block(parts: DataFrame, size: int) -> DataFrame:
    """One row a block: its number, its part and its documents, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, part, docs in _blocked(batches, size):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, _DOCS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(docs.cast(_DOCS))
            columns = [pa.array([number], pa.int64()), pa.array([part], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "part", "docs"])
        give_back()

    return parts.mapInArrow(run, "block long, part int, docs binary")


def _documents(block: pa.Table) -> pa.Table:
    return pa.ipc.open_stream(block.column("docs")[0].as_py()).read_all()


def _evidence(buckets: int):
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        """How often each combination of counts occurs among the deleted tokens, as counted without them."""
        t = _Tokens(_documents(block).column("text"), buckets)
        (single, pair), (less, less_pair) = _told(t, answers, "counts"), _told(t, answers, "deleted")
        c1, c2 = (single - less)[t.at], (pair - less_pair)[t.at_pair]
        c0 = (single - less)[t.at_before]
        combos, n = np.unique(np.stack([c2, c0, c1], 1), axis=0, return_counts=True)
        give_back()
        return pa.table({"c2": combos[:, 0], "c0": combos[:, 1], "c1": combos[:, 2], "n": n})

    return run


def mixture(evidence: DataFrame, n_tokens: int, n_types: int, rounds: int = ROUNDS) -> np.ndarray:
    """[bucket, (uniform, single, pair)] weights by expectation-maximisation over ``c2, c0, c1, n``
    (counts of pair, predecessor and token without the deleted documents, and how often they occur)."""
    weights = np.tile([0.2, 0.4, 0.4], (_BUCKETS, 1))
    weights[0] = [0.3, 0.7, 0.0]
    bucket = F.when(F.col("c0") > 0, F.floor(F.log2(F.col("c0") + 0.5)) + 1).otherwise(0).cast("int")
    rows = evidence.select(
        bucket.alias("b"),
        "n",
        F.when(F.col("c0") > 0, F.col("c2") / F.col("c0")).otherwise(0.0).alias("p2"),
        (F.col("c1") / F.lit(float(max(n_tokens, 1)))).alias("p1"),
    )
    p0 = 1.0 / (n_types + 1)
    for _ in range(rounds):
        w = [F.element_at(F.array(*[F.lit(float(x)) for x in weights[:, k]]), F.col("b") + 1) for k in range(3)]
        each = rows.select("b", "n", (w[0] * p0).alias("e0"), (w[1] * F.col("p1")).alias("e1"), (w[2] * F.col("p2")).alias("e2"))
        all_ = F.col("e0") + F.col("e1") + F.col("e2")
        got = each.groupBy("b").agg(*[F.sum(F.col("n") * F.col(f"e{k}") / all_).alias(f"s{k}") for k in range(3)]).collect()
        for r in got:
            s = np.array([r.s0, r.s1, r.s2]) + [1e-3, 1e-3, 1e-3 if r.b else 0.0]
            weights[r.b] = s / s.sum()
    # buckets that no deleted token met: as the nearest lower one that some did
    seen = {r.b for r in got} if rounds else set()
    for b in range(2, _BUCKETS):
        if b not in seen and b - 1 >= 1:
            weights[b] = weights[b - 1]
    return weights


def _scored(buckets: int, weights: np.ndarray, n_tokens: int, n_types: int):
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        texts = _documents(block)
        t = _Tokens(texts.column("text"), buckets)
        single, pair = _told(t, answers, "counts")
        c1, c0, c2 = single[t.at], single[t.at_before], pair[t.at_pair]
        w = weights[bucket_of(c0)]
        p = w[:, 0] / (n_types + 1) + w[:, 1] * c1 / max(n_tokens, 1) + w[:, 2] * c2 / np.maximum(c0, 1)
        base = np.log10((c1 + 1) / (n_tokens + n_types + 1))
        rows = len(t.first) - 1
        sums = [np.concatenate(([0.0], np.cumsum(x))) for x in (c1 > 0, base, np.log10(p) if n_tokens else p * 0)]
        known, base_sum, model = (s[t.first[1:]] - s[t.first[:-1]] for s in sums)
        del single, pair, c1, c0, c2, w, p, base, sums
        give_back()
        return pa.table(
            {
                "doc_id": texts.column("doc_id"),
                "held_out": pa.array(np.full(rows, block.column("part")[0].as_py() == TEST)),
                "n_tokens": np.diff(t.first),
                "n_known": known.astype(np.int64),
                "train_tokens": np.full(rows, n_tokens),
                "base_score": base_sum,
                "score": model,
            }
        )

    return run


def language_model_scores(docs: DataFrame, block: int = BLOCK, bucket: int = BUCKET, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(12, -(-size // bucket))
    code = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    deleted = F.floor(code / FOLDS) % DELETED == 0
    part = F.when(fold("doc_id", FOLDS) == HELD_OUT, TEST).when(deleted, DELETE).otherwise(LEARN).alias("part")
    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), part, "text")
    texts = written(_with_block(parts, block), FILE)  # few blocks a file, as a reader holds a file's rows at once
    asked = texts.mapInArrow(_asked(buckets), _ddl(_ASK))  # a row is a block: none has to move
    answers = written(asked.groupBy("kind", "bucket").applyInArrow(_answer, _ddl(_ANSWER)))
    totals = [_large(r.counts, 3) for r in answers.where("block = -1").select("counts").collect()]
    n_tokens, n_types, n_deleted = (int(x) for x in (np.sum(totals, 0) if totals else (0, 0, 0)))
    answers = answers.where("block >= 0")
    left, right = texts.where(F.col("part") == DELETE).groupBy("block"), answers.where(F.col("part") == DELETE).groupBy("block")
    combos = left.cogroup(right).applyInArrow(_evidence(buckets), "c2 long, c0 long, c1 long, n long")
    evidence = written(combos.groupBy("c2", "c0", "c1").agg(F.sum("n").alias("n")))
    weights = mixture(evidence, n_tokens - n_deleted, n_types, rounds)
    scored = _scored(buckets, weights, n_tokens, n_types)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(scored, schema)
