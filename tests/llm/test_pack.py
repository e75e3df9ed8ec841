import random
import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from ledgerlens.llm import pack as pk

PATH = P.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)


def lib_ids(text):
    return LIB.encode(text or "", add_special_tokens=False).ids + [1]


def test_ids_match_the_library():
    rng = random.Random(2)
    letters = "abE 'sre\n\t.!?12É三² <|endoftext|>\x1c\x85éİß"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(800)] + ["", None, "don't  Stop", "ΑΣ ΟΔΟΣ"]
    texts += ["<|ENDOFTEXT|> A", "x<|endoftext|>. Y!", "a'!? b\u0338 <\u0338", "and$$$. thhe### |", "don't. they'll, É. é!", "".join(chr(c) for c in range(32, 700))]
    raws = [(t or "").encode() for t in texts]
    for got in (pk.token_ids(raws, PATH, 1), [pk.token_ids([r], PATH, 1)[0] for r in raws]):
        for t, ids in zip(texts, got):
            assert np.frombuffer(ids, "<u4").tolist() == lib_ids(t), repr(t)


def check(rows, placed, capacity):
    want = {}
    for d, t in rows:
        ids = lib_ids(t)
        for k in range(0, len(ids), capacity):
            part = np.array(ids[k : k + capacity], "<u4").tobytes()
            want.setdefault((d, k // capacity, k, len(part) // 4, zlib.crc32(part)), []).append(1)
    got = {}
    for r in placed:
        got.setdefault((r.doc_id, r.piece, r.start, r.length, r.ids_crc32), []).append(1)
    assert got == want
    bins = {}
    for r in placed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(bins)


def test_every_piece_once_and_tight(docs_of):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["cat", "dog", "unbelievable", "sat"]) for _ in range(rng.randint(0, 90)))) for i in range(400)]
    rows += [(1000, None), (1000, None), (None, "cat"), (1001, ""), (1002, "cat " * 63), (1003, "cat " * 1000)]
    for shard in (50, 10_000):
        placed = pk.pack(docs_of(rows, extra=("bin", "item")), PATH, capacity=64, shard=shard).collect()
        n = check(rows, placed, 64)
        least = -(-sum(r.length for r in placed) // 64)
        assert n <= least * 1.03 + 1
    assert pk.pack(docs_of([]), PATH).count() == 0


def test_crossover_keeps_a_solution():
    rng = random.Random(1)
    size = [rng.randint(1, 60) for _ in range(300)]
    a = pk.best_fit(list(range(300)), size, [], 64)
    b = pk.best_fit(pk._decreasing(list(range(300)), size, rng), size, [], 64)
    c = pk.mutate(pk.crossover(a, b, size, 64, rng), size, 64, rng)
    assert sorted(i for x in c for i in x) == list(range(300))
    assert all(sum(size[i] for i in x) <= 64 for x in c)
    best, _ = pk.evolve(size, [], 64, 3)
    assert len(best) <= min(len(a), len(b))


def triplets(n, capacity, seed):
    """Lengths that fill ``n`` sequences exactly, three by three: hard for best fit."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        a = rng.randint(capacity * 38 // 100, capacity * 49 // 100)
        b = rng.randint(capacity // 4, (capacity - a) // 2)
        out += [a, b, capacity - a - b]
    rng.shuffle(out)
    return out


def test_evolution_betters_best_fit():
    """Where best fit misses the bound, generations lower the number of sequences."""
    size = triplets(40, 1000, 5)
    plain = pk.best_fit(pk._decreasing(list(range(len(size))), size, random.Random(0)), size, [], 1000)
    best, generations = pk.evolve(size, [plain], 1000, 1, 400)
    assert generations > 0 and len(best) < len(plain)
    assert sorted(i for b in best for i in b) == list(range(len(size)))
    assert all(sum(size[i] for i in b) <= 1000 for b in best)
    settled, none = pk.evolve([500] * 8, [], 1000, 1, 400)
    assert len(settled) == 4 and none == 0


def test_only_open_shards_evolve(spark):
    rows = [(i, 500) for i in range(100)]
    easy = pk._pack_shards(spark.createDataFrame(rows, "item long, length long"), 3, 1000, 2, 2, 0).collect()
    assert {r.generations for r in easy} == {0}
    size = triplets(40, 1000, 5)
    hard = pk._pack_shards(spark.createDataFrame(list(enumerate(size)), "item long, length long"), 1, 1000, 2, 2, 0).collect()
    assert {r.generations for r in hard} == {2 * pk.GENERATIONS}
    assert sorted(r.item for r in hard) == list(range(len(size)))
    plain = pk.best_fit(pk._decreasing(list(range(len(size))), size, random.Random(0)), size, [], 1000)
    assert len({r.bin for r in hard}) < len(plain)
