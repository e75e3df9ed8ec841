import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from ledgerlens.llm import language_model as lm

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def tokens(text):
    low = (text or "").encode().lower()
    return [*WORDS.findall(low), None]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    chain = {w: [f"w{rng.randrange(40)}" for _ in range(3)] for w in (f"w{i}" for i in range(40))}
    out = []
    for i in range(500):
        w = ["w0"]
        for _ in range(rng.randint(0, 60)):
            w.append(rng.choice(chain.get(w[-1], ["w0", "w1"])) if rng.random() < 0.8 else f"r{rng.randrange(3000)}")
        out.append((i, " ".join(w) if i % 50 else ["", None, "É É\xa0x", " \n"][i // 50 % 4]))
    return out + [(None, "w0 w1"), (3, "w0 w1 W2")]


def scored(docs_of, rows, **kw):
    return lm.language_model_scores(docs_of(rows, extra=("block", "part")), **kw).collect()


@pytest.mark.parametrize("block,bucket", [(4_000_000, 8_000_000), (3000, 1000)])
def test_matches_a_plain_computation(docs_of, rows, block, bucket):
    got = scored(docs_of, rows, block=block, bucket=bucket)
    assert len(got) == len(rows)
    code = lambda d: zlib.crc32(("" if d is None else str(d)).encode())
    learn = [(d, tokens(t)) for d, t in rows if code(d) % 7 != 2]
    single, pair = collections.Counter(), collections.Counter()
    for _, ts in learn:
        single.update(ts)
        pair.update(zip(["<"] + ts[:-1], ts))
    n, v = sum(single.values()), len(single)
    single["<"] = single[None]
    # the mixture, from the deleted tenth
    s0, p0 = collections.Counter(single), collections.Counter(pair)
    deleted = [ts for d, ts in learn if code(d) // 7 % 10 == 0]
    for ts in deleted:
        s0.subtract(ts)
        p0.subtract(zip(["<"] + ts[:-1], ts))
    s0["<"] = s0[None]
    n0 = n - sum(map(len, deleted))
    level = lambda c: c.bit_length()
    weights = {b: [0.2, 0.4, 0.4] if b else [0.3, 0.7, 0.0] for b in range(64)}
    events = [(level(s0[a]), 1 / (v + 1), s0[b] / n0, p0[a, b] / s0[a] if s0[a] else 0.0) for ts in deleted for a, b in zip(["<"] + ts[:-1], ts)]
    for _ in range(lm.ROUNDS):
        sums = {}
        for b, *p in events:
            e = np.array([x * y for x, y in zip(weights[b], p)])
            sums[b] = sums.get(b, 0) + e / e.sum()
        for b, s in sums.items():
            s = s + np.array([1e-3, 1e-3, 1e-3 if b else 0])
            weights[b] = list(s / s.sum())
    for b in range(2, 64):
        if b not in sums:
            weights[b] = weights[b - 1]
    want = collections.Counter()
    for d, t in rows:
        ts = tokens(t)
        base = sum(math.log10((single[x] + 1) / (n + v + 1)) for x in ts)
        score = 0.0
        for a, b in zip(["<"] + ts[:-1], ts):
            w = weights[level(single[a])]
            score += math.log10(w[0] / (v + 1) + w[1] * single[b] / n + (w[2] * pair[a, b] / single[a] if single[a] else 0))
        want[d, code(d) % 7 == 2, len(ts), sum(single[x] > 0 for x in ts), n, round(base, 5), round(score, 5)] += 1
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in got) == want


def test_better_than_the_base_on_unseen_rows(docs_of, rows):
    held = [r for r in scored(docs_of, rows) if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_splits_that_change_between_passes(spark, docs_of, rows, tmp_path):
    path, key = str(tmp_path / "docs"), "spark.sql.files.maxPartitionBytes"
    docs_of(rows).repartition(8).write.parquet(path)
    kept = spark.conf.get(key)
    want = collections.Counter((r.doc_id, r.n_tokens, round(r.score, 5)) for r in scored(docs_of, rows, block=3000))
    lazy = lm.language_model_scores(spark.read.parquet(path), block=3000)
    spark.conf.set(key, "2000")
    try:
        got = lazy.collect()
    finally:
        spark.conf.set(key, kept)
    assert collections.Counter((r.doc_id, r.n_tokens, round(r.score, 5)) for r in got) == want


def test_small_tables(docs_of):
    assert scored(docs_of, []) == []
    one = scored(docs_of, [(1, None)])
    assert len(one) == 1 and one[0].n_tokens == 1 and one[0].score <= 0


def test_counts_survive_packing():
    x = np.array([0, 1, 254, 255, 256, 10**12, 3], np.int64)
    assert (lm._large(lm._small(x), len(x)) == x).all()
    assert (lm._unpacked(lm._packed(np.array([5, 1 << 47], np.uint64), 2), 2) == [5, 1 << 47]).all()
