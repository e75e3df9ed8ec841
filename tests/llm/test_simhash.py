import random

import pytest
import xxhash

from ledgerlens.llm import frames
from ledgerlens.llm import simhash as sh


def slow_fingerprint(text, width=4, seed=42):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    runs = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hs = [xxhash.xxh64(r.encode(), seed=seed).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(prints, reach):
    keys = sorted(set(prints.values()))
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if bin(a ^ b).count("1") <= reach:
                root[find(a)] = find(b)
    least = {}
    for d, f in prints.items():
        r = find(f)
        least[r] = min(d, least.get(r, d))
    return {d: least[find(f)] for d, f in prints.items()}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)] + ["É", "Ünd", "x y"]
    base = [[rng.choice(words) for _ in range(rng.randint(30, 200))] for _ in range(25)]
    out = []
    for i in range(160):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append((i * 3 + 7, " ".join(x.upper() if rng.random() < 0.2 else x for x in w)))
    return out + [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "One"), (6, "one two three")]


def test_fingerprint_matches_the_definition(rows):
    for _, t in rows:
        assert sh.fingerprint(t) == slow_fingerprint(t)


@pytest.mark.parametrize("max_bits, known", [(4, 500_000), (3, 0)])
def test_components_match_brute_force(docs_of, rows, monkeypatch, max_bits, known):
    monkeypatch.setattr(frames, "KNOWN_KEYS", known)  # cells picked out by a list, or by a join
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in sh.near_duplicates(docs_of(rows), max_bits=max_bits).collect()}
    prints = {d: slow_fingerprint(t) for d, t in rows}
    want = slow_components(prints, max_bits)
    assert {d: f for d, (f, _) in got.items()} == {d: f"{p:016x}" for d, p in prints.items()}
    assert {d: c for d, (_, c) in got.items()} == want


def test_close_fingerprints_meet(spark):
    """Chains of flips up to the radius, in one half or both, and one bit further."""
    from ledgerlens.llm.components import components
    from ledgerlens.llm.frames import written

    rng = random.Random(9)
    fps = set()
    for _ in range(60):
        a = rng.getrandbits(63)
        for flips in (0, 1, 2, 3, 4, 5):
            b = a
            for k in rng.sample(range(63), flips):
                b ^= 1 << k
            fps.add(b)
    fps = sorted(fps)
    df = written(spark.createDataFrame([(f,) for f in fps], "fp long"))
    want = slow_components({f: f for f in fps}, 4)
    roots = {r.node: r.root for r in components(sh.links(df, 4)).collect()}
    assert {f: roots.get(f, f) for f in fps} == want


def test_all_within_reach_share_a_cell():
    import numpy as np

    rng = random.Random(3)
    for bits in (2, 3, 4, 6):
        a = [rng.getrandbits(64) for _ in range(300)]
        b = []
        for x in a:
            for k in rng.sample(range(64), bits):
                x ^= 1 << k
            b.append(x)
        reach = (2 * bits // 3 + 1) // 2
        of = []
        for fps in (a, b) if bits < 6 else (a[:20], b[:20]):
            cell, row = sh._cells(np.array(fps, np.uint64), reach)
            sets = [set() for _ in fps]
            for c, r in zip(cell.tolist(), row.tolist()):
                assert c not in sets[r]
                sets[r].add(c)
            of.append(sets)
        assert all(x & y for x, y in zip(*of))


def test_strangers_do_not_meet_and_groups_are_linked_in_proportion(spark):
    """Meetings a fingerprint stay low from 10 to 160 thousand random ones; links follow a group, not its square."""
    import numpy as np
    from pyspark.sql import functions as F

    from ledgerlens.llm.frames import written

    rng = np.random.default_rng(7)
    for n in (10_000, 160_000):
        fps = written(spark.range(n).select(F.xxhash64("id").alias("fp")))
        pairs = sh.meetings(fps).groupBy("cell").agg((F.count("*") * (F.count("*") - 1) / 2).alias("p")).agg(F.sum("p")).first()[0] or 0
        assert pairs / n < 1
    made = []
    for n in (300, 1200):
        flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 63, (n, 3)).astype(np.uint64), axis=1)
        group = np.unique(np.uint64(0x123456789ABCDEF) ^ flips)
        fps = written(spark.createDataFrame([(int(f),) for f in group], "fp long"))
        made.append(sh.links(fps).count() / len(group))
    assert max(made) < 30 and made[1] < 2 * made[0] + 1


def test_keep_one_and_defined_results(docs_of):
    long = " ".join(f"t{i}" for i in range(60))
    rows = [(5, long), (5, long), (9, long), (None, long), (7, "other words here are five"), (None, "lonely text without any id"), (None, None), (8, "")]
    kept = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in sh.keep_one(docs_of(rows, extra=("fp", "root"))).collect())
    assert kept == sorted([(False, 5, long), (False, 7, rows[4][1]), (True, 0, rows[5][1]), (False, 8, "")])
    assert sh.near_duplicates(docs_of([])).count() == 0
    assert sh.keep_one(docs_of([])).count() == 0
