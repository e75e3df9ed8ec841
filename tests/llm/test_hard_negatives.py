import math
import random

import numpy as np
import pytest

from ledgerlens.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank string"


def slow(rows):
    """All anchors against all rows."""
    held = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        held[i, label, tuple(math.floor(256 * float(np.float32(x))) for x in v)] = None
    out = []
    for a, la, va in held:
        if a % 100:
            continue
        score = [(-sum(x * y for x, y in zip(va, vb)), b, lb) for b, lb, vb in held if b != a]
        for s, p, _ in sorted(x for x in score if x[2] == la)[:5]:
            inside = sorted(x[:2] for x in score if x[2] != la and -30 * s <= -100 * x[0] <= -90 * s)[:10]
            out += [(a, p, r, n, -s, -t) for r, (t, n) in enumerate(inside, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    unit = lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v]
    centre = [unit([rng.gauss(0, 1) for _ in range(12)]) for _ in range(8)]
    out = []
    for i in range(600):
        c = rng.choice(centre)
        out.append((i, unit([x + rng.gauss(0, 0.2) for x in c]), rng.randrange(10)))
    same = out[100][1]
    out += [(1000 + i, same, i % 3) for i in range(150)]  # one vector many times
    out += [(5000, [0.0] * 12, 1), (5100, [-x for x in same], 2), (5001, None, 1), (5002, [1.0, None], 2), (5003, [float("nan")] * 12, 3)]
    out += [(5004, [float("inf")] + [0.0] * 11, 3), (5005, same, None), (None, same, 4), (5200, same[:5], 4), (5300, [], 5), out[7], out[7]]
    return out


@pytest.mark.parametrize("shard, anchors, visit", [(hn.SHARD, hn.ANCHORS, hn.VISIT), (90, 3, 1)])
def test_windows_match_all_pairs(spark, rows, monkeypatch, shard, anchors, visit):
    for name, value in (("SHARD", shard), ("ANCHORS", anchors), ("VISIT", visit), ("MERGED", 2)):
        monkeypatch.setattr(hn, name, value)
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    got = sorted(map(tuple, hn.hard_negatives(df).collect()))
    assert got == slow(rows)


def test_empty_table(spark):
    assert hn.hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0
    assert hn.hard_negatives(spark.createDataFrame([(100, [1.0, 2.0], 1, "", "")], SCHEMA)).count() == 0


def test_cells_are_left_out_where_bounds_allow():
    rng = np.random.default_rng(1)
    centre = rng.normal(0, 200, (16, 8))
    rows = np.floor(centre[rng.integers(0, 16, 4000)] + rng.normal(0, 3, (4000, 8))).astype(np.int64)
    centres = hn.codebook(rows[:500, :4].astype(float), 16), hn.codebook(rows[:500, 4:].astype(float), 16)
    index = hn.Index.of(np.arange(4000), np.zeros(4000, np.int64), rows, centres)
    seen = 0
    for bound, at in index.visits(rows[5]):
        s = index.rows[at] @ rows[5]
        assert s.max() <= bound
        seen += len(at)
    assert seen == 4000
    score, ids = hn.first_rows(index, 5, rows[5], 0, 5)
    full = rows @ rows[5]
    full[5] = -(10**9)
    assert ids.tolist() == np.lexsort((np.arange(4000), -full))[:5].tolist()


@pytest.fixture
def limited(spark):
    """Tables are read in a task for each file, and the tasks of a job may give the driver 1.2 MB."""
    conf, live = spark.conf, spark.sparkContext._jsc.sc().conf()
    names = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16", "spark.sql.files.maxPartitionBytes": "300k", "spark.sql.files.openCostInBytes": "300k"}
    was = {k: conf.get(k) for k in names}
    for k, v in names.items():
        conf.set(k, v)
    live.set("spark.driver.maxResultSize", "1200k")
    yield
    live.remove("spark.driver.maxResultSize")
    for k, v in was.items():
        conf.set(k, v)


def test_the_driver_gets_one_sample_however_many_tasks(spark, limited):
    """Once the first 4,000 rows of every task went to the driver (0.8 MB each here)."""
    v = "transform(sequence(1, 16), i -> cast((pmod(xxhash64(id, i), 2001) - 1000) / 4000 as float))"
    df = spark.range(70_000).selectExpr("id as vec_id", f"{v} as embedding", "cast(id % 3 as int) as label")
    assert hn.hard_negatives(df, every=7000).groupBy("anchor_id").count().count() == 10


def test_sample_is_the_least_hashes_where_ids_repeat(spark):
    same = spark.range(3000).selectExpr("1L as vec_id", "id % 10 as label", "array(id, 2L) as v")
    for df in (same, same.union(spark.range(3000).selectExpr("id as vec_id", "id % 10 as label", "array(id, 3L) as v")), spark.range(40).selectExpr("id as vec_id", "id % 10 as label", "array(id) as v")):
        n = df.count()
        got = sorted(tuple(r.v) for r in hn._sample(df, n, 50))
        assert len(got) == min(n, 50)
        rows = sorted(map(tuple, df.selectExpr("xxhash64(vec_id)", "vec_id", "label", "v").collect()))
        assert got == sorted(tuple(r[3]) for r in rows[:50])


@pytest.mark.parametrize("scale, together, visit", [(200, 512, 256), (200, 3, 1), (100, 7, 20), (10**6, 40, 8), (10**8, 40, 8)])
def test_shards_one_after_the_other_match_all_pairs(monkeypatch, scale, together, visit):
    """Anchors walk together and begin each shard with what earlier ones gave; scores in single, double precision and whole numbers."""
    monkeypatch.setattr(hn, "TOGETHER", together)
    monkeypatch.setattr(hn, "VISIT", visit)
    rng = np.random.default_rng(scale % 97)
    centre = rng.normal(0, scale, (9, 6))
    rows = np.floor(centre[rng.integers(0, 9, 900)] + rng.normal(0, scale / 6, (900, 6))).astype(np.int64)
    rows[300:500] = rows[7]  # one vector many times
    ids, labels = rng.permutation(900), rng.integers(0, 4, 900)
    ids[50], ids[60] = ids[7], ids[8]
    centres = hn.codebook(rows[:300, :3].astype(float), 5), hn.codebook(rows[:300, 3:].astype(float), 5)
    part = rng.integers(0, 7, 900)
    shards = [hn.Index.of(ids[part == k], labels[part == k], rows[part == k], centres) for k in range(7)]
    pick = rng.choice(900, 80, replace=False)
    pick[:3] = 7, 8, 310
    own = hn.Anchors(ids[pick], labels[pick], rows[pick], centres)
    near = hn.First(80, 5)
    for index in shards:
        for group in own.together(alike=True):
            hn.nearest_rows(index, own, group, near)
    place, score, id_ = near.rows()
    low, high = np.array([-(-30 * s // 100) for s in score.tolist()]), np.array([90 * s // 100 for s in score.tolist()])
    hard, cut = hn.First(len(place), 10), np.searchsorted(place, np.arange(81))
    for index in shards:
        for group in own.together(alike=False):
            hn.window_rows(index, own, group, cut, low, high, hard)
    window, s, i = hard.rows()
    for a, p in enumerate(pick):
        full = list(zip((-(rows @ rows[p])).tolist(), ids.tolist(), labels.tolist()))
        want = sorted(x[:2] for x in full if x[2] == labels[p] and x[1] != ids[p])[:5]
        assert list(zip((-score[place == a]).tolist(), id_[place == a].tolist())) == want
        for w in range(cut[a], cut[a + 1]):
            want = sorted(x[:2] for x in full if x[2] != labels[p] and low[w] <= -x[0] <= high[w])[:10]
            assert list(zip((-s[window == w]).tolist(), i[window == w].tolist())) == want


def test_anchors_without_windows_or_rows_of_their_label():
    centres = np.zeros((1, 1)), np.zeros((1, 1))
    index = hn.Index.of(np.arange(4), np.array([0, 0, 1, 2]), np.array([[1, 1], [-9, -9], [2, 2], [3, 3]]), centres)
    own = hn.Anchors(np.array([0, 3, 9]), np.array([0, 2, 7]), np.array([[1, 1], [3, 3], [1, 1]]), centres)
    near = hn.First(3, 5)
    for group in own.together(alike=True):
        hn.nearest_rows(index, own, group, near)
    assert [x.tolist() for x in near.rows()] == [[0], [-18], [1]]
    hard = hn.First(1, 10)
    for group in own.together(alike=False):
        hn.window_rows(index, own, group, np.array([0, 1, 1, 1]), np.array([-5]), np.array([-16]), hard)
    assert not hard.n.any()
    none = hn.First(0, 10)
    for group in own.together(alike=False):
        hn.window_rows(index, own, group, np.zeros(4, int), np.zeros(0, int), np.zeros(0, int), none)
