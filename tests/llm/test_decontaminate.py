import collections
import random
import re

import pytest

from ledgerlens.llm import decontaminate as dc


def words(t):
    return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]


def grams(ws, width):
    return collections.Counter(tuple(ws[i : i + width]) for i in range(len(ws) - width + 1))


def slow(rows, bench, limit=0.8):
    """Every window of every text against every item."""
    out = {}
    for d, t in rows:
        ws = words(t)
        for b, text in bench:
            item = words(text)
            if not item:
                continue
            width, best = min(5, len(item)), None
            want = grams(item, width)
            for s in range(len(ws) - len(item) + 1):
                have = grams(ws[s : s + len(item)], width)
                shared = sum((have & want).values())
                x = shared / (sum(have.values()) + sum(want.values()) - shared)
                if x >= limit and (best is None or x > best[0]):
                    best = (x, s)
            if best:
                out[d, b] = (best[1], len(item), round(best[0], 9))
    return out


@pytest.fixture(scope="module")
def tables(spark, docs_of):
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(60)] + ["été", "x2"]
    bench = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 6, 15, 30, 45])))) for i in range(30)]
    bench += [(100, None), (101, " .. "), (102, "same same same same same same same same"), (0, bench[7][1]), (None, bench[8][1])]
    rows = []
    for i in range(90):
        item = (rng.choice(bench)[1] or "a b").split()
        for _ in range(rng.choice([0, 0, 0, 1, 2, 4])):
            k = rng.randrange(len(item))
            item = rng.choice([item[:k] + ["new"] + item[k:], item[:k] + item[k + 1 :], item[:k] + ["other"] + item[k + 1 :]]) or ["z"]
        around = [[rng.choice(vocabulary) for _ in range(rng.randint(0, 30))] for _ in range(2)]
        text = " ".join(around[0]) + rng.choice([" ", ". ", "\n"]) + rng.choice([" ", ", ", " - "]).join(item).upper() + " " + " ".join(around[1])
        rows.append((i, text))
    rows += [(500, None), (501, ""), (502, "same " * 20), (503, bench[4][1])]
    return rows, bench, docs_of(rows, extra=("key", "item_id", "h")), spark.createDataFrame(bench, "item_id long, text string")


def test_matches_brute_force(tables):
    rows, bench, docs, items = tables
    want = slow(rows, bench)
    got = {(r.doc_id, r.item_id): (r.start_word, r.n_words, round(r.similarity, 9)) for r in dc.contaminated(docs, items).collect()}
    # item id 0 stands for two texts: the better of both counts
    assert set(got) == set(want)
    items_by, texts_by = dict(reversed(bench)), dict(rows)
    for (d, b), (start, n, x) in got.items():
        assert x == want[d, b][2] or b == 0
        if b != 0:  # among equally good windows ours begins with a shingle of the item
            window = " ".join(words(texts_by[d])[start : start + n])
            assert slow([(d, window)], [(b, items_by[b])])[d, b] == (0, n, x)
    assert len(want) > 40


def test_drop_and_defined_results(spark, tables, docs_of):
    rows, bench, docs, items = tables
    left = dc.drop_contaminated(docs, items)
    bad = {d for d, _ in slow(rows, bench)}
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(d for d, _ in rows if d not in bad)
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.contaminated(docs, none).count() == 0 and dc.drop_contaminated(docs, none).count() == len(rows)
    assert dc.contaminated(docs_of([]), items).count() == 0
    twice = docs_of([(1, bench[4][1]), (1, bench[4][1]), (None, bench[4][1])])
    assert {r.doc_id for r in dc.contaminated(twice, items).collect()} == {1, None}


def test_blocks_cover_the_fingerprint(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(dc._blocks(F.lit(-1).cast("long"), 23).alias("b")).first().b
    assert len(row) == 24 and sum(bin(x.bits).count("1") for x in row) == 64


def test_no_python_in_the_plan(tables):
    _, _, docs, items = tables
    text = dc.contaminated(docs, items)._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text and "CartesianProduct" not in text
