import math
import random
import re

import numpy as np
import pytest

from ledgerlens.llm import ranked_search as rs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in TERM.findall(text or "")]


def slow(rows, items, k):
    docs = [(d, w) for d, t in rows if (w := words(t))]
    total, length = len(docs), sum(len(w) for _, w in docs)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for d, w in docs:
            m = 75 + (25 * len(w) * total) // length
            score = 0
            for t in words(text):
                if tf := w.count(t):
                    df = sum(t in x for _, x in docs)
                    score += math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1))) * ((10**9 * tf) // (1000 * tf + 12 * m))
            if score > 0:
                scores.append((-score, d is None, d or 0))
        out += [(item, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(120)] + ["É", "Ünd", "a_b", "x-1"]
    text = lambda n: " ".join(rng.choices(vocabulary, [1 / (1 + i) for i in range(len(vocabulary))], k=n))
    out = [(i * 2, text(rng.randint(1, 80))) for i in range(150)]
    out += [(1000 + i, out[3][1]) for i in range(30)]  # ties
    out += [(6, out[3][1]), (6, out[3][1]), (None, out[3][1]), (None, text(9)), (9001, None), (9002, ""), (9003, " _ -"), (9004, "W1 É" * 300)]
    rng.shuffle(out)
    return out


ITEMS = [(1, "w1 w2 w1 É w90"), (2, "w3"), (3, None), (4, "..."), (5, "unheard of"), (None, "w0 w0 Ünd w50"), (7, "w5 w6 w7 w8 w9 w10 w100 w101"), (7, "w5 w6 w7 w8 w9 w10 w100 w101")]


@pytest.mark.parametrize("shard, depth, item_terms", [(rs.SHARD, rs.DEPTH, rs.ITEM_TERMS), (520, 1, 3)])
def test_ranks_match_scoring_everything(spark, docs_of, rows, monkeypatch, shard, depth, item_terms):
    monkeypatch.setattr(rs, "SHARD", shard)
    monkeypatch.setattr(rs, "DEPTH", depth)
    monkeypatch.setattr(rs, "MERGED", 2)
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, score string")
    docs = docs_of([(d, (t or "") and t) for d, t in rows], extra=("term", "tf", "ids")).repartition(5)
    got = sorted(map(tuple, rs.ranked_search(docs, items, 20, item_terms).collect()), key=str)
    assert got == slow(rows, ITEMS, 20)


def test_reading_stops_early_and_right():
    """One document far ahead: the long lists are not read to their ends."""
    rng = np.random.default_rng(3)
    lists = []
    for _ in range(6):
        docs = rng.permutation(5000)
        impacts = np.sort(rng.integers(1, 500, 5000))[::-1]
        docs = np.concatenate([[17], docs[docs != 17]])
        lists.append((docs, np.concatenate([[10_000], impacts[1:]])))
    full = np.zeros(5000, np.int64)
    for docs, impacts in lists:
        full[docs] += impacts
    found, scores = rs.nra(lists, 5000, 1)
    assert found.tolist() == [17] and scores.tolist() == [60_000]
    found, scores = rs.nra(lists, 5000, 20)
    least = np.sort(full)[-20]
    assert sorted(found.tolist()) == np.flatnonzero(full >= least).tolist()
    assert full[found].tolist() == scores.tolist()


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert rs.ranked_search(docs_of([(1, "a")]), none).count() == 0
    assert rs.ranked_search(docs_of([]), some).count() == 0
    assert rs.ranked_search(docs_of([(1, None)]), some).count() == 0
