import random
import re

import pytest

from ledgerlens.llm import frames
from ledgerlens.llm import minhash as mh


def slow_set(text, width=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def slow(rows):
    """(n_shingles, component_id) of each row, by comparing all pairs."""
    sets = sorted({slow_set(t) for _, t in rows} - {frozenset()}, key=sorted)
    root = {s: s for s in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for b in sets[:i]:
            if 100 * len(a & b) >= 80 * len(a | b):
                root[find(a)] = find(b)
    least = {}
    for d, t in rows:
        if (s := slow_set(t)) and d is not None:
            r = find(s)
            least[r] = min(d, least.get(r, d))
    return [(len(s), least.get(find(s)) if s else d) for d, t in rows for s in [slow_set(t)]]


def check(docs_of, rows, **options):
    got = sorted(map(tuple, mh.near_duplicates(docs_of(rows, extra=("n", "node", "hi", "least")), **options).collect()), key=str)
    want = sorted(((d, n, c, d == c) for (d, _), (n, c) in zip(rows, slow(rows))), key=str)
    assert got == want


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)] + ["É", "Ünd"]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    passage = text(60)
    out = []
    for size, copies in ((30, 8), (120, 40), (150, 25), (420, 12), (7, 6)):
        base = text(size)
        for k in range(copies):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, size // 30, size // 15])):
                w[rng.randrange(size)] = rng.choice(words)
            out.append(" ".join(x.upper() if rng.random() < 0.2 else x for x in w))
    chain = text(200)  # each like the next only
    for k in range(8):
        chain[k * 22 : k * 22 + 4] = text(4)
        out.append(" ".join(chain))
    out += [" ".join(text(rng.randint(5, 40)) + passage + text(rng.randint(5, 40))) for _ in range(30)]
    out += [" ".join(text(rng.randint(1, 300))) for _ in range(40)]
    out += [None, "", " \n\t", "one", "ONE", "one two three", "one two  three", "one two", "one two three four", "one two three four"]
    rng.shuffle(out)
    return [(i * 3 + 1, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("sketch, known", [(160, 500_000), (20, 0)])
def test_components_match_all_pairs(docs_of, rows, monkeypatch, sketch, known):
    monkeypatch.setattr(frames, "KNOWN_KEYS", known)  # full sets picked out by a list, or by a join
    check(docs_of, rows, sketch=sketch)


def test_null_and_repeated_ids(docs_of):
    a, b = " ".join(f"t{i}" for i in range(50)), " ".join(f"t{i}" for i in range(1, 51))
    check(docs_of, [(5, a), (5, a), (9, b), (None, a), (5, "another text of five words"), (None, "no id at all here"), (None, None), (7, ""), (8, None), (8, a)])
    assert mh.near_duplicates(docs_of([])).count() == 0


def test_a_text_longer_than_a_block(docs_of):
    rng = random.Random(2)
    long = [f"v{rng.randrange(10**6)}" for _ in range(180_000)]
    less = long[: int(len(long) * 0.9)]
    other = long[: int(len(long) * 0.7)]
    got = {r.doc_id: r.component_id for r in mh.near_duplicates(docs_of([(1, " ".join(long)), (2, " ".join(less)), (3, " ".join(other))])).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_edited_copies_meet_their_centre_only(spark, docs_of):
    """Pairs follow the members of a group, not their square."""
    rng = random.Random(6)
    n_pairs = []
    for words, copies in ((140, 100), (140, 400), (600, 400)):
        base = [f"b{i}" for i in range(words)]
        texts = []
        for k in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, words // 12)):
                w[rng.randrange(words)] = f"x{rng.randrange(10**9)}"
            texts.append(" ".join(w))
        docs = docs_of(list(enumerate([" ".join(base), *texts])))
        classes = mh.classes_of(mh.written(mh.sketches(docs)))
        entries = mh.written(mh.inverted_lists(classes))
        hub = mh.written(mh.hub_pairs(entries, mh.SKETCH, mh.PERCENT))
        found = mh.estimated(hub, classes, mh.SKETCH, mh.PERCENT)
        sets = mh.sets_of(classes.select("node"), classes, docs, 4)
        full = mh.inverted_lists(sets.selectExpr("node", "cast(size(items) as long) as n", "items as least"), mh._WHOLE)
        rest = mh.open_pairs(mh.written(full), mh.components(mh.verified(found, sets, mh.PERCENT)), mh.PERCENT)
        n_pairs.append((hub.count(), rest.count()))
    assert all(sum(p) <= 8 * n for p, n in zip(n_pairs, (100, 400, 400))), n_pairs
