import math
import random
import re
import zlib

import numpy as np
import pytest

from ledgerlens.llm import linear, quality_rank, quality_rules
from ledgerlens.llm.features import WIDTH, dense, linear_scores, sparse_rows, text_stats
from ledgerlens.llm.kernels import Block

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def slow_stats(text):
    words = WORDS.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    at = {}
    for i in range(len(words) - 4):
        at.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def texts():
    rng = random.Random(6)
    letters = ["a", "b", "Zé", "#", "|", "三", " ", " ", "\n", "\t", "\x0b", "\xa0", "\x1c"]
    out = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 120))) for _ in range(300)]
    return out + ["", None, " \n", "a", "a b c d e a b c d e", "x " * 500, "l\nl\nl", "\n\n"]


def test_counts_match_the_definitions(docs_of):
    rows = list(enumerate(texts())) + [(None, "one two"), (3, "again")]
    model = quality_rules.QualityModel(np.zeros(WIDTH), 0.0, 30.0)
    got = quality_rules.quality_rules(docs_of(rows, extra=("n_words", "kept", "score")), model).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words): r for r in got}
    for i, t in rows:
        want = slow_stats(t)
        r = by[(i, *want)]
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert r.base_failed == failed and r.kept == (not failed)
    assert quality_rules.quality_rules(docs_of([]), model).count() == 0


def test_linear_scores_equal_the_sparse_rows():
    rng = np.random.default_rng(1)
    w = rng.normal(size=WIDTH)
    block = Block([(t or "").encode() for t in texts()])
    want = [float((w[b] * v).sum()) for b, v in sparse_rows(block)]
    assert np.allclose(linear_scores(block, w), want, atol=1e-3)
    assert len(text_stats(Block([b""]))["n_words"]) == 1


@pytest.fixture(scope="module")
def labelled(spark, docs_of):
    rng = random.Random(8)
    good = ["river", "stone", "walked", "quiet", "evening", "the", "of", "and"]
    rows, labels = [], []
    for i in range(900):
        w = [rng.choice(good) for _ in range(rng.randint(12, 80))]
        bad = i % 4 == 0
        if bad:
            w = [x + rng.choice(["$$$", "###"]) for x in w]
        rows.append((i, " ".join(w)))
        if i % 3:
            labels.append((i, 0 if bad else 1, 0))
    table = spark.createDataFrame(labels + [(None, 1, 0), (5000, 1, None), (1, None, 0)], "doc_id long, quality int, toxic int")
    return docs_of(rows), table


def test_rules_learn_the_labels(labelled):
    docs, labels = labelled
    model = quality_rules.fit(docs, labels)
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs, model).collect() if not r.base_failed}
    right = [r.kept == (i % 4 != 0) for i, r in got.items()]
    assert len(right) > 300 and np.mean(right) > 0.98
    kept = quality_rules.keep_good(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def test_ranking_holds_on_unseen_rows(labelled):
    docs, labels = labelled
    got = {r.doc_id: r for r in quality_rank.quality_scores(docs, quality_rank.fit(docs, labels)).collect()}
    held = [r for r in got.values() if r.held_out]
    assert {r.doc_id for r in held} == {i for i in got if zlib.crc32(str(i).encode()) % 5 == 0}
    right = [r.predicted == (r.doc_id % 4 != 0) for r in held]
    assert np.mean(right) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())


def test_held_out_labels_are_not_read(spark, labelled):
    from pyspark.sql import functions as F

    docs, labels = labelled
    from ledgerlens.llm.frames import fold

    flipped = labels.withColumn("quality", F.when(fold("doc_id", 5) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality_rank.fit(docs, labels), quality_rank.fit(docs, flipped)
    assert np.array_equal(a.weights, b.weights) and a.offset == b.offset


def test_without_labels(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = docs_of([(1, "word " * 3 + "a b c d e f g h i"), (2, None), (None, "")])
    assert [r.kept for r in sorted(quality_rules.quality_rules(docs, quality_rules.fit(docs, none)).collect(), key=lambda r: r.doc_id or 9)] == [True, False, False]
    got = quality_rank.quality_scores(docs, quality_rank.fit(docs, none)).collect()
    assert {r.score for r in got} == {0.5} and len(got) == 3


def slow_features(text):
    """Sparse and dense features of one text, as one dictionary."""
    block = Block([(text or "").encode()])
    buckets, values = sparse_rows(block)[0]
    out = {}
    for b, v in zip(buckets.tolist(), values.tolist()):
        out[b] = out.get(b, 0.0) + v
    return out | {WIDTH + k: float(x) for k, x in enumerate(dense(text_stats(block))[0])}


def test_ranking_equals_a_plain_pairwise_fit():
    """Bradley-Terry by loops over pairs, with the same steps."""
    rng = random.Random(12)
    texts = [" ".join(rng.choice(["river", "stone", "the", "of", "$$$" if i % 3 == 0 else "quiet"]) for _ in range(rng.randint(4, 15))) for i in range(48)]
    label = [int(i % 3 != 0) for i in range(48)]
    x = [slow_features(t) for t in texts]
    rows = [sparse_rows(Block([t.encode()]))[0] for t in texts]
    first = np.concatenate(([0], np.cumsum([len(b) for b, _ in rows])))
    shape = np.concatenate([dense(text_stats(Block([t.encode()]))) for t in texts])
    sample = linear.Sample(first, np.concatenate([b for b, _ in rows]), np.concatenate([v for _, v in rows]), shape, np.array(label))
    model = quality_rank.fit_pairs(sample, steps=25)

    held = linear.held_rows(48).tolist()
    good = [k for k in range(48) if label[k] and not held[k]]
    bad = [k for k in range(48) if not label[k] and not held[k]]
    n = quality_rank.PARTNERS * max(len(good), len(bad))
    pairs = [(good[k % len(good)], bad[(k + k // len(good) * 7) % len(bad)]) for k in range(n)]
    used = sorted({k for f in x for k in f})
    w, m, v = ({k: 0.0 for k in used} for _ in range(3))
    for t in range(1, 26):
        u = [sum(w[k] * f for k, f in row.items()) for row in x]
        g = {k: 1e-5 * w[k] for k in used}
        for i, j in pairs:
            push = (1 / (1 + math.exp(-(u[i] - u[j]))) - 1) / n
            for k, f in x[i].items():
                g[k] += push * f
            for k, f in x[j].items():
                g[k] -= push * f
        for k in used:
            m[k] += 0.1 * (g[k] - m[k])
            v[k] += 0.01 * (g[k] ** 2 - v[k])
            w[k] -= 0.1 * (1 - (t - 1) / 25) * (m[k] / (1 - 0.9**t)) / (math.sqrt(v[k] / (1 - 0.99**t)) + 1e-6)
    u = [sum(w[k] * f for k, f in row.items()) for row in x]
    out = [u[k] for k in range(48) if held[k]]
    threshold = np.quantile(out, 1 - np.mean([label[k] for k in range(48) if held[k]]))
    got = model.scores(Block([t.encode() for t in texts]))
    want = [1 / (1 + math.exp(-(model.slope * (a - threshold) + math.log(0.3 / 0.7)))) for a in u]
    assert model.slope > 0 and np.allclose(got, want, atol=2e-3)


def test_probability_is_the_calibrated_sum():
    rng = np.random.default_rng(2)
    model = quality_rules.QualityModel(rng.normal(size=WIDTH).astype(np.float32), 0.7, -0.2)
    some = [t for t in texts()[:60]]
    got = model.probability(Block([(t or "").encode() for t in some]))
    for t, p in zip(some, got):
        z = sum(float(model.weights[k]) * f for k, f in slow_features(t).items() if k < WIDTH)
        assert abs(p - 1 / (1 + math.exp(-max(-35, min(35, 0.7 * z - 0.2))))) < 1e-3


def test_labels_of_absent_documents_take_no_place(spark, docs_of):
    docs = docs_of([(i, f"text {i}") for i in range(20)])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(2000)], "doc_id long, quality int, toxic int")
    assert {r.doc_id for r in linear.labelled_rows(docs, labels, "quality", 20).collect()} == set(range(20))
    assert linear.labelled_rows(docs, labels, "quality", 7).count() == 7


def test_clashing_columns_and_long_texts(docs_of):
    """A text longer than a block is counted and scored as a whole."""
    long = "word another $$$ thing\n" * 60_000
    model = quality_rules.QualityModel(np.zeros(WIDTH), 0.0, 30.0)
    r = quality_rules.quality_rules(docs_of([(1, long), (2, "short")], extra=("probability", "n_words")), model).where("doc_id = 1").first()
    assert (r.n_words, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (240_000, 180_000, 59_999, 240_000)
    none = quality_rank.RankModel(np.zeros(WIDTH), np.zeros(11), 0.0, 0.0)
    got = quality_rank.quality_scores(docs_of([(1, long), (None, None)], extra=("score", "held_out", "predicted")), none)
    assert sorted(r.score for r in got.collect()) == [0.5, 0.5]
    assert quality_rank.quality_scores(docs_of([]), none).count() == 0


def labelled_texts(spark, docs_of, rows):
    """(doc_id, text, label) -> documents and labels."""
    return docs_of([r[:2] for r in rows]), spark.createDataFrame([(i, k, 0) for i, _, k in rows], "doc_id long, quality int, toxic int")


def in_hash_order(spark, n):
    from pyspark.sql import functions as F

    return [r.id for r in spark.range(n).orderBy(F.xxhash64("id"), "id").collect()]


def test_ranking_learns_from_all_labelled_rows(spark, docs_of):
    """A mark of bad texts that no row among the first 3,000 has (those were the sample once) is learned."""
    rng = random.Random(3)
    seen, rows = 0, []
    for i in in_hash_order(spark, 7000):
        held = zlib.crc32(str(i).encode()) % 5 == 0
        bad = rng.random() < 0.3
        seen += not held
        mark = ("zebra" if held or seen > 3000 else "$$$") if bad else "stone"
        words = [rng.choice(["river", "walked", "quiet", "the", "of"]) for _ in range(rng.randint(12, 20))] + [mark] * 3
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(not bad)))
    assert seen > 5000
    docs, labels = labelled_texts(spark, docs_of, rows)
    got = {r.doc_id: r for r in quality_rank.quality_scores(docs, quality_rank.fit(docs, labels)).collect()}
    for k in (0, 1):
        assert np.mean([got[i].predicted == k for i, _, label in rows if got[i].held_out and label == k]) > 0.95


@pytest.mark.parametrize("rare, cell", [(False, 20_000), (False, 10), (True, 20_000)])
def test_ranking_of_parts_equals_a_plain_pairwise_fit(spark, docs_of, monkeypatch, rare, cell):
    """The same steps by plain arrays over the pairs of all parts; small cells and a rare class copied to more parts change no row."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(linear, "CELL", cell)
    monkeypatch.setattr(linear, "RARE", 50 if rare else 1)
    rng = random.Random(15)
    rows = []
    for i in range(300):
        bad = i % (30 if rare else 3) == 0
        rows.append((i, " ".join(rng.choice(["river", "stone", "the", "of", "$$$" if bad else "quiet"]) for _ in range(rng.randint(4, 15))), int(not bad)))
    rows[7] = (7, None, 1)
    docs, labels = labelled_texts(spark, docs_of, rows)
    docs = docs.union(docs.where("doc_id % 5 = 1").withColumn("text", F.lit("")))  # repeated ids: the greatest text counts
    labels = labels.union(labels.where("doc_id % 4 = 1")).union(spark.createDataFrame([(None, 1, 0), (9000, 0, 0), (5, None, 0)], labels.schema))
    table = linear.labelled_parts(docs, labels, "quality", 60, F.lit(True))
    model = quality_rank.fit_parts(spark, table, steps=25)

    home = {r.id: r.part for r in spark.range(300).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(5))).collect()}
    members = {p: [r for r in rows if home[r[0]] == p] for p in range(5)}
    held = {r[0] for group in members.values() for r, h in zip(group, linear.held_rows(len(group))) if h}
    x = {i: slow_features(t) for i, t, _ in rows}
    met = {}
    for f in x.values():
        for k in f:
            met[k] = met.get(k, 0) + 1
    used = [k for k in sorted(met) if k >= WIDTH or met[k] >= 15]
    m = np.array([[x[i].get(k, 0.0) for k in used] for i in range(300)])
    parts = {p: sorted({(r[0], r[2]) for q in range(5) for r in members[q] if r[0] not in held and (q == p or rare and r[2] == 0)}) for p in range(5)}
    pairs = []
    for group in parts.values():
        good, bad = [i for i, k in group if k], [i for i, k in group if not k]
        n = quality_rank.PARTNERS * max(len(good), len(bad))
        # partners go by place in the part, held rows left out
        pairs += [(good[k % len(good)], bad[(k + k // len(good) * 7) % len(bad)]) for k in range(n)]
    i, j = np.array(pairs).T

    def grad(w):
        d = m[i] - m[j]
        return (1 / (1 + np.exp(-(d @ w))) - 1) @ d / len(pairs) + 1e-5 * w

    u = m @ linear.descend(grad, len(used), 25)
    label = np.array([k for _, _, k in rows])
    quarter = np.array(sorted(held))
    threshold = np.quantile(u[quarter], 1 - label[quarter].mean())
    slope, _ = linear.platt(u[quarter], label[quarter])
    got = model.scores(Block([(t or "").encode() for _, t, _ in rows]))
    assert slope > 0 and np.allclose(got, 1 / (1 + np.exp(-(slope * (u - threshold) + math.log(0.3 / 0.7)))), atol=2e-3)
    roles = [(p.label, p.role) for p in linear._parts_of(table.collect())]
    table.unpersist()
    assert sum(int((role != linear.COPY).sum()) for _, role in roles) == 300
    assert sum(int((role == linear.HELD).sum()) for _, role in roles) == len(held)
    assert len(roles) == 5 and all(len(set(k[role != linear.HELD])) == 2 for k, role in roles)


def test_curve_of_a_table_equals_the_array_one(spark):
    rng = np.random.default_rng(4)
    u = np.round(rng.normal(size=500), 2)
    label = (u + rng.normal(size=500) > 0.8).astype(int)
    table = spark.createDataFrame([(float(a), int(b)) for a, b in zip(u, label)], "u double, label int").repartition(3)
    slope, q = linear.platt_of(table)
    assert abs(slope - linear.platt(u, label)[0]) < 1e-9 and abs(q - np.quantile(u, 1 - label.mean())) < 1e-12
    assert linear.platt_of(table.where("label = 1")) == (0.0, None)
    assert linear.platt_of(table.limit(0)) == (0.0, None)


def test_few_labels_and_one_class(spark, docs_of):
    for labels in ([(1, 1)], [(1, 1), (2, 0)], [(1, 1), (2, 0), (3, 1), (4, 1), (6, 1)]):
        docs, table = labelled_texts(spark, docs_of, [(i, f"text {i}", k) for i, k in labels])
        got = quality_rank.quality_scores(docs, quality_rank.fit(docs, table)).collect()
        assert len(got) == len(labels) and all(0 <= r.score <= 1 for r in got)
