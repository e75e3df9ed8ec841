import random

from ledgerlens.llm import line_dedup as ld


def slow(rows, min_words):
    """Deleted line numbers by document: a line goes if some run of lines around it with enough words
    occurs at an earlier place (blank lines passed over)."""
    docs = []
    for d, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        all_lines = (t or "").split("\n") if t is not None else []
        docs.append((d, t, [(i, x) for i, x in enumerate(all_lines) if x.strip(" \t\n\r\x0b\x0c")]))
    first, gone = {}, {}
    for k, (_, _, full) in enumerate(docs):
        for i in range(len(full)):
            for j in range(i + 1, len(full) + 1):
                first.setdefault(tuple(x for _, x in full[i:j]), (k, i))
    for k, (d, t, full) in enumerate(docs):
        lost = set()
        for i in range(len(full)):
            for j in range(i + 1, len(full) + 1):
                if sum(len(x.split()) for _, x in full[i:j]) >= min_words and first[tuple(x for _, x in full[i:j])] < (k, i):
                    lost |= {n for n, _ in full[i:j]}
        gone[d, t] = sorted(lost)
    return gone


def corpus(seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5))) for _ in range(9)] + ["", "  "]
    runs = [[rng.choice(pool) for _ in range(rng.randint(1, 7))] for _ in range(8)]
    rows = []
    for i in range(40):
        out = []
        for _ in range(rng.randint(0, 4)):
            out += rng.choice(runs) if rng.random() < 0.7 else [f"u{i} {rng.random()}"]
        rows.append((i, "\n".join(out)))
    return rows


def test_matches_brute_force(spark, docs_of):
    rows_of_batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for seed, min_words, n in ((1, 8, 10000), (2, 5, 7), (3, 1, 1), (4, 12, 10000)):
        spark.conf.set(rows_of_batch, n)  # texts that go on over batches
        rows = corpus(seed)
        want = slow(rows, min_words)
        got = {(r.doc_id, tuple(r.deleted), r.n_deleted) for r in ld.line_dedup(docs_of(rows), min_words).collect()}
        spark.conf.unset(rows_of_batch)
        assert got == {(d, tuple(g), len(g)) for (d, _), g in want.items()}


def test_text_left_and_defined_results(docs_of):
    passage = "\n".join(" ".join(f"p{i}w{j}" for j in range(20)) for i in range(3))
    rows = [(1, "first\n" + passage + "\nlast"), (2, "other\n\n" + passage + "\nend"), (3, passage), (4, None), (5, ""), (None, passage), (6, "short\nshort"), (1, "first\n" + passage + "\nlast")]
    got = {(r.doc_id, r.text, r.n_lines) for r in ld.line_dedup(docs_of(rows, extra=("key", "gone", "pos"))).collect()}
    assert got == {(1, rows[0][1], 5), (2, "other\n\nend", 6), (3, "", 3), (4, None, 0), (5, "", 1), (None, "", 3), (6, "short\nshort", 2)}
    left = ld.delete_lines(docs_of(rows, extra=("key", "gone", "pos")))
    assert sorted((r.doc_id, r.n_chars) for r in left.collect() if r.doc_id in (1, 2, 3)) == [(1, len(rows[0][1])), (1, len(rows[0][1])), (2, 10)]
    assert left.columns == ["doc_id", "text", "lang", "source", "n_chars", "key", "gone", "pos"]
    assert ld.line_dedup(docs_of([])).count() == 0


def test_a_text_repeats_itself(docs_of):
    line = "one two three four five six"
    got = ld.line_dedup(docs_of([(7, "\n".join([line] * 4))]), min_words=6).first()
    assert got.text == line and list(got.deleted) == [1, 2, 3]
