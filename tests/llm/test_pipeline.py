import collections
import random

import pytest
from test_decontaminate import slow as slow_contaminated
from test_line_dedup import slow as slow_lines
from test_pack import check as check_packing
from test_quality import slow_stats
from test_simhash import slow_components, slow_fingerprint

import corpus_pipeline
from ledgerlens.llm.frames import written


@pytest.fixture(scope="module")
def folder(spark, docs_of, tmp_path_factory):
    rng = random.Random(21)
    vocabulary = [f"word{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    bench = [(i, text(rng.randint(12, 40))) for i in range(12)]
    passage = "\n".join(text(20) for _ in range(4))
    rows = [(i, "\n".join(text(rng.randint(5, 30)) for _ in range(rng.randint(1, 6)))) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(8)]  # exact copies
    rows += [(200 + i, rows[20 + i][1].replace("word1 ", "wordx ")) for i in range(8)]  # near copies
    rows += [(300 + i, text(15) + "\n" + passage + "\n" + text(12)) for i in range(5)]
    rows += [(400 + i, text(30) + "\n" + bench[i][1] + " " + text(20)) for i in range(6)]
    rows += [(500, "stutter " * 60), (501, None), (502, ""), (503, "too short"), (None, text(25)), (504, rows[3][1]), (0, rows[0][1])]
    path = tmp_path_factory.mktemp("tables")
    docs_of(rows, extra=("key", "fp", "gone")).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), rows, bench


def plain(rows, bench):
    """What each stage leaves, in plain Python (no labels: the rules alone decide)."""
    out = []
    rows = [(d, t) for d, t in rows if (n := slow_stats(t))[0] >= 10 and 100 * n[4] <= 20 * n[0]]
    out.append(rows)
    gone = slow_lines(rows, 50)
    cut = [(d, "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d, t])) for d, t in rows]
    rows = [(d, c) for d, c in cut if c.split()]
    out.append(rows)
    number = lambda d: 10**9 if d is None else d
    named = {number(d): slow_fingerprint(t) for d, t in rows}
    group = slow_components(named, 4)
    rows = list({(d, t) for d, t in rows if group[number(d)] == number(d)})
    out.append(rows)
    bad = {d for d, _ in slow_contaminated(rows, bench)}
    out.append([(d, t) for d, t in rows if d not in bad])
    return out


def test_every_stage_and_the_run(spark, folder):
    path, rows, bench = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    assert [len(corpus_pipeline.STAGES), corpus_pipeline.ORACLE_SQL] == [5, None]
    steps = plain(rows, bench)
    assert len({len(x) for x in [rows, *steps]}) == 5  # every stage takes some away
    for (_, stage), want in zip(corpus_pipeline.STAGES, steps):
        docs = written(stage(spark, docs, path))
        assert docs.columns == columns
        assert collections.Counter((r.doc_id, r.text) for r in docs.collect()) == collections.Counter(want)
    placed = corpus_pipeline.run(spark, path).collect()
    check_packing(steps[-1], placed, 4096)


def test_empty_tables(spark, folder, tmp_path):
    path, _, _ = folder
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
