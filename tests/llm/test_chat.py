import pytest

from ledgerlens.llm import chat


def slow(rows, part_turns):
    convs = {}
    for c, n, r, t in set(rows):
        convs.setdefault(c, set()).add((n, r or "unknown", t or ""))
    out = {}
    for c, turns in convs.items():
        for who in {r for _, r, _ in turns} - {"system"}:
            group = sorted((n is not None, n or 0, r, t) for n, r, t in turns)
            opening = next(((k, t) for k, (_, _, r, t) in enumerate(group) if r == "system"), None)
            for p in range(0, len(group), part_turns):
                text, mask = "", []
                if opening and opening[0] < p:
                    text = "<|im_start|>system\n" + opening[1] + "<|im_end|>\n"
                for _, _, r, t in group[p : p + part_turns]:
                    text += "<|im_start|>" + ("assistant" if r == who else "system" if r == "system" else "user name=" + r) + "\n"
                    begin = len(text)
                    text += t + "<|im_end|>"
                    if r == who:
                        mask.append((begin, len(text)))
                    text += "\n"
                out[c, who, p // part_turns] = (len(group[p : p + part_turns]), text, mask)
    return out


@pytest.fixture(scope="module")
def rows():
    out = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "hé 😀"), (1, 3, "ann", None), (1, 4, "", "who?"), (1, 4, "", "who?")]
    out += [(2, k, ["ann", "bob", "cy"][k % 3], f"t{k}") for k in range(25)]
    out += [(3, 0, "system", "alone"), (None, 1, "ann", "x"), (None, None, "bob", "first"), (4, 1, "u", "b"), (4, 1, "u", "a"), (5, 1, None, "")]
    out += [(6, k // 5, ["system", "ann", "bob"][k % 3], f"s{k}") for k in range(1, 30)]
    return out


@pytest.mark.parametrize("part_turns", [256, 4])
def test_matches_plain_rendering(spark, rows, part_turns):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit(1)).withColumn("turns", F.lit(2))
    got = {(r.conv_id, r.perspective, r.part): (r.n_turns, r.text, [(m.start, m.end) for m in r["mask"]]) for r in chat.perspectives(df, part_turns).collect()}
    assert got == slow(rows, part_turns)


def test_masks_cut_out_the_speakers_words(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    r = next(r for r in chat.perspectives(df).collect() if (r.conv_id, r.perspective) == (1, "bob"))
    assert [r.text[m.start : m.end] for m in r["mask"]] == ["hé 😀<|im_end|>"]
    assert chat.perspectives(df.limit(0)).count() == 0


def test_a_hot_conversation_with_null_and_equal_numbers(spark):
    """Its turns are dealt out: no part and no group holds more than its turns."""
    rows = [(9, None, "ann" if k % 2 else "bob", f"text {k:05d}") for k in range(600)] + [(9, 4, "cy", f"say {k:05d}") for k in range(600)]
    rows += [(9, 3, "system", "rules"), *[(k, 1, "ann", "x") for k in range(200, 1400)]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    got = [r for r in chat.perspectives(df, 100).collect() if r.conv_id == 9]
    assert {(r.conv_id, r.perspective, r.part): (r.n_turns, r.text, [(m.start, m.end) for m in r["mask"]]) for r in got} == slow([r for r in rows if r[0] == 9], 100)
    assert max(r.n_turns for r in got) == 100 and {r.first_turn for r in got} == {100 * k for k in range(13)}


def test_no_python_in_the_plan(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    text = chat.perspectives(df.select("*"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in text and "Arrow" not in text
