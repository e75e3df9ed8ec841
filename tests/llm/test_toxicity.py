import itertools
import random
import re
import zlib

import numpy as np

from ledgerlens.llm import toxicity as tx


def plain():
    return tx.Lexicon(list(tx.INSULTS), np.array(list(tx.INSULTS.values())))


def test_folding_and_matching():
    lex = plain()
    for t in ("You IDIOT!", "you 1d10t", "іdіоt", "an ｉｄｉｏｔ", "idiots", "(idiot)", "you\tidiot."):
        assert lex.counts(t), t
    for t in ("idio t", "anidiot", "", None, "12 10 2015", "café río"):
        assert not lex.counts(t), t


def test_signs_and_digits_with_several_readings():
    lex = plain()
    for t, n in (
        ("id!ot", 1), ("b!tch", 1), ("re+ard", 1), ("s(um", 1), ("1oser", 1), ("assho1e", 1), ("worth1ess", 1), ("1mbeci1e", 1), ("a$$ho|e", 1),
        ("f|lth", 1), ("hey!idiot", 1), ("you!!b!+ch", 1), ("idiot!you", 1), ("garbage!human", 1), ("garbage hum4n 1d1ot", 2), ("stup1d+id!ot", 2),
    ):
        assert sum(lex.counts(t).values()) == n, t
    for t in ("fail", "ioser", "assho!e", "f(x) + g(y)", "put it in the trash!can", "an id!ot proof and 1diot!proof thing", "1 + 1 | 11!", "!", "+(|"):
        assert not lex.counts(t), t
    whole = tx.Lexicon(["idiot ", "fall"], np.array([1.0, 1.0]))
    assert whole.counts("id1ot!") == whole.counts("id!ot!you") == {0: 1} and whole.counts("fa11") == {1: 1} and not whole.counts("idiots fail")
    assert tx.folded("Id!ot (1) a|b") == " idiot i aib "
    assert {"loser ", "ioser ", "hey ", "you "} <= tx._terms("1oser hey!you")[1]


def slow_counts(lexicon, text):
    """Regular expressions over every reading of the marked text."""
    line = tx._marked(text)
    found, spared = set(), set()
    for chars in itertools.product(*(tx.READINGS.get(c, (c,)) for c in line)):
        read = "".join(chars)
        for k, entry in [*enumerate(lexicon.entries), *((-1, " ".join(e.split())) for e in lexicon.exceptions)]:
            for m in re.finditer(f"(?=(?<= )({re.escape(entry).replace(chr(92) + ' ', ' +')}))", read):
                if m[1][0] != " ":
                    (found if k >= 0 else spared).add((m.start(), m.start() + len(m[1]), k))
    out = {}
    for a, k in sorted({(a, k) for a, _, k in found}):
        if not any(b <= a < e for b, e, _ in spared):
            out[k] = out.get(k, 0) + 1
    return out


def test_counts_match_all_readings_by_regular_expressions():
    rng = random.Random(17)
    lexicon = tx.Lexicon(["idi", "lo ", "tic il", "a", "il l"], np.ones(5), exceptions=("idi lo", "tic"))
    for _ in range(1500):
        text = "".join(rng.choice("idlotca1!|+( .") for _ in range(rng.randint(0, 9)))
        assert lexicon.counts(text) == slow_counts(lexicon, text), repr(text)


def test_exception_phrases():
    lex = plain()
    assert not lex.counts("put it in the trash can, please")
    assert len(lex.counts("trash can and trash talk")) == 1
    assert not lex.counts("the trash, can you")  # punctuation folds away: the phrase stands
    # an exception spares its own span only
    assert lex.counts("class clown award for an idiot") and sum(lex.counts("clown fish idiot").values()) == 1


def test_length_normalises():
    lex = plain()
    assert lex.score("idiot") > lex.score("idiot " + "word " * 5000) >= lex.score("word")


def test_learned_stems_and_folds(spark, docs_of):
    rng = random.Random(3)
    syllables = ["ba", "do", "ki", "lu", "men", "ra", "sto", "ti"]
    rows, labels = [], []
    for i in range(1200):
        w = ["".join(rng.choice(syllables) for _ in range(3)) for _ in range(rng.randint(5, 60))]
        bad = i % 6 == 0
        if bad:
            w.insert(rng.randrange(len(w)), "zorp" + rng.choice(syllables))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    docs, table = docs_of(rows + [(None, None), (7, "")], extra=("label", "term")), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = tx.toxicity(docs, tx.learn(docs, table)).collect()
    assert len(got) == len(rows) + 2
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1} | ({7} if zlib.crc32(b"7") % 3 == 1 else set())
    assert np.mean([r.predicted == (r.doc_id % 6 == 0) for r in held]) > 0.97
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in got)


def test_texts_that_share_a_word_are_no_near_copies(spark, docs_of):
    rng = random.Random(5)
    words = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(3000)]
    least = min(words, key=lambda w: tx.xxhash.xxh64_intdigest(w))
    texts = [" ".join([least, *rng.sample(words, 40), *(["zorp"] if i % 6 == 0 else [])]) for i in range(300)]
    copies = [" ".join([*texts[6].split(), f"q{a}{b}"]) + " blargh" for a in "aeiou" for b in "aeiou"]  # of a toxic text
    rows = list(enumerate(texts + copies))
    labels = spark.createDataFrame([(i, 1, int(i % 6 == 0 or i >= 300)) for i, _ in rows], "doc_id long, quality int, toxic int")
    entries = tx.learn(docs_of(rows), labels).entries
    assert any(e.startswith("zor") for e in entries) and not any(e.startswith("bla") for e in entries)
    kinds = tx._kinds(np.array([tx._min_hashes(tx._words(t)) for t in texts + copies + ["", None]]))
    assert len(set(kinds)) == 301 and len({kinds[6], *kinds[300:325]}) == 1 and kinds[325] == kinds[326]


def test_without_labels(spark, docs_of):
    docs = docs_of([(1, "you are a pathetic idiot and a moron"), (2, "a quiet evening")])
    lex = tx.learn(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r.doc_id: r.predicted for r in tx.toxicity(docs, lex).collect()} == {1: 1, 2: 0}
    assert tx.toxicity(docs_of([]), lex).count() == 0
