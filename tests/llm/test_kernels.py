import collections
import random

import public_tokenizers
import pytest
import tokenizers

from ledgerlens.llm import language_model, line_dedup, pack
from ledgerlens.llm.features import text_stats
from ledgerlens.llm.kernels import Block


def thue_morse(symbols, size):
    word = [0]
    while len(word) < size:
        word += [1 - x for x in word]
    return [symbols[x] for x in word]


def opposite(sep=""):
    """Two different sequences that agree in every polynomial over a power of two."""
    return sep.join(thue_morse("ab", 1024)), sep.join(thue_morse("ba", 1024))


@pytest.mark.parametrize("spans", ["words", "lines"])
def test_hashes_agree_where_the_bytes_do(spans):
    rng = random.Random(1)
    block = Block([bytes(rng.choice(b"ab\0 \n") for _ in range(rng.choice([0, 1, 5, 7, 8, 9, 16, 63, 64, 65, 300]))) for _ in range(3000)])
    starts, ends = getattr(block, spans)()
    by_bytes = collections.defaultdict(set)
    for a, b, h in zip(starts, ends, block.hashes(starts, ends).tolist()):
        by_bytes[block.buf[a:b].tobytes()].add(h)
    assert all(len(x) == 1 for x in by_bytes.values())
    assert len({h for x in by_bytes.values() for h in x}) == len(by_bytes)


def test_words_that_a_polynomial_takes_for_equal():
    a, b = opposite()
    block = Block([a.encode(), b.encode(), f"{a}\n{b}".encode()])
    starts, ends = block.words()
    assert len(set(block.hashes(starts, ends).tolist())) == 2
    assert text_stats(block)["n_dup_lines"].tolist() == [0, 0, 0]
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = pack.token_ids([a.encode(), b.encode()], public_tokenizers.path("word_bpe_49k.json"), 1)
    for t, ids in zip((a, b), got):
        assert list(memoryview(ids).cast("B").cast("I")) == [*library.encode(t, add_special_tokens=False).ids, 1]


def test_lines_and_counts_that_a_polynomial_takes_for_equal(docs_of):
    a, b = opposite(" ")
    assert [r.n_deleted for r in line_dedup.line_dedup(docs_of([(1, a), (2, b)])).collect()] == [0, 0]
    a, b = opposite()
    out = {r.doc_id: r.n_known for r in language_model.language_model_scores(docs_of([(i, a) for i in range(8)] + [(100, b)])).collect()}
    folds = {r.doc_id: r.held_out for r in language_model.language_model_scores(docs_of([(i, a) for i in range(8)] + [(100, b)])).collect()}
    assert out[100] == (1 if folds[100] else 2)
