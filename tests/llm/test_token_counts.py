import random

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerlens.llm import token_counts as tc

PATH = P.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)


def lib_counts(texts):
    return [len(e.ids) for e in LIB.encode_batch(texts, add_special_tokens=False)]


def test_adversarial_texts_match_the_library():
    rng = random.Random(3)
    letters = "ab 's're'lldt \n\t\r.!?$12é三²  <|endoftext|>\x1c\x85\x00#ñ​"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(1500)]
    texts += ["", " ", "\n\n", "a" * 3000, "don't we'll 're x", "<|endoftext|>", "a<|endoftext|> b", " \n " * 50, "😀" * 700]
    assert tc.count_tokens(texts, PATH).tolist() == lib_counts(texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=80), max_size=5))
def test_any_text_matches_the_library(texts):
    assert tc.count_tokens(texts, PATH).tolist() == lib_counts(texts)


def test_scan_is_the_sequential_composition():
    maps = np.random.default_rng(1).integers(0, 9, (37, 9)).astype(np.uint8)
    got, now = tc.scan(maps), np.arange(9)
    for k in range(37):
        now = maps[k][now]
        assert (got[k] == now).all()


def test_parts_and_forgetting_change_nothing(monkeypatch):
    texts = ["The cat's sat on  the mat.\n\n" * 40, "x" * 500, None or "word " * 300]
    want = lib_counts(texts)
    monkeypatch.setattr(tc, "PART", 100)
    monkeypatch.setattr(tc, "MOST_STATES", 3)
    assert tc.count_tokens(texts, PATH).tolist() == want


def test_defined_results(docs_of, spark):
    rows = [(1, None), (1, None), (2, ""), (None, "hello world"), (3, "word " * 1024), (4, "word " * 1023)]
    got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tc.token_counts(docs_of(rows, extra=("n_tokens", "state")), PATH).collect()}
    assert got >= {(1, 0, 0, False), (2, 0, 0, False), (None, 11, 2, False)}
    assert {r[0]: r[3] for r in got}[3] is True and len(got) == 5
    assert tc.token_counts(docs_of([]), PATH).count() == 0
