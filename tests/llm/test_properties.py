"""Random texts against plain versions, without Spark."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import brute
from quadrille.llm import line_dedup, ngram_join, packing, tokens
from quadrille.llm.queries import tokenizer_path

TEXT = st.text(alphabet="aAbBé \t\n,.", max_size=60)
with open(tokenizer_path(), encoding="utf-8") as f:
    JSON = f.read()
WHOLE, BY_CHUNK = Tokenizer.from_str(JSON), tokens.encoder(JSON, True)


@settings(max_examples=300, deadline=None)
@given(TEXT, TEXT)
def test_shingle_sets(one, two):
    a, b = (ngram_join.shingle_hashes(t.encode()) for t in (one, two))
    x, y = brute.shingles(one), brute.shingles(two)
    assert len(a) == len(x) and len(np.intersect1d(a, b)) == len(x & y)


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=list("abAZ'sétÉß.,,. \n\t_-!<|>endoftext|12½²µ\x85\xa0\x1cΣİ́»"), max_size=40))
def test_chunks_encode_as_whole_texts(text):
    assert BY_CHUNK(text) == np.array(WHOLE.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=200, deadline=None)
@given(TEXT, TEXT)
def test_line_keys(one, two):
    plain = lambda x: brute.ascii_lower(x.strip(brute.WS))
    assert (line_dedup.line_key(one.encode()) == line_dedup.line_key(two.encode())) == (plain(one) == plain(two))


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 500), max_size=12))
def test_patterns_hold_the_demand(demand):
    made, held = packing.cutting_stock(demand, 32), {}
    for pattern, copies in made:
        assert sum(s * n for s, n in pattern.items()) <= 32
        for s, n in pattern.items():
            held[s] = held.get(s, 0) + n * copies
    assert held == demand
