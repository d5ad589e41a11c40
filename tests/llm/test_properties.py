"""Properties that hold for any text."""

from __future__ import annotations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from inkwell.llm import addresses, language_id, names, ocr, packing, pii

TEXT = st.text(max_size=300)
LOOSE = st.lists(st.sampled_from(["Robert", "Moll", " ", "\n", "12", "-", "@", "a.org", "+49 30 1234567", "Weg 5", ",", "rue", "R.", "Passport", "ß", "İ", "­", "(", "WO 2020/123456"]), max_size=40).map("".join)


@settings(max_examples=150, deadline=None)
@given(st.one_of(TEXT, LOOSE))
def test_pieces_lie_in_the_text_and_do_not_overlap(text):
    found = pii.pieces(text)
    assert all(0 <= a < b <= len(text) and k in pii.KINDS for k, a, b in found)
    assert all(x[2] <= y[1] for x, y in zip(found, found[1:]))
    if not found:
        assert pii.masked(text) == text


@settings(max_examples=150, deadline=None)
@given(st.one_of(TEXT, LOOSE))
def test_scanned_text_is_read_whole(text):
    tokens = ocr.tokens(text)
    lines = text.split("\n")
    assert all(0 <= line < len(lines) for line, *_ in tokens)
    rebuilt = ocr.rebuilt(text, {})
    kept = "".join(c for i, line in enumerate(lines) if not ocr.running(line) for c in line if c.isalnum())
    assert sorted(c for c in rebuilt if c.isalnum()) == sorted(kept)


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_scores_are_probabilities(texts):
    rng = np.random.default_rng(0)
    model = language_id.Model(rng.normal(size=(2**language_id.BITS, 9)).astype(np.float32), np.zeros(9), 1.0)
    log_p, weight = model.scores(texts)
    assert log_p.shape == (len(texts), 9) and np.allclose(np.exp(log_p).sum(axis=1), 1)
    alone = [model.scores([t]) for t in texts]
    assert all(np.allclose(a[0][0], b, atol=1e-3) and a[1][0] == w for a, b, w in zip(alone, log_p, weight))


@settings(max_examples=150, deadline=None)
@given(st.one_of(TEXT, LOOSE), st.one_of(st.none(), TEXT))
def test_names_and_addresses_are_read_without_error(text, country):
    for kind in ("P", "O", "?"):
        assert names.classified(names.raw_tokens(text), kind)[0] in ("P", "O")
    for reading in addresses.hypotheses(text, country):
        assert reading["street"] and reading["number"]


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=30))
def test_packs_hold_every_item_once(histogram):
    patterns = packing.plan(histogram, 64)
    placed: dict[int, int] = {}
    for pattern, n in patterns:
        assert sum(pattern) <= 64
        for length in pattern:
            placed[length] = placed.get(length, 0) + n
    assert placed == histogram
