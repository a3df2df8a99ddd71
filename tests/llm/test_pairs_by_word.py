"""Operator 3 looks up a word's contexts once for each distinct word, not at each of its bytes."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from sparkclean.llm import context_mixing as m

TEXTS = ["", None, "a", "A b", "ab  \t", " ", "Über\u0085 日本\x0b\x0cHello", "the the the", "x y z w v"]


def test_words_of_a_column_are_those_of_its_texts():
    column = pa.array([*TEXTS, "cut off"]).slice(1, len(TEXTS) - 1)
    words, edges = m.words_of(column)
    want = [m.tokens(t) for t in TEXTS[1:]]
    assert [words.to_pylist()[a:b] for a, b in zip(edges, edges[1:])] == want
    assert m.normal(words, edges) == [b" ".join(w) for w in want]


def test_pairs_are_found_by_word():
    rng = random.Random(4)
    known = ["".join(rng.choices("abcdefg", k=rng.randint(1, 12))) for _ in range(60)]
    texts = [b" ".join(m.tokens(t)) for t in [*TEXTS, *(" ".join(rng.choices(known, k=rng.randint(0, 80))) for _ in range(60)), ""]]
    learnt = [rng.random() < 0.8 for _ in texts]
    pairs = m.Pairs(texts, learnt)
    grams, prefixes, sizes = m.contexts(texts)
    want: dict = {}
    for key in zip(grams.tolist(), prefixes.tolist(), np.repeat(learnt, sizes).tolist()):
        want[key] = want.get(key, 0) + 1
    assert list(zip(pairs.grams.tolist(), pairs.prefixes.tolist())) == [k[:2] for k in want] and pairs.sizes.tolist() == sizes.tolist()
    assert pairs.times.tolist() == [n if k[2] else 0 for k, n in want.items()]
    costs = np.random.default_rng(1).random(len(want))
    by_key, ends = dict(zip(want, costs)), np.cumsum(sizes)
    keys = list(zip(grams.tolist(), prefixes.tolist(), np.repeat(learnt, sizes).tolist()))
    assert np.allclose(pairs.by_text(costs), [sum(by_key[k] for k in keys[b - n : b]) for b, n in zip(ends, sizes)], rtol=1e-12)
    again = m.Pairs(texts * 4, learnt * 4)  # no more places to look up, however often the words come
    assert len(again.number) == len(pairs.number) and (again.times == 4 * pairs.times).all()
