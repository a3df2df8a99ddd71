"""Operator 8 compares the orders of many queries and vectors in one product."""

from __future__ import annotations

import math

import numpy as np
import pytest

from sparkclean.llm import permutation_index


def random_vectors(spark, n):
    e = np.random.default_rng(5).normal(size=(n, 64)).astype(np.float32)
    e /= np.linalg.norm(e, axis=1)[:, None]
    return e.astype(np.float64), spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(e)], "vec_id long, embedding array<float>")


@pytest.mark.parametrize("by_root", [5.0, 15.0])  # 274 pivots; 822, of which 512 are put in order
def test_the_best_stand_first_by_their_orders(spark, by_root):
    e, df = random_vectors(spark, 3000)
    hits, queries = 0, range(0, 3000, 20)
    rows = permutation_index.nearest(df.coalesce(1), by_root=by_root, read=1000.0, share=0.05).collect()
    assert len(rows) == 20 * len(queries)
    for q in queries:
        s = e @ e[q]
        s[q] = -np.inf
        found = [(r.vec_id, r.score) for r in rows if r.query_id == q]
        assert all(math.isclose(score, s[v], rel_tol=1e-12) for v, score in found)
        hits += len({v for v, _ in found} & set(np.argsort(-s)[:20].tolist()))
    assert hits >= 0.95 * 20 * len(queries)


def test_orders_agree_by_the_pivots_that_both_hold():
    rng = np.random.default_rng(2)
    a, b = (np.array([rng.permutation(30)[:7] for _ in range(n)], np.int16) for n in (5, 4))
    got = permutation_index.weights(a, 30) @ permutation_index.weights(b, 30).T
    want = [[sum(math.sqrt((7 - i) * (7 - j)) for i, p in enumerate(x) for j, r in enumerate(y) if p == r) for y in b] for x in a]
    assert np.allclose(got, want, rtol=1e-6)
