"""Operator 10 finds isolated pairs at the threshold at any size of a label."""

import math

import numpy as np
import pytest

from cadenza.llm.vector_dedup import near_vectors, needed_passes

from . import cases

DIMS = 64


def isolated_pairs(n, low, high, seed=11):
    """2 n unit vectors; row n + k has with row k a cosine between low and high, and nothing else is close."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    a, other = unit(rng.normal(size=(n, DIMS))), rng.normal(size=(n, DIMS))
    aside = unit(other - (other * a).sum(1, keepdims=True) * a)
    cosine = rng.uniform(low, high, size=(n, 1))
    return np.concatenate([a, cosine * a + np.sqrt(1 - cosine**2) * aside])


def test_isolated_pairs_in_one_large_label(spark):
    # with a window of 2, 8000 vectors are as 256,000 with one of 64
    n = 4000
    x = isolated_pairs(n, 0.9302, 0.95)
    rows = [(k, v, 1, "id", "v", "part", "c") for k, v in enumerate(x.tolist())]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(spark.createDataFrame(rows, cases.VECTORS), window=2).collect()}
    assert len(got) == 2 * n
    found = sum(got[k] == (1, k, True) and got[n + k] == (1, k, False) for k in range(n))
    assert found >= 0.985 * n


@pytest.mark.parametrize("size", [1, 64, 1000, 100_000, 2_000_000, 10**9])
def test_passes_follow_the_size(size):
    once = (1 - math.acos(0.93) / math.pi) ** math.log2(max(size / 64, 1))
    k = needed_passes(size, 0.93, 64, 0.99)
    assert 1 - (1 - once) ** k >= 0.99 - 1e-9
