"""Loopy message passing of the personal-data field against sums over all labellings."""

import numpy as np
import pytest

from plumbline.llm import pii


@pytest.mark.parametrize("seed", range(6))
def test_messages_in_loops_come_near_the_exact_sums(seed):
    """Cycles with chords, as repeated tokens make them: what all labellings sum up to, and the surest label of each node."""
    rng = np.random.default_rng(seed)
    n, k = 7, 3
    edges = np.array([(i, (i + 1) % n) for i in range(n)] + [(0, 3), (2, 5)])
    unary = rng.normal(size=(n, k)) * 1.5
    pots = np.array([np.eye(k) * rng.uniform(0.1, 0.5) for _ in edges])  # equal labels are likelier, as skip edges make them
    total = np.zeros((n, k))
    for x in np.ndindex(*[k] * n):
        w = np.exp(sum(unary[i, x[i]] for i in range(n)) + sum(pots[e, x[a], x[b]] for e, (a, b) in enumerate(edges)))
        for i in range(n):
            total[i, x[i]] += w
    exact = total / total.sum(1, keepdims=True)
    got = pii.marginals(unary, edges, pots)
    assert np.abs(got - exact).max() < 0.06
    sure = np.sort(exact, 1)[:, -1] - np.sort(exact, 1)[:, -2] > 0.12
    assert (got.argmax(1) == exact.argmax(1))[sure].all() and sure.sum() >= 3
