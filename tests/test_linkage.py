"""Average linkage by chains of nearest neighbours against merging the closest pair, one after the other."""

import time

import numpy as np

from graphtide.operators.redundancy import average_linkage


def greedy(vectors, threshold):
    unit = vectors / np.maximum(np.sqrt((vectors * vectors).sum(1, keepdims=True)), 1e-12)
    each = np.round(1 - unit @ unit.T, 9)
    clusters = [[i] for i in range(len(vectors))]
    while len(clusters) > 1:
        low, a, b = min((each[np.ix_(x, y)].mean(), i, j) for i, x in enumerate(clusters) for j, y in enumerate(clusters[:i]))
        if not low < threshold:
            break
        clusters[b] += clusters.pop(a)
    out = np.zeros(len(vectors), int)
    for c in clusters:
        out[c] = min(c)
    return np.unique(out, return_inverse=True)[1]


def test_equals_merging_the_closest_pair():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 10, 40):
        for threshold in (0.0, 0.05, 0.25, 0.6, 2.5):
            centres = rng.normal(size=(max(1, n // 4), 5))
            vectors = centres[rng.integers(len(centres), size=n)] + 0.3 * rng.normal(size=(n, 5))
            if n > 3:
                vectors[1], vectors[3] = vectors[0], 2 * vectors[0]  # equal directions
            assert average_linkage(vectors, threshold).tolist() == greedy(vectors, threshold).tolist(), (n, threshold)


def test_many_near_vectors():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(50, 32))
    of = rng.integers(50, size=6000)
    began = time.time()
    got = average_linkage(centres[of] + 0.05 * rng.normal(size=(6000, 32)), 0.2)
    assert len(set(zip(got, of))) == 50 == len(set(got)) and time.time() - began < 60
