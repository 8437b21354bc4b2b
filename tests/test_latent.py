"""Latent retrieval against numpy's SVD of the whole matrix on fixtures."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from quillstone.operators import dense, latent


def texts(n, seed, topics=6):
    rng = random.Random(seed)
    words = [[f"{chr(97 + t)}{rng.randrange(10**6)}" for _ in range(14)] for t in range(topics)]
    return [(i, " ".join(rng.choice(words[rng.choice([i % topics, i % topics, rng.randrange(topics)])]) for _ in range(rng.randint(3, 25)))) for i in range(n)]


def by_numpy(corpus, queries, components):
    """Unit coordinates of the queries, from the dense matrix and numpy's SVD."""
    grams = lambda t: Counter([t[i : i + 4] for i in range(len(t) - 3)] if len(t) >= 4 else [t] if t else [])
    docs = [grams("".join(t.split())) for _, t in corpus]
    df = Counter(g for d in docs for g in d)
    terms = {g: i for i, g in enumerate(sorted(df))}
    idf = {g: math.log(len(docs) / (1 + c)) + 1 for g, c in df.items()}

    def row(c):
        x, total = np.zeros(len(terms)), sum(c.values()) or 1
        for g, n in c.items():
            if g in terms:
                x[terms[g]] = n / total * idf[g]
        return x

    _, s, vt = np.linalg.svd(np.array([row(d) for d in docs]), full_matrices=False)
    kept = [i for i in range(min(components, len(s))) if s[i] > 1e-12]
    x = np.array([row(grams("".join(t.split()))) for _, t in queries]) @ (vt[kept].T / s[kept])
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300), s[kept]


@pytest.mark.parametrize("n,components,rows,cols,whole", [(50, 128, 4096, 16384, 1024), (50, 20, 16, 40, 1024), (160, 6, 64, 100, 30)])
def test_cosines_equal_numpy_svd(spark, monkeypatch, n, components, rows, cols, whole):
    monkeypatch.setattr(latent, "WHOLE", whole)
    monkeypatch.setattr(latent, "ROWS", rows)
    monkeypatch.setattr(latent, "COLS", cols)
    corpus = texts(n, 3)
    queries = texts(20, 4) + corpus[:15] + [(900, ""), (901, "zz"), (902, corpus[0][1] + " unseen words qqqq")]
    queries = [(1000 + i, t) for i, (_, t) in enumerate(queries)]
    space = latent.fit_latent(spark.createDataFrame(corpus, "doc_id long, text string"), components, rounds=60, tolerance=1e-13)
    want, values = by_numpy(corpus, queries, components)
    assert space.values == pytest.approx(values, rel=1e-9, abs=1e-12)
    got = {r.doc_id: r.vector for r in latent.coordinates(spark.createDataFrame(queries, "doc_id long, text string"), space).collect()}
    x = np.array([got[i] for i, _ in queries])
    assert np.abs(x @ x.T - want @ want.T).max() < 1e-6
    assert not x[35].any()


def test_no_grams(spark):
    assert latent.fit_latent(spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")) is None


def test_nearest_in_blocks_with_floor_and_nulls(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(90, 5)).round(1)
    rows = [(i, [float(c) for c in x]) for i, x in enumerate(v)] + [(90, None), (91, [0.0] * 5)]
    v = np.vstack([v, np.zeros((2, 5))])
    df = spark.createDataFrame(rows, "id long, v array<double>")
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    for block in (4096, 10):
        monkeypatch.setattr(dense, "BLOCK", block)
        got = sorted(tuple(r)[:3] for r in dense.nearest_dense(df.filter("id % 3 = 0"), df.filter("id % 3 = 1"), "id", "v", k=4, least=0.0).collect())
        want = []
        for q in range(0, 92, 3):
            s = {p: round(max(0.0, float(u[q] @ u[p])), 9) for p in range(1, 92, 3)}
            want += [(q, k, p) for k, p in enumerate(sorted(s, key=lambda p: (-s[p], p))[:4])]
        assert got == want
