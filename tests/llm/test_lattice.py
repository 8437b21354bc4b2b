"""Embedding links against brute force: whole cells, blocks, crowded cells parted anew, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import lattice

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows):
    u = np.array([r[1] for r in rows], np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = (u @ u.T >= 0.98) & np.equal.outer([r[2] for r in rows], [r[2] for r in rows])
    np.fill_diagonal(link, False)
    root = np.arange(len(rows))
    while True:
        new = np.minimum(root, np.where(link, root[None], len(rows)).min(axis=1))
        if (new == root).all():
            return link, root
        root = new


def clouds(rng, n, dim, each):
    """Vectors around n centres, as far apart as decides links, and strangers."""
    centre = rng.normal(size=(n, dim))
    v = np.concatenate([centre + s * rng.normal(size=centre.shape) for s in (0, 0.05, *[0.1] * each, *[0.13] * each)] + [rng.normal(size=(4 * n, dim)), centre[:5]])
    return [(i, [float(np.float32(x)) for x in e], int(i % n) % 3) for i, e in enumerate(v)]


def test_nearest_points_are_nearest():
    y = np.random.default_rng(0).normal(size=(300, 8)) * 1.5
    p = lattice.nearest_e8(y)
    assert ((2 * p) % 1 == 0).all() and (p.sum(axis=1) % 2 == 0).all() and (np.ptp((2 * p) % 2, axis=1) == 0).all()
    near = p[:, None, :] + lattice.minimal_vectors()[None]
    assert (((y - p) ** 2).sum(axis=1) <= ((y[:, None] - near) ** 2).sum(axis=2).min(axis=1) + 1e-9).all()


@pytest.mark.parametrize("options", [{}, {"block": 16}, {"crowd": 20, "block": 8}, {"crowd": 3, "levels": 2, "tables": 10}])
def test_links_match_brute_force(spark, options):
    rows = clouds(np.random.default_rng(3), 40, 16, 4)
    link, root = brute(rows)
    out = {r.vec_id: r for r in lattice.embedding_links(spark.createDataFrame(rows, VECTORS).repartition(3), **options).collect()}
    got = np.array([out[i].n_links for i in range(len(rows))])
    assert link.sum() > 200 and (got <= link.sum(axis=1)).all()
    recall = got.sum() / link.sum()
    assert recall == 1 if "crowd" not in options else recall >= 0.99
    if recall == 1:
        assert [out[i].component_id for i in range(len(rows))] == root.tolist()


def test_one_dense_group_and_many_copies(spark):
    """Hundreds of vectors near one another and a third of all rows equal: every link is counted once."""
    rng = np.random.default_rng(4)
    centre = rng.normal(size=24)
    v = [centre + 0.03 * rng.normal(size=24) for _ in range(300)] + [centre * 1.0] * 200 + [rng.normal(size=24) for _ in range(100)]
    rows = [(i, [float(np.float32(x)) for x in e], 1) for i, e in enumerate(v)]
    link, root = brute(rows)
    for options in ({"block": 32}, {"block": 32, "crowd": 64, "levels": 3}):
        out = {r.vec_id: r for r in lattice.embedding_links(spark.createDataFrame(rows, VECTORS), **options).collect()}
        assert [out[i].n_links for i in range(600)] == link.sum(axis=1).tolist() and [out[i].component_id for i in range(600)] == root.tolist()


def test_odd_rows(spark):
    good = [1.0, 0.5, 0.25, 0.0]
    rows = [(1, good, 1), (1, good, 1), (2, [2 * x for x in good], 1), (3, good, None), (4, None, 1), (5, [0.0] * 4, 1), (6, [float("nan")] * 4, 1), (7, [None] * 4, 1), (8, [], 1), (9, [1.0, 0.5], 1), (None, good, 1), (10, [1e-30] * 4, 2), (11, [1e30] * 4, 2)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("cell", F.lit(1)).withColumn("node", F.lit(1))
    out = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in lattice.embedding_links(df).collect())
    assert out == [(0, 3, 1, False), (1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), *[(i, 0, i, True) for i in range(3, 10)], (10, 1, 10, True), (11, 1, 10, False)]
    assert lattice.embedding_links(df.limit(0)).count() == 0
    texts = df.withColumn("label", F.concat(F.lit("l"), "label"))
    assert {r.vec_id: r.n_links for r in lattice.embedding_links(texts).filter("vec_id > 1").collect()} == {2: 3, 3: 0, 4: 0, 5: 0, 6: 0, 7: 0, 8: 0, 9: 0, 10: 1, 11: 1}


@pytest.mark.parametrize("options", [{}, {"crowd": 3, "levels": 2, "tables": 1, "probes": 1, "block": 16}])
def test_no_link_is_left_to_chance(spark, options):
    """Pairs just within the limit in a crowd of strangers, where vectors that met in shared cells only missed some."""
    rng = np.random.default_rng(11)
    centre = rng.normal(size=(500, 24))
    centre /= np.linalg.norm(centre, axis=1, keepdims=True)
    side = rng.normal(size=centre.shape)
    side -= (side * centre).sum(axis=1, keepdims=True) * centre
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    v = np.concatenate([centre, 0.9801 * centre + np.sqrt(1 - 0.9801**2) * side])
    rows = [(i, [float(np.float32(x)) for x in e], 1) for i, e in enumerate(v)]
    link, root = brute(rows)
    out = {r.vec_id: r for r in lattice.embedding_links(spark.createDataFrame(rows, VECTORS), **options).collect()}
    assert [out[i].n_links for i in range(len(rows))] == link.sum(axis=1).tolist() and link.sum() >= 1000
    assert [out[i].component_id for i in range(len(rows))] == root.tolist()


def test_strips_and_tiles_that_can_hold_no_link(spark, monkeypatch):
    """Several strips a label, tiles far apart passed over, lengths and labels of their own: the links are those of brute force."""
    monkeypatch.setattr(lattice, "STRIP", 50)
    rng = np.random.default_rng(12)
    centre = np.eye(12)[:6]
    v = np.concatenate([centre + 0.06 * rng.normal(size=centre.shape) for _ in range(60)])
    rows = [(i, [float(np.float32(x)) for x in e], i % 2) for i, e in enumerate(v)]
    link, root = brute(rows)
    seen = []
    monkeypatch.setattr(lattice, "_linked", lambda a, b, *rest, whole=lattice._linked: seen.append(len(a) * len(b)) or whole(a, b, *rest))
    out = {r.vec_id: r for r in lattice.embedding_links(spark.createDataFrame(rows, VECTORS), block=8).collect()}
    assert [out[i].n_links for i in range(len(rows))] == link.sum(axis=1).tolist() and [out[i].component_id for i in range(len(rows))] == root.tolist()
    side, w = np.zeros(180, np.int32), np.ones(180, np.int64)
    one = v[::2].astype(np.float32)
    keys = lattice.Lattice(12, 2, 3, 2.5, 5).keys(lattice._units(one.astype(np.float64)), np.zeros(180, np.int64))
    seen.clear()
    ((rows_, total, _),) = lattice._pairs(side, w, one, keys, 0.98, 8)
    assert sum(seen) < 180 * 180 / 2
    want = link[::2, ::2].sum(axis=1)
    assert dict(zip(rows_.tolist(), total.tolist())) == {i: n for i, n in enumerate(want.tolist()) if n}
