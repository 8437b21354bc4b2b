"""A task of the block joins holds one pair of blocks, whatever the tables' size, and the results stay those of plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.operators import blockjoin as B
from quillstone.operators import dense


def vectors(spark):
    rng = np.random.default_rng(4)
    v = np.round(rng.normal(size=(60, 5)), 1)
    v[7], v[20], v[33] = v[4], 0.0, v[4]
    return v, spark.createDataFrame([(i, [float(c) for c in x]) for i, x in enumerate(v)], "id long, v array<double>")


def test_a_task_of_the_posting_join_holds_one_pair_of_blocks(spark):
    vec = spark.range(90).select(F.col("id").alias("doc_id"), F.explode(F.array(F.lit("abcd"), F.concat(F.lit("g"), F.col("id") % 7))).alias("g"), F.lit(0.5).alias("w"))
    known = vec.select("g").distinct().withColumn("gram", F.monotonically_increasing_id())
    packed = B._packed(vec, known, "doc_id", 10, 90)
    pairs = packed.hint("shuffle_replicate_nl").crossJoin(packed.toDF(*[f"p_{c}" for c in packed.columns]))
    sizes = pairs.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(sizes) == 81 and max(sizes) == 1


@pytest.mark.parametrize("share,many,dense_columns", [(1.0, 0, 1), (0.0, 0, 3), (1.0, 1 << 30, 1)])
def test_tile_by_columns_by_gram_and_by_cell(monkeypatch, share, many, dense_columns):
    monkeypatch.setattr(B, "SHARE", share)
    monkeypatch.setattr(B, "MANY", many)
    monkeypatch.setattr(B, "DENSE", dense_columns)
    rng = np.random.default_rng(1)
    full = [np.where(rng.random((n, 12)) < 0.4, rng.random((n, 12)), 0.0) for n in (9, 6)]
    sides = []
    for x in full:
        g, d = np.nonzero(x.T)
        known, n = np.unique(g, return_counts=True)
        sides.append((known.astype(np.int64), n.astype(np.int32), d.astype(np.int32), x[d, g]))
    assert np.allclose(B.tile(sides[0], 9, sides[1], 6), full[0] @ full[1].T)


@pytest.mark.parametrize("k", [1, 4])
def test_dense_search_in_small_blocks_equals_numpy(spark, monkeypatch, k):
    monkeypatch.setattr(dense, "BLOCK", 8)
    monkeypatch.setattr(dense, "AT_ONCE", 3)
    v, df = vectors(spark)
    u = v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-300)
    base = np.arange(0, 60, 3)
    want = {}
    for q in range(60):
        if q % 3:
            s = np.round(u[base] @ u[q], 9)
            want[q] = [int(base[i]) for i in np.argsort(-s, kind="stable")[:k]]
    found = dense.nearest_dense(df.filter("id % 3 <> 0"), df.filter("id % 3 = 0"), "id", "v", k=k)
    assert "CartesianProduct" in found._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.q, r.rank)):
        got.setdefault(r.q, []).append(r.p)
    assert got == want
