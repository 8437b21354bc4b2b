"""Exact and near dedup on large groups against brute force, and their defined results for odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from quillstone.llm import common, exact_dedup, minhash

DOCS = "doc_id long, text string"


def words(rng, n):
    return " ".join(f"w{rng.randrange(3000)}" for _ in range(n))


def brute(texts, n, percent):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def test_groups_larger_than_a_block_match_brute_force(spark, monkeypatch):
    """Chains of edits in one group: blocks of few members, so that pairs of blocks are compared."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rng = random.Random(5)
    texts = []
    for _ in range(3):
        w = words(rng, 90).split()
        for _ in range(26):
            w = list(w)
            for _ in range(rng.choice([1, 2, 3])):
                w[rng.randrange(len(w))] = f"z{rng.randrange(9)}"
            texts.append(" ".join(w))
    texts += [None, "", "a b", "A b", " ".join(["same"] * 30_000), " ".join(["same"] * 20_000)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    df = spark.createDataFrame([(i, texts[i]) for i in order], DOCS).withColumn("cls", F.lit(1)).withColumn("id", F.lit(1))
    for n, percent in ((3, 85), (5, 80)):
        out = {r.doc_id: r for r in minhash.near_duplicates(df, ngram=n, percent=percent).collect()}
        root, size = brute(texts, n, percent)
        assert [out[i].component_id for i in range(len(texts))] == root and [out[i].n_shingles for i in range(len(texts))] == size


def test_near_dedup_of_odd_rows(spark):
    rng = random.Random(2)
    a, b = words(rng, 50), words(rng, 50)
    df = spark.createDataFrame([(1, a), (1, b), (2, a + " tail"), (2, b), (None, a), (None, "lone words of their own here"), (3, None), (3, "")], DOCS).withColumn("row", F.lit(1)).withColumn("key", F.lit(1))
    kept = minhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(1, a), (1, b), (0, "lone words of their own here"), (3, ""), (3, "")])
    assert minhash.near_duplicates(df.limit(0)).count() == 0 and minhash.drop_near_duplicates(df.limit(0)).count() == 0


def test_exact_dedup_of_odd_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "c"), (2, "ab"), (2, "c  c"), (None, "cc"), (None, "ab  "), (None, "lone"), (4, None), (5, "")] + [(9, "hot")] * 400, DOCS).withColumn("h", F.lit("x")).withColumn("row", F.lit("x"))
    kept = exact_dedup.drop_copies(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, "ab  "), (0, "lone"), (1, "c"), (2, "c  c"), (4, ""), (9, "hot")]
    out = exact_dedup.exact_groups(df).collect()
    assert len(out) == 409 and {(r.keep_id, r.group_size) for r in out if r.doc_id == 9} == {(9, 400)}


def test_texts_that_share_an_md5_stay_apart(spark, monkeypatch):
    """With a hash of one value for all texts the second digest and the bytes decide."""
    monkeypatch.setattr(exact_dedup.F, "md5", lambda c: F.lit("00"))
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a "), (4, None), (5, " ")], DOCS)
    assert {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_groups(df).collect()} == {1: (3, 2), 2: (2, 1), 3: (3, 2), 4: (5, 2), 5: (5, 2)}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_stars_and_chains(spark, seed):
    rng = random.Random(seed)
    edges = [(0, i) for i in range(1, 900)] + [(i, i + 1) for i in range(2000, 2040)] + [(rng.randrange(3000, 3200), rng.randrange(3000, 3200)) for _ in range(150)] + [(5, 5)]
    rng.shuffle(edges)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.comp for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
