"""The block join against the gram join, whatever the blocks; ties, eras, single grams and empty sides."""

import random

import pytest
from pyspark.sql import functions as F

from quillstone.operators import blockjoin as B
from quillstone.operators import ngrams as N


@pytest.fixture(scope="module")
def vec(spark):
    rng = random.Random(2)
    words = ["abcd", "bcde", "xy", "zzzz", "qrst", "common", "rare"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 9)))) for i in range(70)] + [(70, None), (71, "abcd"), (72, "abcd")]
    return N.vectors(spark.createDataFrame(rows, "doc_id long, text string"))


def key(rows):
    return {(r.q, r.p): round(r.s, 9) for r in rows}


def sides(vec):
    return vec.filter("doc_id % 3 <> 0"), vec.filter("doc_id % 3 = 0")


@pytest.mark.parametrize("rows,at_once", [(512, 1 << 21), (7, 5)])
def test_equals_the_gram_join(spark, vec, monkeypatch, rows, at_once):
    monkeypatch.setattr(B, "ROWS", rows)
    monkeypatch.setattr(B, "AT_ONCE", at_once)
    a, b = sides(vec)
    want = key(N.similarities(a, b).collect())
    assert key(B.block_similarities(a, b).collect()) == want
    assert key(B.block_similarities(a, b, least=0.4).collect()) == {x: s for x, s in want.items() if s >= 0.4}
    docs = [vec.select("doc_id").distinct().filter(c) for c in ("doc_id % 3 <> 0", "doc_id % 3 = 0")]
    for k in (1, 4):
        top = [sorted(tuple(r)[:3] for r in N.top_k(s, *docs, k).collect()) for s in (B.block_similarities(a, b, k=k), N.similarities(a, b))]
        assert top[0] == top[1]
    own = key(B.block_similarities(vec, vec, apart=True).collect())
    assert own == {x: s for x, s in key(N.similarities(vec, vec).collect()).items() if x[0] != x[1]}


def test_older_only(spark, vec):
    a, b = (v.withColumn("era", F.when(F.col("doc_id") != 4, F.col("doc_id") % 5)) for v in sides(vec))
    got = key(B.block_similarities(a, b, older=True).collect())
    assert got == {x: s for x, s in key(N.similarities(a, b).collect()).items() if x[0] != 4 and x[1] != 4 and x[1] % 5 < x[0] % 5}


def test_empty_sides(spark, vec):
    none = vec.limit(0)
    assert B.block_similarities(none, vec).count() == B.block_similarities(vec, none).count() == 0


@pytest.mark.parametrize("text", ["", "a", "abc", "abcd", "abcdabcd", "日本語の日本語の", "a😀b😀a😀b😀", "ab\0cdab\0cd\0", "x" * 5000, "Müller Müller"])
def test_grams_of_a_text(text):
    from collections import Counter

    want = Counter(text[i : i + 4] for i in range(len(text) - 3)) if len(text) >= 4 else Counter([text] if text else [])
    g, tf = N.grams_of(text)
    assert dict(zip((str(x) for x in g), tf.tolist())) == want


def test_counts_equal_exploded_grams_also_for_repeated_ids(spark):
    rows = [(1, "abcab cab"), (1, "abca"), (2, None), (3, "é日 日é日日"), (None, "abcdef")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plain = df.select("doc_id", F.explode(N.four_grams(F.col("text"))).alias("g")).groupBy("doc_id", "g").agg(F.count(F.lit(1)).alias("tf"))
    assert sorted(map(str, N.counts(df).collect())) == sorted(map(str, plain.collect()))
