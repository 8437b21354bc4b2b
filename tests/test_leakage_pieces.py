"""Terms of the leakage audit are counted where the texts are: a piece gives one row a term and label, and small pieces give the same findings."""

from collections import Counter

from pyspark.sql import functions as F

from quillstone.operators import leakage as L


def test_equal_texts_give_one_row_a_term_and_label(spark):
    rows = spark.range(500).coalesce(1).select("id", F.lit("ab ab\0c").alias("text"), F.when(F.col("id") % 5 == 0, "u").otherwise("v").alias("label"))
    got = {(r.term, r.label): (r.hits, r.first) for r in L._postings(rows, (2, 3)).collect()}
    want = {(t, label): (n, first) for t in ("ab", "ba", "b\0", "\0c", "aba", "bab", "ab\0", "b\0c") for label, n, first in (("u", 100, 0), ("v", 400, 1))}
    assert got == want and L._postings(rows, (2, 3)).count() == len(want)


def test_small_pieces_find_the_same(spark, monkeypatch):
    rows = [(i, "abcd" * (i % 4) + "né\U0001f600"[: i % 3 + 1] * 2, "uv"[i % 7 < 3]) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string")
    whole = sorted(map(tuple, L.leakage(df).collect()))
    monkeypatch.setattr(L, "PIECE", 7)
    assert sorted(map(tuple, L.leakage(df).collect())) == whole and whole
    hits = Counter((t[k : k + 2], label) for _, t, label in rows for k in {t.find(t[j : j + 2]) for j in range(len(t) - 1)})
    got = {(r.term, r.label): r.n for r in L._postings(df.withColumnRenamed("doc_id", "id"), (2,)).groupBy("term", "label").agg(F.sum("hits").alias("n")).collect()}
    assert got == dict(hits)
