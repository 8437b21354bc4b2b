"""Gram sets against their SQL on texts that are short, empty, null, or hold zero-width spaces."""

import duckdb
import pytest
from pyspark.sql import Row

from quillstone.plans.retrieval_queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def odd_tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    texts = {1: "", 2: None, 3: "ab", 4: " a\tb ", 5: "abcabc", 6: "ab​cd﻿e", 7: "a b\nc d e f g", 8: "\U0001f600\U0001f601\U0001f602x"}
    docs = [Row(doc_id=i, text=t, lang="en", source="web", n_chars=len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in texts], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{d}/labels.parquet")
    return d


def test_gram_sets_of_odd_texts_equal_their_sql(spark, odd_tables):
    db = duckdb.connect()
    for t in ("documents", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{odd_tables}/{t}.parquet/*.parquet')")
    want = sorted(db.execute(ORACLES["v2_gram_sets"]).fetchall())
    assert sorted(tuple(r) for r in QUERIES["v2_gram_sets"](spark, odd_tables).collect()) == want
    assert {r[0] for r in want} == {5, 6, 7, 8}


def test_grams_of_a_text_are_counted_without_making_them(spark):
    """Counts equal plain sets, and no array of n-grams is built in the plan."""
    import random

    from pyspark.sql import functions as F

    from quillstone.operators import ngrams as N

    rng = random.Random(1)
    texts = ["".join(rng.choice("ab c𝒳日") for _ in range(rng.randrange(0, 14))) for _ in range(200)] + ["x" * 5000, "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    flat = {r.doc_id: r.t or "" for r in df.select("doc_id", N.normalize_grams(F.col("text")).alias("t")).collect()}
    for sizes in ((3, 4, 5, 6), (1, 2), (2, 5), (4,)):
        found = N.gram_set_sizes(df, sizes)
        assert "transform" not in found._jdf.queryExecution().optimizedPlan().toString() and "zip_with" not in found._jdf.queryExecution().optimizedPlan().toString()
        want = {i: sum(len({t[k : k + n] for k in range(len(t) - n + 1)}) for n in sizes) for i, t in flat.items()}
        assert {r.doc_id: r.grams for r in found.collect()} == want
