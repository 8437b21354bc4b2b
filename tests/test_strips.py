"""A task of the posting join streams a strip of the base past one block of queries and hands on k rows a query; wide rows are written in small row groups."""

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillstone import session
from quillstone.operators import blockjoin as B
from quillstone.operators import ngrams as N


@pytest.mark.parametrize("rows,strip,strips", [(4, 100, 1), (4, 5, 4), (40, 1, 2)])
def test_rows_a_query_grow_with_strips_and_not_with_blocks(spark, monkeypatch, rows, strip, strips):
    monkeypatch.setattr(B, "ROWS", rows)
    monkeypatch.setattr(B, "LEAST_ROWS", 1)
    monkeypatch.setattr(B, "STRIP", strip, raising=False)
    words = ["abcde", "bcdef", "xyxyx", "zzzz", "qrstu", "common"]
    texts = [(i, " ".join(words[(i * k) % 6] for k in range(1 + i % 5))) for i in range(80)]
    vec = N.vectors(spark.createDataFrame(texts, "doc_id long, text string"))
    found = B.block_similarities(vec, vec, k=3, apart=True)
    assert found.groupBy("q").count().agg(F.max("count")).first()[0] <= 3 * max(strips, 12 // -(-80 // rows))
    docs = vec.select("doc_id").distinct()
    plain = N.similarities(vec, vec).filter("q <> p")
    got, want = (sorted((r.q, r.rank, r.p, round(r.s, 9)) for r in N.top_k(x, docs, docs, 3).collect()) for x in (found, plain))
    assert got == want


def test_wide_rows_have_small_row_groups(spark, monkeypatch):
    monkeypatch.setattr(session, "WIDE", 1 << 20)
    rows = spark.range(60).coalesce(1).select("id", F.concat(*[F.sha2(F.concat("id", F.lit(f"-{k}")).cast("binary"), 512) for k in range(1000)]).cast("binary").alias("v"))
    held = session.cut(rows, None, True)
    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata.row_group(i).total_byte_size for f in held.inputFiles() for i in range(pq.ParquetFile(f.removeprefix("file://")).metadata.num_row_groups)]
    assert len(groups) > 4 and max(groups) < 3 << 20
    assert held.count() == 60 and held.select(F.sum(F.length("v"))).first()[0] == 60 * 128000
