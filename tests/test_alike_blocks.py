"""Blocks of documents that are alike, and pairs of blocks met once for both sides: other work, the same results."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.operators import blockjoin as B
from quillstone.operators import ngrams as N


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(6)
    words = {"x": ["abcd", "bcde", "cdef"], "y": ["mnop", "nopq", "opqr"], "z": ["stuv"], None: ["wxyz"]}
    rows = [(i, " ".join(rng.choice(words[lang] + ["abcd"]) for _ in range(rng.randint(1, 9))), lang) for i in range(120) for lang in ["z" if i % 40 == 0 else None if i % 39 == 0 else "xy"[i % 2]]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def key(rows):
    return {(r.q, r.p): round(r.s, 9) for r in rows}


def test_blocks_hold_documents_that_are_alike(spark, docs):
    vec = N.document_vectors(docs, keep=("lang",))
    lang = {r.doc_id: r.lang for r in docs.collect()}
    packed, many = B._blocks(vec, None, "doc_id", 16, 120, "lang")
    held = [[lang[i] for i in np.frombuffer(r.ids, np.int64).tolist()] for r in packed.collect()]
    assert sum(map(len, held)) == 120 and len(held) <= many
    assert all(len(set(x)) == 1 for x in held if "x" in x or "y" in x) and any({"z", None} == set(x) for x in held)  # few of a kind share one


@pytest.mark.parametrize("many", [1, 2, 5, 8])
def test_two_blocks_meet_once(spark, many):
    pairs = spark.range(many).select(F.col("id").cast("int").alias("b")).crossJoin(spark.range(many).select(F.col("id").cast("int").alias("q_b")))
    met = [(r.q_b, r.b) for r in pairs.filter(B._once(many)).collect()]
    assert len(met) == many * (many + 1) // 2 and {tuple(sorted(x)) for x in met} == {(i, j) for i in range(many) for j in range(i, many)}
    each = [sum(q == i for q, _ in met) for i in range(many)]
    assert max(each) - min(each) <= 1


@pytest.mark.parametrize("rows", [7, 2048])
def test_results_are_those_of_the_gram_join(spark, docs, monkeypatch, rows):
    monkeypatch.setattr(B, "ROWS", rows)
    monkeypatch.setattr(B, "LEAST_ROWS", 1)
    vec = N.document_vectors(docs, keep=("lang",))
    plain = N.similarities(*[N.vectors(docs)] * 2)
    want = key(plain.filter("q <> p").collect())
    assert key(B.block_similarities(vec, vec, apart=True, alike="lang").collect()) == want
    assert key(B.block_similarities(vec, vec, least=0.55, apart=True, alike="lang").collect()) == {x: s for x, s in want.items() if s >= 0.55}
    for k, own in ((1, True), (4, True), (4, False)):
        queries, base = (vec, vec) if own else (vec.filter("doc_id % 3 <> 0"), vec.filter("doc_id % 3 = 0"))
        sims = plain.filter("q <> p") if own else plain.filter("q % 3 <> 0 and p % 3 = 0")
        found = B.block_similarities(queries, base, k=k, apart=True, alike="lang")
        ids = [x.select("doc_id") for x in (queries, base)]
        got, asked = (sorted((r.q, r.rank, r.p, round(r.s, 9)) for r in N.top_k(x, *ids, k, lone=False).collect()) for x in (found, sims))
        assert got == asked


def test_only_results_of_a_tile_are_handled(spark, docs, monkeypatch):
    """With a threshold a tile is neither clipped nor ranked; scores above 1 by rounding come out as 1, and each pair is a row for both sides."""
    monkeypatch.setattr(B, "ROWS", 9)
    monkeypatch.setattr(B, "LEAST_ROWS", 1)
    monkeypatch.setattr(np, "clip", lambda *a, **k: (_ for _ in ()).throw(AssertionError("the whole tile is clipped")))
    monkeypatch.setattr(B, "merged", None)
    monkeypatch.setattr(B, "tile", lambda a, n, b, m, whole=B.tile: whole(a, n, b, m) * (1 + 1e-12))
    vec = N.vectors(docs)
    found = B.block_similarities(vec, vec, least=0.9, apart=True).collect()
    plain = key(N.similarities(vec, vec).filter("q <> p and s >= 0.9").collect())
    assert key(found) == plain and len(found) == len(plain) and max(r.s for r in found) == 1.0
