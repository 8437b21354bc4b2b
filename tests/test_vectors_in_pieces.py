"""Document vectors are weighed in pieces: no table has a row a posting, weights are those of plain Python, and the block join takes them as it takes postings."""

import math
from collections import Counter

import pytest

from quillstone.operators import blockjoin as B
from quillstone.operators import ngrams as N

ROWS = [(i, i % 2 == 0, "severalwordsofatext") for i in range(40)] + [
    (40, True, ""), (41, False, "ab"), (42, True, "ab\0cdab\0cd\0"), (43, False, "日本語の日本語の"), (44, True, "a😀b😀a😀b😀text"), (45, False, None), (46, True, "textofwords" * 3), (47, False, "ab")
]


def plain(rows):
    held = {i: Counter(t[k : k + 4] for k in range(len(t) - 3)) if len(t) > 3 else Counter([t] if t else []) for i, t in ((i, t or "") for i, _, t in rows)}
    df = Counter(g for c in held.values() for g in c)
    out = {}
    for i, c in held.items():
        w = {g: tf * (math.log(len(rows) / (1 + df[g])) + 1) for g, tf in c.items()}
        norm = math.sqrt(sum(x * x for x in w.values())) or 1.0
        if w:
            out[i] = sorted(round(x / norm, 12) for x in w.values())
    return out


@pytest.mark.parametrize("piece", [1, 60, 1 << 18])
def test_no_table_has_a_row_a_posting(spark, monkeypatch, piece):
    monkeypatch.setattr(N, "PIECE", piece)
    seen, cut = [], N.cut
    monkeypatch.setattr(N, "cut", lambda df, *a: seen.append(cut(df, *a)) or seen[-1])
    df = spark.createDataFrame(ROWS, "doc_id long, side boolean, text string")
    vec = N.document_vectors(df, keep=("side",))
    got = vec.collect()
    assert {r.doc_id: sorted(round(x, 12) for x in r.w) for r in got} == plain(ROWS)
    assert all(r.side == ROWS[r.doc_id][1] and len(set(r.gram)) == len(r.gram) for r in got)
    assert max(t.count() for t in seen) < sum(len(r.w) for r in got) / 5
    sides = [N.vectors(df).filter(c) for c in ("doc_id % 2 = 0", "doc_id % 2 = 1")]
    want = {(r.q, r.p): round(r.s, 9) for r in B.block_similarities(*sides).collect()}
    assert {(r.q, r.p): round(r.s, 9) for r in B.block_similarities(vec.filter("side"), vec.filter("not side")).collect()} == want
    assert B.block_similarities(vec.filter("doc_id < 0"), vec).count() == 0


def test_counts_of_repeated_ids_add_up(spark):
    df = spark.createDataFrame([(1, True, "abcab cab"), (1, False, "abca"), (2, False, "bcab")], "doc_id long, side boolean, text string")
    want = {}
    for r in N.vectors(df).collect():
        want.setdefault(r.doc_id, []).append(round(r.w, 12))
    got = N.document_vectors(df, keep=("side",)).collect()
    assert {r.doc_id: sorted(round(x, 12) for x in r.w) for r in got} == {i: sorted(w) for i, w in want.items()}
    assert sorted((r.doc_id, r.side) for r in got) == [(1, True), (2, False)]
