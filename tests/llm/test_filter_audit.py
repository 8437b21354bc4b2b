"""Filter audit: every order by brute force, the sketch without false clearances, defined results for odd rows."""

import random
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import filter_audit as A

DOCS = "doc_id long, text string, source string, n string"
LABELS = "doc_id long, quality int, toxic int"


def world():
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["Ab", "cd", "e#f", "gh", "IJ", f"w{rng.randrange(400)}"]) for _ in range(n)) for n in (0, 1, 49, 50, 51, 80, 200, 60, 55)]
    texts += ["  ", "x" * 300, " ".join(f"w{i}" for i in range(70)), " ".join(f"w{i}" for i in range(30_000)), None, ""]
    rows = [(i, rng.choice(texts), rng.choice(["a", "a", "a", "b", "", None]), "x") for i in range(160)]
    rows += [(None, texts[5], "a", None), (None, texts[5], "b", None), (3, rows[3][1], "a", None), (3, "another text", "b", None), (200, None, None, None)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 160, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    return rows, labels


def brute(rows, labels):
    fails = []
    for i, text, part, _ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        f["E"] = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _, _ in rows)
        good, toxic = (any(j == i and i is not None and r[k] == 1 for j, *r in labels) for k in (0, 1))
        fails.append((part or "", {x for x in f if f[x]}, good, toxic))
    out = {}
    for part in {p for p, *_ in fails}:
        own = [x for x in fails if x[0] == part]
        removed = {x: 0 for x in "ABCDE"}
        for order in permutations("ABCDE"):
            for k, x in enumerate(order):
                before = set(order[:k])
                gone = [r for r in own if not r[1] & before and x in r[1]]
                removed[x] += len(gone)
                out[part, "".join(order), k + 1] = [
                    sum(not r[1] & (before | {x}) for r in own), len(gone), sum(bool(r[1] & before) and x in r[1] for r in own), sum(r[1] == {x} for r in own),
                    sum(r[2] for r in gone), sum(r[3] for r in gone),
                ]
        for (p, order, k), v in out.items():
            if p == part:
                v.append(removed[order[k - 1]])
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("most_cells", [A.MOST_CELLS, 1024])
def test_all_orders_equal_brute_force(spark, most_cells):
    rows, labels = world()
    docs = spark.createDataFrame(rows, DOCS)
    got = A.filter_interactions(docs, spark.createDataFrame(labels, LABELS), most_cells=most_cells).collect()
    assert {tuple(r[:3]): tuple(r[3:]) for r in got} == brute(rows, labels)
    assert len(got) == len({tuple(r[:3]) for r in got})


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert A.filter_interactions(docs, labels).count() == 0
    one = A.filter_interactions(spark.createDataFrame([(1, None, None, None)], DOCS), labels)
    assert one.count() == 600 and one.agg(F.max("removed")).first()[0] == 1


@pytest.mark.parametrize("bits,hashes", [(10, 4), (20, 2), (22, 4)])
def test_the_merged_sketch_never_clears_a_repeat(spark, bits, hashes):
    digests = np.random.default_rng(2).integers(-(2**63), 2**63, 3000)
    all_ = np.concatenate([digests, digests[:200], digests[:50]])
    df = spark.createDataFrame([(int(x),) for x in all_], "digest long").repartition(7)
    held = np.unpackbits(A.sketch_of(df, bits, hashes))
    flag = held[A._cells(digests, bits, hashes)].all(axis=0)
    assert flag[:200].all()
    want = np.bincount(A._cells(all_, bits, hashes).ravel().astype(np.int64), minlength=1 << bits)
    assert ((want > 1) == held[: 1 << bits].astype(bool)).all()
    if bits > 20:
        assert flag[200:].mean() < 0.01  # and most unique digests are cleared


def test_a_unique_text_is_not_shuffled(spark):
    digests = spark.range(5000).select(F.xxhash64("id").alias("digest"))
    again = A.may_repeat(digests, 5000)
    assert digests.filter(again(F.col("digest"))).count() < 50
