"""Co-training: features and odds against plain Python, independence of batches, defined results for odd rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import cotraining as C

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def junk(rng, n):
    return " ".join(f"W{rng.randrange(500)}!!" for _ in range(n))


def plain(rng, n):
    return " ".join(f"w{rng.randrange(500)}" for _ in range(n))


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(7)
    good = [i % 3 > 0 for i in range(240)]
    rows = [(i, (plain if g else junk)(rng, rng.randint(5, 60)), "en", "fine" if g else "poor", 400 if g else 9000) for i, g in enumerate(good)]
    rows += [(240, None, None, None, None), (241, "", "en", "fine", 0), (242, plain(rng, 40_000), "en", "fine", 400)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(good[i]), 0) for i in range(120)] + [(7, None, 0), (9_999, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    return docs, labels, good, rows


def test_trigrams_stay_within_their_text():
    texts = [b"", b"ab", b"abcd"]
    bucket, a, b = C.trigrams(texts)
    one = lambda t: [(int.from_bytes(t[i : i + 3].ljust(3, b"\0"), "big") * 2654435761 % 2**32) >> 21 for i in range(len(t))]
    assert [bucket[s:e].tolist() for s, e in zip(a, b)] == [one(t) for t in texts]


def test_text_statistics_are_those_counted_by_hand():
    texts = [b"", b"a b a a\nB!! 7", b"  ", "ÄÄ x".encode(), b"w " * 3000]
    got = C.text_stats(texts)
    for i, t in enumerate(texts):
        words = t.lower().split()
        size, n = max(len(t), 1), len(words)
        again, near = n - len(set(words)), sum(x == y for x, y in zip(words, words[1:]))
        shares = [sum(ok(c) for c in t) / size for ok in (lambda c: 65 <= c < 91, lambda c: 48 <= c < 58, lambda c: c in b"!#$%&*+<=>@\\^_`{|}~", lambda c: c in b".,;:?'\"()-/[]")]
        lines = t.count(b"\n") + 1
        want = [np.log1p(n) / 10, again / max(n, 1), near / max(n, 1), (again / max(n, 1)) ** 0.5, (near / max(n, 1)) ** 0.5, np.log1p(size) / 10, np.log(lines) / 5, np.log(size / lines) / 5, *shares, sum(c >= 128 for c in t) / size, *np.sqrt(shares)]
        assert got[i] == pytest.approx(want)


def test_odds_are_those_of_plain_sums_whatever_the_neighbours():
    rng = np.random.default_rng(1)
    m = C.Model(rng.normal(size=C.TEXT + 1), rng.normal(size=C.STATS), np.ones(C.STATS), rng.normal(size=C.META + 1))
    texts = [b"", b"hello", b"x" * 4000, "naïve\nline".encode()]
    lang, source, n = ["en", None, "de", "de"], ["a", "b", None, "a"], [0, 5, None, 11]
    t, e, _ = m.logits(texts, lang, source, n)
    for i, text in enumerate(texts):
        grams = [(int.from_bytes((text + b"\0\0")[k : k + 3], "big") * 2654435761 % 2**32) >> 21 for k in range(len(text))]
        want = sum(m.text[g] for g in grams) * 100 / (len(text) + C.SHRINK) + (C.text_stats([text])[0] - m.mean) @ m.text[C.BUCKETS : -1] + m.text[-1]
        size = 0 if n[i] is None else 1 + int(2 * np.log2(n[i] + 1))
        cols = [zlib.crc32(str(lang[i]).encode()) % C.LANGS, C.LANGS + zlib.crc32(str(source[i]).encode()) % C.SOURCES, C.LANGS + C.SOURCES + size]
        assert t[i] == pytest.approx(want) and e[i] == pytest.approx(m.meta[cols].sum() + m.meta[-1])
        assert m.logits([text], [lang[i]], [source[i]], [n[i]])[0][0] == pytest.approx(t[i], abs=1e-9)


def test_gradient_is_that_of_the_loss():
    """Against finite differences of the log loss over the rows the other view is sure of."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    m = C.Model(rng.normal(size=C.TEXT + 1) * 0.01, np.zeros(C.STATS), np.ones(C.STATS), rng.normal(size=C.META + 1), np.array([[1.0, 0], [50.0, 0]]))
    texts = ["some text", "other words here", "UPPER!!", "", None]
    rest = (["en", "de", "fr", None, "en"], ["a", "b", "c", "d", None], [9, 16, 7, 0, None])
    batch = pa.record_batch([pa.array(texts, pa.string()), pa.array(rest[0]), pa.array(rest[1]), pa.array(rest[2], pa.int64())], names=list("abcd"))
    (out,) = C._passed_on([batch], m)
    raw = [(t or "").encode() for t in texts]
    says = 1 / (1 + np.exp(-m.logits(raw, *rest)[1] * 50))
    for y in (0, 1):
        sums = np.frombuffer(out.column(1)[y].as_py(), np.float64)
        sure = [i for i, p in enumerate(says) if (p >= C.SURE if y else p <= 1 - C.SURE)]
        assert sums[C.TEXT + C.META + 2] == len(sure)
        loss = lambda: sum(np.log1p(np.exp((1 - 2 * y) * o)) for o in m.logits([raw[i] for i in sure], *[[r[i] for i in sure] for r in rest])[0])
        for k in (*np.flatnonzero(sums[: C.BUCKETS])[:5], C.BUCKETS, C.BUCKETS + 4, C.TEXT):
            was, m.text[k] = m.text[k], m.text[k] + 1e-5
            up = loss()
            m.text[k] = was - 1e-5
            assert (up - loss()) / 2e-5 == pytest.approx(sums[k], rel=1e-3, abs=1e-4)
            m.text[k] = was


def test_scores_are_right_and_do_not_depend_on_order_or_partitions(spark, world):
    docs, labels, good, rows = world
    out = {r.doc_id: r for r in C.score_quality(docs, labels).collect()}
    assert all((out[i].p >= 0.5) == g for i, g in enumerate(good)) and len(out) == len(rows)
    assert all((out[i].p_meta >= 0.5) == g and (out[i].p_text >= 0.5) == g for i, g in enumerate(good)) and out[242].p >= 0.5
    again = {r.doc_id: r for r in C.score_quality(docs.orderBy(F.desc("doc_id")).repartition(5), labels.repartition(3)).collect()}
    assert max(abs(out[i].p - again[i].p) for i in out) < 1e-4


def test_a_view_that_knows_teaches_the_other(spark):
    """Labelled texts say nothing, so the text view learns the words of junk only from rows the metadata view is sure of."""
    rng = random.Random(3)
    rows = [(i, plain(rng, 20), "en", ("fine", "poor")[i % 2], 100) for i in range(200)] + [(i, (plain if i % 2 == 0 else junk)(rng, 20), "en", ("fine", "poor")[i % 2], 100) for i in range(200, 500)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(200)], "doc_id long, quality int")
    alone, taught = (C.fit(docs, labels, "quality", rounds=k) for k in (0, 3))
    texts = [r[1].encode() for r in rows[200:]]
    gap = lambda m: (o := m.logits(texts, *[[None] * 300] * 3)[0])[::2].mean() - o[1::2].mean()
    assert gap(taught) > gap(alone) + 0.5


def test_defined_results_of_odd_tables(spark, world):
    docs, labels, good, rows = world
    odd = docs.union(docs.filter("doc_id < 60").withColumn("doc_id", F.lit(3).cast("long"))).withColumn("p", F.lit("mine")).withColumn("row", F.lit(1)).withColumn("y", F.lit(2))
    scored = C.score_quality(odd, labels)
    assert scored.columns == [*DOCS.replace(",", "").split()[::2], "row", "y", "p_text", "p_meta", "p"] and scored.count() == len(rows) + 60
    kept = C.drop_low_quality(odd, labels)
    assert kept.columns == odd.columns and {r.p for r in kept.collect()} == {"mine"}
    assert C.score_quality(docs, labels.limit(0)).filter("p <> 0.5").count() == 0
    assert C.score_quality(docs, labels.filter("quality = 1")).filter("p <> 0.5").count() == 0
    assert C.score_quality(docs.limit(0), labels).count() == 0
    assert C.score_quality(docs, spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, quality int")).count() == len(rows)  # none can be set aside
    few = C.score_quality(docs, labels, labelled_rows=60)
    assert few.filter("doc_id < 240").filter(F.expr("(p >= 0.5) <> (doc_id % 3 > 0)")).count() <= 5
