"""The language model against plain Python: probabilities that sum to 1, the gradient, counts on both sides of the known words."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstone.llm import maxent as M
from quillstone.llm.common import word_hashes

DOCS = "doc_id long, text string, h string"


def model(words=400, rows=64, seed=0, tail=25.5):
    rng = np.random.default_rng(seed)
    hashes = np.sort(word_hashes([" ".join(f"w{i}" for i in range(words)).encode()])[0])
    hashes = np.sort(np.append(hashes, M._END))
    counts = rng.integers(1, 50, len(hashes))
    rank = np.empty(len(hashes), np.int64)
    rank[np.lexsort((hashes, -counts))] = np.arange(len(hashes))
    first = np.where(hashes == M._END, M.END_SLOT, M.FIRST_CLASS + rank % (M.FAN - M.FIRST_CLASS))
    paths = M.nested_classes(first, rank)
    weights = rng.normal(size=(rows, M.FAN)).astype(np.float32) * 0.3
    return M.Model(hashes, counts, int(counts.sum()), len(hashes), *paths, M._biases(*paths[1:], np.append(counts, tail)), weights, float(np.log10(tail)))


@pytest.mark.parametrize("words", [0, 1, 5, 400, 3000])
def test_probabilities_of_all_words_and_the_tail_sum_to_one(words):
    m = model(words)
    context = np.random.default_rng(3).integers(0, 1 << 63, (M.FEATURES, 1), dtype=np.uint64)
    everything = np.append(np.arange(len(m.hashes)), -1)
    assert (10 ** m.log10(everything, np.repeat(context, len(everything), axis=1))).sum() == pytest.approx(1, abs=1e-5)
    m.weights[:] = 0
    share = 10 ** m.log10(everything, np.repeat(context, len(everything), axis=1))
    assert share == pytest.approx(np.append(m.counts, 25.5) / (m.counts.sum() + 25.5), rel=1e-4)


def test_gradient_matches_finite_differences():
    m = model(40, rows=8)
    texts = ["w1 w2 w3 unknown w2", "", "w7 w7 w7 W1"]
    (out,) = M._gradient([pa.record_batch([pa.array(texts)], names=["text"])], m)
    got = M._joined({k: np.frombuffer(b.as_py(), np.float32) for k, b in zip(out.column(0).to_pylist(), out.column(1))}, 0).reshape(-1, 2, M.FAN)
    seq, begins = M.sequence([t.encode() for t in texts])
    place, context = m.look_up(seq), M.features(seq, begins)
    m.weights = m.weights.astype(np.float64)
    m.bias = m.bias.astype(np.float64)
    loss = lambda: m.log10(place, context).sum() * np.log(10)
    for row, slot in ((0, 0), (1, 2), (3, 5), (7, 1), (5, 7)):
        was = m.weights[row, slot]
        m.weights[row, slot] = was + 1e-5
        up = loss()
        m.weights[row, slot] = was - 1e-5
        assert (up - loss()) / 2e-5 == pytest.approx(got[row, 0, slot] - got[row, 1, slot], abs=1e-3)
        m.weights[row, slot] = was


def brute(texts, held):
    tokens = [(t or "").lower().split() + ["\n"] for t in texts]
    c = Counter(w for t, h in zip(tokens, held) if not h for w in t)
    n, v = sum(c.values()), len(c)
    return tokens, c, n, [sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t) for t in tokens]


@pytest.mark.parametrize("known", [200_000, 12, 1])
def test_base_scores_are_exact_and_context_helps(spark, known):
    """With few known words the rest meet their counts in the join."""
    rng = random.Random(8)
    tongues = [[f"{k}{i}" for i in range(30)] for k in "abc"]
    texts = [" ".join(rng.choice(tongues[i % 3]) for _ in range(50)) for i in range(150)] + [None, "", "UNSEEN a1 A1"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], DOCS)
    out = {r.doc_id: r for r in M.score_texts(df, lambda i: F.crc32(i.cast("string")) % 5 == 1, known=known).collect()}
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))]
    tokens, c, n, base = brute(texts, held)
    for i, t in enumerate(tokens):
        assert out[i].base_score == pytest.approx(base[i]) and out[i].n_tokens == len(t) and out[i].n_known == sum(c[w] > 0 for w in t)
        assert out[i].train_tokens == n and out[i].held_out == held[i]
    gain = np.mean([out[i].score - out[i].base_score for i in range(150) if held[i]])
    assert gain > (5 if known > 90 else -1)  # the words before tell the vocabulary


def test_scores_do_not_depend_on_partitions_and_odd_rows_are_defined(spark):
    rng = random.Random(1)
    rows = [(i % 40, " ".join(rng.choice("abcdefgh") for _ in range(30)), "x") for i in range(60)] + [(None, "a b", "x"), (70, "long " * 60_000, "x")]
    df = spark.createDataFrame(rows, DOCS)
    one = lambda d: sorted((str(r.doc_id), r.n_tokens, round(r.base_score, 6), round(r.score, 2)) for r in M.score_texts(d, lambda i: i == 5).collect())
    first = one(df)
    assert len(first) == 62 and first == one(df.orderBy(F.desc("text")).repartition(7))
    assert M.score_texts(df.limit(0), lambda i: i == 5).count() == 0
    none = M.score_texts(df, lambda i: i.isNull() | i.isNotNull()).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == pytest.approx(0) for r in none)  # one unseen kind of word has all probability
