"""Resampling from cell counts against single draws and a plain count; longest common substrings by rank doubling against brute force."""

import random
import time

import numpy as np
import pytest

from quillstone.operators import overlap, resample

SIZES = [500, 300, 150, 40, 9, 1]


def _cells(spark, scale=1):
    begins = np.concatenate([[0], np.cumsum(SIZES)[:-1]]) * scale
    rows = [(i, k * scale, int(b)) for i, (k, b) in enumerate(zip(SIZES, begins))]
    return spark.createDataFrame(rows, "cell long, k long, begins long")


def _matrix(df, rounds):
    out = np.zeros((rounds, len(SIZES)), np.int64)
    for r in df.collect():
        out[r["r"], r["cell"]] += r["k"]
    return out


def test_rounds_are_the_generators_own_in_any_task(spark):
    got = _matrix(resample.resampled_cells(_cells(spark), 64), 64)
    for r in range(64):
        assert (got[r] == resample.redrawn(np.array(SIZES), r)).all() and got[r].sum() == 1000
    again = _matrix(resample.resampled_cells(_cells(spark).repartition(5), 64), 64)
    assert (got == again).all() and len({tuple(x) for x in got}) > 60


def test_moments_are_those_of_single_draws(spark):
    rounds = 4000
    by_cell, by_row = _matrix(resample.resampled_cells(_cells(spark), rounds), rounds), _matrix(resample.resampled(_cells(spark), rounds), rounds)
    p = np.array(SIZES) / 1000
    sd = np.sqrt(1000 * p * (1 - p))
    for m in (by_cell, by_row):
        assert (abs(m.mean(0) - 1000 * p) < 5 * sd / rounds**0.5 + 1e-9).all()
        assert (abs(m.std(0) / sd - 1) < 0.1).all()
        assert abs(np.corrcoef(m[:, 0], m[:, 1])[0, 1] + (p[0] * p[1] / ((1 - p[0]) * (1 - p[1]))) ** 0.5) < 0.08


def test_work_does_not_grow_with_the_rows(spark):
    got = _matrix(resample.resampled_cells(_cells(spark, 10**9), 32), 32)  # 10^12 rows
    assert (got.sum(1) == 1000 * 10**9).all()
    assert resample.resampled_cells(_cells(spark).limit(0), 8).count() == 0


def _plain(a, b):
    best = ""
    for i in range(len(a)):
        while i + len(best) < len(a) and a[i : i + len(best) + 1] in b:
            best = a[i : i + len(best) + 1]
    return best


@pytest.mark.parametrize("alphabet", ["a", "ab", "abcd", "a가😀\ud800 "])
def test_longest_common_is_the_first_longest(alphabet):
    rng = random.Random(len(alphabet))
    for _ in range(300):
        a, b = ("".join(rng.choices(alphabet, k=rng.randrange(24))) for _ in range(2))
        assert overlap.longest_common(a, b) == _plain(a, b), (a, b)


def test_long_texts_are_quick():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(2000)]
    a, b = (" ".join(rng.choices(words, k=20_000)) for _ in range(2))
    b = b[:70_000] + a[30_000:30_900] + b[70_000:]
    began = time.time()
    assert a[30_000:30_900] in overlap.longest_common(a, b) and time.time() - began < 10
    assert overlap.longest_common("ab" * 50_000, "ba" * 50_000) == "ab" * 49_999 + "a"
