"""Statistics and resampling against plain Python."""

import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from quillstone.functions import stats
from quillstone.operators import resample

LABELS = ["a", "b", "c"]


@pytest.mark.parametrize("n,p", [(1, 0.5), (7, 0.1), (60, 0.9), (400, 0.33), (1100, 0.02)])
def test_tail_is_exact(n, p):
    q = Fraction(p)
    terms = [math.comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(n + 1)]
    k = np.array(sorted({0, 1, n // 3, n // 2, n - 1, n, n + 1}))
    want = [float(sum(terms[max(i, 0) :])) for i in k]
    assert stats.tail(k, np.full(len(k), n), np.full(len(k), p)) == pytest.approx(want, rel=1e-10, abs=1e-300)


def test_tail_holds_for_large_samples():
    n = 100_000
    got = stats.tail(np.array([50_000, 50_500, 51_000, 99_999]), np.full(4, n), np.full(4, 0.5))
    normal = [0.5 * math.erfc((k - 0.5 - n / 2) / math.sqrt(n / 2)) for k in (50_000, 50_500, 51_000)]
    assert got[:3] == pytest.approx(normal, rel=2e-3) and 0 <= got[3] < 1e-300
    assert stats.tail(np.array([3.0]), np.array([1e6]), np.array([1e-6])) == pytest.approx(1 - 2.5 / math.e, rel=1e-5)


def test_step_down_over_ranges_equals_one_window(spark):
    rng = random.Random(1)
    rows = [(i, round(rng.random() ** 4, 3)) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, p double").repartition(7)
    one = {r.k: r.p_holm for r in stats.holm(df, "p", "k").collect()}
    assert {r.k: r.p_holm for r in stats.holm_ranged(df, "p", "k").collect()} == pytest.approx(one)
    ordered, top = sorted(rows, key=lambda r: (r[1], r[0])), 0.0
    for i, (k, p) in enumerate(ordered):
        top = max(top, min(1.0, p * (500 - i)))
        assert one[k] == pytest.approx(top)


def f1(rows):
    out = []
    for x in LABELS:
        tp = sum(a == x and b == x for a, b in rows)
        wrong = sum((a == x) != (b == x) for a, b in rows)
        if any(a == x for a, _ in rows):
            out.append(2 * tp / (2 * tp + wrong))
    return sum(out) / len(out)


def area(rows):
    """rows: (label, predicted, rank)"""
    total = 0.0
    for r in {x[2] for x in rows}:
        taken = [x for x in rows if x[2] >= r]
        total += sum(a != b for a, b, _ in taken) / len(taken) * sum(x[2] == r for x in rows) / len(rows)
    return total


def test_rounds_are_those_of_single_rows(spark):
    """Cells drawn by count give each round the rows that drawing single rows would, and the scores of those rows."""
    rng = random.Random(4)
    models = ["m1", "m2"]
    scored = [(i, m, rng.choice(LABELS[:2]) if m == "m1" else None, rng.choice(LABELS), rng.randrange(4)) for i in range(57) for m in models]
    label = {i: x for i, m, x, _, _ in scored if m == "m1"}
    scored = [(i, m, label[i], p, r) for i, m, _, p, r in scored] + [(99, "m1", "a", "a", 1)]  # not scored by all models
    cells = resample.joint_cells(spark.createDataFrame(scored, "doc_id long, model string, label string, predicted string, rnk int"), models)
    held = {r.cell: r for r in cells.collect()}
    assert sum(r.k for r in held.values()) == 57
    rows = [c for c in sorted(held) for _ in range(held[c].k)]
    drawn = resample.resampled(cells, 20)
    got = {(r.r, r.cell): r.k for r in drawn.collect()}
    for r in range(20):
        want = Counter(rows[p] for p in resample.place(np.int64(r), np.arange(57), 57))
        assert {c: k for (x, c), k in got.items() if x == r} == dict(want)
    outcomes = drawn.join(cells.drop("k", "begins"), "cell")
    by_f1 = {(r.r, r.model): r.f for r in resample.macro_f1(outcomes, models, LABELS).collect()}
    by_area = {(r.r, r.model): r.f for r in resample.risk_areas(outcomes, models).collect()}
    for r in range(20):
        for j, m in enumerate(models):
            mine = [(held[c].label, held[c].predicted[j], held[c].rnk[j]) for (x, c), k in got.items() if x == r for _ in range(k)]
            assert by_f1[r, m] == pytest.approx(f1([x[:2] for x in mine])) and by_area[r, m] == pytest.approx(area(mine))


def test_places_are_even_and_rounds_differ():
    at = resample.place(np.int64(3), np.arange(100_000), 50)
    counts = np.bincount(at, minlength=50)
    assert len(counts) == 50 and ((counts - 2000) ** 2 / 2000).sum() < 110  # chi-square with 49 degrees of freedom
    sums = [resample.place(np.int64(r), np.arange(400), 400).sum() for r in range(500)]
    assert np.std(sums) == pytest.approx(math.sqrt(400) * 400 / math.sqrt(12), rel=0.15)


def test_intervals_and_differences(spark):
    rows = [(r, m, v) for r in range(200) for m, v in (("x", r / 200), ("y", r / 200 - (0.1 if r >= 10 else -0.1)), ("z", r / 200))]
    scores = spark.createDataFrame(rows, "r long, model string, f double")
    assert {r.model: (r.lo, r.hi) for r in resample.intervals(scores, 200).filter("model = 'x'").collect()} == {"x": (5 / 200, 194 / 200)}
    got = {(r.m1, r.m2): r for r in resample.differences(scores, 200).collect()}
    assert got["x", "y"].p == pytest.approx(0.1) and got["x", "y"].p_holm == pytest.approx(0.2)  # x - z is 0 throughout: its w is 1 and its p 0
    assert (got["x", "y"].lo, got["x", "y"].hi) == pytest.approx((-0.1, 0.1)) and got["x", "z"].p == 0
