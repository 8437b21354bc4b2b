"""Harness and leakage audit against hand cases and plain Python."""

import math
from collections import Counter, defaultdict

import pytest

from quillstone.operators.harness import UNKNOWN, harness, macro_f1
from quillstone.operators.leakage import leakage


def test_harness_parts_scored_from_the_rest(spark):
    gold = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b"), (5, "a"), (6, None), (7, "")], "doc_id long, label string")
    rows = [
        ("m", 1, "a", None, True, 0), ("m", 2, "b", None, False, 0), ("m", 3, UNKNOWN, None, False, 0), ("m", 4, "b", "boom", False, 0), ("m", 6, "a", None, None, 0), ("m", 99, "a", None, None, 0),
        ("n", 1, "b", None, None, 0), ("n", 1, "a", None, None, 1), ("n", 2, UNKNOWN, "boom", None, 0),
    ]
    pred = spark.createDataFrame(rows, "model string, doc_id long, predicted string, error string, evidence_grounded boolean, at int")
    got = {r.model: r for r in harness(gold, pred, ["a", "b", "c"], order="at").collect()}
    m = got["m"]
    assert (m.gold_size, m.matched, m.missing, m.unknown, m.errors, m.n_scored, m.ungrounded) == (5, 4, 1, 1, 1, 2, 1)
    assert (m.coverage, m.accuracy) == (0.4, 0.5) and m.macro_f1 == pytest.approx(2 / 3)  # b has no support among the scored
    n = got["n"]
    assert (n.matched, n.missing, n.unknown, n.errors, n.n_scored, n.accuracy, n.macro_f1) == (2, 3, 1, 1, 1, 1.0, 1.0)


def test_harness_without_scored_rows(spark):
    gold = spark.createDataFrame([(1, "a")], "doc_id long, label string")
    pred = spark.createDataFrame([("m", 1, UNKNOWN, None)], "model string, doc_id long, predicted string, error string")
    r = harness(gold, pred, ["a"]).first()
    assert (r.n_scored, r.coverage, r.accuracy, r.macro_f1) == (0, 0.0, 0.0, 0.0)
    assert harness(gold.limit(0), pred, ["a"]).count() == 0


def test_macro_f1_by_hand(spark):
    rows = spark.createDataFrame([("m", "a", "a"), ("m", "a", "b"), ("m", "b", "b"), ("m", "b", "c")], "model string, label string, predicted string")
    assert macro_f1("model", "label", "predicted", rows, ["a", "b", "c"]).first().macro_f1 == pytest.approx((2 / 3 + 1 / 2) / 2)


def plain(rows, sizes, least):
    rows = [r for r in rows if r[2]]
    base, docs = Counter(r[2] for r in rows), defaultdict(set)
    for i, text, _ in rows:
        t = "".join(text.split())
        for n in sizes:
            for k in range(len(t) - n + 1):
                docs[t[k : k + n]].add(i)
    groups = defaultdict(list)
    for term, ids in docs.items():
        if len(ids) >= least:
            groups[frozenset(ids)].append(term)
    label_of = {i: x for i, _, x in rows}
    out = []
    for ids, forms in groups.items():
        count = Counter()
        for i in sorted(ids):
            count[label_of[i]] += 1
        label, hits = count.most_common(1)[0]
        n, prior = len(ids), base[label] / len(rows)
        p = sum(math.comb(n, k) * prior**k * (1 - prior) ** (n - k) for k in range(hits, n + 1))
        out.append([min(forms, key=lambda t: (len(t), t)), len(forms), label, n, hits, hits / n, prior, hits / n - prior, p])
    out.sort(key=lambda f: (round(f[8], 12), -round(f[7], 9), -f[3], f[0]))
    top = 0
    for k, f in enumerate(out):
        top = max(top, min(1, f[8] * (len(out) - k)))
        f += [top, top < 0.05]
    return out


def test_leakage_equals_plain_python(spark):
    words = ["alpha", "beta", "gamma", "delta", "leak", "mark"]
    rows = [(i, " ".join(words[(i * k + k) % 6] for k in range(1, 5)) + (" xyz!" if i % 3 == 0 else ""), "ab"[i % 3 == 0] if i % 7 else "c") for i in range(90)] + [(90, "alpha leak", None), (91, "", "a")]
    got = leakage(spark.createDataFrame(rows, "doc_id long, text string, label string"), sizes=(2, 3, 4), min_support=12).orderBy("place").collect()
    want = plain(rows, (2, 3, 4), 12)
    assert len(got) == len(want) and [r.place for r in got] == list(range(1, len(got) + 1))
    for r, w in zip(got, want):
        assert list(r)[1:6] == [w[0], w[1], w[2], w[3], w[4]] and list(r)[6:11] == pytest.approx(w[5:10], abs=1e-9) and r.significant == w[10]


def test_leakage_tie_of_labels_goes_to_the_first_document(spark):
    rows = [(i, "same text here", "ba"[i % 2]) for i in range(12)]
    assert {r.label for r in leakage(spark.createDataFrame(rows, "doc_id long, text string, label string")).collect()} == {"b"}


def test_sector_table_by_hand(spark):
    from quillstone.operators.harness import sector_table

    rows = [("m", i, "x", y, p) for i, (y, p) in enumerate([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b")])] + [("m", 9, None, "a", "a"), ("m", 10, "y", "b", None), ("m", 11, "y", "b", "b")]
    got = {r.source: r for r in sector_table(spark.createDataFrame(rows, "model string, doc_id long, source string, label string, predicted string"), ["a", "b"], small=2).collect()}
    x = got["x"]
    assert (x.n, x.correct, x.base_label, x.majority_correct, x.items_vs_majority, x.small, x.listed) == (4, 3, "a", 2, 1, False, True)
    assert (x.accuracy, x.base, x.lift, x.norm_lift) == (0.75, 0.5, 0.25, 0.5) and x.macro_f1 == pytest.approx((2 / 3 + 4 / 5) / 2)
    none = got[UNKNOWN]
    assert (none.n, none.norm_lift, none.macro_f1, none.small, none.listed) == (1, 0.0, 1.0, True, False)
    assert (got["y"].correct, got["y"].items_vs_majority, got["y"].listed) == (1, -1, False)


def test_format_drift_and_marks(spark):
    from quillstone.operators import segments

    rates = spark.createDataFrame([("s", "decision", 0.9), ("s", "serial", 0.94), ("s", "body", 0.79), ("t", "body", None)], "source string, field string, rate double")
    assert {(r.source, r.field): r.drift for r in segments.format_drift(rates).collect()} == {("s", "decision"): False, ("s", "serial"): True, ("s", "body"): True, ("t", "body"): True}
    seen = spark.createDataFrame([("s", "☑□☑", 3), ("s", "☑", 1), ("t", "◆☑◆□", 1)], "source string, pattern string, n long")
    assert [r.unknown for r in segments.unknown_marks(seen, segments.CHECK_MARKS).orderBy("pattern").collect()] == ["◆□", "", "□"]
