"""Written figures held against results; probes proven by counterexamples; the case registry against probe results."""

import pytest
from pyspark.sql import functions as F

from quillstone.operators import probes, reports
from quillstone.plans.report_queries import FRAMES, PROBES

UNITS = [("pairs", r"([\d,]+)\s*(?:request[–—-]?\s*reply\s*)?pairs"), ("cases", r"([\d,]+)\s*cases"), ("cases", r"([\d,]+) files\s*— W1")]


def _stale(spark, text, pairs=1122, cases=902):
    docs = spark.createDataFrame([(1, text)], "id long, text string")
    truth = spark.createDataFrame([(1, "pairs", pairs), (1, "cases", cases)], "id long, unit string, value long")
    return [(r.unit, r.nth, r.claimed, r.actual) for r in reports.restatements(docs, UNITS, truth).filter("not agrees").orderBy("unit", "nth").collect()]


def test_every_restated_figure_is_met(spark):
    assert _stale(spark, "| split | 1,122 pairs |\n| Track | 902 cases -> 1,124 request-reply pairs |") == [("pairs", 1, 1124, 1122)]
    assert _stale(spark, "corpus: 902 cases, 1,122 pairs. Again 1122pairs; 902 files — W1") == []
    assert _stale(spark, "58 failures, 341 tests, 1,122 pairs") == []
    assert _stale(spark, "903 files — W1 and 901 cases") == [("cases", 0, 901, 902), ("cases", 0, 903, 902)]
    assert _stale(spark, ", pairs 99999999999999999999 pairs")[-1][2:] == (None, 1122)
    assert _stale(spark, None) == []


REPORT = """<!-- A:시작 -->
| a | b | diff | p |
|---|:--|--:|---|
| x | y | +0.120 | 0.010 |
| x | z | -0.030 | 0.500 |
| x | x | +0.000 | 1.000 |
<!-- A:끝 -->
<!-- B:시작 -->
| x | y | +0.999 | 0.999 |
<!-- B:끝 -->"""


def _claims(spark, text, tag):
    rows = reports.table_rows(spark.createDataFrame([(1, text)], "id long, text string"), tag)
    return rows.filter(F.col("cells")[2].rlike("^[+-]")).select(*[F.col("cells")[i].alias(c) for i, c in enumerate(("a", "b", "diff", "p"))])


def test_tables_of_a_section_only_and_every_mismatch(spark):
    actual = spark.createDataFrame([("x", "y", 0.12, 0.0104), ("x", "z", -0.031, 0.4), ("y", "z", 0.5, 0.5)], "a string, b string, diff double, p double")
    fields = {"diff": reports.signed(3), "p": reports.fixed(3)}
    got = sorted(map(tuple, reports.reconcile(_claims(spark, REPORT, "A"), actual, ["a", "b"], fields).collect()), key=str)
    assert got == sorted([("x", "z", "diff", "-0.030", "-0.031", "differs"), ("x", "z", "p", "0.500", "0.400", "differs"), ("x", "x", "row", None, None, "unknown"), ("y", "z", "row", None, None, "missing")], key=str)
    assert [tuple(r) for r in _claims(spark, REPORT, "B").collect()] == [("x", "y", "+0.999", "0.999")]
    assert _claims(spark, REPORT, "C").count() == 0 and _claims(spark, None, "A").count() == 0
    docs = spark.createDataFrame([(1, REPORT), (2, "<!-- A:끝 --> <!-- A:시작 -->"), (3, None)], "id long, text string")
    assert sorted(r.id for r in reports.without_section(docs, "A").collect()) == [2, 3]


def test_rows_written_twice_and_null_keys(spark):
    claimed = spark.createDataFrame([("x", "1"), ("x", "2"), (None, "3")], "k string, v string")
    actual = spark.createDataFrame([("x", 1), (None, 3)], "k string, v int")
    got = reports.reconcile(claimed, actual, ["k"], {"v": lambda c: c})
    assert [tuple(r) for r in got.collect()] == [("x", "v", "2", "1", "differs")]
    assert reports.reconcile(claimed.limit(0), actual, ["k"], {"v": lambda c: c}).count() == 2


GOOD = {
    "ids": "SELECT 1 AS doc_id, 1 AS c", "texts": "SELECT 'ab' AS text, 2 AS n_chars", "labelled": "SELECT 1 AS doc_id, 1 AS text_id", "answers": "SELECT 'major' AS label, 'rare' AS predicted, 'high' AS confidence, 3 AS rnk",
    "said": "SELECT 'm' AS model, 1 AS doc_id, 1 AS c", "covered": "SELECT 'm' AS model, 5 AS c, 5 AS n", "parts": "SELECT 1 AS doc_id, 1 AS c", "turns": "SELECT 'user' AS role", "places": "SELECT 1 AS conv_id, 1 AS turn, 1 AS c",
}
BAD = {
    "document ids are distinct": "SELECT 1 AS doc_id, 2 AS c", "every document has a text": "SELECT ' ' AS text, 1 AS n_chars", "recorded sizes are the texts'": "SELECT 'ab' AS text, 3 AS n_chars",
    "labels meet documents": "SELECT 1 AS doc_id, CAST(NULL AS INT) AS text_id", "labels are of the scheme": "SELECT 'odd' AS label, 'rare' AS predicted, 'high' AS confidence, 3 AS rnk",
    "answers are of the scheme": "SELECT 'major' AS label, CAST(NULL AS STRING) AS predicted, 'high' AS confidence, 3 AS rnk", "ranks stand for confidences": "SELECT 'major' AS label, 'rare' AS predicted, 'high' AS confidence, 2 AS rnk",
    "one answer a model and document": "SELECT 'm' AS model, 1 AS doc_id, 2 AS c", "models answer one sample": "SELECT 'm' AS model, 4 AS c, 5 AS n", "no document is in both parts": "SELECT 1 AS doc_id, 2 AS c",
    "roles are known": "SELECT 'judge' AS role", "turns are one a place": "SELECT 1 AS conv_id, 1 AS turn, 2 AS c",
}


def test_each_probe_holds_and_is_proven_by_a_counterexample(spark):
    assert set(GOOD) == set(FRAMES) and set(BAD) == {p.name for p in PROBES}
    good = probes.run_probes(spark, PROBES, {k: spark.sql(v) for k, v in GOOD.items()}).collect()
    assert [r.probe for r in good] == [p.name for p in PROBES] and all(r.ran and r.passed and r.rows == 1 for r in good)
    for p in PROBES:
        both = spark.sql(GOOD[p.frame]).unionByName(spark.sql(BAD[p.name]))
        rows = {r.probe: r for r in probes.run_probes(spark, [q for q in PROBES if q.frame == p.frame], {p.frame: both}).collect()}
        assert (rows[p.name].rows, rows[p.name].failing, rows[p.name].passed) == (2, 1, False)
        assert all(r.passed for n, r in rows.items() if n != p.name)


def test_probes_that_break_are_results_and_hide_no_other(spark):
    t = spark.createDataFrame([("1",), ("x",)], "v string")
    asked = [probes.Probe("ok", "t", "v IS NULL"), probes.Probe("breaks", "t", "CAST(v AS INT) < 0"), probes.Probe("no column", "t", "w > 0"), probes.Probe("no frame", "u", "true"), probes.Probe("raises", "r", "true"), probes.Probe("empty", "e", "true")]
    spark.conf.set("spark.sql.ansi.enabled", "true")
    rows = {r.probe: r for r in probes.run_probes(spark, asked, {"t": t, "r": lambda: 1 / 0, "e": t.limit(0)}).collect()}
    assert rows["ok"].passed and rows["ok"].detail == "0 of 2 rows fail" and rows["empty"].passed
    assert not rows["breaks"].passed and rows["breaks"].detail.startswith("exception") and rows["no column"].detail == "exception AnalysisException"
    assert rows["raises"].detail == "exception ZeroDivisionError" and rows["no frame"].passed is None and not rows["no frame"].ran


_CASE = "id string, layer string, category string, title string, symptom string, fix string, pattern string, probe string, status string, metric struct<name: string, before: double, after: double, kind: string, source: string>"


def test_registry_form_and_standing(spark):
    kinds = spark.createDataFrame([("extraction", "silent-empty"), ("agent", "miscalibration")], "layer string, category string")
    ok = lambda i, **k: tuple({**dict(id=i, layer="extraction", category="silent-empty", title="t", symptom="s", fix="f", pattern=None, probe=None, status="fixed", metric=None), **k}.values())
    rows = [
        ok("a"), ok("b", layer="cooking"), ok("c", category="miscalibration"), ok("d", metric=("m", 1.0, 2.0, "measured", "")), ok("e", metric=("m", None, 2.0, "guessed", None)), ok("f", pattern="odd", title=None),
        ok("g", probe="p1"), ok("h", probe="p2"), ok("i", probe="p1", status="open"), ok("j", probe="p2", status="open"), ok("k", probe="gone", pattern="twice"), ok("l", pattern="twice"), ok("m", metric=("m", 1.0, 2.0, "live", None)),
    ]
    cases = spark.createDataFrame(rows, _CASE)
    got = sorted((r.id, r.problem) for r in probes.case_problems(cases, kinds, ["twice"]).collect())
    assert got == [("b", "unknown layer cooking"), ("c", "no category miscalibration in extraction"), ("d", "measured figure without source"), ("e", "metric without before"), ("e", "unknown kind of figure guessed"), ("f", "no title"), ("f", "unknown pattern odd")]
    assert [tuple(r) for r in probes.patterns_without_guard(cases, {}).collect()] == [("twice", 2)]
    assert probes.patterns_without_guard(cases, {"twice": "p1"}).count() == 0
    results = spark.createDataFrame([("p1", True, True), ("p2", True, False)], "probe string, ran boolean, passed boolean")
    how = {r.id: r.standing for r in probes.standing(cases, results).collect()}
    assert (how["a"], how["g"], how["h"], how["i"], how["j"], how["k"]) == ("recorded", "holds", "regressed", "stale", "open", "not run")


@pytest.mark.parametrize("c, w", [(0.0, "+0.000"), (-0.0304, "-0.030"), (12.3456, "+12.346")])
def test_signed(spark, c, w):
    assert spark.range(1).select(reports.signed(3)(F.lit(c)).alias("x")).first().x == w
