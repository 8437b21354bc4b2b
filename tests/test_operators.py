"""Small fixtures with hand-computed or brute-force answers for the operators outside the training-data part."""

import math

import pytest
from pyspark.sql import functions as F

from quillstone.functions import stats
from quillstone.functions import text as T
from quillstone.operators import ngrams, overlap, router, rules, segments, splits


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(col).first()[0]


def test_marks_keep_the_first_rising_chain(spark):
    t = "① a ② b ④ d ③ c"
    marks = one(spark, T.sequence_marks(F.col("t")), t=t)
    assert [(m.num, t[m.pos]) for m in marks] == [(1, "①"), (2, "②"), (3, "③")]
    assert one(spark, T.sequence_marks(F.col("t")), t="only ① one") == []


def test_grounding_differs_on_empty_quotes(spark):
    assert one(spark, T.quote_grounded(F.col("q"), F.col("s")), q="", s="x") is False
    assert one(spark, T.evidence_grounded(F.col("q"), F.col("s")), q="", s="x") is True
    assert one(spark, T.quote_grounded(F.col("q"), F.col("s")), q="a​ b•c", s="x ab c y") is True


@pytest.mark.parametrize(
    "answer,expect",
    [("", ("미분류", "empty")), ("가능합니다", ("긍정", "affirm")), ("할 수 없습니다", ("부정", "deny")), ("가능하나 개별적으로 판단", ("판단유보", "abstain")), ("해당합니다 그러나 볼 수 없", ("부정", "deny>affirm")), ("볼 수 없 그러나 가능합니다", ("긍정", "affirm>deny")), ("글", ("미분류", "no_match"))],
)
def test_verdicts(spark, answer, expect):
    label, rule = T.verdict(F.col("a"))
    assert (one(spark, label, a=answer), one(spark, rule, a=answer)) == expect


def test_masking_and_group_keys(spark):
    masked, hits = T.mask_leaks(F.col("t"))
    assert one(spark, masked, t="이 비조치를 요청") == "이  요청" and one(spark, hits, t="이 비조치를 요청") == 1
    a, b = (one(spark, T.group_key(F.col("t")), t=x) for x in ("일련번호 230014 2024. 3. 1. 까지", "일련번호: 250058 2025.12.31 까지"))
    assert a == b


def test_wilson_and_tail_and_holm(spark):
    lo, hi = stats.wilson(F.lit(0), F.lit(0))
    r = spark.range(1).select(lo.alias("lo"), hi.alias("hi")).first()
    assert (r.lo, r.hi) == (0.0, 1.0)
    df = spark.createDataFrame([("a", 3, 5, 0.5), ("b", 0, 4, 0.1), ("c", 5, 5, 0.5)], "k string, x int, n int, p double")
    df = df.withColumn("t", stats.binomial_tail("x", "n", "p"))
    got = {r.k: (r.t, r.p_holm) for r in stats.holm(df, "t", "k").collect()}
    assert got["a"][0] == pytest.approx(0.5) and got["b"][0] == pytest.approx(1.0) and got["c"][0] == pytest.approx(1 / 32)
    assert got["c"][1] == pytest.approx(3 / 32) and got["a"][1] == pytest.approx(1.0)


def test_grams_short_texts_and_similarity(spark):
    df = spark.createDataFrame([(0, "abcdabcd"), (1, "ab"), (2, ""), (3, "abcdabcd"), (4, "zzzzz"), (5, None)], "doc_id long, text string")
    tf = {(r.doc_id, r.g): r.tf for r in ngrams.counts(df).collect()}
    assert tf[0, "abcd"] == 2 and tf[1, "ab"] == 1 and not any(k[0] in (2, 5) for k in tf) and tf[4, "zzzz"] == 2
    sims = {(r.q, r.p): r.s for r in ngrams.similarities(ngrams.vectors(df), ngrams.vectors(df)).collect()}
    assert sims[0, 3] == pytest.approx(1.0) and (0, 4) not in sims
    top = {r.q: (r.p, r.s) for r in ngrams.top_k(ngrams.similarities(ngrams.vectors(df.filter("doc_id > 3")), ngrams.vectors(df.filter("doc_id < 4"))), df.filter("doc_id > 3"), df.filter("doc_id < 4"), 1).collect()}
    assert top[4] == (0, 0.0) and top[5] == (0, 0.0)  # nothing shared: the first row at similarity 0


def test_leaders_follow_the_sequential_pass(spark):
    pairs = [(0, 1, 0.9), (1, 2, 0.9), (2, 3, 0.9), (4, 5, 0.2)]
    sims = spark.createDataFrame([(a, b, s) for a, b, s in pairs] + [(b, a, s) for a, b, s in pairs], "q long, p long, s double")
    got = {r.doc_id: r.leader for r in ngrams.leaders(sims, spark.range(6).withColumnRenamed("id", "doc_id")).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 5}


def test_longest_common_matches_brute_force():
    import random

    rng = random.Random(1)
    for _ in range(60):
        a, b = ("".join(rng.choice("ab ") for _ in range(rng.randint(0, 14))) for _ in range(2))
        best = max((len(a[i:j]) for i in range(len(a)) for j in range(i, len(a) + 1) if a[i:j] in b), default=0)
        assert len(overlap.longest_common(a, b)) == best


def test_positions_and_samples(spark):
    df = spark.range(100).select(((F.col("id") * 37) % 101).alias("k"))
    got = [(r.k, r.pos) for r in splits.indexed(df, "k").collect()]
    assert sorted(p for _, p in got) == list(range(100)) and [k for k, _ in sorted(got, key=lambda x: x[1])] == sorted(k for k, _ in got)
    rows = spark.range(100).selectExpr("id as doc_id", "cast(id % 3 = 0 as int) as s")
    n = {r.s: r["count"] for r in splits.stratified(rows, ["s"], "doc_id", 10).groupBy("s").count().collect()}
    assert n == {1: 3, 0: 7}


def test_router_scenarios(spark):
    hits = [
        (1, 0, "a", 0.75, "s1", 2024), (1, 1, "a", 0.3, "s2", 2024),  # R8
        (2, 0, "a", 0.05, "s1", 2024),  # below the floor, no rule: R2
        (3, 0, "a", 0.375, "s1", 2024),  # risky band, rule fires: R5 to the rule
        (4, 0, "a", 0.75, "s1", 2010),  # old precedent, rule fires: R7
        (5, 0, "a", 0.65, "s1", 2024), (5, 1, "b", 0.645, "s1", 2024), (5, 2, "a", 0.3, "s1", 2024),  # R9
        (6, 0, "a", 0.7, "s1", 2024), (6, 1, "b", 0.5, "s2", 2024), (6, 2, "c", 0.4, "s3", 2024),  # R6
        (7, 0, "a", 0.05, "s1", 2024),  # rules conflict: R1
    ]
    fired = [(3, 1, "b", 0.9), (4, 1, "b", 0.9), (7, 1, "a", 0.9), (7, 2, "b", 0.9)]
    frames = {
        "hits": spark.createDataFrame(hits, "q long, rank int, label string, s double, source string, year int"),
        "fired": spark.createDataFrame(fired, "q long, ord int, label string, prec double"),
        "risk": spark.createDataFrame([("trust", 0.1), ("middle", 0.4), ("doubt", 0.5)], "band string, risk double"),
        "requests": spark.createDataFrame([(q, 2024) for q in range(1, 8)], "q long, year int"),
    }
    got = {r.q: (r.path, r.reason, r.decision) for r in router.route(router.Policy(), **frames).collect()}
    assert got[1] == ("precedent", "R8", "a") and got[2][:2] == ("abstain", "R2") and got[3] == ("rule", "R5", "b") and got[4] == ("rule", "R7", "b")
    assert got[5][:2] == ("abstain", "R9") and got[6][:2] == ("abstain", "R6") and got[7][:2] == ("abstain", "R1")
    always = {r.q: r.abstained for r in router.route(router.POLICIES["naive"], **frames).collect()}
    assert not any(always.values())


def test_rules_learn_a_shared_phrase(spark):
    rows = [(i, f"request {i} mentions zebra crossing", "s1", "rare") for i in range(6)] + [(i, f"plain text number {i} of many", f"s{i % 4}", "major") for i in range(6, 14)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, label string")
    learned, default = rules.induce(df, max_depth=2)
    got = {r.doc_id: r.predicted for r in rules.apply_rules(learned, default, df).collect()}
    assert all(got[i] == label for i, _, _, label in rows)
    assert learned[0].precision == 1.0 and math.isclose(learned[0].support, learned[0].correct)


def test_fields_stand_alone_on_up_to_three_lines(spark):
    fields, warnings = segments.split_fields(F.col("t"), ["판단", "판단이유", "사실", "기타"])
    rows = ["머리\n사실\n\n a  b\n판단\n이유\nx\n판 단\ny 판단\n사실\nc", "", None, "판단 있음"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").select("i", fields.alias("f"), warnings.alias("w")).orderBy("i").collect()
    assert got[0].f == {"사실": "a b\nc", "판단이유": "x", "판단": "y 판단"} and got[0].w == ["missing_field:기타"]
    assert all(r.f == {} and len(r.w) == 4 for r in got[1:])


def test_abstentions_are_withdrawn_only_without_opposing_evidence(spark):
    out = spark.createDataFrame([(q, "abstain", "R5", None, True, "major", "surface", "low") for q in range(5)] + [(5, "rule", "R3", "rare", False, "rare", None, "low")], "q int, path string, reason string, decision string, abstained boolean, predicted string, abstain_reason string, confidence string")
    # 0 recovers; 1 has opposing evidence; 2 a low top; 3 another verdict; 4 no precedent; 5 is answered already
    hits = spark.createDataFrame([(0, 0, "other", 0.5), (0, 1, "rare", 0.1), (1, 0, "other", 0.5), (1, 1, "rare", 0.2), (2, 0, "other", 0.1), (3, 0, "other", 0.5), (5, 0, "other", 0.5)], "q int, rank int, label string, s double")
    verdicts = spark.createDataFrame([(q, "differs" if q == 3 else "applies") for q in range(6)], "q int, verdict string")
    got = {r.q: (r.predicted, r.abstained, r.confidence, r.recovered) for r in router.recover(out, hits, verdicts).collect()}
    assert got[0] == ("other", False, "medium", True) and got[5] == ("rare", False, "low", False)
    assert all(got[q] == ("major", True, "low", False) for q in (1, 2, 3, 4))


def test_control_characters_are_dropped_not_spaced(spark):
    assert one(spark, T.control_squeeze(F.col("t")), t="\n a\tb\x01c  d\n\n\n\ne \u3000\n") == "abc d\n\ne"


def test_maximal_forms_grow_while_support_holds(spark):
    texts = ["xx abcde fgh", "y abcde fgi", "abcdz q q1", "zqqa qq2 p.q(r", None, "", "mmm nm p.q(r mm", "aXbbXc aXb"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    held = ["".join((t or "").split()) for t in texts]

    def brute(term, limit):
        hits, cur = [t for t in held if term in t], term
        while hits and len(cur) < limit:
            after = sorted({t[t.find(cur) + len(cur)] for t in hits if t.find(cur) + len(cur) < len(t)})
            before = sorted({t[t.find(cur) - 1] for t in hits if t.find(cur) > 0})
            grown = [g for g in [cur + c for c in after] + [c + cur for c in before] if all(g in t for t in hits)]
            if not grown:
                break
            cur = grown[0]
        return cur

    terms = ["bc", "cde", "fg", "q", "qq", "mm", ".q(", "X", "bX", "none", "a"]
    for limit in (5, 40):
        assert rules.maximal_forms(terms, rows, limit) == {t: brute(t, limit) for t in terms}
    assert rules.maximal_forms([], rows) == {}
