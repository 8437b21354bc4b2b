"""Validators in the router, rule transfer and the two retrievers, by hand."""

import pytest

from quillstone.operators import ngrams, router, rules


def routed(spark, policy, hits, fired=(), year=2020):
    h = spark.createDataFrame([(1, *x) for x in hits], "q long, rank int, label string, s double, source string, year int, grounded boolean")
    f = spark.createDataFrame([(1, *x) for x in fired], "q long, ord int, label string, prec double")
    risk = spark.createDataFrame([("trust", 0.1), ("middle", 0.1), ("doubt", 0.5)], "band string, risk double")
    return router.route(policy, h, f, risk, spark.createDataFrame([(1, year)], "q long, year int")).first()


def test_a_dropped_quotation_leaves_the_claim_unsupported(spark):
    p = router.Policy()
    ok = routed(spark, p, [(0, "rare", 0.5, "x", 2020, True), (1, "rare", 0.3, "y", 2020, None)])
    assert (ok.decision, ok.abstained, ok.confidence) == ("rare", False, "medium")
    one = routed(spark, p, [(0, "rare", 0.5, "x", 2020, False), (1, "rare", 0.3, "y", 2020, None)])
    assert (one.decision, one.confidence) == ("rare", "low")  # V3 lowers, the other precedent still backs it
    none = routed(spark, p, [(0, "rare", 0.5, "x", 2020, False), (1, "rare", 0.3, "y", 2020, False)])
    assert (none.decision, none.abstained, none.abstain_reason, none.predicted, none.confidence) == (None, True, "validation_failed", "rare", "low")  # V5
    free = routed(spark, router.Policy(validate=False), [(0, "rare", 0.5, "x", 2020, False)])
    assert (free.decision, free.abstain_reason) == ("rare", None)


def test_labels_outside_the_scheme_are_withdrawn(spark):
    out = routed(spark, router.Policy(labels=("rare", "major")), [(0, "odd", 0.7, "x", 2020, True)])
    assert (out.decision, out.abstain_reason) == (None, "validation_failed")  # V1


def test_a_fallback_without_evidence_is_no_answer(spark):
    out = routed(spark, router.Policy(allow_abstain=False), [(0, "rare", 0.01, "x", 2020, None)])
    assert (out.decision, out.abstained, out.abstain_reason, out.predicted) == (None, True, "validation_failed", "major")


def test_conflicts_and_precise_rules_lower_medium_only(spark):
    p = router.Policy()
    medium = [(0, "rare", 0.5, "x", 2020, None), (1, "rare", 0.3, "y", 2020, None)]
    assert routed(spark, p, medium, [(1, "major", 0.97)]).confidence == "low"  # V4 and V6
    high = [(0, "rare", 0.9, "x", 2020, None), (1, "rare", 0.3, "y", 2020, None)]
    assert routed(spark, p, high, [(1, "major", 0.97)]).confidence == "high"


def test_transfer_counts_first_matches_and_silent_rules(spark):
    rows = spark.createDataFrame([(1, "xx a", "s", "p"), (2, "xx yy", "s", "q"), (3, "yy", "s", "q"), (4, "none", "s", "q"), (5, None, None, "p")], "doc_id long, text string, source string, label string")
    listed = [rules.Rule(1, (("ngram", "xx"),), "p", 5, 5), rules.Rule(2, (("ngram", "yy"),), "q", 4, 3), rules.Rule(3, (("ngram", "zz"),), "q", 4, 4)]
    got = {r.rule: (r.support, r.correct) for r in rules.transfer(listed, "q", rows).collect()}
    assert got == {"rule1": (2, 1), "rule2": (1, 1), "rule3": (0, 0), "default": (2, 1), "fired": (3, 2), "all": (5, 3)}


def test_word_vectors_and_fusion(spark):
    df = spark.createDataFrame([(0, "The cat sat"), (1, "the CAT\tsat"), (2, "dog"), (3, ""), (4, None)], "doc_id long, text string")
    vec = ngrams.vectors(df, grams=ngrams.word_grams)
    sims = {(r.q, r.p): r.s for r in ngrams.similarities(vec, vec).collect()}
    assert sims[0, 1] == pytest.approx(1.0) and (0, 2) not in sims and not any(3 in k or 4 in k for k in sims)
    a = spark.createDataFrame([(1, 10, 0), (1, 11, 1)], "q long, p long, rank int")
    b = spark.createDataFrame([(1, 11, 0), (1, 12, 1)], "q long, p long, rank int")
    assert {r.p: r.score for r in ngrams.rrf([a, b]).collect()} == pytest.approx({10: 1 / 61, 11: 1 / 61 + 1 / 62, 12: 1 / 62})


def test_answers_without_evidence_are_counted(spark):
    hits = spark.createDataFrame([(1, 0, "a", 0.9), (2, 0, "b", 0.9), (2, 1, "a", 0.8), (4, 0, "b", 0.05)], "q long, rank int, label string, s double")
    fired = spark.createDataFrame([(3, 1, "c", 0.9)], "q long, ord int, label string, prec double")
    outcome = spark.createDataFrame([(1, "a", False), (2, "a", False), (3, "c", False), (4, "b", False), (5, "a", False), (6, None, True)], "q long, decision string, abstained boolean")
    got = lambda **k: tuple(router.unsupported(router.Policy(**k), outcome, hits, fired).first())
    assert got() == (6, 5 / 6, 5, 1, 0.2)
    assert got(use_rules=False)[2:4] == (5, 2) and got(use_rules=False, top_k=1)[2:4] == (5, 3)
    assert tuple(router.unsupported(router.Policy(), outcome.limit(0), hits, fired).first()) == (0, 0.0, 0, 0, 0.0)
