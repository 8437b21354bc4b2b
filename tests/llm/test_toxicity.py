"""Toxicity: the lexicon, its matching rule against all subsets, folding, and defined results for odd rows."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quillstone.llm import toxicity

DOCS = "doc_id long, text string"


def words(rng, n):
    return " ".join(f"w{rng.randrange(4000)}" for _ in range(n))


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), DOCS).withColumn("score", F.lit("mine")).withColumn("row", F.lit("mine")).withColumn("y", F.lit("mine"))


def test_toxicity_learns_and_folds(spark):
    rng = random.Random(6)
    texts, toxic = [], []
    for i in range(160):
        bad = i % 4 == 0
        texts.append(words(rng, 40) + (f" you moron {words(rng, 5)} idi0t" if bad else "") + (" paper trash can" if i % 8 == 3 else ""))
        toxic.append(int(bad))
    texts += ["m0rоn", None, "", "MORON!", "trash can"]
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)] + [(3, 1, None)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in toxicity.score_toxicity(docs(spark, texts), labels).collect()}
    assert all((out[i]["score"] >= 0.5) == bool(t) for i, t in enumerate(toxic))
    assert out[160]["score"] >= 0.5 and out[163]["score"] >= 0.5  # a digit, a Cyrillic letter, upper case
    assert max(out[k]["score"] for k in (161, 162, 164)) < 0.5
    lexicon = toxicity.Lexicon({" trash ": 5.0}, (" trash can ",))
    assert lexicon.matches(lexicon.automaton(), toxicity.fold(b"a trash can")) == [] and lexicon.matches(lexicon.automaton(), toxicity.fold(b"a trash bin"))


@pytest.mark.parametrize("seed", range(30))
def test_of_overlapping_terms_the_heaviest_stays(seed):
    rng = random.Random(seed)
    text = toxicity.fold(" ".join(rng.choice(["ab", "abc", "cab", "bcabc"]) for _ in range(8)).encode())
    terms = {t: float(w) for w, t in enumerate(rng.sample([" ab ", " abc", " ca", " cab ", " bc", " bca", " ab", " bcabc "], 5), 1)}
    lexicon = toxicity.Lexicon(terms)
    got = lexicon.matches(lexicon.automaton(), text)
    spans = [(i, i + len(t), w) for t, w in terms.items() for i in range(len(text)) if text.startswith(t, i)]
    apart = lambda x, y: x[1] - 1 <= y[0] or y[1] - 1 <= x[0]
    left, want = sorted(spans, key=lambda x: (-x[2], x[0])), []
    while left:  # the heaviest of all, then the heaviest of those that do not overlap it, and so on
        want.append(left[0])
        left = [x for x in left[1:] if apart(x, left[0])]
    assert got == sorted(want) and all(apart(x, y) for x, y in itertools.combinations(got, 2))


def test_folding():
    assert toxicity.fold("M0R0N mоrоn ｍｏｒｏｎ m\u200boron".encode()).split() == ["moron"] * 4
    assert toxicity.fold(b"1337 a 10.5 2024-01-15 (77)").split() == ["a"]  # numbers are no words
    assert toxicity.fold(b"l33t").split() == ["ieet"] and toxicity.fold(b"") == "  "


def test_odd_rows_and_tables(spark):
    texts = ["you moron"] * 30 + ["nice day"] * 60 + [None, "", "moron " * 50_000]
    labels = spark.createDataFrame([(i, int(i < 30)) for i in range(90)] + [(None, 1), (1, None), (2, 7), (3, 0), (500, 1)], "doc_id long, toxic int")
    df = docs(spark, texts).union(docs(spark, texts[:5]))
    out = toxicity.score_toxicity(df, labels, held_fold=None)
    assert out.columns == ["doc_id", "text", "row", "y", "score"] and out.count() == 98
    assert all((r.score >= 0.5) == ("moron" in (r.text or "")) for r in out.collect())
    assert toxicity.score_toxicity(df, labels.limit(0)).filter("score <> 0").count() == 0
    assert toxicity.score_toxicity(df, labels.filter("toxic = 1")).filter("score <> 0").count() == 0
    assert toxicity.score_toxicity(df.limit(0), labels).count() == 0
    renamed = toxicity.score_toxicity(df.withColumnRenamed("doc_id", "k"), labels.withColumnRenamed("doc_id", "k"), id_col="k")
    assert renamed.filter("score >= 0.5").count() == 36
