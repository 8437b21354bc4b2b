"""Mixing against exponents and positions worked out in plain Python; packing against a plain best fit."""

import math
import random
from collections import Counter, defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillstone.llm import mixing, packing

DOCS = "doc_id long, text string, source string"


def docs(spark, rows):
    return spark.createDataFrame([(i, " ".join("w" for _ in range(n)) if n is not None else None, s) for i, n, s in rows], DOCS)


@pytest.fixture(scope="module")
def shares(spark):
    return {"a": 500, "b": 300, "c": 200}


@pytest.mark.parametrize("target", [0.2, 0.5, 0.9, 1.0, 1.05])
def test_exponent_meets_the_target_entropy(spark, shares, target):
    df = spark.createDataFrame([(s, n, n / 1000) for s, n in shares.items()], "src string, tokens long, share double")
    x = mixing.find_exponent(df, target, None, None)
    w = [(n / 1000) ** x for n in shares.values()]
    w = [v / sum(w) for v in w]
    assert -sum(v * math.log(v) for v in w) == pytest.approx(target, abs=1e-5)


def test_exponents_at_the_ends(spark, shares):
    df = spark.createDataFrame([(s, n, n / 1000) for s, n in shares.items()], "src string, tokens long, share double")
    assert mixing.find_exponent(df, 5.0, None, None) == 0.0  # more than the logarithm of three
    steep = mixing.find_exponent(df, -1.0, None, None)  # below what any exponent gives: the largest source has all the weight
    assert steep < 1000 and (300 / 500) ** steep < 1e-19
    assert mixing.find_exponent(df, None, 1.0, None) == pytest.approx(1.0, abs=1e-6) and mixing.find_exponent(df, None, 100.0, None) == 0.0
    assert mixing.find_exponent(df, None, 1.0, 50.0) == 1.0  # a budget that repeats every source whatever the exponent


@pytest.mark.parametrize("target", [0.01, 0.3, 0.9])
def test_near_equal_shares_reach_any_entropy(spark, target):
    near = {"a": 0.3334, "b": 0.3333, "c": 0.3333}
    x = mixing.find_exponent(spark.createDataFrame(list(near.items()), "src string, share double"), target, None, None)
    w = [(v / 0.3334) ** x for v in near.values()]
    w = [v / sum(w) for v in w]
    assert x > 32 and -sum(v * math.log(v) for v in w) == pytest.approx(target, abs=1e-5)


def test_tied_largest_sources_bound_the_entropy_from_below(spark):
    df = spark.createDataFrame([("a", 0.4), ("b", 0.4), ("c", 0.2)], "src string, share double")
    x = mixing.find_exponent(df, 0.1, None, None)
    assert 0.5**x < 1e-19 and mixing.find_exponent(df.filter("src <> 'c'"), 0.1, None, None) == 1.0


def test_repeated_and_null_ids_give_the_same_stream_in_any_order(spark):
    rng = random.Random(7)
    rows = [(rng.choice([None, None, 5, 6, i]), rng.choice([0, 3, 3, 8, 400]), rng.choice(["a", "a", "a", None])) for i in range(160)]
    runs = []
    for df in (docs(spark, rows), docs(spark, rows[::-1]).repartition(7)):
        out = mixing.mix_sources(df, budget=30000, max_repeats=2.0, block_tokens=700).collect()
        runs.append(Counter((r.doc_id, r.source, r.epoch, r.n_tokens, r.start, round(r.mix_key, 9)) for r in out))
    first = Counter((r[0], r[1], r[3]) for r in runs[0].elements() if r[2] == 0)
    assert runs[0] == runs[1] and first == Counter((i, s, n) for i, n, s in rows)


def brute_rows(rows, out):
    """What any right result must be, from its own epochs: whole permutations, streams without gaps, cut at the budget."""
    size = {i: n or 0 for i, n, _ in rows}
    by = defaultdict(list)
    for r in out:
        by[r.source].append(r)
    for source, held in by.items():
        ids = {i for i, _, s in rows if s == source}
        total = sum(size[i] for i in ids)
        budget = held[0].budget_tokens
        for k in range(max(r.epoch for r in held)):
            assert {r.doc_id for r in held if r.epoch == k} == ids  # only the last epoch is cut
        ends = sorted((r.start, r.start + r.n_tokens) for r in held if r.n_tokens)
        assert all(b <= budget for _, b in ends)
        seen = sorted({a for a, _ in ends})
        assert len(seen) == len(ends)  # no two documents of tokens begin at one place
        for (a, b), (c, _) in zip(ends, ends[1:]):
            assert c >= b and (c == b or c >= total * (held[0].budget_tokens // max(total, 1)))  # gaps only where documents no longer fit
        last = budget - total * (budget // max(total, 1))
        assert sum(b - a for a, b in ends) >= total * (budget // max(total, 1)) and last >= 0


@pytest.mark.parametrize("options", [{}, {"max_repeats": 3.0}, {"budget": 4000}, {"target_entropy": 1.2, "budget": 3000}, {"target_entropy": 0.4, "budget": 3000}])
def test_streams_are_whole_permutations_cut_at_their_budgets(spark, options):
    rng = random.Random(2)
    rows = [(i, rng.randint(0, 30), rng.choice(["big"] * 12 + ["mid"] * 4 + ["tiny", None])) for i in range(150)] + [(200, None, "void"), (201, 0, "void")]
    out = mixing.mix_sources(docs(spark, rows), block_tokens=90, **options).collect()
    brute_rows(rows, out)
    assert sum(r.budget_tokens for r in {r.source: r for r in out}.values()) == pytest.approx(options.get("budget", sum(r.budget_tokens for r in {r.source: r for r in out}.values())), abs=5)
    assert {r.doc_id for r in out if r.source == "void"} == {200, 201}
    again = mixing.mix_sources(docs(spark, rows).orderBy(F.desc("doc_id")).repartition(5), block_tokens=90, **options).collect()
    key = lambda r: (r.doc_id, r.epoch, r.start, r.budget_tokens, round(r.mix_key, 9))
    assert sorted(map(key, out)) == sorted(map(key, again))


def test_copies_keep_columns_and_rows_of_one_id_apart(spark):
    rows = [(1, 10, "a"), (2, 20, "a"), (2, 5, "b"), (2, 7, "b"), (None, 3, "b"), (None, None, None)]
    df = docs(spark, rows).withColumn("n", F.lit("mine")).withColumn("row", F.lit("mine")).withColumn("times", F.length("text")).withColumn("key", F.lit(1))
    out = mixing.mixed_documents(df, max_repeats=2.0)
    assert out.columns == df.columns
    got = Counter((r.doc_id, r.source, len((r.text or "").split())) for r in out.collect())
    assert set(got) == {(i, s, n or 0) for i, n, s in rows} and max(got.values()) <= 3 and {r.n for r in out.collect()} == {"mine"}
    assert mixing.mixed_documents(df.limit(0)).count() == 0
    tiny = mixing.mix_sources(docs(spark, [(1, 1, "tiny"), (2, 4000, "big")]), target_entropy=math.log(2), max_repeats=None, budget=9000)
    assert tiny.filter("source = 'tiny'").count() == pytest.approx(4500, abs=5)


def best_fit(pieces, capacity, per_source):
    """(size, source, cluster) in order -> bin of each: of the bins with room and no conflict the fullest, then the oldest."""
    bins, out = [], []
    for n, source, cluster in pieces:
        fits = [k for k, b in enumerate(bins) if sum(x[0] for x in b) + n <= capacity and all(x[2] != cluster for x in b) and sum(x[1] == source for x in b) < per_source]
        k = min(fits, key=lambda k: (capacity - sum(x[0] for x in bins[k]), k), default=len(bins))
        if k == len(bins):
            bins.append([])
        bins[k].append((n, source, cluster))
        out.append(k)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_packing_is_a_plain_best_fit(seed):
    rng = random.Random(seed)
    pdf = pd.DataFrame({"id": range(120), "source": [rng.choice([None, "a", "b"]) for _ in range(120)], "cluster": [rng.choice("cdefghijklmnop") for _ in range(120)], "n": [rng.choice([1, 3, 8, 20, 41, 77, 130]) for _ in range(120)], "shard": 0})
    got = packing.pack_frame(pdf, 50, 2)
    assert got.groupby("id").n_tokens.sum().to_dict() == dict(zip(pdf.id, pdf.n))
    pieces = [(int(r.n_tokens), pdf.source[r.id], pdf.cluster[r.id]) for r in got.itertuples()]
    assert [p[0] for p in pieces] == sorted((p[0] for p in pieces), reverse=True) and got.bin.tolist() == best_fit(pieces, 50, 2)


def test_packing_of_odd_rows(spark):
    rows = [(1, 30, None), (2, None, "a"), (3, 0, "a"), (None, 10, "a"), (None, 12, "a"), (5, 120, "b")] + [(7, 9, "c")] * 40
    out = packing.pack(docs(spark, rows).withColumn("shard", F.lit(1)).withColumn("key", F.lit(2)), capacity=50, shard_docs=8).collect()
    empty = [r for r in out if not r.n_tokens]
    assert sorted(r.doc_id for r in empty) == [2, 3] and all(r.bin is None and r.start is None for r in empty)
    assert sum(r.n_tokens for r in out) == 30 + 10 + 12 + 120 + 360 and len([r for r in out if r.doc_id == 7]) == 40
    same = Counter((r.shard, r.bin) for r in out if r.doc_id == 7)
    assert max(same.values()) == 1 and len({s for s, _ in same}) > 1  # equal rows meet in no bin and spread over the shards
    assert packing.pack(docs(spark, rows).limit(0)).count() == 0
