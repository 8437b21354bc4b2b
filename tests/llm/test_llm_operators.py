"""Training-data operators against brute force on small fixtures, with their stated edge cases."""

import random
from collections import Counter
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from quillstone.llm import exact_dedup, minhash, mixing, packing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, source="s0"):
    rows = [(i, t, "en", source if isinstance(source, str) else source[i], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).withColumn("h", F.lit("clash")).withColumn("id", F.lit("clash"))


def words(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def test_exact_groups(spark):
    texts = ["a b", "ab", " a\tb\n", None, "", "c", "A b", "x" * 50_000, "x" * 50_000]
    df = docs(spark, texts).union(docs(spark, ["a b"]))
    out = {r.doc_id: r for r in exact_dedup.exact_groups(df).collect()}
    assert out[1].keep_id == 2 and out[2].kept and out[0].group_size == 4  # id 0 is there twice
    assert out[3].keep_id == 3 and out[4].keep_id == 3 and out[6].group_size == 1 and out[8].keep_id == 7
    assert out[5].text_sha256 == sha256(b"c").hexdigest()
    kept = exact_dedup.drop_copies(df)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 5, 6, 7] and kept.columns == df.columns
    assert exact_dedup.exact_groups(df.limit(0)).count() == 0


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(5)
    base = [words(rng, 120) for _ in range(6)]
    texts = [None, "", "one two", "ONE two", "one two three four"]
    for b in base:
        for _ in range(6):
            w = b.split()
            for _ in range(rng.randint(0, 8)):
                w[rng.randrange(len(w))] = f"z{rng.randrange(99999)}"
            texts.append(" ".join(w))
    out = {r.doc_id: r for r in minhash.near_duplicates(docs(spark, texts), ngram=3, percent=85).collect()}
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(i):
                if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    assert [out[i].component_id for i in range(len(texts))] == root
    assert [out[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]


def test_mixing_budgets_and_order(spark):
    rng = random.Random(2)
    source = ["big"] * 60 + ["mid"] * 25 + ["tiny"] * 8 + [None] * 4 + ["void"]
    texts = [words(rng, rng.randint(5, 30)) for _ in source[:-1]] + [None]
    df = docs(spark, texts, source)
    out = mixing.mix_sources(df, max_repeats=2.0, block_tokens=100).toPandas()
    size = Counter()
    for t, s in zip(texts, source):
        size[s] += len((t or "").split())
    assert set(out.doc_id) == set(range(len(texts)))  # the least budget that shows every source once shows every document
    for s, rows in out.groupby("source", dropna=False):
        rows = rows.sort_values(["start", "n_tokens"])
        budget = rows.budget_tokens.iloc[0]
        assert (rows.start.to_numpy()[1:] >= rows.start.to_numpy()[:-1]).all() and (rows.start + rows.n_tokens).max() <= budget
        assert budget <= 2.001 * size[s if isinstance(s, str) else None] + 1
    # the exponent is where the limit binds: the flattest mix in which no source is shown over twice as often as the largest
    shares = {s: n / sum(size.values()) for s, n in size.items() if n}
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        worst = max((p / max(shares.values())) ** (mid - 1) for p in shares.values())
        lo, hi = (mid, hi) if worst > 2 else (lo, mid)
    z = sum(p**hi for p in shares.values())
    got = dict(zip(out.source, out.weight))
    assert got["mid"] == pytest.approx(shares["mid"] ** hi / z, rel=1e-6)
    assert mixing.mix_sources(df.limit(0)).count() == 0
    again = mixing.mixed_documents(df, max_repeats=2.0, block_tokens=100)
    assert again.columns == df.columns and again.count() == len(out)


def test_packing_respects_conflicts_and_loses_nothing(spark):
    rng = random.Random(4)
    texts = [words(rng, rng.choice([3, 10, 40, 90, 250])) for _ in range(80)] + ["same text here"] * 30 + [None, ""]
    df = docs(spark, texts, [f"s{i % 3}" for i in range(len(texts))])
    out = packing.pack(df, capacity=100, per_source=2, shard_docs=60).toPandas()
    assert out.groupby("doc_id").n_tokens.sum().to_dict() == {i: len((t or "").split()) for i, t in enumerate(texts)}
    for _, b in out.groupby(["shard", "bin"]):
        b = b.sort_values(["start", "n_tokens"])
        assert b.n_tokens.sum() == b.filled.iloc[0] <= 100 and (b.start.to_numpy()[1:] == (b.start + b.n_tokens).to_numpy()[:-1]).all()
        keys = ["".join((texts[i] or "").split()) for i in b.doc_id]
        assert len(set(keys)) == len(keys) and max(Counter(i % 3 for i in b.doc_id).values()) <= 2
    assert packing.pack(df.limit(0)).count() == 0


def test_packer_takes_the_tightest_compatible_bin():
    p = packing.Packer(10, 2)
    assert [p.add(7, 1, 1)[0], p.add(5, 1, 2)[0], p.add(6, 2, 4)[0]] == [0, 1, 2]
    assert p.add(3, 2, 1) == (2, 6)  # bin 0 is tightest but holds the cluster; bin 2 is next
    assert p.add(3, 1, 8) == (0, 7)
    assert p.add(4, 1, 16) == (1, 5) and p.add(1, 1, 32)[0] not in (0, 1)  # bin 1 has its two of source 1
