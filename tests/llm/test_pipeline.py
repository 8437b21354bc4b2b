"""The pipeline on odd rows: each stage's decisions take effect on all its predecessor kept, and its rows are what plain Python says."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join(f"w{rng.randrange(900)}" for _ in range(n))


def junk(rng, n):
    return " ".join(f"W{rng.randrange(900)}!!" for _ in range(n))


def shingles(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def near_groups(texts):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(i):
                if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    return root


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(9)
    base = [words(rng, 60) for _ in range(25)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(base)]
    rows += [(100, base[0], "en", "s0", 1), (101, base[1] + " ", "en", "s0", 1), (102, base[2] + " tail", "en", "s1", 1), (5, words(rng, 40), "en", "s1", 1), (6, base[6], "en", "s0", 360)]
    rows += [(None, words(rng, 50), None, None, None), (None, words(rng, 50), "en", "s2", 5), (103, None, "en", "s2", None), (104, "", None, "s2", 0), (105, words(rng, 9000), "en", "s1", 60_000)]
    rows += [(200 + i, junk(rng, rng.randint(10, 60)), "en", f"s{i % 3}", 300) for i in range(12)]
    labels = [(i, 1) for i in range(25)] + [(200 + i, 0) for i in range(9)] + [(103, 1), (104, 1), (None, 0), (999, 0), (3, None)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").withColumn("toxic", F.lit(0)).write.parquet(f"{path}/labels.parquet")
    return rows, path


def test_every_stage_against_plain_python(spark, tables):
    rows, path = tables
    key = lambda r: (r[0], r[1])
    seen, now = {}, spark.read.parquet(f"{path}/documents.parquet")
    columns = now.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, path)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert now.columns == columns
        now.write.parquet(f"{path}/{k}")
        now = spark.read.parquet(f"{path}/{k}")
        seen[name] = now.collect()
    good = [r for r in rows if "!!" not in (r[1] or "")]
    quality = Counter(map(key, seen["quality"]))
    assert quality == Counter(map(key, good))
    # of equal texts the longest original, then the smallest id, stays; null ids come last
    groups = {}
    for r in good:
        groups.setdefault("".join((r[1] or "").split()), []).append(r)
    keep = [min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)) for g in groups.values()]
    assert Counter(map(key, seen["exact_dedup"])) == Counter(map(key, keep))
    order = sorted(keep, key=lambda r: (r[0] is None, r[0] or 0))
    root = near_groups([r[1] for r in order])
    near = Counter(map(key, seen["near_dedup"]))
    want = Counter(key(r) for i, r in enumerate(order) if root[i] == i)
    same = lambda c: {k: n for k, n in c.items() if k[0] is not None}  # noqa: E731  rows of one id, or none, have no order among themselves
    assert same(near) == same(want) and sum(near.values()) == sum(want.values())
    mixed = Counter(map(key, seen["mixing"]))
    assert set(mixed) == set(near) and max(mixed.values()) <= 2  # every document, and at most the repetitions the limit allows
    packed = Counter()
    for r in seen["packing"]:
        packed[r.doc_id] += r.n_tokens
    tokens = Counter()
    for (i, t), n in mixed.items():
        tokens[i] += n * len((t or "").split())
    assert packed == tokens
    bins = Counter()
    for r in seen["packing"]:
        if r.bin is not None:
            bins[r.shard, r.bin] += r.n_tokens
    assert max(bins.values()) <= 2048 and all(r.filled == bins[r.shard, r.bin] for r in seen["packing"] if r.bin is not None)


def test_clashing_columns_and_empty_tables(spark, tables):
    rows, path = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    odd = docs.withColumns({c: F.lit("mine") for c in ("p", "row", "key", "id", "n", "times", "h", "cls", "shard", "label")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, path)
        assert out.columns == odd.columns, name
        assert {r.p for r in out.select("p").distinct().collect()} == {"mine"}
        assert stage(spark, odd.limit(0), path).count() == 0
    assert corpus_pipeline.packing(spark, odd, path).count() > 0 and corpus_pipeline.packing(spark, odd.limit(0), path).count() == 0


def test_run_is_its_stages_in_turn(spark, tables):
    rows, path = tables
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]
    out = corpus_pipeline.run(spark, path)
    assert out.columns == ["doc_id", "part", "n_tokens", "shard", "bin", "start", "filled"] and out.agg(F.sum("n_tokens")).first()[0] > 0
