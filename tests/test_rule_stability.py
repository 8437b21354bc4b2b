"""Rule stability against a plain recount of every fold."""

import random
from collections import Counter

from pyspark.sql import functions as F

from quillstone.functions.text import squeeze
from quillstone.operators import bitmaps, rules
from quillstone.plans import learn_queries


def _rows():
    words = ["alpha", "bravo", "comet", "delta", "eagle", "forum", "gamma", "hotel"]
    out = []
    for i in range(60):
        w, x = words[i % 8], words[(i * 5 + i // 8) % 8]
        label = "rare" if w in "alpha bravo comet" and x != "delta" else "other" if w in "delta eagle" and i % 5 else "major"
        # zebra stands in one fold less than it is learned in
        out.append((i, f"{w} {x} {'zebra' if i % 5 and i % 7 == 0 else ''}", f"s{i % 3}", "rare" if i % 5 and i % 7 == 0 else label, i))
    return out


def test_every_firing_and_every_fold_counts(spark):
    df = spark.createDataFrame(_rows(), "doc_id long, text string, source string, label string, pos long")
    got = {r.name.rpartition(" => ")[0]: (r.folds, r.support, r.correct) for r in rules.stability(df).collect()}
    flat = {r.doc_id: (r.t, r.source, r.label) for r in df.select("doc_id", squeeze(F.col("text")).alias("t"), "source", "label").collect()}
    vocabulary = rules.atoms(df)
    folds, support, correct = Counter(), Counter(), Counter()
    for k in range(5):
        train = df.filter(F.col("pos") % 5 != k)
        learned, _ = rules.induce(train, vocabulary.join(train.select(F.col("doc_id").alias("doc")), "doc", "left_semi"))
        for r in learned:
            name = " AND ".join(f"{a}:{v}" for a, v in sorted(r.atoms))
            folds[name] += 1
            for i, (t, source, label) in flat.items():
                fires = all(v in t if kind == "ngram" else v == source if kind == "sector" else v == "short" for kind, v in r.atoms)
                if i % 5 == k and fires:
                    support[name] += 1
                    correct[name] += label == r.label
    assert got == {x: (folds[x], support[x], correct[x]) for x in folds}
    assert any(s < 1 for _, s, _ in got.values()) or max(f for f, _, _ in got.values()) > 1


def test_the_query_sets_no_limits(spark, monkeypatch, tmp_path):
    seen = {}
    monkeypatch.setattr(learn_queries, "run_sql", lambda s, d, q: s.createDataFrame(_rows(), "doc_id long, text string, source string, label string, pos long"))
    monkeypatch.setattr(learn_queries.R, "stability", lambda rows, **limits: seen.update(limits) or rows)
    learn_queries.QUERIES["r10_rule_stability"](spark, str(tmp_path))
    assert seen == {}


def _plain_covering(held, label, beam_width=12, min_support=4, min_precision=0.8, depth=3):
    """Sequential covering over sets: held has the rows of each (kind, value)."""
    names, live, learned, dropped = sorted(label.values()), set(label), [], []
    kinds = len(set(names))
    while True:
        beam, best, best_score = [()], None, -1.0
        for _ in range(depth):
            scored = []
            for k, combo in enumerate(beam):
                rows = live.intersection(*(held[a] for a in combo))
                for atom in held.keys() - set(combo):
                    got = rows & held[atom]
                    if len(got) >= min_support:
                        correct, said = max((sum(label[i] == x for i in got), x) for x in set(names))
                        scored.append((-(correct + 1) / (len(got) + kinds), -len(got), sorted(v for _, v in (*combo, atom)), k, *atom, (*combo, atom), said, correct))
            scored = sorted(scored)[:beam_width]
            for s in scored:
                if s[8] / -s[1] < min_precision:
                    dropped.append((len(learned) + 1, s[6], s[7], -s[1], s[8]))
                elif -s[0] > best_score:
                    best, best_score = (len(learned) + 1, s[6], s[7], -s[1], s[8]), -s[0]
            beam = [s[6] for s in scored]
        if best is None:
            rest = Counter(label[i] for i in sorted(live or label))
            return learned, max(rest, key=lambda x: rest[x]) if rest else "", dropped
        learned.append(best)
        live -= live.intersection(*(held[a] for a in best[1]))


def _said(listed):
    return [(r.order, r.atoms, r.label, r.support, r.correct) for r in listed]


def test_bitmaps_learn_what_plain_sets_learn(spark):
    """Over several blocks, with rows that have no label and rows that hold no atom."""
    rng = random.Random(4)
    rows = [(3 * i, rng.choice(["a", "b", "b", "c", "c", None])) for i in range(300)]
    label = {i: x for i, x in rows if x}
    held = {("ngram", f"g{j:02}"): {i for i, x in rows if rng.random() < (0.3 if x == "abc"[j % 3] else 0.06)} for j in range(9)}
    inc = spark.createDataFrame([(kind, value, i) for (kind, value), at in held.items() for i in at], "kind string, value string, doc long")
    df = spark.createDataFrame(rows, "doc_id long, label string").withColumn("text", F.lit(None).cast("string"))
    labelled = {a: at & set(label) for a, at in held.items()}
    got = rules.induce_with_discards(df, inc)
    want, default, dropped = _plain_covering(labelled, label)
    assert len(want) > 2 and (_said(got.rules), got.default) == (want, default)
    assert dropped and _said(got.dropped) == dropped
    assert rules.induce(df, inc, max_rules=1)[0] == got.rules[:1]
    assert bitmaps.build(inc, df.select(F.col("doc_id").alias("doc"), "label", F.lit(0).alias("fold"))).blocks.count() == -(-len(label) // 64) > 2
    assert rules.induce(df.limit(0), inc) == ([], "") and rules.stability(df.withColumn("pos", F.lit(0)).withColumn("source", F.lit("s"))).count() == 0


def test_folds_learned_in_step_equal_folds_learned_alone(spark):
    df = spark.createDataFrame(_rows(), "doc_id long, text string, source string, label string, pos long")
    inc = rules.atoms(df)
    runs = rules.learn(bitmaps.build(inc, df.select(F.col("doc_id").alias("doc"), "label", (F.col("pos") % 5).alias("fold"))), [3, -1])
    for run, part in zip(runs, (df.filter("pos % 5 <> 3"), df)):
        alone = rules.induce_with_discards(part, inc)
        assert (run.rules, run.default, run.dropped) == (alone.rules, alone.default, alone.dropped)
