"""Spacing, spans, passages, criteria, base rates, segments and the schema check against plain Python."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillstone.functions import schema
from quillstone.operators import base_rates, criteria, overlap, passages, segments, spacing
from quillstone.streaming.resume import append_new


def plain_model(texts):
    seen = defaultdict(lambda: [0, 0])
    for t in texts:
        for line in t.split("\n"):
            words = line.split()
            s = "".join(words)
            if len(" ".join(words)) < 4:
                continue
            ends = {sum(map(len, words[: k + 1])) for k in range(len(words))}
            for i in range(1, len(s)):
                for a, b in spacing.WINDOWS:
                    if i >= a and i + b <= len(s):
                        seen[f"{a}_{b}:{s[i - a : i + b]}"][i in ends] += 1
    kept = {c: v for c, v in seen.items() if sum(v) >= spacing.MIN_COUNT}
    odds = {c: max(-4.0, min(4.0, math.log((y + 0.5) / (n + 0.5)))) for c, (n, y) in kept.items()}
    return odds, math.log((sum(v[1] for v in kept.values()) + 1) / (sum(v[0] for v in kept.values()) + 1))


def plain_restore(odds, prior, line):
    s = line.replace(" ", "")
    kept = {len(line[:k].replace(" ", "")) for k, c in enumerate(line) if c == " "}
    out = s[:1]
    for i in range(1, len(s)):
        known = [odds[c] for a, b in spacing.WINDOWS if i >= a and i + b <= len(s) and (c := f"{a}_{b}:{s[i - a : i + b]}") in odds]
        score = sum(known) / len(known) if known else prior
        out += (" " if i in kept or score > 0 else "") + s[i]
    return out


def test_spaces_are_restored_as_by_hand(spark):
    rng = random.Random(3)
    vocabulary = ["ab", "abc", "cab", "dd", "edda", "a", "bcd"]
    texts = ["\n".join(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 9))) for _ in range(3)) for _ in range(25)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = spacing.train(df)
    odds, prior = plain_model(texts)
    assert {r.context: r.odds for r in model[0].collect()} == pytest.approx(odds) and model[1] == pytest.approx(prior)
    bare = ["abcabdd", "ab cabdd", "a", "", None, "zzqq", "abc\n\ncabdd", "​abdd"]
    out = {r.doc_id: r.restored for r in spacing.restore(model, spark.createDataFrame(list(enumerate(bare)), "doc_id long, text string")).collect()}
    assert [out[i] for i in range(len(bare))] == ["\n".join(plain_restore(odds, prior, x) for x in (t or "").replace("​", "").split("\n")) for t in bare]
    best = [r for r in spacing.evaluate(model, df).collect() if r.best]
    assert len(best) == 1 and best[0].f1 == max(r.f1 for r in spacing.evaluate(model, df).collect())


def plain_span(a, b):
    best = ""
    covered = set()
    for i in range(len(a) - 3):
        j = b.find(a[i : i + 4])
        if i in covered or j < 0:
            continue
        x, y = i, j
        while x and y and a[x - 1] == b[y - 1]:
            x, y = x - 1, y - 1
        n = 0
        while x + n < len(a) and y + n < len(b) and a[x + n] == b[y + n]:
            n += 1
        covered.update(range(x, x + n - 3))
        best = max(best, a[x : x + n], key=len)
    return best


@pytest.mark.parametrize("seed", range(40))
def test_spans_grow_from_first_places(seed):
    rng = random.Random(seed)
    a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 40))) for _ in range(2))
    assert overlap.seeded_span(a, b) == plain_span(a, b)
    whole = max((a[i:j] for i in range(len(a)) for j in range(i, len(a) + 1) if a[i:j] in b), key=len, default="")
    assert len(overlap.longest_common(a, b)) == len(whole)


def test_first_places_may_hide_a_longer_passage():
    assert overlap.seeded_span("abcde", "abcd.bcde.abcde") == "abcd" and overlap.longest_common("abcde", "abcd.bcde.abcde") == "abcde"


def test_passages_of_every_length_are_found(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(1, 4)))
    texts = [" ".join(word() for _ in range(60)) for _ in range(30)]
    items = ["", " ", "ab", "a b"]
    for n in (1, 2, 3, 4, 5, 7, 8, 9, 15):
        for _ in range(3):
            w = rng.choice(texts).split()
            at = rng.randrange(len(w) - n)
            items.append("  ".join(w[at : at + n])[rng.randint(0, 1) :])  # also from within a word
    items += ["no such words here at all", "zz"]
    flat = lambda t: " ".join(t.split())
    got = {r.item_id: (r.docs, r.first_doc) for r in passages.found(spark.createDataFrame(list(enumerate(texts)) + [(99, None)], "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    want = {i: [d for d, t in enumerate(texts) if flat(x) and flat(x) in flat(t)] for i, x in enumerate(items)}
    assert got == {i: (len(d), min(d)) for i, d in want.items() if d}


def test_criteria_are_rejected_for_every_reason(spark):
    rows = [
        ("n", "요청 행위가 소비자에게 불이익을 초래하는가", "근거 문장", "a", "여기 근거  문장이 있다"),
        ("", "이 사안은 조치 대상인가?", "", "x", "r"),
        (None, None, None, None, None),
        ("n", "요청인이 제재 이력을 보유하고 있는가", "•근거", "b", "근 거"),
    ]
    df = spark.createDataFrame(rows, "name string, question string, quote string, implies string, reasoning string")
    got = [r[0] for r in df.select(criteria.problems(*[F.col(c) for c in df.columns], ["a", "b"])).collect()]
    assert got == [[], ["no_name", "circular", "ungrounded", "unknown_label"], ["no_name", "no_question", "ungrounded", "unknown_label"], []]


def test_criteria_that_ask_the_same_are_one(spark):
    ask = ["is the customer harmed by it", "is the customer harmed by this", "is the customer harmed by it", "was the fund registered abroad", "was the fund registered abroad", "does a contract exist at all"]
    items = [(i, q, f"n{i % 2}", "a" if i < 3 else "b", i // 2, "a" if i < 3 else "b" if i < 5 else "a") for i, q in enumerate(ask)]
    cases = [("a",)] * 20 + [("b",)] * 10
    out = criteria.consolidate(spark.createDataFrame(items, "id long, question string, name string, implies string, serial long, decision string"), spark.createDataFrame(cases, "label string"), least=3).orderBy("id").collect()
    assert {r.label: r.floor for r in criteria.floors(spark.createDataFrame(cases, "label string"), 3).collect()} == {"a": 3, "b": 2}  # 1.5 to even
    assert [(r.id, r.question, r.name, r.support, r.sources, r.implies, r.observed) for r in out] == [(0, ask[0], "n0", 3, 2, "a", "a"), (1, ask[3], "n1", 2, 2, "b", "b")]


def test_sentences_fall_back_to_all_cases(spark):
    gold = spark.createDataFrame([("s", "a")] * 7 + [("s", "b")] + [("t", "b")] * 2, "source string, label string")
    got = {r.source: r.sentence for r in base_rates.sentences(gold, "source", ["a", "b", "c"]).collect()}
    assert got == {"s": "Of 8 past cases of s: a 88%, b 12%, c 0%. Never: c.", "t": "Of 10 past cases: a 70%, b 30%, c 0%."}


def test_refused_keywords_are_named_where_they_stand():
    bad = {"type": "object", "properties": {"xs": {"type": "array", "maxItems": 3, "items": [{"uniqueItems": True}]}}}
    assert [p.split(":")[0] for p in schema.problems(bad)] == ["$.properties.xs.maxItems", "$.properties.xs.items[0].uniqueItems"]
    assert schema.problems({"type": "string"}) == [] and schema.problems(None) == []


def test_cases_dividers_and_health(spark):
    part = spark.createDataFrame([("No 123 allowed, allowed",), ("denied but allowed No 9",), ("x" * 250 + " denied",), ("",)], "p string")
    serial, said, label, warnings = segments.case_fields(F.col("p"), r"No (\d+)", ["allowed", "denied"])
    got = [tuple(r) for r in part.select(serial, said, label, warnings).collect()]
    assert got == [("123", ["allowed"], "allowed", []), ("9", ["denied", "allowed"], None, ["several_decisions"]), (None, [], None, ["no_serial", "no_decision"]), (None, [], None, ["no_serial", "no_decision"])]
    report = Counter({(r.kind, r.value): r.n for r in segments.extraction_report(part.union(part.limit(1)).select(serial.alias("serial"), label.alias("label"), warnings.alias("warnings"))).collect()})
    assert report["label", "none"] == 3 and report["duplicate_serial", "123"] == 2 and report["warning", "no_serial"] == 2
    pages = spark.createDataFrame([(1, " Part\n One "), (2, "Part " + "x" * 100), (3, "text")], "n int, t string")
    assert [r[0] for r in pages.orderBy("n").select(segments.divider(F.col("t"), ["^Part"])).collect()] == ["Part One", None, None]
    assert pages.select(segments.composed(F.lit("é"))).first()[0] == "é"
    long = spark.createDataFrame([("가" * 300 + " a" * 3000,), ("가 나" * 200,), ("abc",)], "t string")
    assert [r[0] for r in long.select(segments.spacing_lost(F.col("t"))).collect()] == [False, False, False]
    assert spark.createDataFrame([("가" * 300,)], "t string").select(segments.spacing_lost(F.col("t"))).first()[0]


def test_appends_skip_what_is_done(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k long, sha string")
    rows.write.parquet(f"{tmp_path}/in")
    for run in range(3):
        stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
        append_new(stream, f"{tmp_path}/out", ["k", "sha"], f"{tmp_path}/c{run}").awaitTermination()
        if run == 1:
            spark.createDataFrame([(2, "changed"), (3, "c")], "k long, sha string").write.mode("append").parquet(f"{tmp_path}/in")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == [(1, "a"), (2, "b"), (2, "changed"), (3, "c")]
