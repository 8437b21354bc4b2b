import random

import pytest
from pyspark.sql import functions as F

from quillstone.llm.line_dedup import drop_repeated_lines, repeated_runs


def brute_runs(docs):
    pos = [(d, i) for d, ls in sorted(docs.items()) for i in range(len(ls))]
    out = {}
    for b, (d, i) in enumerate(pos):
        best = 0
        for d2, j in pos[:b]:
            n = 0
            while i + n < len(docs[d]) and j + n < len(docs[d2]) and docs[d][i + n] == docs[d2][j + n]:
                n += 1
            best = max(best, n)
        if best:
            out[d, i] = best
    return out


@pytest.mark.parametrize("seed,letters,n,size", [(1, "ab", 5, 9), (2, "abcd", 8, 14), (3, "abcdefgh", 10, 20)])
def test_runs_match_brute_force(spark, seed, letters, n, size):
    rng = random.Random(seed)
    docs = {d: [rng.choice(letters) for _ in range(rng.randint(1, size))] for d in range(n)}
    docs[n] = docs[0] * 2
    lines = spark.createDataFrame([(d, i, x) for d, ls in docs.items() for i, x in enumerate(ls)], "doc long, i int, line string")
    got = {(r.doc, r.i): r.run for r in repeated_runs(lines).collect()}
    assert got == brute_runs(docs)


def test_later_copies_go_and_edge_cases_hold(spark):
    long = "one two three four five six seven eight nine ten"
    rows = [(1, f"start\n{long}\nshort"), (2, f"other\n{long}\nshort\nend"), (3, None), (4, ""), (5, "short"), (None, long), (6, long + " x"), (6, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit(7))
    out = {r.doc_id: r for r in drop_repeated_lines(df).filter("doc_id is not null and doc_id <> 6").collect()}
    assert out[1].text == rows[0][1] and out[1].n_dropped == 0
    assert out[2].text == "other\nend" and out[2].n_dropped == 2  # the short line goes with its run
    assert out[3].text == "" and out[4].text == "" and out[5].text == "short"
    assert drop_repeated_lines(df).count() == len(rows)
    assert drop_repeated_lines(df.limit(0)).count() == 0


def brute_drop(rows, min_words):
    """rows in their order: the text left of each, every run being looked for at all earlier positions."""
    docs = {d: (t or "").split("\n") for d, t in enumerate(rows)}
    gone = set()
    for (d, i), n in brute_runs(docs).items():
        if sum(len(x.split()) for x in docs[d][i : i + n]) >= min_words:
            gone |= {(d, k) for k in range(i, i + n)}
    return ["\n".join(x for i, x in enumerate(docs[d]) if (d, i) not in gone) if any(k[0] == d for k in gone) else (rows[d] or "") for d in docs]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_texts_left_match_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = ["", "", "a b", "c d e", "f g h i", "j", "k l m n o"]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 12))) for _ in range(14)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    out = {r.doc_id: r for r in drop_repeated_lines(df, min_words=4).collect()}
    assert [out[i].text for i in range(len(texts))] == brute_drop(texts, 4)
    assert all(out[i].n_lines == len((t or "").split("\n")) for i, t in enumerate(texts))


def test_rows_that_share_an_id_or_have_none_take_part(spark):
    long = "one two three four five six seven eight nine ten"
    df = spark.createDataFrame([(1, f"a\n{long}"), (2, long), (3, f"b\n{long}"), (3, long), (3, long), (None, f"c\n{long}")], "doc_id long, text string").withColumn("key", F.lit(0)).withColumn("row", F.lit(0))
    assert sorted((r.doc_id or 99, r.text, r.n_dropped) for r in drop_repeated_lines(df).collect()) == [(1, f"a\n{long}", 0), (2, "", 1), (3, "", 1), (3, "", 1), (3, "b", 1), (99, "c", 1)]


def test_a_long_text_that_repeats_itself_and_a_very_common_line(spark):
    line = "one two three four five six seven eight nine ten"
    texts = ["\n".join([line] * 3000)] + [f"\nown {i}\n" for i in range(600)]
    out = {r.doc_id: r for r in drop_repeated_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert out[0].text == line and out[0].n_dropped == 2999
    assert all(out[i].text == texts[i] for i in range(1, 601))
