"""Grounding over all pairs, and marks over a table, against brute force."""

import random

from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import grounding
from quillstone.plans import text_queries

MARKED = ["(질의1) 첫째 (질의2) 둘째", "① a ② b ④ d ③ c", "only ① one", "② then ① x ② y ③ z", "no marks", "❶ one ❷ two (질의 3) three"]


def _tables(spark, path):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé어𝄞") for _ in range(rng.randint(1, 7)))
    texts = [" ".join(word() for _ in range(rng.randint(0, 80))) for _ in range(60)]
    quotes = ["", " ", "•", "ab", texts[3][5:36], texts[9][10:80]]
    for _ in range(60):
        t = rng.choice([x for x in texts if len(x) > 60])
        at, n = rng.randint(0, len(t) - 1), rng.choice([1, 3, 15, 16, 30, 31, 32, 60, 200])
        quotes.append(t[at : at + n].replace(" ", rng.choice(["", " ", "  ", "\n"])))
    docs = [(i, t) for i, t in enumerate(texts + ["•" + texts[9], texts[9].replace(" ", "　"), "", None])]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(quotes)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_every_pair_is_checked(spark, tmp_path):
    _tables(spark, tmp_path)
    docs, items = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "benchmark"))
    q, t = F.col("quote"), F.col("text")
    brute = docs.crossJoin(items.withColumnRenamed("text", "quote")).filter(T.quote_grounded(q, t) & T.evidence_grounded(q, t))
    want = {(r.doc_id, r.item_id) for r in brute.select("doc_id", "item_id").collect()}
    got = text_queries.QUERIES["p17_p18_grounding"](spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want) and all(r.grounded for r in got)
    assert any(d % 40 != i % 40 for d, i in want) and not any(i < 3 for _, i in want)


def test_lengths_around_a_span_are_all_met(spark):
    text = "".join(random.Random(2).choice("abc") for _ in range(300))
    items = spark.createDataFrame([(n, text[100 : 100 + n]) for n in range(1, 2 * grounding.LONG)], "item_id long, quote string")
    docs = spark.createDataFrame([(0, text), (1, text[99:190])], "doc_id long, text string")
    assert grounding.grounded(docs, items).count() == 2 * (2 * grounding.LONG - 1)


def test_marks_are_found_in_documents(spark, tmp_path):
    spark.createDataFrame([(i + 70, t) for i, t in enumerate(MARKED)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.id, r.num, r.part) for r in text_queries.QUERIES["p12_p13_marks"](spark, str(tmp_path)).collect()}
    assert {(70, 1, "(질의1) 첫째"), (70, 2, "(질의2) 둘째"), (71, 3, "③ c"), (72, None, None), (74, None, None), (75, 2, "❷ two")} <= got and {i for i, _, _ in got} == set(range(70, 76))
