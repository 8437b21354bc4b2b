"""Passages of a benchmark found whole in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Inner words that two texts must share in a row before they are compared; shorter passages share all theirs.
INNER = 6


def found(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, docs, first_doc): for each passage in any document the number of documents that hold it, white space aside, and the smallest id.

    docs: (doc_id, text); items: (item_id, text). A passage's first and last words may be parts of words of a document, so the hash of the words
    between them (INNER at most) meets that of every run of as many words of the documents, and the whole text is compared where they meet.
    Passages of one or two words have none between: they are compared with every document. Empty passages and null texts are in none.
    """
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    quotes = items.select("item_id", flat.alias("quote")).filter("quote <> ''").withColumn("words", F.split("quote", " "))
    quotes = quotes.withColumn("n", F.least(F.size("words") - 2, F.lit(INNER)))
    texts = docs.select("doc_id", flat.alias("text")).filter("text <> ''")
    lengths = [r.n for r in quotes.filter("n > 0").select("n").distinct().collect()]  # INNER at most
    pairs = texts.select("doc_id").join(F.broadcast(quotes.filter("n <= 0").select("item_id"))) if not quotes.filter("n <= 0").isEmpty() else None
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.xxhash64(F.array_join(F.slice("w", i, n), " ")))
    words = texts.select("doc_id", F.split("text", " ").alias("w"))
    for n in lengths:
        keyed = quotes.filter(F.col("n") == n).select("item_id", F.xxhash64(F.array_join(F.slice("words", 2, n), " ")).alias("key"))
        keys = words.filter(F.size("w") >= n).select("doc_id", F.explode(F.array_distinct(runs(n))).alias("key"))
        met = keys.join(keyed, "key").select("doc_id", "item_id").distinct()
        pairs = met if pairs is None else pairs.unionByName(met)
    if pairs is None:
        return items.limit(0).select("item_id", F.lit(0).cast("long").alias("docs"), F.lit(0).cast("long").alias("first_doc"))
    hits = pairs.join(quotes.select("item_id", "quote"), "item_id").join(texts, "doc_id").filter(F.contains("text", "quote"))
    return hits.groupBy("item_id").agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("first_doc"))
