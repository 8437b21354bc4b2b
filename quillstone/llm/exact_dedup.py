"""Exact dedup: 128-bit content hash groups, byte comparison inside them, one row of each group stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import hot_join, keyed_rows, strip_whitespace
from quillstone.session import cut


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=strip_whitespace, prefer: Column | None = None) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when normalise() makes them equal byte for byte. Rows meet on the md5 of the normalised
    text; the grouping key also holds the text itself, so an md5 collision makes two groups, never one.
    The row with the largest prefer value (default: code points of the original text), then the smallest id, stays.

    Null text counts as empty, so null and empty texts are one group. A null id sorts after all others.
    Rows that repeat an id with an equal text are members like any other; all of them carry the same flags.
    An empty table gives an empty result; further columns are ignored, whatever their names.
    """
    text = F.col(text_col).cast("string")
    prefer = F.coalesce(F.char_length(text), F.lit(0)) if prefer is None else prefer
    rows = docs.select(F.col(id_col).alias("id"), normalise(text).alias("norm"), prefer.cast("long").alias("len"))
    keyed = rows.select("id", "norm", "len", F.unhex(F.md5("norm")).alias("h"))
    order = F.struct((-F.col("len")).alias("l"), F.col("id").isNull().alias("n"), F.col("id").alias("id"))
    held = keyed.groupBy("h", "norm").agg(F.count(F.lit(1)).alias("group_size"), F.min(order).alias("keep"))
    held = held.select("h", "group_size", F.col("keep.id").alias("keep_id"), F.sha2("norm", 256).alias("text_sha256"))
    held = cut(held)
    shared = held.groupBy("h").count().filter("count > 1").select("h")
    on = ["h"]
    rows = keyed.select("id", "h")
    if not shared.isEmpty():  # two texts under one md5: those rows also match on the second digest
        on, rows = ["h", "text_sha256"], keyed.select("id", "h", F.sha2("norm", 256).alias("text_sha256"))
    total = held.agg(F.sum("group_size")).first()[0] or 0
    out = hot_join(cut(rows), held.withColumn("c", F.col("group_size")), on, "c", total)  # a group may hold a third of all rows
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, with the columns of docs, whatever their names: the longest original, then the smallest id; null ids come last.

    Different texts under one id all stay; of equal rows under one id one stays.
    """
    rows = keyed_rows(docs, id_col, text=F.col(text_col))
    stay = exact_groups(rows, "key", "text").filter("kept").select("key")
    return rows.join(stay, "key", "left_semi").select("row.*")
