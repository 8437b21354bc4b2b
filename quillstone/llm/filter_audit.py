"""Interaction of quality filters: what each filter removes in every order of application, from additive counts of failure masks.

Duplicates are found with a counting Bloom filter as a prepass. Every task counts the digests of its rows in a sparse sketch, sketches
of all tasks are merged cell by cell, and a text with a cell that was met only once is certainly unique. Only the others, possible
repeats, are shuffled with their whole text for the exact smallest id of each text; a false alarm costs a row of shuffle, never a result.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import WORD, hot_join, spread
from quillstone.session import cut

FILTERS = "ABCDE"
#: Cells of the sketch for every row, hashes per text, and the most cells of one sketch: its bits are what the driver and a worker hold (64 MB).
CELLS_PER_ROW, HASHES, MOST_CELLS = 16, 4, 1 << 29
#: Cells merged and kept together; digests a task counts before it sends them on.
CHUNK_BITS, FLUSH = 18, 1 << 19


def failures(text: Column) -> Column:
    """Bits of the filters a text fails by itself: A 1, B 2, C 4, D 8. Null counts as empty.

    A: under 50 words; B: distinct words under 65 % of the words; C: over 5 % capital letters A-Z; D: holds one of #$%&*|.
    """
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words)
    fails = [n < 50, F.size(F.array_distinct(words)) * 100 < n * 65, F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.length(text) * 5, text.rlike("[#$%&*|]")]
    return sum((f.cast("int") * (1 << k) for k, f in enumerate(fails)), F.lit(0))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def _cells(digest: np.ndarray, bits: int, hashes: int) -> np.ndarray:
    """(hashes, n) cells of digests in a sketch of 2**bits cells: double hashing, all distinct since the step is odd."""
    h = _mixed(digest.view(np.uint64))
    step = _mixed(h) | np.uint64(1)
    return (h + np.arange(hashes, dtype=np.uint64)[:, None] * step) & np.uint64((1 << bits) - 1)


def _counted(batches, bits: int, hashes: int):
    """Sparse sketch of a task's digests: for each chunk of cells, those met once and those met more often."""
    held, n = [], 0

    def sketch():
        cells, count = np.unique(np.concatenate([_cells(d, bits, hashes).ravel() for d in held]), return_counts=True)
        chunk, at = np.unique(cells >> np.uint64(CHUNK_BITS), return_index=True)
        rows = []
        for c, a, b in zip(chunk, at, [*at[1:], len(cells)]):
            low, often = (cells[a:b] & np.uint64((1 << CHUNK_BITS) - 1)).astype(np.uint32), count[a:b] > 1
            rows.append((int(c), low[~often].tobytes(), low[often].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], ["chunk", "once", "often"])

    for b in batches:
        if b.num_rows:
            held.append(b.column(0).to_numpy(zero_copy_only=False))
            n += b.num_rows
        if n >= FLUSH:
            yield sketch()
            held, n = [], 0
    if held:
        yield sketch()


def _merged(batches):
    """Chunks of the merged sketch as bits: set where the cell was met more than once over all tasks."""
    held: dict[int, np.ndarray] = {}
    for b in batches:
        for c, once, often in zip(*(b.column(k) for k in range(3))):
            x = held.setdefault(c.as_py(), np.zeros(1 << CHUNK_BITS, np.uint8))
            for blob, k in ((once, 1), (often, 2)):
                at = np.frombuffer(blob.as_buffer(), np.uint32)
                x[at] = np.minimum(x[at] + k, 2)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([np.packbits(x > 1).tobytes() for x in held.values()], pa.binary())], ["chunk", "bits"])


def sketch_of(digests: DataFrame, bits: int, hashes: int) -> np.ndarray:
    """The merged sketch of a column of 64-bit digests as packed bits, one a cell: met more than once."""
    parts = digests.mapInArrow(lambda it: _counted(it, bits, hashes), "chunk int, once binary, often binary")
    out = np.zeros(max(1, 1 << max(bits, CHUNK_BITS) - 3), np.uint8)
    for r in parts.repartition("chunk").mapInArrow(_merged, "chunk int, bits binary").toLocalIterator():
        at = r.chunk << (CHUNK_BITS - 3)
        out[at : at + (1 << (CHUNK_BITS - 3))] = np.frombuffer(r.bits, np.uint8)
    return out


def may_repeat(digests: DataFrame, n_rows: int, most_cells: int = MOST_CELLS):
    """A function from a digest column to a condition: false where the digest is certain to stand on one of the n_rows rows only.

    The sketch has CELLS_PER_ROW cells a row up to most_cells, the bound of what is broadcast. Beyond it false alarms grow more frequent
    (0.2 % at 16 cells a row, 15 % at 4, 63 % at 1), which costs shuffle and changes no result.
    """
    bits = min(max(10, int(n_rows * CELLS_PER_ROW).bit_length()), max(10, most_cells.bit_length() - 1))
    hashes = max(1, min(HASHES, round(0.69 * (1 << bits) / max(1, n_rows))))
    mask = digests.sparkSession.sparkContext.broadcast(sketch_of(digests, bits, hashes))

    @F.pandas_udf("boolean")
    def again(digest: pd.Series) -> pd.Series:
        cells = _cells(digest.to_numpy(), bits, hashes)
        shift = np.uint8(7) - (cells & np.uint64(7)).astype(np.uint8)
        return pd.Series(((mask.value[cells >> np.uint64(3)] >> shift) & 1).all(axis=0))

    return again


def failing_rows(docs: DataFrame, part_col: str = "source", id_col: str = "doc_id", most_cells: int = MOST_CELLS) -> DataFrame:
    """(id, part, mask): every document with the bits of the filters it fails; E, 16, is failed by a text that a smaller id has too."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = spread(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text")))
    rows = rows.withColumn("digest", F.xxhash64("text"))
    check = F.xxhash64(F.lit(7), "text").alias("check")  # with the digest, 128 bits lead a row back to its text's group
    flags = cut(rows.select("id", "part", failures(F.col("text")).alias("mask"), "digest", check))
    n_rows = flags.count()
    repeats = rows.filter("id is not null").filter(may_repeat(flags.select("digest"), n_rows, most_cells)(F.col("digest")))
    # a text's group meets map-side first, so copies of one text cost one row a task
    groups = repeats.groupBy("text").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count(F.lit(1)).alias("c"))
    groups = cut(groups.filter("least < most").select(F.xxhash64("text").alias("digest"), check, "least", "c"))
    met = hot_join(flags, groups, ["digest", "check"], "c", n_rows, "left")
    return met.select("id", "part", (F.col("mask") + F.coalesce((F.col("id") > F.col("least")).cast("int"), F.lit(0)) * 16).alias("mask"))


def mask_counts(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, mask, good, toxic, n): failing_rows counted by part, mask and label; counts of sets of rows without common rows add up.

    Rows are counted by id before they meet the labels, so an id on many rows is one row a part and mask.
    """
    held = rows.groupBy("id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    on = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    marks = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(on("quality").alias("good"), on("toxic").alias("toxic"))
    met = held.filter("id is not null").join(marks, "id", "left").select("part", "mask", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    none = held.filter("id is null").select("part", "mask", "n", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    return met.unionByName(none).groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def order_steps(spark) -> DataFrame:
    """(filter_order, step, before, bit): all orders of the filters, step by step; before has the bits of the filters applied earlier."""
    rows = []
    for order in permutations(FILTERS):
        before = 0
        for step, f in enumerate(order, 1):
            rows.append(("".join(order), step, before, 1 << FILTERS.index(f)))
            before |= rows[-1][3]
    return spark.createDataFrame(rows, "filter_order string, step int, before int, bit int")


def filter_interactions(docs: DataFrame, labels: DataFrame, part_col: str = "source", id_col: str = "doc_id", most_cells: int = MOST_CELLS) -> DataFrame:
    """For each part, order of the five filters and step: what the step keeps and removes, and what its filter is worth.

    (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), counts of documents of the part:
    kept after the step; removed by it; redundant, failing its filter but removed earlier; unique_fails, failing its filter only;
    removed ones labelled quality 1 and toxic 1; shapley, what the filter removes summed over all orders. Zeros included.

    Whole texts count. Null text counts as empty, a null part as the empty string. A text fails E when a row with a smaller id has the same text, removed
    or not; a row without id is never a repeat and none is one of it; rows with the same id and text are not repeats of each other. An
    id labelled on several rows is good or toxic if any of them says so; null labels say nothing. Rows repeating an id count each. An
    empty table gives no parts and no rows. Further columns of docs and labels are not read.
    """
    spark = docs.sparkSession
    counts = mask_counts(failing_rows(docs, part_col, id_col, most_cells), labels, id_col)
    # 80 pairs of (filters before, filter) answer all 600 steps of a part; a part has at most 128 rows of counts
    pairs = [before * 32 + (1 << k) for before in range(32) for k in range(5) if not before & (1 << k)]
    each = counts.withColumn("pair", F.explode(F.array(*map(F.lit, pairs)))).withColumns({"before": F.floor(F.col("pair") / 32).cast("int"), "bit": (F.col("pair") % 32).cast("int")})
    mask, fails = F.col("mask"), F.col("mask").bitwiseAND(F.col("bit")) != 0
    passed = mask.bitwiseAND(F.col("before")) == 0
    total = lambda on, n="n": F.sum(F.when(on, F.col(n)).otherwise(F.lit(0))).cast("long")
    each = each.withColumns({"good_n": F.col("n") * F.col("good"), "toxic_n": F.col("n") * F.col("toxic"), "share": F.when(fails, F.col("n") * (120 / F.bit_count(mask)).cast("long"))})
    sums = each.groupBy("part", "before", "bit").agg(
        total(passed & ~fails).alias("kept"),
        total(passed & fails).alias("removed"),
        total(~passed & fails).alias("redundant"),
        total(mask == F.col("bit")).alias("unique_fails"),
        total(passed & fails, "good_n").alias("good_lost"),
        total(passed & fails, "toxic_n").alias("toxic_lost"),
        F.coalesce(F.sum("share"), F.lit(0)).cast("long").alias("shapley"),  # a filter comes first among m failed ones in 120 / m orders
    )
    out = sums.join(F.broadcast(order_steps(spark)), ["before", "bit"])  # 600 rows
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
