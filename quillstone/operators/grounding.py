"""Quotations found in documents: every (document, quotation) pair, by equality of window hashes and then by the texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import evidence_grounded, quote_grounded, squeeze
from quillstone.session import cut

#: Characters of a hashed window, and windows of which the smallest hash stands for all.
WIDTH, SPAN = 16, 16
#: Quotations from this length on hold a whole span; shorter ones meet windows of their own length.
LONG = WIDTH + SPAN - 1


def _hashes(text: str, width: int) -> np.ndarray:
    """A hash of each window of width characters."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(codes) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n] + np.uint64(1)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def _least(hashes: np.ndarray) -> np.ndarray:
    """The smallest hash of each run of SPAN windows."""
    n = len(hashes) - SPAN + 1
    return np.min(np.lib.stride_tricks.sliding_window_view(hashes, SPAN), axis=1) if n > 0 else hashes[:0]


def _keys(rows: DataFrame, id_col: str, text: Column, short: list[int], quotes: bool) -> DataFrame:
    """(id, size, key): of a document all keys, for long quotations (size 0) and for each short length; of a quotation its one key.

    A document that holds a long quotation also holds its first SPAN windows, so their smallest hash is among the document's keys.
    """

    def fn(batches):
        for b in batches:
            ids, sizes, keys = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if quotes:
                    size = 0 if len(t) >= LONG else len(t)
                    found = [(size, (_hashes(t, size) if size else _least(_hashes(t[:LONG], WIDTH)))[:1])] if t else []
                else:
                    found = [(0, np.unique(_least(_hashes(t, WIDTH)))), *((n, np.unique(_hashes(t, n))) for n in short)]
                for size, got in found:
                    ids += [i] * len(got)
                    sizes += [size] * len(got)
                    keys.append(got.view(np.int64))
            if ids:
                yield pa.record_batch([pa.array(ids, b.schema.field(0).type), pa.array(sizes, pa.int32()), pa.array(np.concatenate(keys))], names=[id_col, "size", "key"])

    rows = rows.select(id_col, text.alias("t"))
    return rows.mapInArrow(fn, f"{id_col} {rows.schema[id_col].dataType.simpleString()}, size int, key long")


def grounded(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, grounded): the pairs of docs (doc_id, text) and items (item_id, quote) in which the text holds the quotation.

    Both checks must hold, so an empty quotation is grounded nowhere. White space is gone from what is hashed, as it is from what is compared.
    """
    flat = squeeze(F.col("quote"))
    short = sorted(r.n for r in items.select(F.char_length(flat).alias("n")).filter(F.col("n").between(1, LONG - 1)).distinct().collect())  # at most LONG - 1 lengths
    held = cut(_keys(items, "item_id", flat, short, True))  # written, so that the joins know their sizes
    pairs = cut(_keys(docs, "doc_id", squeeze(F.col("text")), short, False).join(held, ["size", "key"]).select("doc_id", "item_id").distinct())
    both = pairs.join(items, "item_id").join(docs, "doc_id")
    found = quote_grounded(F.col("quote"), F.col("text")) & evidence_grounded(F.col("quote"), F.col("text"))
    return both.filter(found).select("doc_id", "item_id", F.lit(True).alias("grounded"))
