"""Leakage audit: terms whose documents lean to one label more than the label's share explains."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import stats
from quillstone.functions.text import squeeze

SIZES, MIN_SUPPORT, ALPHA = (2, 3, 4, 5, 6), 12, 0.05
PIECE = 1 << 20  # characters of texts worked on at once


def _terms(texts: list[str], n: int):
    """The distinct n-grams of some texts as strings, and for each text with a gram one pair (number of the gram, number of the text), in that order."""
    held = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    chars, text = np.concatenate(held), np.repeat(np.arange(len(held)), [len(h) for h in held])
    first = np.flatnonzero(text[: max(0, len(text) - n + 1)] == text[n - 1 :])
    letters, code = np.unique(chars, return_inverse=True)
    key, size = np.zeros(len(first), np.int64), 1
    for k in range(n):
        if size * len(letters) * len(texts) >= 1 << 62:  # as dense numbers, so that the key fits
            _, key = np.unique(key, return_inverse=True)
            size = max(1, len(first))
        key, size = key * len(letters) + code[first + k], size * len(letters)
    pair, one = np.unique(key * len(texts) + text[first], return_index=True)
    key = pair // len(texts)
    new = np.append(True, key[1:] != key[:-1])[: len(key)]
    each = np.ascontiguousarray(chars[first[one[new], None] + np.arange(n)])
    if len(letters) and not letters[0]:  # a NUL would be lost at the end of a numpy string
        names = [x.tobytes().decode("utf-32-le", "surrogatepass") for x in each]
    else:
        names = each.view(f"<U{n}").ravel().tolist()
    return names, np.cumsum(new) - 1, pair % len(texts)


def _postings(kept: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """(term, label, hits, first, x, y) of pieces of the rows (id, text, label): rows of the label with the term, their least id, and the digests of their ids."""
    rows = kept.select("id", "label", squeeze(F.col("text")).alias("text"), F.xxhash64("id").alias("x"), F.xxhash64("id", F.lit(1)).alias("y"))
    kind = rows.schema["id"].dataType.simpleString()

    def tallied(held):
        labels, label = np.unique([r["label"] for r in held], return_inverse=True)
        ids, x, y = (np.array([r[c] for r in held], np.int64) for c in ("id", "x", "y"))
        for n in sizes:
            names, term, text = _terms([r["text"] for r in held], n)
            if not names:
                continue
            key = term * len(labels) + label[text]
            order = np.argsort(key, kind="stable")
            key, text = key[order], text[order]
            at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            cols = [np.diff(np.append(at, len(key))), np.minimum.reduceat(ids[text], at), np.bitwise_xor.reduceat(x[text], at), np.bitwise_xor.reduceat(y[text], at)]
            which = [pa.array(names, pa.string()).take(pa.array(key[at] // len(labels))), pa.array(labels.tolist(), pa.string()).take(pa.array(key[at] % len(labels)))]
            yield pa.RecordBatch.from_arrays([*which, *(pa.array(c) for c in cols)], ["term", "label", "hits", "first", "x", "y"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                held.append(row)
                n += len(row["text"])
                if n >= PIECE:
                    yield from tallied(held)
                    held, n = [], 0
        if held:
            yield from tallied(held)

    return rows.mapInArrow(run, "term string, label string, hits long, first long, x long, y long").withColumn("first", F.col("first").cast(kind))


def leakage(rows: DataFrame, sizes: tuple[int, ...] = SIZES, min_support: int = MIN_SUPPORT, id_col: str = "doc_id") -> DataFrame:
    """One finding for each set of documents that terms cover, of rows (id, text, label); rows without a label take no part.

    (place, term, surface_forms, label, support, hits, concentration, prior, lift, p, p_holm, significant): the shortest, then first term of the set and how many
    terms cover it; the label most of the set has, on ties that of its first document; its share of the set, its share of all rows, and
    their difference; the chance of so many hits, step-down adjusted over all findings. Places are by p, then larger lift, then larger support, then term.

    Terms are counted in pieces of the rows, without a row per document and term. A set is known by its size and two order-free 64-bit digests. Hits by label are counted as rows (term, label), so labels may be any.
    """
    kept = rows.filter(F.col("label").isNotNull() & (F.col("label") != "")).select(F.col(id_col).alias("id"), "text", "label")
    n = kept.count()
    xor = [F.bit_xor(c).alias(c) for c in ("x", "y")]
    led = _postings(kept, sizes).groupBy("term", "label").agg(F.sum("hits").alias("hits"), F.min("first").alias("first"), *xor)
    best = F.max(F.struct("hits", (-F.col("first")).alias("early"), "label")).alias("b")
    terms = led.groupBy("term").agg(F.sum("hits").alias("support"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), best).filter(F.col("support") >= min_support)
    sets = terms.groupBy("support", "x", "y").agg(F.min(F.struct(F.char_length("term").alias("l"), "term")).alias("t"), F.count(F.lit(1)).alias("surface_forms"), F.first("b").alias("b"))
    prior = kept.groupBy("label").agg((F.count(F.lit(1)) / F.lit(float(max(n, 1)))).alias("prior"))
    out = sets.select(F.col("t.term").alias("term"), "surface_forms", "support", F.col("b.label").alias("label"), F.col("b.hits").alias("hits")).join(prior, "label")
    out = out.withColumn("concentration", F.col("hits") / F.col("support")).withColumn("lift", F.col("concentration") - F.col("prior"))
    out = out.withColumns({"p": F.round(stats.binomial_tail("hits", "support", "prior"), 12), "by_lift": -F.round("lift", 9), "by_support": -F.col("support")})
    out = stats.holm_ranged(out, "p", "by_lift", "by_support", "term", place="place").withColumn("significant", F.col("p_holm") < ALPHA)
    return out.select("place", "term", "surface_forms", "label", "support", "hits", "concentration", "prior", "lift", "p", "p_holm", "significant")
