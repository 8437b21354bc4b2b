"""Latent retrieval: a truncated SVD of the distributed document-by-gram matrix, and coordinates of any text in its space.

The matrix lives in blocks of ROWS documents by about COLS grams, each one row of a table. Products with tall matrices, cut along the same
blocks, are joins on a block number; only matrices of components by components reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.operators import ngrams as N
from quillstone.operators.splits import indexed
from quillstone.session import cut

COMPONENTS, ROWS, COLS = 128, 4096, 16384
#: Entries of a block multiplied at once; bounds the memory of a product beside its result.
_AT_ONCE = 1 << 15
#: Corpora of up to so many documents are spanned whole, so their axes are exact; a square of this size is the largest matrix the driver meets.
WHOLE = 1024
#: Singular values up to here are no axes.
NO_AXIS = 1e-12


@dataclass
class Latent:
    """vocabulary: (g, idf, c, at): a gram's weight and place; projection: (c, cells): V/S by blocks of grams; values: the singular values."""

    vocabulary: DataFrame
    projection: DataFrame
    values: np.ndarray


def _binary(*arrays: np.ndarray) -> list[pa.Array]:
    return [pa.array([a.tobytes()], pa.binary()) for a in arrays]


def _rows_of(blob, width: int) -> np.ndarray:
    return np.frombuffer(blob.as_buffer(), np.float64).reshape(-1, width)


def _product(keys: np.ndarray, other: np.ndarray, vals: np.ndarray, size: int, right: np.ndarray) -> np.ndarray:
    """Sum of vals * right[other] by key: a sparse block times a dense one."""
    out = np.zeros((size, right.shape[1]))
    order = np.argsort(keys, kind="stable")
    for a in range(0, len(order), _AT_ONCE):
        i = order[a : a + _AT_ONCE]
        k, first = np.unique(keys[i], return_index=True)
        out[k] += np.add.reduceat(vals[i, None] * right[other[i]], first, axis=0)
    return out


def vocabulary(corpus: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(g, idf, c, at): the corpus's grams with their block and place in it."""
    held = cut(N.idf(N.counts(corpus, id_col), corpus.count()).select("g", "idf"))
    blocks = max(corpus.sparkSession.sparkContext.defaultParallelism, -(-held.count() // COLS))
    held = held.withColumn("c", F.pmod(F.xxhash64("g"), F.lit(blocks)).cast("int"))
    return cut(held.withColumn("at", F.row_number().over(Window.partitionBy("c").orderBy("g")) - 1))


def _blocks(rows: DataFrame, vocab: DataFrame, id_col: str) -> DataFrame:
    """(r, c, nr, mc, d, at, val): the matrix of rows (with pos) in blocks: entries at document d of block r and gram at of block c.

    An entry is the gram's share of the document's grams times its idf; grams the vocabulary lacks count in the share only.
    """
    tf = N.counts(rows, id_col).withColumn("total", F.sum("tf").over(Window.partitionBy(id_col)))
    place = rows.select(id_col, (F.col("pos") / ROWS).cast("int").alias("r"), (F.col("pos") % ROWS).cast("int").alias("d"))
    cells = tf.join(place, id_col).join(vocab, "g").select("r", "d", "c", "at", (F.col("tf") / F.col("total") * F.col("idf")).alias("val"))

    def pack(key, t):
        cols = [t.column(n).to_numpy().astype(kind) for n, kind in (("d", np.int32), ("at", np.int32), ("val", np.float64))]
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), *_binary(*cols)], names=["r", "c", "d", "at", "val"])

    packed = cells.groupBy("r", "c").applyInArrow(pack, "r int, c int, d binary, at binary, val binary")
    nr = place.groupBy("r").agg(F.count(F.lit(1)).alias("nr"))
    return cut(packed.join(nr, "r").join(vocab.groupBy("c").agg(F.count(F.lit(1)).alias("mc")), "c").select("r", "c", "nr", "mc", "d", "at", "val"))


def _summed(parts: DataFrame, key: str) -> DataFrame:
    """(key, cells): cells added up by key, one at a time, as they stream in."""

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for k, blob in zip(b.column(0).to_pylist(), b.column(1)):
                x = np.frombuffer(blob.as_buffer(), np.float64)
                if k in held:
                    held[k] += x
                else:
                    held[k] = x.copy()
        for k, x in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *_binary(x)], [key, "cells"])

    return parts.repartition(key).mapInArrow(add, f"{key} int, cells binary")


def _times(blocks: DataFrame, right: DataFrame | None, width: int, seed: int = 0) -> DataFrame:
    """(r, cells): the matrix times right (c, cells); without right, times a random matrix that each task draws from the block's number."""
    drawn = right is None

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                r, c, nr, mc = (b.column(k)[i].as_py() for k in range(4))
                d, at, val = (np.frombuffer(b.column(k)[i].as_buffer(), t) for k, t in ((4, np.int32), (5, np.int32), (6, np.float64)))
                other = np.random.default_rng([seed, c]).normal(size=(mc, width)) if drawn else _rows_of(b.column(7)[i], width)
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), *_binary(_product(d, at, val, nr, other))], ["r", "cells"])

    names = ["r", "c", "nr", "mc", "d", "at", "val"]
    df = blocks.select(names) if drawn else blocks.join(right, "c").select(*names, "cells")
    return _summed(df.mapInArrow(run, "r int, cells binary"), "r")


def _times_transposed(blocks: DataFrame, left: DataFrame, width: int) -> DataFrame:
    """(c, cells): the transposed matrix times left (r, cells)."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                c, mc = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                d, at, val = (np.frombuffer(b.column(k)[i].as_buffer(), t) for k, t in ((2, np.int32), (3, np.int32), (4, np.float64)))
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), *_binary(_product(at, d, val, mc, _rows_of(b.column(5)[i], width)))], ["c", "cells"])

    return _summed(blocks.join(left, "r").select("c", "mc", "d", "at", "val", "cells").mapInArrow(run, "c int, cells binary"), "c")


def _mapped(tall: DataFrame, key: str, width: int, by: np.ndarray) -> DataFrame:
    """A tall matrix times a small one that travels with the plan."""

    def run(batches):
        for b in batches:
            for k, blob in zip(b.column(0), b.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array([k.as_py()], pa.int32()), *_binary(_rows_of(blob, width) @ by)], [key, "cells"])

    return tall.mapInArrow(run, f"{key} int, cells binary")


def _gram(tall: DataFrame, width: int) -> np.ndarray:
    """tall' tall, added up in the tasks, then over 16 of them, then here: width by width numbers each time."""

    def run(batches):
        total = np.zeros((width, width))
        for b in batches:
            for blob in b.column(1):
                x = _rows_of(blob, width)
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), *_binary(total)], ["key", "cells"])

    parts = tall.mapInArrow(run, "key int, cells binary").select(F.pmod(F.spark_partition_id(), F.lit(16)).alias("key"), "cells")
    return sum((np.frombuffer(r.cells, np.float64).reshape(width, width) for r in _summed(parts, "key").collect()), np.zeros((width, width)))


def _orthonormal(tall: DataFrame, width: int) -> tuple[DataFrame, int]:
    """The column space of a tall matrix by two rounds of Gram eigenvectors, directions of no weight left out."""
    for _ in range(2):
        tall = cut(tall)
        weight, vectors = np.linalg.eigh(_gram(tall, width))
        kept = weight > max(weight[-1], 0) * 1e-13
        if not kept.any():
            return tall, 0
        tall, width = _mapped(tall, "r", width, vectors[:, kept] / np.sqrt(weight[kept])), int(kept.sum())
    return cut(tall), width


def fit_latent(corpus: DataFrame, components: int = COMPONENTS, id_col: str = "doc_id", rounds: int = 4, tolerance: float = 1e-6, seed: int = 1) -> Latent | None:
    """The latent space of the corpus's texts (id, text): the leading axes of its document-by-gram matrix.

    The range of a random product spans a corpus of up to WHOLE documents, whose axes are exact. In larger ones a range of twice the components is turned
    towards the leading axes by up to rounds products with the matrix and its transpose, until the leading singular values move by less than
    tolerance, relatively: their last axes are approximate, as the gaps between singular values allow. Axes with singular values up to 1e-12 are dropped. None where the corpus has no gram.
    """
    vocab = vocabulary(corpus, id_col)
    blocks = _blocks(indexed(corpus.select(id_col, "text"), id_col), vocab, id_col)
    if blocks.isEmpty():
        return None
    n = corpus.count()
    width = n if n <= WHOLE else max(2 * components, components + 32)
    q, width = _orthonormal(_times(blocks, None, width, seed), width)
    before = None
    for k in range(max(1, rounds)):
        z = cut(_times_transposed(blocks, q, width))
        weight, vectors = np.linalg.eigh(_gram(z, width))
        lead = np.sqrt(np.maximum(weight[::-1][:components], 0))
        if n <= WHOLE or k + 1 == rounds or before is not None and len(before) == len(lead) and np.abs(lead - before).max() <= tolerance * lead[0]:
            break
        before = lead
        q, width = _orthonormal(_times(blocks, z, width), width)
    kept = np.flatnonzero(lead > NO_AXIS)
    top = vectors[:, ::-1][:, kept]
    return Latent(vocab, cut(_mapped(z, "c", width, top / lead[kept] ** 2)), lead[kept])


def coordinates(rows: DataFrame, space: Latent, id_col: str = "doc_id") -> DataFrame:
    """(id, vector): the texts of rows in the space, of unit length, or all zeros for a text without a known gram."""
    at, width = indexed(rows.select(id_col, "text"), id_col), len(space.values)

    def run(batches):
        for b in batches:
            for r, blob in zip(b.column(0).to_pylist(), b.column(1)):
                x = _rows_of(blob, width)
                x = x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(x)) + r * ROWS), pa.array(list(x), pa.list_(pa.float64()))], ["pos", "vector"])

    found = _times(_blocks(at, space.vocabulary, id_col), space.projection, width).mapInArrow(run, "pos long, vector array<double>")
    none = F.array_repeat(F.lit(0.0), width)
    return cut(at.join(found, "pos", "left").select(id_col, F.coalesce("vector", none).alias("vector")))
