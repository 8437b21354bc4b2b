"""Dense retrieval: exact nearest vectors by blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.operators.blockjoin import best
from quillstone.session import cut

#: Vectors of one block of either side, and queries compared with a block at once; they bound what a task holds.
BLOCK, AT_ONCE = 4096, 512


def _unit(column) -> np.ndarray:
    """Rows of unit length; a null vector, a null component and a zero vector are zeros."""
    rows = [x.as_py() or [] for x in column]
    v = np.zeros((len(rows), max((len(r) for r in rows), default=0)))
    for i, r in enumerate(rows):
        v[i, : len(r)] = [0.0 if c is None else c for c in r]
    return v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-300)


def _packed(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(ids, units): blocks of about BLOCK vectors in the order of ids, each one row and one partition."""
    blocks = max(1, round(rows.count() / BLOCK))
    held = rows.select(F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int").alias("b"), F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))

    def pack(key, t):
        ids = t.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        return pa.table({"b": pa.array([key[0].as_py()], pa.int32()), "ids": pa.array([ids[order].tobytes()], pa.binary()), "units": pa.array([_unit(t.column("v"))[order].tobytes()], pa.binary())})

    return cut(held.groupBy("b").applyInArrow(pack, "b int, ids binary, units binary")).repartitionById(blocks, F.col("b")).drop("b")


def nearest_dense(queries: DataFrame, base: DataFrame, id_col: str, vector_col: str, k: int = 1, least: float = -1.0) -> DataFrame:
    """(q, rank, p, s): the k base vectors of largest cosine for each query, ties to the smaller id; cosines below least count as least.

    Both sides are cut into blocks of about BLOCK vectors; each pair of blocks meets once, in a task of its own, in numpy, and gives the k best rows a
    query, reduced by an aggregation. Neither side is broadcast or copied in a shuffle; rows are queries times blocks. Vectors are of one length; null ones are zeros.
    """
    left, right = _packed(queries, id_col, vector_col).toDF("qi", "qu"), _packed(base, id_col, vector_col)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                qi, qu, pi, pu = (np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in enumerate((np.int64, np.float64) * 2))
                a, c = qu.reshape(len(qi), -1), pu.reshape(len(pi), -1)
                if a.shape[1] != c.shape[1]:  # only where one side has nothing but nulls
                    a, c = (np.pad(x, ((0, 0), (0, max(a.shape[1], c.shape[1]) - x.shape[1]))) for x in (a, c))
                for at in range(0, len(qi), AT_ONCE):
                    s = np.maximum(a[at : at + AT_ONCE] @ c.T, least)
                    x, y = np.nonzero(best(np.where(np.isnan(s), -np.inf, np.round(s, 9)), k))
                    yield pa.RecordBatch.from_arrays([pa.array(qi[at + x]), pa.array(pi[y]), pa.array(s[x, y])], ["q", "p", "s"])

    found = left.hint("shuffle_replicate_nl").crossJoin(right).mapInArrow(run, "q long, p long, s double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc(F.round("s", 9)), "p")) - 1
    return found.withColumn("rank", rank).filter(F.col("rank") < k).select("q", "rank", "p", "s")
