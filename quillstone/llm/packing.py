"""Conflict-constrained best-fit packing of documents into fixed-length training sequences."""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import keyed_rows, n_words, strip_whitespace

#: Documents a shard holds on average; bounds the memory and the search of one packing task.
SHARD_DOCS = 2048
SCHEMA = "id {id}, part int, n_tokens long, shard long, bin long, start long, filled long"


class Packer:
    """Open bins of one shard, ordered by residual; each carries a bitmap of clusters and bit planes of sources.

    Plane j of a bin has the sources seen more than j times, so the last plane says which are at their limit.
    """

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.planes = capacity, per_source
        self.order: list[tuple[int, int]] = []  # (residual, bin), ascending
        self.clusters: list[int] = []
        self.sources: list[list[int]] = []
        self.filled: list[int] = []

    def _place(self, k: int, n: int, source: int, cluster: int) -> tuple[int, int]:
        start = self.filled[k]
        self.filled[k] += n
        self.clusters[k] |= cluster
        carry = source
        for j, plane in enumerate(self.sources[k]):  # the lowest plane that lacks the bit takes it
            self.sources[k][j], carry = plane | carry, carry & plane
        if self.capacity > self.filled[k]:
            bisect.insort(self.order, (self.capacity - self.filled[k], k))
        return k, start

    def add(self, n: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, start) for a piece of n tokens: the tightest bin that has room and no conflict, or a new one."""
        for at in range(bisect.bisect_left(self.order, (n, -1)), len(self.order)):
            _, k = self.order[at]
            if not self.clusters[k] & cluster and not self.sources[k][-1] & source:
                del self.order[at]
                return self._place(k, n, source, cluster)
        self.clusters.append(0)
        self.sources.append([0] * self.planes)
        self.filled.append(0)
        return self._place(len(self.filled) - 1, n, source, cluster)


def pack_frame(pdf: pd.DataFrame, capacity: int, per_source: int) -> pd.DataFrame:
    """Packs one shard: longest pieces first, ties by id; pieces of a whole capacity fill bins of their own; rows without tokens come last, without a bin."""
    empty, pdf = pdf[pdf["n"] <= 0], pdf[pdf["n"] > 0]
    bare = pd.DataFrame({"id": empty["id"].to_numpy(), "part": np.zeros(len(empty), np.int32), "n_tokens": 0, **{c: pd.array([None] * len(empty), "Int64") for c in ("shard", "bin", "start", "filled")}})
    if pdf.empty:
        return bare
    pdf = pdf.sort_values(["n", "id"], ascending=[False, True], kind="stable", na_position="last", ignore_index=True)
    sources, clusters = pd.factorize(pdf["source"], use_na_sentinel=False)[0], pd.factorize(pdf["cluster"], use_na_sentinel=False)[0]
    pieces = []
    for row, n in enumerate(pdf["n"].to_numpy()):
        full, rest = divmod(int(n), capacity)
        pieces += [(capacity, row, part) for part in range(full)]
        if rest or not full:
            pieces.append((rest, row, full))
    pieces.sort(key=lambda x: (-x[0], x[1], x[2]))
    packer, out = Packer(capacity, per_source), []
    for n, row, part in pieces:
        k, start = packer.add(n, 1 << int(sources[row]), 1 << int(clusters[row]))
        out.append((row, part, n, k, start))
    rows, part, n, k, start = (np.array(x, np.int64) for x in zip(*out))
    packed = pd.DataFrame({"id": pdf["id"].to_numpy()[rows], "part": part.astype(np.int32), "n_tokens": n, "shard": int(pdf["shard"].iloc[0]), "bin": k, "start": start, "filled": np.array(packer.filled, np.int64)[k]})
    return packed if empty.empty else pd.concat([packed.astype({c: "Int64" for c in ("shard", "bin", "start", "filled")}), bare], ignore_index=True)


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    cluster: Column | None = None,
    tokens: Column | None = None,
    capacity: int = 2048,
    per_source: int = 4,
    shard_docs: int = SHARD_DOCS,
) -> DataFrame:
    """One row per piece: id, part, n_tokens, shard, bin, start, filled (tokens in that bin).

    A document longer than capacity is cut into pieces; all but the last fill a bin. No bin takes two pieces of one
    duplicate cluster (default: equal text without white space) nor more than per_source of one source (the largest
    pieces excepted, which are alone). Shards of about shard_docs documents, dealt by an id hash, are packed apart: groups,
    hot sources and hot clusters spread over all of them, and a shard's work does not grow with the input.

    Null or empty texts have no tokens and are in no bin: one row with part 0 and null shard, bin, start and filled. Null sources are one
    source. Rows repeating an id, or without one, are pieces of their own, dealt over the shards like any others; equal ones meet in no bin.
    An empty table gives an empty result.
    """
    text = F.col("text").cast("string")
    sized = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce((F.xxhash64(strip_whitespace(text)) if cluster is None else cluster).cast("string"), F.lit("")).alias("cluster"),
        F.coalesce(n_words(text) if tokens is None else tokens, F.lit(0)).cast("long").alias("n"),
    )
    rows = keyed_rows(sized, "id", **{c: F.col(c) for c in sized.columns})
    shards = max(1, round(docs.select(id_col).count() / shard_docs))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(F.col("key").cast("string"), "cluster"), F.lit(shards)).cast("long")).select(*sized.columns, "shard")
    schema = SCHEMA.format(id=sized.schema["id"].dataType.simpleString())
    packed = rows.groupBy("shard").applyInPandas(lambda pdf: pack_frame(pdf, capacity, per_source), schema)
    return packed.withColumnRenamed("id", id_col)
