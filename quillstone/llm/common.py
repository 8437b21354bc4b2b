"""Pieces the training-data operators share: column helpers, byte-level tokenising in numpy, connected components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.session import cut

WHITESPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text handled at once by the numpy kernels; bounds a worker's memory whatever an Arrow batch holds.
CHUNK_BYTES = 1 << 20

_rng = np.random.default_rng(20260101)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)


def strip_whitespace(text: Column) -> Column:
    """Text without the six ASCII white-space characters; null counts as empty."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for ch in WHITESPACE:
        out = F.replace(out, F.lit(ch), F.lit(""))
    return out


def n_words(text: Column) -> Column:
    """Words of non-white-space characters as a long; null has none."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def fold_of(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id's text, modulo folds; null ids fall in fold 2, which no contract holds out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % F.lit(folds), F.lit(2))


def repeated_ids(df: DataFrame, id_col: str) -> bool:
    """Whether any id is null or on more than one row."""
    return not df.groupBy(F.col(id_col).alias("k")).count().filter("count > 1 or k is null").isEmpty()


def text_chunks(batch, text_col: int, limit: int = CHUNK_BYTES):
    """Slices of an Arrow record batch with at most limit bytes of text, at least one row each: (first row, list of bytes)."""
    rows, held, first = [], 0, 0
    for i, t in enumerate(batch.column(text_col)):
        b = (t.as_py() or "").encode("utf-8", "surrogatepass")
        if rows and held + len(b) > limit:
            yield first, rows
            rows, held, first = [], 0, i
        rows.append(b)
        held += len(b)
    if rows:
        yield first, rows


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _powers(n: int, cache: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """p**i and its inverse modulo 2**64 for i < n, grown on demand and kept by the worker."""
    if cache.get("n", 0) < n:
        size = max(n, CHUNK_BYTES + 4096)
        one = np.full(size, _P, np.uint64)
        inv = np.full(size, _P_INV, np.uint64)
        one[0] = inv[0] = 1
        cache |= {"n": size, "p": np.multiply.accumulate(one), "q": np.multiply.accumulate(inv)}
    return cache["p"][:n], cache["q"][:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, A-Z lower-cased, and where each text's words begin (one more entry than texts)."""
    joined = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(joined, np.uint8)
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=1))
    starts, ends = edge[0::2], edge[1::2]
    p, q = _powers(len(raw))
    sums = np.cumsum(np.where(space, np.uint64(0), _FOLDED[raw]) * p, dtype=np.uint64)
    before = np.where(starts > 0, sums[starts - 1], np.uint64(0))
    h = _mix((sums[ends - 1] - before) * q[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    limits = np.cumsum([0] + [len(t) + 1 for t in texts])
    return h, np.searchsorted(starts, limits)


def shingle_sets(texts: list[bytes], n: int):
    """For each text the sorted distinct hashes of its n-word shingles; a shorter text is one shingle, an empty one none."""
    h, at = word_hashes(texts)
    mult = _mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    if len(h) >= n:
        whole = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            whole += _mix(h[k : len(h) - n + 1 + k] ^ mult[k]) * mult[k]
        whole = _mix(whole)
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= n:
            yield np.unique(whole[a : b - n + 1])
        elif b > a:
            short = np.zeros(1, np.uint64)
            for k in range(b - a):
                short += _mix(h[a + k : a + k + 1] ^ mult[k]) * mult[k]
            yield _mix(short + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp): the smallest node each node of an edge list reaches.

    Rounds of hooking on the smallest neighbouring label, then a pointer jump, each written to the shared folder. Minima are taken
    map-side first, and labels of nodes with more than a 256th of all edge ends, less than 256 of them, are broadcast to their edges, so
    a star of any size spreads over all tasks.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("near")).filter("node <> near")
    both = cut(both.union(both.select(F.col("near").alias("node"), F.col("node").alias("near"))).distinct())
    degree = cut(both.groupBy("near").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("m")))
    labels = cut(degree.select(F.col("near").alias("node"), F.least("near", "m").alias("comp")))
    ends = degree.agg(F.sum("c")).first()[0] or 0
    hubs = any_hot(degree, "c", ends)
    while True:
        seen = hot_join(both, labels.withColumnRenamed("node", "near").join(degree.select("near", "c"), "near"), ["near"], "c", ends, hot=hubs)
        seen = seen.groupBy("node").agg(F.min("comp").alias("m"))
        hooked = cut(labels.join(seen, "node").select("node", F.col("comp").alias("was"), F.least("comp", "m").alias("comp")))
        jump = hooked.select(F.col("node").alias("comp"), F.col("comp").alias("root"))
        held = hooked.groupBy("comp").agg(F.count(F.lit(1)).alias("c"))
        jumped = hot_join(hooked, held.join(jump, "comp", "left"), ["comp"], "c", ends) if any_hot(held, "c", ends) else hooked.join(jump, "comp", "left")
        after = cut(jumped.select("node", "was", F.least(F.coalesce("root", "comp"), "comp").alias("comp")))
        moved = not after.filter("was <> comp").isEmpty()
        labels = after.select("node", "comp")
        if not moved:
            return labels


def append_columns(df: DataFrame, text_col: str, fields: str, make) -> DataFrame:
    """df with further columns that make() computes from its rows: one Arrow pass, no shuffle, no join.

    make() is called once per task and returns fn(texts, table) -> arrays for fields ("name type, ..."), where
    table holds the same rows of df. New names must not clash with those of df; callers use a prefix.
    """
    import pyarrow as pa
    from pyspark.sql.types import StructType

    at, added = df.columns.index(text_col), StructType.fromDDL(fields)

    def run(batches):
        fn = make()
        for batch in batches:
            for first, texts in text_chunks(batch, at):
                part = batch.slice(first, len(texts))
                yield pa.record_batch([*part.columns, *fn(texts, part)], names=[*part.schema.names, *added.names])

    return df.mapInArrow(run, StructType(df.schema.fields + added.fields))


def spread(df: DataFrame) -> DataFrame:
    """df, dealt anew where its scan gives fewer tasks than the cluster has cores: a small file is one task otherwise. Rows and results are the same."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def packed_row(df: DataFrame) -> Column:
    """All columns of df as one struct named row, so that an operator's own columns cannot clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def keyed_rows(docs: DataFrame, id_col: str, **columns: Column) -> DataFrame:
    """(row: struct of docs' columns, key, and the given columns): key tells the rows apart and orders them by id, null ids last.

    Where ids are unique and not null the key is the id. Otherwise a running number joins it, in a written table, so that it stays
    the same whatever is computed again; rows that share an id then have an arbitrary order among themselves.
    """
    picked = [c.alias(name) for name, c in columns.items()]
    if not repeated_ids(docs, id_col):
        return docs.select(packed_row(docs), F.col(id_col).alias("key"), *picked)
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("k"))
    return cut(docs.select(packed_row(docs), key.alias("key"), *picked))


def any_hot(right: DataFrame, count: str, total: int) -> bool:
    """Whether hot_join would broadcast any row of right; best asked of a written table."""
    return not right.filter(F.col(count) > max(1, total // 256)).isEmpty()


def hot_join(left: DataFrame, right: DataFrame, on: list[str], count: str, total: int, how: str = "inner", hot: bool = True) -> DataFrame:
    """left joined with right, which has one row a key and in count the rows of left with that key; total is the sum of the counts.

    Keys with more than a 256th of the rows are less than 256, so those rows of right are broadcast and their rows of left stay where they are;
    all others meet in a shuffle, where no key is large. Without hot, where any_hot has found none, all meet in that shuffle: half the plan, and no
    broadcast for the driver to hold.
    """
    bound = max(1, total // 256)
    kept = [c for c in right.columns if c not in on and c != count]
    names = [*left.columns, *kept]
    if not hot:
        return left.join(right.drop(count), on, how).select(*names)
    rows = right.filter(F.col(count) > bound).drop(count)
    rows = rows.select(*on, *[F.col(c).alias(f"__hot_{c}") for c in kept], F.lit(True).alias("__hot"))
    both = left.join(F.broadcast(rows), on, "left")
    near = both.filter("__hot").select(*[F.col(f"__hot_{c}").alias(c) if c in kept else F.col(c) for c in names])
    far = both.filter("__hot is null").select(*left.columns).join(right.filter(F.col(count) <= bound).drop(count), on, how).select(*names)
    return near.unionByName(far)


def summed_tables(parts: DataFrame, dtype=np.float32) -> dict[int, np.ndarray]:
    """Sums of tables that tasks send as rows (key, blob), by key.

    A reducer adds a key's tables one by one in double precision, so its memory holds one table a key; as many rows as keys
    reach the driver, whatever the input.
    """
    import pyarrow as pa

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for k, blob in zip(b.column(0).to_pylist(), b.column(1)):
                x = np.frombuffer(blob.as_buffer(), dtype)
                if k in held:
                    held[k] += x
                else:
                    held[k] = x.astype(np.float64)
        if held:
            yield pa.record_batch([pa.array(list(held), pa.int32()), pa.array([x.astype(dtype).tobytes() for x in held.values()], pa.binary())], names=["key", "blob"])

    return {r.key: np.frombuffer(r.blob, dtype) for r in parts.repartition("key").mapInArrow(add, "key int, blob binary").collect()}


def bounded_sample(df: DataFrame, bound: int, *keys: str, seed: int = 3) -> DataFrame:
    """Rows of df whose key hash is low: about bound of them, or all when there are fewer; the same rows every time."""
    n = df.count()
    if n <= bound:
        return df
    return df.filter(F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys], F.lit(seed)), F.lit(1_000_000)) < int(bound / n * 1_000_000))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_logistic(
    x: np.ndarray, y: np.ndarray, l2: float, steps: int, start: np.ndarray | None = None, rate: float = 0.1, on: np.ndarray | None = None, tilt: np.ndarray | None = None, near: float = 0.0
) -> np.ndarray:
    """Weights and, last, the bias of a logistic regression by full-batch Adam; deterministic.

    on: a mask of the rows to learn from, so none is copied. tilt: a gradient added to the loss's own. near: how strongly weights are held near start.
    """
    w = np.zeros(x.shape[1] + 1, np.float32) if start is None else start.copy()
    first, m, v = w.copy(), np.zeros_like(w), np.zeros_like(w)
    on = np.ones(len(y), np.float32) if on is None else on.astype(np.float32)
    if start is None:
        p = ((y * on).sum() + 0.5) / (on.sum() + 1)
        w[-1] = np.log(p / (1 - p))
    for t in range(1, steps + 1):
        r = ((sigmoid(x @ w[:-1] + w[-1]) - y) * on).astype(np.float32) / on.sum()
        g = np.append(x.T @ r + l2 * w[:-1], r.sum()).astype(np.float32) + near * (w - first)
        if tilt is not None:
            g += tilt
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= (rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return w
