"""Similarity join of sparse vectors in blocks: a stated set of queries against a base, exact, with k rows a query and strip of the base leaving a task.

A block holds the postings of at most ROWS documents, about POSTINGS of them, sorted by gram, as one row. A block of queries is one partition of
a table, a strip of at most STRIP base blocks is one of another. Each pair of blocks meets once: a task holds one block of queries, streams one strip
past it and adds, pair by pair, the products of weights that share a gram into a dense tile of scores. Neither side is copied in a shuffle, and a task
holds the few pairs of one Arrow batch whatever the tables' size. No pair of documents is ever a row unless it is a result.
Documents of one language, or whatever else tells which share grams, may share blocks, so that tiles across languages have few common grams; a table
met with itself meets each pair of blocks once, for both sides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.session import cut

ROWS, LEAST_ROWS, POSTINGS, STRIP = 2048, 128, 1 << 20, 32
#: Values of a column of likes that are told apart; one with less than this part of a block shares blocks with others such.
LIKES, SMALL = 256, 1 / 4
#: Products made at once; with a tile they bound what a task holds.
AT_ONCE = 1 << 21
#: A gram in more than this share of a tile's cells is a column of a matrix product, DENSE columns at a time; one with more cells than MANY is added by itself.
SHARE, DENSE, MANY = 1 / 200, 512, 128

_PACKED = "ids binary, eras binary, gram binary, n binary, doc binary, w binary"
_KINDS = (np.int64, np.float64, np.int64, np.int32, np.int32, np.float64)
_NAMES = [c.split()[0] for c in _PACKED.split(", ")]


def _by_document(vec: DataFrame) -> bool:
    return vec.schema["w"].dataType.typeName() == "array"


def _number(vec: DataFrame, id_col: str, rows: int, alike: str | None, docs: int, many: int) -> tuple[Column, int]:
    """The block of a document, and how many there are: its likes' own blocks, or those of all likes too few for one."""
    like = F.pmod(F.xxhash64(alike), F.lit(LIKES)) if alike else F.lit(0)
    sizes = {r.like: (r.docs, r.many) for r in vec.groupBy(like.alias("like")).agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size("w")).alias("many")).collect()} if alike else {0: (docs, many)}
    small = [x for x, (d, m) in sizes.items() if max(d / rows, m / POSTINGS) < SMALL]
    groups = [[x] for x in sorted(sizes) if x not in small] + ([small] if small else [])
    start, many_of, blocks = [0] * LIKES, [1] * LIKES, 0
    for group in groups:
        d, m = (sum(sizes[x][i] or 0 for x in group) for i in (0, 1))
        n = max(1, -(-d // rows), -(-m // POSTINGS))
        for x in group:
            start[x], many_of[x] = blocks, n
        blocks += n
    at = lambda listed: F.element_at(F.array(*[F.lit(x) for x in listed]), (like + 1).cast("int")) if alike else F.lit(listed[0])
    return (at(start) + F.pmod(F.xxhash64(id_col), at(many_of))).cast("int").alias("b"), max(1, blocks)


def _blocks(vec: DataFrame, known: DataFrame | None, id_col: str, rows: int, docs: int, alike: str | None = None) -> tuple[DataFrame, int]:
    """Numbered blocks of a table of postings (id, g, w[, era]) over the known grams, or of document vectors, and how many."""
    many = vec.count() if known is not None else vec.agg(F.sum(F.size("w"))).first()[0] or 0
    number, blocks = _number(vec, id_col, rows, alike if known is None else None, docs, many)
    era = F.col("era").cast("double") if "era" in vec.columns else F.lit(None).cast("double")
    held = (vec if known is None else vec.join(known, "g")).select(number, F.col(id_col).cast("long").alias("id"), "gram", "w", era.alias("era"))

    whole = known is None

    def pack(key, t):
        if whole:
            t = t.combine_chunks().sort_by("id")
            ids, eras = (t.column(c).to_numpy() for c in ("id", "era"))
            gram, w = (t.column(c).combine_chunks() for c in ("gram", "w"))
            doc = np.repeat(np.arange(len(ids)), gram.value_lengths().to_numpy())
            gram, w = gram.flatten().to_numpy(), w.flatten().to_numpy()
        else:
            ids, first, doc = np.unique(t.column("id").to_numpy(), return_index=True, return_inverse=True)
            eras, gram, w = t.column("era").to_numpy()[first], t.column("gram").to_numpy(), t.column("w").to_numpy()
        order = np.argsort(gram, kind="stable")
        grams, n = np.unique(gram, return_counts=True)
        cols = [ids, eras.astype(np.float64), grams, n.astype(np.int32), doc.astype(np.int32)[order], w[order]]
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in cols)], names=["b", *_NAMES])

    return cut(held.groupBy("b").applyInArrow(pack, f"b int, {_PACKED}"), wide=True), blocks


def _dealt(packed: DataFrame, parts: int) -> DataFrame:
    """Blocks dealt out evenly to so many partitions."""
    return packed.repartitionById(parts, F.col("b") % parts).select("b", *_NAMES)


def _packed(vec: DataFrame, known: DataFrame | None, id_col: str, rows: int, docs: int) -> DataFrame:
    """Blocks, each in a partition of its own."""
    return _dealt(*_blocks(vec, known, id_col, rows, docs))


def tile(a: tuple, n: int, b: tuple, m: int) -> np.ndarray:
    """(n, m) sums of products of weights that share a gram. Sides are (grams, postings of each, documents, weights), in the order of grams.

    Frequent grams are columns of matrix products, rarer ones are added one by one, and those of a few cells many at once.
    """
    out = np.zeros((n, m))
    flat = out.reshape(-1)
    _, x, y = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    (ca, da, wa), (cb, db, wb) = ((s[1].astype(np.int64), s[2], s[3]) for s in (a, b))
    fa, fb = (np.cumsum(c) - c for c in (ca, cb))
    ca, cb, fa, fb = ca[x], cb[y], fa[x], fb[y]
    cells = ca * cb
    often = cells > max(MANY, n * m * SHARE)
    rest = cells <= MANY

    def postings(first, many):
        """Which of the grams, and which posting, for all postings of some grams."""
        g = np.repeat(np.arange(len(many)), many)
        return g, np.arange(len(g)) + np.repeat(first - (np.cumsum(many) - many), many)

    at = np.flatnonzero(often)
    for i in range(0, len(at), DENSE):
        some = at[i : i + DENSE]
        sides = []
        for first, many, doc, w, size in ((fa, ca, da, wa, n), (fb, cb, db, wb, m)):
            g, p = postings(first[some], many[some])
            dense = np.zeros((size, len(some)))
            dense[doc[p], g] = w[p]
            sides.append(dense)
        out += sides[0] @ sides[1].T
    for k in np.flatnonzero(~often & ~rest):
        i, j = slice(fa[k], fa[k] + ca[k]), slice(fb[k], fb[k] + cb[k])
        out[da[i, None], db[j]] += wa[i, None] * wb[j]
    at = np.flatnonzero(rest)
    ends = np.cumsum(cells[at])
    i = 0
    while i < len(at):
        done = ends[i - 1] if i else 0
        to = max(i + 1, int(np.searchsorted(ends, done + AT_ONCE, "right")))
        some = at[i:to]
        g, q = postings(fa[some], ca[some])
        c = cb[some][g]
        _, p = postings(fb[some][g], c)
        q = np.repeat(q, c)
        np.add.at(flat, da[q].astype(np.int64) * m + db[p], wa[q] * wb[p])
        i = to
    return out


def best(r: np.ndarray, k: int) -> np.ndarray:
    """Where the k largest values of each row stand; of equal ones the first."""
    if k >= r.shape[1]:
        return np.ones(r.shape, bool)
    top = r >= np.partition(r, -k, axis=1)[:, -k, None]
    for i in np.flatnonzero(top.sum(axis=1) > k):
        on = np.flatnonzero(top[i])
        top[i, on[np.argsort(-r[i, on], kind="stable")[k:]]] = False
    return top


def merged(held: tuple | None, s: np.ndarray, p: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids), k a row at most: the best of those held and of those of one more block, ties to the smaller id; no score: -1."""
    if s.shape[1] > k:
        at = np.argpartition(-np.where(best(np.round(s, 9), k), s, -2.0), k - 1, axis=1)[:, :k]
        s, p = np.take_along_axis(s, at, axis=1), p[at]
    else:
        p = np.broadcast_to(p, s.shape)
    if held is not None:
        s, p = np.hstack([held[0], s]), np.hstack([held[1], p])
        at = np.lexsort((p, -np.round(s, 9)), axis=1)[:, :k]
        s, p = np.take_along_axis(s, at, axis=1), np.take_along_axis(p, at, axis=1)
    return s, p


def _once(many: int) -> Column:
    """Whether block q_b is the one of two blocks that meets the other, b: each meets equally many, and itself."""
    ahead = F.pmod(F.col("b") - F.col("q_b"), F.lit(many)) * 2
    return (ahead < many) | ((ahead == many) & (F.col("b") > F.col("q_b")))


def block_similarities(queries: DataFrame, base: DataFrame, id_col: str = "doc_id", k: int | None = None, least: float = 0.0, apart: bool = False, older: bool = False, alike: str | None = None) -> DataFrame:
    """(q, p, s): cosines, clamped to [0, 1], of pairs that share a gram and reach least, from unit postings (id, g, w) or from document
    vectors (id, gram, w) of one document_vectors() table on both sides.

    With k, only a query's k best of each strip of the base, which hold its k best of all (ties to the smaller id). apart leaves
    a document and itself out. older takes base rows whose era is below the query's only; rows without era then meet nothing. alike names a column of
    document vectors whose equal values tell which share most grams; it costs or saves time and changes no result.
    A table met with itself meets half of the pairs of blocks, each for both sides, unless older or k above 1 ask for more: with k, a query
    then has a row for each of the blocks it is met from.
    """
    known = None if _by_document(base) else cut(base.select("g").distinct().withColumn("gram", F.monotonically_increasing_id()))
    cores = queries.sparkSession.sparkContext.defaultParallelism
    n, m = (x.select(id_col).distinct().count() for x in (queries, base))
    rows = min(ROWS, max(LEAST_ROWS, int((n * m / (3 * cores)) ** 0.5)))  # small tables are cut finer, so that all cores have pairs
    right, many = _blocks(base, known, id_col, rows, m, alike)
    left, asked = (right, many) if queries is base else _blocks(queries, known, id_col, rows, n, alike)
    both = queries is base and not older and (k is None or k == 1)
    strips = min(many, max(-(-many // STRIP), -(-3 * cores // asked)))
    # The second side is what a task holds, the first one streams past.
    met = _dealt(right, strips).hint("shuffle_replicate_nl").crossJoin(_dealt(left, asked).toDF("q_b", *[f"q_{c}" for c in _NAMES]))
    if both:
        met = met.filter(_once(many))
    met = met.select(*_NAMES, *[f"q_{c}" for c in _NAMES], (F.col("b") != F.col("q_b")).alias("mirrored") if both else F.lit(False).alias("mirrored"))

    def rows_of(q, p, s):
        for x in range(0, len(q), 1 << 16):
            y = slice(x, x + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(q[y]), pa.array(p[y]), pa.array(s[y])], ["q", "p", "s"])

    def kept(qi, p, s):
        r, c = np.nonzero(s > 0)
        return rows_of(qi[r], p[r, c], s[r, c])

    def run(batches):
        top, ids = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                held = [np.frombuffer(batch.column(c)[i].as_buffer(), _KINDS[c % 6]) for c in range(12)]
                (pi, pe, *b), (qi, qe, *a) = held[:6], held[6:]
                mirrored = batch.column(12)[i].as_py()
                s = tile(a, len(qi), b, len(pi))
                if k is None:  # few pairs are results: nothing is done to the others
                    r, c = np.nonzero(s >= least if least > 0 else s > 0)
                    stay = np.ones(len(r), bool)
                    if apart:
                        stay &= qi[r] != pi[c]
                    if older:
                        stay &= pe[c] < qe[r]
                    r, c = r[stay], c[stay]
                    q, p, s = qi[r], pi[c], np.minimum(s[r, c], 1.0)
                    yield from rows_of(q, p, s)
                    if mirrored:
                        yield from rows_of(p, q, s)
                    continue
                np.clip(s, 0.0, 1.0, out=s)
                s[s < least] = -1.0
                s[s == 0] = -1.0
                if apart:
                    s[qi[:, None] == pi[None, :]] = -1.0
                if older:
                    s[~(pe[None, :] < qe[:, None])] = -1.0
                if mirrored:
                    t, at = merged(None, s.T, qi, k)
                    yield from kept(pi, at, t)
                if ids is not None and not np.array_equal(ids, qi):  # another block of queries
                    yield from kept(ids, top[1], top[0])
                    top = None
                top, ids = merged(top, s, pi, k), qi.copy()
        if top is not None:
            yield from kept(ids, top[1], top[0])

    return cut(met.mapInArrow(run, "q long, p long, s double"))
