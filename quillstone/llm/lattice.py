"""Embedding near-duplicates: every pair of a label is compared by cosine, in tiles that E8 lattice cells put in order and that centres and radii rule out."""

from __future__ import annotations

import itertools
import math
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import _mix, components, hot_join, spread
from quillstone.session import cut

#: The most vectors of a strip, the most strips a label is cut into for the sake of cores alone, and the most partitions they meet in.
STRIP, FEW, MOST_TASKS = 1 << 16, 8, 4096


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: steps to the neighbouring lattice points."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            out.append(v)
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def _nearest_d8(y: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: round, and where the sum is odd move the worst coordinate to its other side."""
    f = np.rint(y)
    odd = np.flatnonzero(f.sum(axis=1).astype(np.int64) & 1)
    rest = (y - f)[odd]
    worst = np.abs(rest).argmax(axis=1)
    f[odd, worst] += np.where(rest[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
    return f


def nearest_e8(y: np.ndarray) -> np.ndarray:
    """Nearest points of E8 = D8 and D8 shifted by a half in every coordinate."""
    a, b = _nearest_d8(y), _nearest_d8(y - 0.5) + 0.5
    nearer = ((y - a) ** 2).sum(axis=1) <= ((y - b) ** 2).sum(axis=1)
    return np.where(nearer[:, None], a, b)


class Lattice:
    """Cells of unit vectors in several tables, each a random projection to eight dimensions decoded in E8: what stands near what."""

    def __init__(self, dim: int, tables: int, probes: int, scale: float, seed: int):
        rng = np.random.default_rng([seed, dim])
        self.maps = [rng.normal(size=(dim, 8)) * scale / np.sqrt(8) for _ in range(tables)]
        self.steps, self.probes = minimal_vectors(), probes
        self.mult = _mix(np.arange(1, 9, dtype=np.uint64)) | np.uint64(1)

    def _code(self, points: np.ndarray, table: int, label: np.ndarray) -> np.ndarray:
        h = (_mix((np.rint(points * 2).astype(np.int64).view(np.uint64)) * self.mult) * self.mult).sum(axis=-1, dtype=np.uint64)
        return _mix(h ^ _mix(label.view(np.uint64) * np.uint64(31) + np.uint64(table))).view(np.int64)

    def keys(self, unit: np.ndarray, label: np.ndarray) -> np.ndarray:
        """(n, tables): the least code of a vector's home cell and of the neighbouring cells nearest to it, so that vectors near each other mostly share one."""
        out = []
        for t, m in enumerate(self.maps):
            y = unit @ m
            c = nearest_e8(y)
            gain = (y - c) @ self.steps.T
            top = np.argpartition(-gain, self.probes, axis=1)[:, : self.probes]
            codes = np.concatenate([self._code(c, t, label)[:, None], self._code(c[:, None, :] + self.steps[top], t, label[:, None])], axis=1)
            out.append(codes.min(axis=1))
        return np.stack(out, axis=1)


def _vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Each embedding in double precision, or None where it can't be compared."""
    out = []
    for x in column:
        v = x.as_py()
        if v is None or not len(v) or any(c is None for c in v):
            out.append(None)
            continue
        v = np.array(v, np.float64)
        out.append(v if np.isfinite(v).all() and np.any(v) else None)
    return out


def _units(vectors: list[np.ndarray]) -> np.ndarray:
    v = np.array(vectors)
    v /= np.abs(v).max(axis=1, keepdims=True)  # so squares neither overflow nor vanish
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _classes(batches):
    """A digest of label and vector for each row; null where the row links with nothing."""
    for b in batches:
        keys = [None if v is None or not l.is_valid else blake2b(v.tobytes() + str(l.as_py()).encode(), digest_size=16).digest() for v, l in zip(_vectors(b.column(1)), b.column(2))]
        yield pa.record_batch([b.column(0), pa.array(keys, pa.binary())], names=["id", "node"])


def _coded(batches, tables: int, probes: int, scale: float, seed: int, kind: str):
    """Each node's vector (bytes, of the kind of number the column holds), a digest of what it may be linked with (its label and length), and the cells that order it."""
    for b in batches:
        vectors, said = _vectors(b.column(1)), b.column(2).to_pylist()
        labels = np.array([x if isinstance(x, int) else int.from_bytes(blake2b(repr(x).encode(), digest_size=7).digest(), "big") for x in said], np.int64)
        size = np.array([len(v) for v in vectors], np.int64)
        for dim in np.unique(size):  # vectors of another length link with none of these
            at = np.flatnonzero(size == dim)
            keys = Lattice(int(dim), tables, probes, scale, seed).keys(_units([vectors[i] for i in at]), labels[at] * 1_000_003 + dim)
            kin = [blake2b(f"{dim}:{said[i]}".encode("utf-8", "surrogatepass"), digest_size=16).digest() for i in at]
            yield pa.record_batch(
                [b.column(0).take(pa.array(at)), b.column(3).take(pa.array(at)), pa.array(kin, pa.binary()), pa.array([vectors[i].astype(kind).tobytes() for i in at], pa.binary()), pa.array(list(keys), pa.list_(pa.int64()))],
                names=["node", "w", "kin", "raw", "keys"],
            )


def _linked(a: np.ndarray, b: np.ndarray, fa: np.ndarray, fb: np.ndarray, limit: float) -> np.ndarray:
    """Which vectors of a and b (fa and fb: their units in single precision) have a cosine of at least limit in double precision.

    A product in single precision decides wherever its error can't matter; only what is left is multiplied again.
    """
    slack = (a.shape[1] + 8) * 2.0**-22
    near = fa @ fb.T
    link = near >= limit - slack
    if link.any():
        x, y = np.nonzero(link & (near < limit + slack))
        step = max(1, (1 << 22) // a.shape[1])
        for i in range(0, len(x), step):
            p, q = x[i : i + step], y[i : i + step]
            link[p, q] = np.einsum("ij,ij->i", _units(a[p].astype(np.float64)), _units(b[q].astype(np.float64))) >= limit
    return link


def _joined(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Let root, the least member known of each member's cluster, know the links x to y."""
    while len(x):
        rx, ry = root[x], root[y]
        apart = rx != ry
        x, y, rx, ry = x[apart], y[apart], rx[apart], ry[apart]
        least = np.minimum(rx, ry)
        np.minimum.at(root, rx, least)
        np.minimum.at(root, ry, least)
        while (root[root] != root).any():
            root[:] = root[root]


def _pairs(side: np.ndarray, weight: np.ndarray, raw: np.ndarray, keys: np.ndarray, limit: float, block: int):
    """Links within one strip or between two: (member, weight linked with it, least member of its cluster here), from tiles of block by block members.

    Members stand in the order of their cells, so a tile holds such as are near each other; two tiles whose centres are farther apart than their
    radii and the limit allow hold no link and are not multiplied.
    """
    order = np.lexsort((*keys.T[::-1], side))
    raw, halves = raw[order], (np.flatnonzero(side[order] == 1), np.flatnonzero(side[order] == 2))
    apart = len(halves[0]) + len(halves[1]) > 0
    if apart and not (len(halves[0]) and len(halves[1])):
        return
    tiles, reach = [], np.sqrt(max(0.0, 2 - 2 * limit)) + 1e-6
    for at in halves if apart else (np.arange(len(raw)),):
        tiles.append([])
        for x in range(at[0], at[-1] + 1, block):
            y = min(x + block, at[-1] + 1)
            unit = _units(raw[x:y].astype(np.float64))
            centre = unit.mean(axis=0)
            tiles[-1].append((x, y, unit.astype(np.float32), centre, np.sqrt(((unit - centre) ** 2).sum(axis=1).max())))
    w = weight[order].astype(np.float64)  # sums stay below 2^53
    total, root = np.zeros(len(raw)), np.arange(len(raw))
    for i, (x, xe, fx, cx, rx) in enumerate(tiles[0]):
        for y, ye, fy, cy, ry in tiles[1] if apart else tiles[0][i:]:
            if np.sqrt(((cx - cy) ** 2).sum()) - rx - ry > reach:
                continue
            link = _linked(raw[x:xe], raw[y:ye], fx, fy, limit)
            if x == y:
                link &= np.tri(len(link), k=-1, dtype=bool).T
            if link.any():
                held = link.astype(np.float64)
                total[x:xe] += held @ w[y:ye]
                total[y:ye] += w[x:xe] @ held
                p, q = np.nonzero(link)
                _joined(root, p + x, q + y)
    rows = np.flatnonzero(total)
    yield order[rows], total[rows], order[root[rows]]


def _strips(batches, limit: float, kind: str, block: int):
    """Runs of equal (b1, b2, kin) in sorted rows (kin, b1, b2, side, node, w, raw, keys); a run may cross Arrow batches."""
    held: list[pa.RecordBatch] = []

    def done(parts):
        t = pa.Table.from_batches(parts).combine_chunks() if parts else None
        if t is None or t.num_rows < 2:
            return
        raw = np.frombuffer(b"".join(t.column("raw").to_pylist()), kind).reshape(t.num_rows, -1)
        keys = t.column("keys").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        nodes = t.column("node").combine_chunks()
        for rows, total, root in _pairs(t.column("side").to_numpy(), t.column("w").to_numpy(), raw, keys, limit, block):
            yield pa.record_batch([nodes.take(pa.array(rows)), pa.array(total.astype(np.int64)), nodes.take(pa.array(root))], names=["node", "n", "root"])

    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        kin = batch.column(0).dictionary_encode()
        names, codes = kin.dictionary.to_pylist(), kin.indices.to_numpy()
        b1, b2 = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        edge = np.flatnonzero((np.diff(codes) != 0) | (np.diff(b1) != 0) | (np.diff(b2) != 0)) + 1
        for x, y in zip(np.concatenate([[0], edge]), np.concatenate([edge, [batch.num_rows]])):
            k = (names[codes[x]], b1[x], b2[x])
            if k != key:
                yield from done(held)
                held, key = [], k
            held.append(batch.slice(x, y - x))
    yield from done(held)


def embedding_links(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    limit: float = 0.98,
    tables: int = 2,
    probes: int = 3,
    scale: float = 2.5,
    seed: int = 5,
    crowd: int = 2048,
    levels: int = 4,
    block: int = 2048,
) -> DataFrame:
    """One row per vector: id, n_links (other vectors linked directly), component_id (smallest id reachable), kept.

    Vectors of one label are linked when their cosine, in double precision, is at least limit: all of them, none is left to chance. Equal vectors are
    one node with a weight. A label's nodes are dealt into strips of at most STRIP; a task compares two strips, or one with itself, and gives a count
    and a cluster edge a node, never a row per pair. Within it nodes stand in the order of their E8 cells in tables projections to eight dimensions (the least
    code of home and probes neighbours, at scale), block at a time, and tiles too far apart for any link are passed over. Where nothing is far apart the
    work is the square of a label's nodes, in matrix products; memory is that of two strips and a tile.
    crowd and levels parted crowded cells when vectors met in shared cells alone, which missed pairs; they change nothing now.

    Null, empty or zero vectors, vectors with null or non-finite components and null labels link with nothing: n_links 0, a
    component of their own. Rows repeating an id are separate vectors. An empty table gives an empty result; further columns are ignored.
    """
    number = getattr(vectors.schema[vector_col].dataType, "elementType", None)
    kind_of = "float32" if number is not None and number.simpleString() == "float" else "float64"  # floats travel as they are and are widened where they are compared
    rows = spread(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label")))
    kind, label_kind = (rows.schema[c].dataType.simpleString() for c in ("id", "label"))
    keyed = cut(rows.mapInArrow(_classes, f"id {kind}, node binary"))
    held = rows.mapInArrow(lambda it: _first_of_class(it), f"node binary, id {kind}, v array<double>, label {label_kind}")
    nodes = cut(held.filter("node is not null").groupBy("node").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("w"), F.first("v").alias("v"), F.first("label").alias("label")))
    coded = cut(nodes.select("node", "v", "label", "w").mapInArrow(lambda it: _coded(it, tables, probes, scale, seed, kind_of), "node binary, w long, kin binary, raw binary, keys array<long>"))
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    sizes = cut(coded.groupBy("kin").agg(F.count(F.lit(1)).alias("c")))
    n = sizes.agg(F.sum("c")).first()[0] or 0
    share = max(1, n // (2 * cores))  # of a strip, so that few labels are work for all cores
    strips = F.greatest(F.ceil(F.col("c") / STRIP), F.least(F.ceil(F.col("c") / block), F.ceil(F.col("c") / share), F.lit(FEW))).cast("int")
    dealt = sizes.filter("c > 1").select("kin", "c", strips.alias("nb"))
    placed = hot_join(coded, dealt, ["kin"], "c", n).withColumn("b", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    pairs = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("o"))
    sent = pairs.select("kin", F.least("b", "o").alias("b1"), F.greatest("b", "o").alias("b2"), F.when(F.col("b") == F.col("o"), 0).when(F.col("b") < F.col("o"), 1).otherwise(2).alias("side"), "node", "w", "raw", "keys")
    tasks = dealt.agg(F.sum(F.col("nb") * (F.col("nb") + 1) / 2 * F.least(F.lit(1.0), F.col("c") / block))).first()[0] or 0  # many small labels share one
    sent = sent.repartition(min(3 * math.ceil(tasks) + 1, MOST_TASKS), "kin", "b1", "b2").sortWithinPartitions("kin", "b1", "b2")
    found = cut(sent.mapInArrow(lambda it: _strips(it, limit, kind_of, block), "node binary, n long, root binary"))
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    comps = components(found, "node", "root")
    homes = nodes.select("node", "rep", "w").join(counts, "node", "left").join(comps, "node", "left").select("node", "rep", "w", (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("comp", "node").alias("comp"))
    homes = cut(homes)
    least = cut(homes.groupBy("comp").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("c")))
    homes = hot_join(homes, least, ["comp"], "c", least.agg(F.sum("c")).first()[0] or 0).select("node", "w", "n_links", "component_id")
    homes = cut(homes)
    linked = keyed.filter("node is not null")
    out = hot_join(linked, homes.withColumnRenamed("w", "c"), ["node"], "c", homes.agg(F.sum("w")).first()[0] or 0).select("id", "n_links", "component_id")
    out = out.unionByName(keyed.filter("node is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    own = F.col("component_id")
    return out.select(F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), own.cast("long" if kind in ("int", "bigint") else kind).alias("component_id"), F.col("id").eqNullSafe(own).alias("kept"))


def _first_of_class(batches):
    for b in batches:
        for k in _classes([b]):
            yield pa.record_batch([k.column(1), b.column(0), b.column(1), b.column(2)], names=["node", "id", "v", "label"])
