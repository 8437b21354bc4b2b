"""Circulant MinHash near-duplicate detection with exact Jaccard verification."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import _mix, any_hot, components, hot_join, keyed_rows, repeated_ids, shingle_sets, spread, text_chunks
from quillstone.session import cut

#: Positions of the circulant permutation; shingles are first permuted, then folded onto them.
CIRCLE_BITS = 20
#: Texts that meet in one numpy pass of the last comparison.
BLOCK = 128


class Circulant:
    """All signature coordinates from two permutations.

    The first (a bijective 64-bit mix) sends a shingle to a position p on the circle; the second is one table,
    and coordinate k is the least entry at p + k over all shingles: the table circularly shifted by k.
    A shingle's coordinates are a contiguous window of the table, so each costs one short copy.
    """

    def __init__(self, bands: int, rows: int, seed: int):
        rng = np.random.default_rng(seed)
        size, k = 1 << CIRCLE_BITS, bands * rows
        table = rng.permutation(size).astype(np.uint32)
        self.windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([table, table[:k]]), k)
        self.key = np.uint64(rng.integers(1, 1 << 63)) | np.uint64(1)
        self.bands, self.rows = bands, rows
        self.mult = _mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
        self.salt = _mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        at = (_mix(shingles * self.key) >> np.uint64(64 - CIRCLE_BITS)).astype(np.int64)
        return np.minimum.reduce([self.windows[at[i : i + 2048]].min(axis=0) for i in range(0, len(at), 2048)])

    def codes(self, signatures: np.ndarray) -> np.ndarray:
        """One 64-bit code for each band of each signature."""
        parts = signatures.reshape(-1, self.bands, self.rows).astype(np.uint64)
        return _mix((_mix(parts + self.mult) * self.mult).sum(axis=2, dtype=np.uint64) ^ self.salt).view(np.int64)


def _signatures(batches, ngram: int, bands: int, rows: int, seed: int):
    circle = Circulant(bands, rows, seed)
    for batch in batches:
        for first, texts in text_chunks(batch, 1):
            sizes, classes, signatures = [], [], []
            for s in shingle_sets(texts, ngram):
                sizes.append(len(s))
                classes.append(blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                if len(s):
                    signatures.append(circle.signature(s))
            codes = iter(circle.codes(np.array(signatures, np.uint32)) if signatures else ())
            yield pa.record_batch(
                [batch.column(0).slice(first, len(texts)), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array([next(codes) if n else None for n in sizes], pa.list_(pa.int64()))],
                names=["id", "n", "cls", "codes"],
            )


def _sets(batches, ngram: int):
    for batch in batches:
        for first, texts in text_chunks(batch, 1):
            sets = [s.view(np.int64) for s in shingle_sets(texts, ngram)]
            yield pa.record_batch([batch.column(0).slice(first, len(texts)), pa.array(sets, pa.list_(pa.int64()))], names=["cls", "items"])


def _ordered(pairs: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs, smaller class first, whose sizes allow the similarity at all."""
    fits = F.expr(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    return pairs.filter(fits).select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the similarity."""
    left, right = sets.toDF("a", "xs"), sets.toDF("b", "ys")
    both = pairs.join(right, "b").join(left, "a")
    both = both.select("a", "b", F.size(F.array_intersect("xs", "ys")).cast("long").alias("i"), (F.size("xs") + F.size("ys")).cast("long").alias("t"))
    return both.filter(f"100 * i >= {percent} * (t - i)").select("a", "b")


def _prefix_lists(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(item, cls, n, s, hub): for each node the shared ones of its rarest n - ceil(n * percent / 100) + 1 shingles.

    Sets that similar share one of those shingles of either, in any fixed order of shingles; here the rarest among the nodes come
    first, so a node whose own shingles fill the prefix is in no list. s counts its shingles that other nodes have too,
    hub tells how common its shingles are.
    """
    posts = sets.join(nodes, "cls").select("cls", "n", F.explode("items").alias("item"))
    seen = posts.groupBy("item").agg(F.count(F.lit(1)).alias("df"))
    own = Window.partitionBy("cls")
    posts = posts.join(seen, "item").select(
        "item", "cls", "n", "df", F.row_number().over(own.orderBy("df", "item")).alias("k"), F.count(F.when(F.col("df") > 1, 1)).over(own).alias("s"), F.avg(F.log("df")).over(own).alias("hub")
    )
    return posts.filter(f"k <= n * (100 - {percent}) div 100 + 1 and df > 1").select("item", "cls", "n", "s", "hub")


def _star_pairs(posts: DataFrame, percent: int) -> DataFrame:
    """Members of each list against its most central one, where they are of different components and can reach the similarity."""
    hubs = posts.groupBy("item").agg(F.max(F.struct("hub", "cls", "n", "s", "comp")).alias("h"))
    both = posts.join(hubs, "item").filter("comp <> h.comp").select(F.col("h.cls").alias("ca"), F.col("h.n").alias("na"), F.col("h.s").alias("sa"), F.col("cls").alias("cb"), F.col("n").alias("nb"), F.col("s").alias("sb"))
    return both.filter(f"100 * least(sa, sb) >= {percent} * (na + nb - least(sa, sb))")


def _block_links(posts: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links across components among members of one list, as edges that connect the same nodes.

    Lists with one most central member are a group. Its members outside its commonest component are cut into blocks, the rest
    into others, and every pair of blocks with one of the former is compared in one numpy pass: rows grow with members times
    blocks, and a group of any size spreads over many tasks.
    """
    lists = posts.groupBy("item").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(F.struct("hub", "cls")).alias("h")).filter("lo <> hi").select("item", F.col("h.cls").alias("g"))
    members = cut(posts.join(lists, "item").select("g", "cls", "n", "comp").distinct())
    held = members.groupBy("g", "comp").agg(F.count(F.lit(1)).alias("c"))
    shape = held.groupBy("g").agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("all"))
    blocks = lambda c: F.ceil(c / BLOCK).cast("int")
    shape = shape.select("g", F.col("top.comp").alias("major"), blocks(F.col("all") - F.col("top.c")).alias("few"), blocks(F.col("top.c")).alias("many")).filter("few > 0")
    placed = members.join(shape, "g").withColumn("o", F.xxhash64("cls"))
    minor, last = F.col("comp") != F.col("major"), F.when(F.col("comp") != F.col("major"), F.col("few") + F.col("many")).otherwise(F.col("few")) - 1
    placed = placed.select("g", "cls", "n", "comp", F.when(minor, F.pmod("o", "few")).otherwise(F.col("few") + F.pmod("o", "many")).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), last)).alias("o"))
    placed = placed.select("g", F.least("b", "o").alias("b1"), F.greatest("b", "o").alias("b2"), F.when(F.col("b") == F.col("o"), 0).when(F.col("b") < F.col("o"), 1).otherwise(2).alias("side"), "cls", "comp")
    sent = placed.join(sets, "cls").select("g", "b1", "b2", "side", "cls", "comp", "items")
    sent = sent.repartition("g", "b1", "b2").sortWithinPartitions("g", "b1", "b2")
    return sent.mapInArrow(lambda it: _compare_blocks(it, percent), "a binary, b binary")


def _compare_blocks(batches, percent: int):
    """Edges from each run of equal (g, b1, b2) in sorted rows; a run may cross Arrow batches."""
    held, key = [], None

    def done():
        edges = list(_compare(held, percent)) if len(held) > 1 else []
        if edges:
            yield pa.record_batch([pa.array([e[k] for e in edges], pa.binary()) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        keys = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
        rest = [batch.column(k).to_pylist() for k in range(3, 6)]
        items = batch.column(6)
        for i, k in enumerate(keys):
            if k != key:
                yield from done()
                held, key = [], k
            held.append((*(c[i] for c in rest), items[i].values.to_numpy()))
    yield from done()


def _compare(rows: list, percent: int):
    """(node, root of its cluster) for the rows (side, cls, comp, items) of one pair of blocks."""
    one = [i for i, r in enumerate(rows) if r[0] == 1] or list(range(len(rows)))
    two = [i for i, r in enumerate(rows) if r[0] == 2] or one
    if any(r[0] for r in rows) and (len(one) == len(rows) or two is one):
        return  # one of the two blocks is empty
    size = np.array([len(r[3]) for r in rows])
    _, where = np.unique(np.concatenate([r[3] for r in rows]), return_inverse=True)
    at = np.cumsum(np.concatenate([[0], size]))
    comp = np.unique([r[2] for r in rows], return_inverse=True)[1]
    mark = np.zeros(where.max() + 1, np.int64)
    other = np.concatenate([where[at[j] : at[j + 1]] for j in two])
    begins = np.cumsum(np.concatenate([[0], size[two]]))[:-1]
    root = np.arange(len(rows))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in one:
        mark[where[at[i] : at[i + 1]]] = 1
        shared = np.add.reduceat(mark[other], begins)
        mark[where[at[i] : at[i + 1]]] = 0
        like = (100 * shared >= percent * (size[i] + size[two] - shared)) & (comp[two] != comp[i])
        for j in np.flatnonzero(like):
            x, y = find(i), find(two[j])
            root[max(x, y)] = min(x, y)
    for i in range(len(rows)):
        if find(i) != i:
            yield rows[i][1], rows[find(i)][1]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 5, percent: int = 80, bands: int = 25, rows: int = 5, seed: int = 11) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id reachable over links), kept.

    Two texts are linked when 100 * |A & B| >= percent * |A | B| for their sets of word shingles. Texts with one set
    form a class and only classes are compared. Classes that share a band of their signature are candidates: each
    bucket first tests all members against one pivot. Members of buckets that still hold several components are then
    compared by prefix filtering, which is exact: first with the most central member of each list, then block by block in all
    pairs across components, always on full sets. So no candidate that could join two components goes untested, while
    copies and near copies of one text leave after the first rounds and no stage emits a row per pair of a group.

    Null or empty texts have no shingles and link with nothing. Null ids are never a component's smallest unless all are null.
    Rows repeating an id with equal text share a class and flags. An empty table gives an empty result; further columns are ignored.
    """
    docs = spread(docs)
    rows_in = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows_in.schema["id"].dataType.simpleString()
    sig = cut(rows_in.mapInArrow(lambda it: _signatures(it, ngram, bands, rows, seed), f"id {kind}, n long, cls binary, codes array<long>"))
    classes = cut(sig.filter("n > 0").groupBy("cls").agg(F.min("id").alias("rep"), F.min("n").alias("n"), F.first("codes").alias("codes")))
    spots = classes.select("cls", "n", F.explode("codes").alias("code"))
    full = spots.groupBy("code").agg(F.min(F.struct("cls", "n")).alias("pivot"), F.max("cls").alias("hi"), F.count(F.lit(1)).alias("c"))
    full = cut(full.filter("pivot.cls <> hi").select("code", "pivot", "c"))
    total = full.agg(F.sum("c")).first()[0] or 0
    spots = cut(hot_join(spots, full, ["code"], "c", total, hot=any_hot(full, "c", total)))
    wanted = classes.join(spots.select("cls").distinct(), "cls", "left_semi").select("rep", F.col("cls").alias("want"))
    texts = rows_in.join(wanted, F.col("id").eqNullSafe(F.col("rep"))).select("want", "text")
    sets = texts.mapInArrow(lambda it: _sets(it, ngram), "cls binary, items array<long>")
    if repeated_ids(rows_in, "id"):  # one id may hold several texts; only the one of the class counts
        sets = texts.mapInArrow(lambda it: _own_sets(it, ngram), "cls binary, items array<long>").dropDuplicates(["cls"])
    sets = cut(sets)

    tested = cut(_ordered(spots.filter("cls <> pivot.cls").select(F.col("pivot.cls").alias("ca"), F.col("pivot.n").alias("na"), F.col("cls").alias("cb"), F.col("n").alias("nb")), percent))
    links = cut(_verified(tested, sets, percent))
    comps = components(links)
    open_ = spots.join(comps.withColumnRenamed("node", "cls"), "cls", "left").select("code", "cls", "n", F.coalesce("comp", "cls").alias("comp"))
    split = open_.groupBy("code").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("code")
    posts = cut(_prefix_lists(open_.join(split, "code").select("cls", "n").distinct(), sets, percent))
    home = lambda: posts.join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    more = cut(_verified(_ordered(_star_pairs(home(), percent), percent).join(tested, ["a", "b"], "left_anti"), sets, percent))
    if not more.isEmpty():
        links = links.union(more)
        comps = components(links)
    more = cut(_block_links(home(), sets, percent))
    if not more.isEmpty():
        comps = components(links.union(more))
    homes = classes.select("cls", "rep").join(comps.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "rep", F.coalesce("comp", "cls").alias("comp"))
    least = homes.groupBy("comp").agg(F.min("rep").alias("component_id"))
    homes = homes.join(least, "comp").select("cls", "component_id")
    out = sig.select("id", "n", "cls").join(homes, "cls", "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("id").eqNullSafe(own).alias("kept"))


def _own_sets(batches, ngram: int):
    """Sets of those texts whose class is the one wanted."""
    for batch in batches:
        for first, texts in text_chunks(batch, 1):
            wants = batch.column(0).slice(first, len(texts)).to_pylist()
            own = [(w, s.view(np.int64)) for w, s in zip(wants, shingle_sets(texts, ngram)) if blake2b(s.tobytes(), digest_size=16).digest() == w]
            yield pa.record_batch([pa.array([w for w, _ in own], pa.binary()), pa.array([s for _, s in own], pa.list_(pa.int64()))], names=["cls", "items"])


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each component of near duplicates, the smallest id's, and all rows without shingles, with the columns of docs, whatever their names.

    Rows sharing an id, or without one, are rows of their own: different texts under one id all stay.
    """
    rows = keyed_rows(docs, id_col, text=F.col(text_col).cast("string"))
    stay = near_duplicates(rows, "key", "text", **options).filter("kept").select("key")
    return rows.join(stay, "key", "left_semi").select("row.*")
