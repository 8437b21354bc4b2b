"""Character n-gram vectors as postings tables, similarity joins over them, and what is built on nearest neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.text import normalize_grams
from quillstone.session import cut

#: Postings a piece of texts holds, but for its last text's: what a task packs, weighs and hands on at once.
PIECE = 1 << 18


def char_grams(text: Column, sizes: tuple[int, ...] = (4,), short: bool = True) -> Column:
    """Array of the text's character n-grams of the given sizes; with short, a text below the size is one gram.

    The text is split into characters once, so a long text costs its length and not its square.
    """
    chars, length = F.split(text, ""), F.char_length(text)
    none = F.array().cast("array<string>")
    out = none
    for n in sizes:
        grams = chars
        for k in range(1, n):  # arrays are joined shifted against themselves: linear, and nothing is evaluated per position
            grams = F.zip_with(grams, F.slice(chars, k + 1, F.greatest(length, F.lit(1))), lambda a, b: F.concat(a, b))
        many = F.when(length >= n, F.slice(grams, 1, length - n + 1))
        one = F.when(length > 0, F.array(text)).otherwise(none) if short else none
        out = F.concat(out, F.coalesce(many, one))
    return out


def four_grams(text: Column) -> Column:
    return char_grams(normalize_grams(text))


def word_grams(text: Column) -> Column:
    """The lower-case words of a text, as often as they occur."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[ \\t\\n\\x0b\\x0c\\r]+"), lambda w: w != "")


def grams_of(text: str, n: int = 4) -> tuple[list[str] | np.ndarray, np.ndarray]:
    """The distinct n-grams of a text, n up to 4, and how often each occurs; a shorter text is one gram, an empty one none."""
    if len(text) <= n:
        return ([text], np.ones(1, np.int64)) if text else ([], np.zeros(0, np.int64))
    letters, code = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
    if len(letters) > 1 << 16 or not letters[0]:  # a NUL would be lost at the end of a numpy string
        from collections import Counter

        held = Counter(text[i : i + n] for i in range(len(text) - n + 1))
        return list(held), np.array(list(held.values()), np.int64)
    key = np.zeros(len(code) - n + 1, np.uint64)
    for k in range(n):
        key = (key << np.uint64(16)) | code[k : len(code) - n + 1 + k].astype(np.uint64)
    key, tf = np.unique(key, return_counts=True)
    at = np.stack([(key >> np.uint64(16 * (n - 1 - k))) & np.uint64(0xFFFF) for k in range(n)], axis=1)
    return np.ascontiguousarray(letters[at.astype(np.int64)]).view(f"<U{n}").ravel(), tf


def distinct_grams(text: str, sizes: tuple[int, ...]) -> int:
    """How many distinct n-grams of the given sizes a text has; one below a size has none of it."""
    letter = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    key, total = letter, 0  # numbers of what stands at a place, one character longer each round; three letters fit as they are
    for n in range(1, min(max(sizes, default=0), len(letter)) + 1):
        if n > 1:
            key = key[:-1] << np.uint64(21) | letter[n - 1 :]
        if n >= 3 or n in sizes:
            key, held = np.unique(key, return_inverse=True)
            total += len(key) if n in sizes else 0
            key = held.astype(np.uint64)
    return total


def gram_set_sizes(df: DataFrame, sizes: tuple[int, ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, grams): the size of each text's set of n-grams, normalised as four_grams() does; a text is worked where it is."""
    rows = df.select(id_col, normalize_grams(F.col(text_col)).alias("t"))
    cores = df.sparkSession.sparkContext.defaultParallelism
    rows = rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([distinct_grams(t.as_py() or "", sizes) for t in b.column(1)], pa.int64())], [id_col, "grams"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, grams long")


def counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", grams=four_grams) -> DataFrame:
    """(id, g, tf): the multiset of each text's grams, by default its 4-grams.

    4-grams are counted where the text is, without a shuffle; only where ids repeat are counts of one id added up. Other grams are
    exploded and grouped.
    """
    if grams is not four_grams:
        return df.select(F.col(id_col), F.explode(grams(F.col(text_col))).alias("g")).groupBy(id_col, "g").agg(F.count(F.lit(1)).alias("tf"))
    rows = df.select(id_col, F.col(text_col).alias("t"))
    cores = df.sparkSession.sparkContext.defaultParallelism
    rows = (rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows).withColumn("t", normalize_grams(F.col("t")))

    def run(batches):
        for b in batches:
            for i, t in enumerate(b.column(1)):
                g, tf = grams_of(t.as_py() or "")
                if len(tf):
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.full(len(tf), i))), pa.array(g, pa.string()), pa.array(tf, pa.int64())], [id_col, "g", "tf"])

    out = rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, g string, tf long")
    if df.groupBy(id_col).count().filter("count > 1").isEmpty():
        return out
    return out.groupBy(id_col, "g").agg(F.sum("tf").alias("tf"))


def _weighed(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("idf", F.log(F.lit(float(max(1, n))) / (1 + F.col("df"))) + 1)


def idf(tf: DataFrame, n: int) -> DataFrame:
    """(g, df, idf) with idf = ln(n / (1 + df)) + 1."""
    return _weighed(tf.groupBy("g").agg(F.count(F.lit(1)).alias("df")), n)


def vectors(df: DataFrame, corpus: DataFrame | None = None, id_col: str = "doc_id", grams=four_grams) -> DataFrame:
    """(id, g, w): L2-normalised tf-idf postings; grams the corpus lacks weigh as idf 1. Written once, as every similarity join reads them."""
    tf = cut(counts(df, id_col, grams=grams))
    base = tf if corpus is None else counts(corpus, id_col, grams=grams)
    n = (df if corpus is None else corpus).count()
    w = tf.join(idf(base, n).select("g", "idf"), "g", "left").select(id_col, "g", (F.col("tf") * F.coalesce("idf", F.lit(1.0))).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))
    return cut(w.withColumn("norm", norm).select(id_col, "g", (F.col("w") / F.when(F.col("norm") == 0, 1.0).otherwise(F.col("norm"))).alias("w")))


def _coded(text: str) -> np.ndarray | None:
    """The 4-grams of a text as numbers of four 16-bit letters, padded by 0 where the text is shorter; None where a letter is wider or 0."""
    raw = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16).astype(np.uint64)
    if len(raw) != len(text) or not raw.all():
        return None
    raw = np.pad(raw, (0, max(0, 4 - len(raw))))
    return raw[:-3] << np.uint64(48) | raw[1:-2] << np.uint64(32) | raw[2:-1] << np.uint64(16) | raw[3:]


def _pieces(df: DataFrame, id_col: str, keep: list[str]) -> DataFrame:
    """The counted 4-grams of texts, a row a piece of about PIECE postings: documents, their postings and the piece's distinct grams with their documents."""
    rows = df.select(id_col, *keep, F.col("text").alias("t"))
    cores = df.sparkSession.sparkContext.defaultParallelism
    rows = (rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows).withColumn("t", normalize_grams(F.col("t")))
    most = PIECE

    def pack(number, docs, grams, tf):
        docs = pa.Table.from_batches(docs)
        known, at = np.unique(np.concatenate([g for g in grams if isinstance(g, np.ndarray)] or [np.zeros(0, np.uint64)]), return_inverse=True)
        letters = np.stack([(known >> np.uint64(s)) & np.uint64(0xFFFF) for s in (48, 32, 16, 0)], axis=1).astype(np.uint32)
        named = pa.concat_arrays([pa.array(np.ascontiguousarray(letters).view("<U4").ravel(), pa.string()), *(g for g in grams if isinstance(g, pa.Array))]).dictionary_encode()
        place = named.indices.to_numpy()
        ends = [np.cumsum([len(g) for g in grams if isinstance(g, kind)]) for kind in (np.ndarray, pa.Array)]
        parts = [iter(np.split(x, e)) for x, e in zip((place[: len(known)][at], place[len(known) :]), ends)]
        at = np.concatenate([next(parts[isinstance(g, pa.Array)]) for g in grams]).astype(np.int32)
        lists = [*(docs.column(c).combine_chunks() for c in docs.column_names), named.dictionary, pa.array(np.bincount(at, minlength=len(named.dictionary)), pa.int64())]
        held = [np.array([len(x) for x in tf], np.int64), at, np.concatenate(tf).astype(np.int64)]
        cols = [pa.array([number], pa.int64()), *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists), *(pa.array([x.tobytes()], pa.binary()) for x in held)]
        return pa.RecordBatch.from_arrays(cols, ["piece", *docs.column_names, "grams", "n", "many", "at", "tf"])

    def run(batches):
        number, docs, grams, tfs, held = TaskContext.get().partitionId() << 32, [], [], [], 0
        for b in batches:
            named = b.select(b.schema.names[:-1])
            for i, t in enumerate(b.column(b.num_columns - 1)):
                if not (t := t.as_py()):
                    continue
                g = _coded(t)
                g, tf = grams_of(t) if g is None else np.unique(g, return_counts=True)
                docs.append(named.slice(i, 1))
                grams.append(g if isinstance(g, np.ndarray) and g.dtype == np.uint64 else pa.array(g, pa.string()))
                tfs.append(tf)
                held += len(tf)
                if held >= most:
                    yield pack(number, docs, grams, tfs)
                    number, docs, grams, tfs, held = number + 1, [], [], [], 0
        if held:
            yield pack(number, docs, grams, tfs)

    lists = ", ".join(f"`{c}` array<{rows.schema[c].dataType.simpleString()}>" for c in [id_col, *keep])
    return cut(rows.mapInArrow(run, f"piece long, {lists}, grams array<string>, n array<long>, many binary, at binary, tf binary"), None, True)


def document_vectors(df: DataFrame, id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, keep..., gram, w): the postings of vectors(), a row a document that has any; grams are numbers.

    A piece's postings stay packed until they are weighed; only its distinct grams meet the corpus's. keep names columns that go along;
    of rows of one id, whose counts add up, the largest: of booleans any that holds.
    """
    keep = list(keep)
    number = lambda known: cut(known.withColumn("gram", F.monotonically_increasing_id()))
    if not df.groupBy(id_col).count().filter("count > 1").isEmpty():
        vec = vectors(df, id_col=id_col)
        vec = vec.join(number(vec.select("g").distinct()), "g").groupBy(id_col).agg(F.collect_list(F.struct("gram", "w")).alias("x"))
        sides = df.groupBy(F.col(id_col).alias("__id")).agg(*[F.max(c).alias(c) for c in keep or [F.lit(True)]])
        return cut(vec.join(sides, F.col(id_col).eqNullSafe(F.col("__id"))).select(id_col, *keep, F.col("x.gram").alias("gram"), F.col("x.w").alias("w")))
    pieces = _pieces(df, id_col, keep)
    own = pieces.select("piece", F.posexplode(F.arrays_zip("grams", "n")).alias("i", "x")).select("piece", "i", F.col("x.grams").alias("g"), "x.n")
    known = number(_weighed(own.groupBy("g").agg(F.sum("n").alias("df")), df.count()).select("g", "idf"))
    met = own.join(known, "g").select(F.col("piece").alias("part"), "i", "idf", "gram")
    names = [id_col, *keep]

    def weigh(left, right):
        one = {c: left.column(c).combine_chunks() for c in left.column_names}
        many, at, tf = (np.frombuffer(one[c][0].as_buffer(), t) for c, t in (("many", np.int64), ("at", np.int32), ("tf", np.int64)))
        order = np.argsort(right.column("i").to_numpy())
        w = tf * right.column("idf").to_numpy()[order][at]
        norm = np.sqrt(np.add.reduceat(w * w, np.cumsum(many) - many))
        norm[norm == 0] = 1.0
        ends = pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (right.column("gram").to_numpy()[order][at], w / np.repeat(norm, many))]
        return pa.Table.from_arrays([*(one[c].flatten() for c in names), *lists], names=[*names, "gram", "w"])

    packed = pieces.select("piece", *names, "many", "at", "tf").groupBy("piece").cogroup(met.groupBy("part"))
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)
    return cut(packed.applyInArrow(weigh, f"{kinds}, gram array<long>, w array<double>"), None, True)


def similarities(queries: DataFrame, base: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(q, p, s): cosine, clamped to [0, 1], of every pair that shares a gram: an equi-join on the gram, summed map-side first."""
    a, b = queries.select(F.col(id_col).alias("q"), "g", F.col("w").alias("wq")), base.select(F.col(id_col).alias("p"), "g", F.col("w").alias("wp"))
    s = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.sum(F.col("wq") * F.col("wp"))))
    return a.join(b, "g").groupBy("q", "p").agg(s.alias("s"))


def top_k(sims: DataFrame, queries: DataFrame, base: DataFrame, k: int, id_col: str = "doc_id", lone: bool = True) -> DataFrame:
    """(q, rank, p, s): the k most similar, ties to the smaller id; a query without a shared gram gets the first base row at 0, without lone none."""
    order = Window.partitionBy("q").orderBy(F.desc(F.round("s", 9)), "p")
    ranked = sims.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < k)
    if not lone:
        return ranked.select("q", "rank", "p", "s")
    first = base.agg(F.min(id_col).alias("p"))
    alone = queries.select(F.col(id_col).alias("q")).join(sims.select("q").distinct(), "q", "left_anti").crossJoin(first)
    return ranked.select("q", "rank", "p", "s").union(alone.select("q", F.lit(0), "p", F.lit(0.0)))


def rrf(lists: list[DataFrame], k: int = 60) -> DataFrame:
    """(q, p, score): reciprocal rank fusion, the sum of 1 / (k + rank + 1) over the lists that hold the pair."""
    union = lists[0].select("q", "p", "rank")
    for other in lists[1:]:
        union = union.unionByName(other.select("q", "p", "rank"))
    return union.groupBy("q", "p").agg(F.sum(1.0 / (k + 1 + F.col("rank"))).alias("score"))


def leaders(sims: DataFrame, nodes: DataFrame, limit: float = 0.55, id_col: str = "doc_id") -> DataFrame:
    """(id, leader): greedy leader clustering in id order: an unassigned row leads, and later unassigned rows this similar to it follow.

    Rounds over edges between undecided rows: a row without an undecided smaller neighbour leads, its neighbours follow. The
    smallest id decides first, so the outcome is that of the sequential pass, in as many rounds as the longest chain of decisions.
    """
    edges = cut(sims.filter((F.col("s") >= limit) & (F.col("q") < F.col("p"))).select(F.col("q").alias("a"), F.col("p").alias("b")))
    left = cut(nodes.select(F.col(id_col).alias("id")))
    done = None
    while True:
        live = edges.join(left.select(F.col("id").alias("a")), "a").join(left.select(F.col("id").alias("b")), "b")
        lead = left.join(live.select(F.col("b").alias("id")).distinct(), "id", "left_anti")
        follow = live.join(lead.select(F.col("id").alias("a")), "a").groupBy("b").agg(F.min("a").alias("leader")).select(F.col("b").alias("id"), "leader")
        step = cut(lead.select("id", F.col("id").alias("leader")).union(follow))
        done = step if done is None else done.union(step)
        left = cut(left.join(step.select("id"), "id", "left_anti"))
        if left.isEmpty():
            return done.withColumnRenamed("id", id_col)
