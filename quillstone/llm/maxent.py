"""LM scoring: a hashed maximum-entropy model with a class-factored softmax, trained by distributed gradient updates."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import _mix, append_columns, spread, summed_tables, text_chunks, word_hashes
from quillstone.session import cut

#: Outcomes of one class decision, and how many of them lead on to classes where not all can be words.
FAN, INNER = 8, 6
#: Words whose counts shape the classes.
CONTEXTS = 24
FEATURES = 3  # previous word; the word before it, skipping one; both as an n-gram
END_SLOT, TAIL_SLOT, FIRST_CLASS = 0, 1, 2
_END, _START = (np.uint64(x) for x in _mix(np.array([101, 202], np.uint64)))
_KEYS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_ROWS = 2048  # tokens decided at once: what they touch stays in the processor's cache
_NEVER = np.float32(-1e4)


def sequence(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, an end after each, and where each text begins (one more entry than texts)."""
    h, at = word_hashes(texts)
    doc = np.repeat(np.arange(len(texts)), np.diff(at))
    seq = np.full(len(h) + len(texts), _END, np.uint64)
    seq[np.arange(len(h)) + doc] = h
    return seq, at + np.arange(len(at))


def features(seq: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """(FEATURES, n) 64-bit hashes of each token's context within its text."""
    one, two = np.roll(seq, 1), np.roll(seq, 2)
    first = begins[:-1]
    one[first] = _START
    two[first] = _START
    second = first + 1
    two[second[second < begins[1:]]] = _START
    return np.stack([_mix(one * _KEYS[0]), _mix(two * _KEYS[1]), _mix(one * _KEYS[2] + two * _KEYS[0])])


@dataclass
class Model:
    """Known words (hashes ascending, counts) with their paths through nested classes, and the weights of every class decision.

    A path is a run of (node, slot) in two arrays: at each node one of FAN outcomes, a word or a class, is drawn. Its log odds are
    the node's bias plus one row of weights for each context feature, found by hashing feature and node together. The
    last path is that of the tail: all other words.
    """

    hashes: np.ndarray
    counts: np.ndarray
    total: int
    distinct: int
    start: np.ndarray  # (words + 1)
    length: np.ndarray
    node: np.ndarray
    slot: np.ndarray
    bias: np.ndarray  # (nodes, FAN)
    weights: np.ndarray  # (rows, FAN), rows a power of two
    tail_norm: float

    def look_up(self, seq: np.ndarray) -> np.ndarray:
        """For each token its place among the known words, -1 if none."""
        if not len(self.hashes):
            return np.full(len(seq), -1)
        uniq, inverse = np.unique(seq, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hashes, uniq), len(self.hashes) - 1)
        return np.where(self.hashes[at] == uniq, at, -1)[inverse]

    def decisions(self, place: np.ndarray, context: np.ndarray):
        """For every decision on the tokens' paths: position, slot, rows (one array a feature) and probabilities (n, FAN)."""
        length = self.length[place]
        ends = np.cumsum(length)
        pos = np.repeat(np.arange(len(place)), length)
        at = np.arange(len(pos)) + np.repeat(self.start[place] - (ends - length), length)
        node, slot = self.node[at], self.slot[at]
        shift = np.uint64(64 - (len(self.weights).bit_length() - 1))
        key = (node.astype(np.uint64) * _KEYS[0] + _KEYS[1]) | np.uint64(1)
        rows = [((np.take(c, pos) * key) >> shift).astype(np.int64) for c in context]
        z = np.take(self.bias, node, axis=0)
        for r in rows:
            z += np.take(self.weights, r, axis=0)
        np.exp(z, out=z)  # weights are a few steps long and biases negative, so nothing overflows
        z /= np.einsum("ij->i", z)[:, None]
        return pos, slot, rows, z

    def log10(self, place: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Log10 probability of each token's path; what an unknown or tail word shares with others of the tail is not in it."""
        out = []
        for i in range(0, len(place), _ROWS):
            pos, slot, _, p = self.decisions(place[i : i + _ROWS], context[:, i : i + _ROWS])
            logs = np.log10(np.maximum(p.reshape(-1)[np.arange(len(pos)) * FAN + slot], 1e-30))
            out.append(np.bincount(pos, logs, len(place[i : i + _ROWS])))
        return np.concatenate(out) if out else np.zeros(0)


def _word_counts(batches):
    """(h, n): token counts, summed within the task in bounded tables."""
    held: list[np.ndarray] = []
    sums: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def merged(sums, held):
        u, n = np.unique(np.concatenate(held), return_counts=True)
        if not len(sums[0]):
            return u, n
        w, at = np.unique(np.concatenate([sums[0], u]), return_inverse=True)
        return w, np.bincount(at, np.concatenate([sums[1], n]), len(w)).astype(np.int64)

    size = 0
    for b in batches:
        for _, texts in text_chunks(b, 0):
            seq, _ = sequence(texts)
            held.append(seq)
            size += len(seq)
            if size > 1_000_000:
                sums, held, size = merged(sums, held), [], 0
                if len(sums[0]) > 1_000_000:
                    yield pa.record_batch([pa.array(sums[0].view(np.int64)), pa.array(sums[1])], names=["h", "n"])
                    sums = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    if held:
        sums = merged(sums, held)
    if len(sums[0]):
        yield pa.record_batch([pa.array(sums[0].view(np.int64)), pa.array(sums[1])], names=["h", "n"])


def _context_counts(batches, model: Model, top: np.ndarray):
    """How often each known word stands before each of the top words, sent in blocks."""
    table = np.zeros(len(model.hashes) * CONTEXTS, np.float32)
    rank = np.full(len(model.hashes), -1)
    rank[top[:CONTEXTS]] = np.arange(len(top[:CONTEXTS]))
    for b in batches:
        for _, texts in text_chunks(b, 0):
            place = model.look_up(sequence(texts)[0])
            for gap in (1, 2):
                a, c = place[:-gap], place[gap:]
                ok = (a >= 0) & (c >= 0)
                a, c = a[ok], rank[c[ok]]
                np.add.at(table, a[c >= 0] * CONTEXTS + c[c >= 0], np.float32(1))
    yield from _blobs(table)


def _blobs(table: np.ndarray, blocks: int = 32):
    parts = np.array_split(table.astype(np.float32, copy=False), blocks)
    yield pa.record_batch([pa.array(np.arange(blocks), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["key", "blob"])


def _joined(sums: dict[int, np.ndarray], size: int) -> np.ndarray:
    return np.concatenate([sums[k] for k in sorted(sums)]) if sums else np.zeros(size, np.float32)


def _clusters(table: np.ndarray, weight: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means of words, commonest first, by the square roots of their context shares, weighted by frequency; deterministic."""
    n = table.sum(axis=1, keepdims=True)
    prior = table.sum(axis=0) / max(table.sum(), 1)
    x = np.sqrt((table + 4 * prior) / (n + 4)).astype(np.float32)
    centre = x[np.linspace(0, min(len(x), 8 * k) - 1, k).astype(int)].copy()
    w = np.sqrt(weight)
    for _ in range(rounds):
        near = (2 * x @ centre.T - (centre * centre).sum(axis=1)).argmax(axis=1)
        for c in range(k):
            if (at := near == c).any():
                centre[c] = np.average(x[at], axis=0, weights=w[at])
    return near


def nested_classes(first: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, node, slot): every word's path from its slot at the root and its rank by frequency, and last the tail's path.

    In a class of at most FAN words all are outcomes; in a larger one the FAN - INNER commonest are, and the rest are dealt to INNER
    classes within it: frequent words have short paths, and the depth grows with the logarithm of the number of words.
    """
    words = [np.arange(len(first) + 1)]
    node, slot = [np.zeros(len(first) + 1, np.int64)], [np.append(first, TAIL_SLOT)]
    open_ = np.flatnonzero(first >= FIRST_CLASS)
    open_ = open_[np.argsort(rank[open_], kind="stable")]
    group, made = first[open_].astype(np.int64), 1
    while len(open_):
        _, at, size = np.unique(group, return_inverse=True, return_counts=True)
        order = np.argsort(at, kind="stable")
        place = np.empty(len(at), np.int64)
        place[order] = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
        leaf = (size[at] <= FAN) | (place < FAN - INNER)
        s = np.where(leaf, place, FAN - INNER + (place - (FAN - INNER)) % INNER)
        words.append(open_)
        node.append(made + at)
        slot.append(s)
        made += len(size)
        open_, group = open_[~leaf], (at * FAN + s)[~leaf]
    word = np.concatenate(words)
    order = np.argsort(word, kind="stable")  # a word's levels stay in their order
    length = np.bincount(word, minlength=len(first) + 1)
    return np.cumsum(length) - length, length, np.concatenate(node)[order].astype(np.int32), np.concatenate(slot)[order].astype(np.int8)


def _biases(length: np.ndarray, node: np.ndarray, slot: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Log shares of every node's outcomes by the counts (the tail's last) below them: without features the model is one of word frequencies."""
    nodes = int(node.max()) + 1
    mass = np.bincount(node.astype(np.int64) * FAN + slot, np.repeat(counts, length), nodes * FAN).reshape(nodes, FAN)
    return np.where(mass > 0, np.log(np.maximum(mass, 1e-9)) - np.log(np.maximum(mass.sum(axis=1, keepdims=True), 1e-9)), _NEVER).astype(np.float32)


def _gradient(batches, model: Model):
    """Observed and expected counts of every row and outcome over the task's texts: the likelihood's gradient is their difference."""
    sums = np.zeros(2 * model.weights.size + 16, np.float32)
    sums = sums[(-sums.ctypes.data % 64) // 4 :][: 2 * model.weights.size]  # a row's observed and expected counts share a cache line
    pairs, couple = sums.view(np.complex64), np.arange(0)  # outcomes are added two at a time, as the two parts of a complex number
    for b in batches:
        for _, texts in text_chunks(b, 0):
            seq, begins = sequence(texts)
            place, context = model.look_up(seq), features(seq, begins)
            for i in range(0, len(seq), _ROWS):
                _, slot, rows, p = model.decisions(place[i : i + _ROWS], context[:, i : i + _ROWS])
                # viewed anew: an unpickled dtype is an object of its own, with which add.at is ten times slower
                flat = p.reshape(-1).view(np.float32).view(np.complex64)
                if len(couple) < len(flat):
                    couple = np.tile(np.arange(FAN // 2, FAN), 2 * len(p))
                for r in rows:
                    cell = np.repeat(r * FAN, FAN // 2)
                    cell += couple[: len(flat)]
                    np.add.at(pairs, cell, flat)
                    np.add.at(sums, r * (2 * FAN) + slot, np.float32(1))
    yield from _blobs(sums)


def updated(weights: np.ndarray, seen: np.ndarray, expected: np.ndarray, rate: float, damp: float) -> np.ndarray:
    """One gradient step, each weight scaled by its information: the mean of the observed and the expected one, and a prior."""
    return weights + (rate * (seen - expected) / ((seen + expected) / 2 + damp)).astype(np.float32)


def rows_for(total: int, most: int) -> int:
    """Rows of weights for so many training tokens: the power of two at or above an eighth of them, from 1024 to most."""
    return min(most, 1 << max(10, math.ceil(math.log2(max(total, 1) / 8))))


def _commonest(counts: DataFrame, distinct: int, total: int, known: int) -> DataFrame:
    """The words above the least count that leaves at most known of them: no task sends the driver more than its share.

    The count is found by narrowing an interval with 32 thresholds an aggregation.
    """
    if distinct <= known:
        return counts
    lo, hi = 0, total  # more than known words lie above lo, no word above hi
    while hi - lo > 1:
        tries = sorted({lo + max(1, (hi - lo) * k // 32) for k in range(1, 32)} | {x for x in (lo + 2**k for k in range(40)) if x < hi})
        above = counts.agg(*[F.count(F.when(F.col("n") > t, 1)).alias(str(t)) for t in tries]).first().asDict()
        lo = max([t for t in tries if above[str(t)] > known], default=lo)
        hi = min([t for t in tries if above[str(t)] <= known], default=hi)
    return counts.filter(F.col("n") > hi)


def train(texts: DataFrame, text_col: str = "text", known: int = 200_000, most_rows: int = 1 << 18, steps: int = 2, task_tokens: int = 32_000_000, rate: float = 0.5, damp: float = 4.0) -> tuple[Model, DataFrame]:
    """The model, and the table of all word counts (h, n).

    Every step is one pass over all training texts: tasks of about task_tokens tokens sum observed and expected counts, reducers
    add them by block, and the driver moves the weights. Words, classes and rows of weights grow with the corpus; what a worker holds is
    bounded by known (words with a path of their own, about 70 bytes each) and most_rows (32 bytes each, three times in training);
    the counts of all words stay a table.
    """
    only = spread(texts.select(text_col))
    counts = cut(only.mapInArrow(_word_counts, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    total, distinct = (int(x) for x in counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first())
    rows = _commonest(counts, distinct, total, known).toPandas().sort_values("h")
    words, n = rows["h"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64)
    order = np.argsort(words)
    words, n = words[order], n[order]
    tail = total - int(n.sum()) + 0.5 * (distinct - len(n) + 1)
    top = np.lexsort((words, -n))
    rank = np.empty(len(n), np.int64)
    rank[top] = np.arange(len(n))
    top = top[words[top] != _END]
    first = np.where(words == _END, END_SLOT, FIRST_CLASS)
    tasks = max(6, math.ceil(total / task_tokens))
    model = Model(words, n, total, distinct, *nested_classes(first, rank), None, np.zeros((rows_for(total, most_rows), FAN), np.float32), math.log10(tail))
    if len(top):
        table = _joined(summed_tables(only.coalesce(tasks).mapInArrow(lambda it: _context_counts(it, model, top), "key int, blob binary")), len(n) * CONTEXTS).reshape(-1, CONTEXTS)
        first[top] = FIRST_CLASS + _clusters(table[top], n[top], FAN - FIRST_CLASS)
        model.start, model.length, model.node, model.slot = nested_classes(first, rank)
    model.bias = _biases(model.length, model.node, model.slot, np.append(n, tail))
    for _ in range(steps if total else 0):
        got = _joined(summed_tables(only.coalesce(tasks).mapInArrow(lambda it: _gradient(it, model), "key int, blob binary")), 0).reshape(-1, 2, FAN)
        model.weights = updated(model.weights, got[:, 0], got[:, 1], rate, damp)
    return model, counts


def score_texts(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's probability).

    Tokens are words with A-Z lower-cased and an end. The model learns from rows where held_out is false. A token's
    probability is that of its class, its class's class and so on down to the word, each decided by hashed features of the two words before
    it. Words beyond the commonest, and unknown ones, form the tail, shared out as the base does; they meet their counts in a join.

    Null text counts as empty: one token, the end. Null ids take part like any other; rows repeating an id are scored each. Without
    training texts every word is unknown. An empty table gives an empty result; further columns are ignored. options: see train.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("held_out", F.coalesce(held_out(F.col("id")), F.lit(False)))
    model, counts = train(rows.filter(~F.col("held_out")), **options)
    base_norm = math.log10(model.total + 0.5 * (model.distinct + 1))

    def make():
        log_known = np.log10(model.counts + 0.5) - base_norm

        def fn(texts, table):
            seq, begins = sequence(texts)
            place, context = model.look_up(seq), features(seq, begins)
            known = place >= 0
            logs = np.where(known, 0.0, -model.tail_norm) + model.log10(place, context)
            base = np.where(known, log_known[place], -base_norm) if len(model.counts) else np.full(len(seq), -base_norm)
            sums = lambda x: np.add.reduceat(x, begins[:-1])  # noqa: E731  every text has an end, so no range is empty
            rest = [seq[a:b][~known[a:b]].view(np.int64) for a, b in zip(begins[:-1], begins[1:])]
            return [pa.array(np.diff(begins)), pa.array(sums(known.astype(np.int64))), pa.array(sums(base)), pa.array(sums(logs)), pa.array(rest, pa.list_(pa.int64()))]

        return fn

    part = append_columns(spread(rows), "text", "n_tokens long, known long, base double, logs double, rest array<long>", make).drop("text")
    part = cut(part.withColumn("row", F.monotonically_increasing_id()))
    rare = part.select("row", F.explode("rest").alias("h")).groupBy("row", "h").agg(F.count(F.lit(1)).alias("k"))
    rare = rare.join(counts, "h", "left").groupBy("row")
    rare = rare.agg(F.sum(F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("l"), F.sum(F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0)).alias("more"))
    out = part.drop("rest").join(rare, "row", "left")
    extra = F.coalesce("l", F.lit(0.0))
    return out.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + extra).alias("base_score"),
        (F.col("logs") + extra).alias("score"),
    )
