"""Quality by co-training: a text view and a page-metadata view teach each other, then vote with calibrated odds."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import append_columns, bounded_sample, fit_logistic, packed_row, sigmoid, spread, summed_tables, text_chunks, word_hashes

BUCKETS, STATS = 2048, 17
#: Characters added to a text's length before its trigrams are shared out, so that few characters say little.
SHRINK = 64
LANGS, SOURCES, SIZES = 16, 64, 48
TEXT, META = BUCKETS + STATS, LANGS + SOURCES + SIZES
#: Calibrated confidence from which a view passes its label on to the other, and how much such rows weigh against labelled ones.
SURE, PASSED_WEIGHT = 0.95, 0.5

def _counted(mask: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many of the positions of each range are on."""
    c = np.zeros(len(mask) + 1, np.int32)  # a chunk of text is far shorter than this can count
    np.cumsum(mask, dtype=np.int32, out=c[1:])
    return c[ends] - c[begins]


_KIND = np.zeros(256, np.int8)
for _k, _chars in enumerate([b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!#$%&*+<=>@\\^_`{|}~", b".,;:?'\"()-/[]"], 1):
    _KIND[list(_chars)] = _k


def _per_text(values: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values over the ranges of positions; empty ranges give 0."""
    c = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return c[ends] - c[begins]


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the byte trigram at every position of the joined texts, and where each text's own positions begin and end.

    Two zero bytes follow each text, so the trigrams of its range hold its bytes and zeros only, never a neighbour's bytes.
    """
    raw = np.frombuffer(b"".join(t + b"\0\0" for t in texts) + b"\0\0", np.uint8).astype(np.uint32)
    code = (raw[:-2] << np.uint32(16)) | (raw[1:-1] << np.uint32(8)) | raw[2:]
    bucket = (code * np.uint32(2654435761)) >> np.uint32(32 - 11)
    size = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(np.concatenate([[0], size[:-1] + 2])) if len(texts) else size
    return bucket, begins, begins + size


def text_stats(texts: list[bytes]) -> np.ndarray:
    """(n, STATS): words and their repetition, size, line layout and character classes of each text."""
    h, at = word_hashes(texts)
    n = np.diff(at)
    wordy = np.flatnonzero(n)  # a text with words has a byte at least, so 20 bits tell those of a chunk apart
    doc = np.repeat(np.arange(len(wordy), dtype=np.uint64), n[wordy])
    key = np.sort((doc << np.uint64(44)) | (h >> np.uint64(20)))
    twice = key[1:][key[1:] == key[:-1]] >> np.uint64(44)
    again = np.zeros(len(texts))
    again[wordy] = np.bincount(twice.astype(np.int64), minlength=len(wordy))
    echo = np.flatnonzero((h[1:] == h[:-1]) & (doc[1:] == doc[:-1]))
    near = np.zeros(len(texts))
    near[wordy] = np.bincount(doc[1:][echo].astype(np.int64), minlength=len(wordy))
    many = np.maximum(n, 1)
    words = [np.log1p(n) / 10, again / many, near / many]
    words += [np.sqrt(x) for x in words[1:]]
    raw, edge = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    a, b = edge[:-1], edge[1:]
    size = np.maximum(b - a, 1)
    kind = _KIND[raw]
    shares = [_counted(kind == k, a, b) / size for k in (1, 2, 3, 4)]
    lines = _counted(raw == 10, a, b) + 1
    return np.column_stack([*words, np.log1p(size) / 10, np.log(lines) / 5, np.log(size / lines) / 5, *shares, _counted(raw >= 128, a, b) / size, *[np.sqrt(s) for s in shares]])


def metadata(lang: list, source: list, n_chars: list) -> np.ndarray:
    """(n, 3) active columns of the metadata view: hashed language, hashed source, half-octave of the recorded size. Null is a value of its own."""
    out = np.empty((len(lang), 3), np.int64)
    for i, (x, y, z) in enumerate(zip(lang, source, n_chars)):
        size = 0 if z is None or z < 0 else 1 + min(SIZES - 2, int(2 * np.log2(z + 1)))
        out[i] = zlib.crc32(str(x).encode()) % LANGS, LANGS + zlib.crc32(str(y).encode()) % SOURCES, LANGS + SOURCES + size
    return out


@dataclass
class Model:
    """Weights of both views (bias last), the scale of the text statistics, each view's calibration, and the vote."""

    text: np.ndarray
    mean: np.ndarray
    sd: np.ndarray
    meta: np.ndarray
    calibrate: np.ndarray | None = None  # slope and bias of each view
    vote: np.ndarray | None = None  # weight of each view's calibrated log odds, and a bias

    def logits(self, texts: list[bytes], lang: list, source: list, n_chars: list) -> tuple[np.ndarray, np.ndarray, tuple]:
        """Log odds of both views, and the features they come from."""
        bucket, a, b = trigrams(texts)
        size = b - a + SHRINK
        stats = (text_stats(texts) - self.mean) / self.sd
        gram = _per_text(self.text[bucket], a, b) / size * 100
        on = metadata(lang, source, n_chars)
        # row sums, not a matrix product: a row's odds must not depend on the rows beside it
        return gram + (stats * self.text[BUCKETS:-1]).sum(axis=1) + self.text[-1], self.meta[on].sum(axis=1) + self.meta[-1], (bucket, a, b, size, stats, on)

    def calibrated(self, *odds: np.ndarray) -> list[np.ndarray]:
        return [o * self.calibrate[v, 0] + self.calibrate[v, 1] for v, o in enumerate(odds)]

    def probabilities(self, texts, lang, source, n_chars) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.calibrated(*self.logits(texts, lang, source, n_chars)[:2])
        return sigmoid(a), sigmoid(b), sigmoid(a * self.vote[0] + b * self.vote[1] + self.vote[2])


def _passed_on(batches, model: Model):
    """For each view and class: gradient sums of the view's loss over the rows that the other view is sure of, and their number."""
    text, meta, n = np.zeros((2, TEXT + 1)), np.zeros((2, META + 1)), np.zeros((2, 2))
    for batch in batches:
        for first, texts in text_chunks(batch, 0):
            rest = [batch.column(k).slice(first, len(texts)).to_pylist() for k in (1, 2, 3)]
            odds_text, odds_meta, (bucket, a, b, size, stats, on) = model.logits(texts, *rest)
            says = [sigmoid(c) for c in model.calibrated(odds_text, odds_meta)]
            for y in (0, 1):
                sure = [np.flatnonzero(p >= SURE if y else p <= 1 - SURE) for p in says]
                i = sure[1]  # the metadata view teaches the text view
                if len(i):
                    r = sigmoid(odds_text[i]) - y
                    spread = np.zeros(len(bucket))
                    spread[np.concatenate([np.arange(s, e) for s, e in zip(a[i], b[i])])] = np.repeat(r * 100 / size[i], b[i] - a[i])
                    text[y, :BUCKETS] += np.bincount(bucket, spread, BUCKETS)
                    text[y, BUCKETS:-1] += r @ stats[i]
                    text[y, -1] += r.sum()
                i = sure[0]
                if len(i):
                    r = sigmoid(odds_meta[i]) - y
                    meta[y, :META] += np.bincount(on[i].ravel(), np.repeat(r, 3), META)
                    meta[y, -1] += r.sum()
                n[0, y] += len(sure[1])
                n[1, y] += len(sure[0])
    if n.any():
        blobs = [np.concatenate([t, m, c]) for t, m, c in zip(text, meta, n.T)]
        yield pa.record_batch([pa.array([0, 1], pa.int32()), pa.array([x.tobytes() for x in blobs], pa.binary())], names=["key", "blob"])


def _dense(texts, table) -> list[pa.Array]:
    """Both views' features of labelled rows, for the driver's fit."""
    bucket, a, b = trigrams(texts)
    grams = [np.bincount(bucket[s:e], minlength=BUCKETS) / (e - s + SHRINK) * 100 for s, e in zip(a, b)]
    on = metadata(*(table.column(k).to_pylist() for k in ("lang", "source", "n_chars")))
    text = [np.concatenate([g, s]).astype(np.float16).tobytes() for g, s in zip(grams, text_stats(texts))]
    return [pa.array(text, pa.binary()), pa.array(list(on), pa.list_(pa.int64()))]


def fit(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", rounds: int = 3, labelled_rows: int = 6000) -> Model | None:
    """Co-training from a bounded sample of labelled rows and every other row of docs; None when labels show fewer than two classes.

    A quarter of the labelled sample is set aside. In each round both views, calibrated on the set-aside rows, score every row of docs
    outside the sample; the rows a view is sure of (SURE) teach the other view through the sums of its loss's gradient, taken where the rows are.
    The driver then moves each view's weights on the labelled rows' loss, tilted by the difference of the two gradients (the usual
    surrogate for a loss that is known by its gradient), class by class, so that a class that is easier to be sure of
    does not shift the prior. At the end the set-aside rows calibrate each view and weight the vote.

    labelled_rows bounds the sample (about 12 kB each on the driver); a labelled id on several rows takes part with one of them.
    """
    known = labels.filter(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    known = bounded_sample(known.filter("id is not null"), labelled_rows, "id")
    rows = spread(docs.select(F.col(id_col).alias("id"), F.col("text").cast("string").alias("text"), "lang", "source", F.col("n_chars").cast("long").alias("n_chars")))
    seen = rows.join(F.broadcast(known), "id").groupBy("id", "y").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("r")).select("id", "y", "r.*")
    table = append_columns(seen, "text", "a binary, b array<long>", lambda: _dense).select("id", "y", "a", "b").toArrow()
    order = np.argsort(table.column("id").to_numpy(), kind="stable")
    ids, y = table.column("id").take(pa.array(order)).to_pylist(), table.column("y").to_numpy().astype(np.float32)[order]
    if len({*y}) < 2:
        return None
    # one copy of each matrix; the fits below take masks of its rows
    text, meta = np.empty((len(y), TEXT), np.float32), np.zeros((len(y), META), np.float32)
    for k, i in enumerate(order):
        text[k] = np.frombuffer(table.column("a")[int(i)].as_buffer(), np.float16)
        meta[k, table.column("b")[int(i)].as_py()] = 1
    del table
    pa.default_memory_pool().release_unused()
    mean, sd = text[:, BUCKETS:].mean(axis=0), np.maximum(text[:, BUCKETS:].std(axis=0), 1e-3)
    text[:, BUCKETS:] = (text[:, BUCKETS:] - mean) / sd
    aside = np.array([zlib.crc32(str(i).encode()) % 4 for i in ids]) == 0
    if len({*y[aside]}) < 2 or len({*y[~aside]}) < 2:  # too few labels to set any aside
        aside = np.ones(len(y), bool)
        train = aside
    else:
        train = ~aside
    views, l2 = (text, meta), (1e-6, 1e-3)
    weights = [fit_logistic(views[v], y, l2[v], 500, on=train) for v in range(2)]
    odds = lambda v: views[v] @ weights[v][:-1] + weights[v][-1]

    def model() -> Model:
        cal = np.array([fit_logistic(odds(v)[aside, None], y[aside], 1e-3, 300) for v in range(2)])
        for v in np.flatnonzero(cal[:, 0] < 0):  # a view that ranks the set-aside rows no better than chance says the prior
            cal[v] = 0, np.log((y[aside].sum() + 0.5) / ((1 - y[aside]).sum() + 0.5))
        return Model(weights[0].astype(np.float64), mean.astype(np.float64), sd.astype(np.float64), weights[1].astype(np.float64), cal.astype(np.float64))

    pool = rows.join(F.broadcast(known.select("id")), "id", "left_anti").select("text", "lang", "source", "n_chars")
    for _ in range(rounds):
        now = model()
        sums = summed_tables(pool.mapInArrow(lambda it, m=now: _passed_on(it, m), "key int, blob binary"), np.float64)
        for v in range(2):
            tilt = np.zeros(views[v].shape[1] + 1)
            for c in (0, 1):
                if c not in sums or not (n := sums[c][TEXT + META + 2 + v]):
                    continue
                passed = (sums[c][: TEXT + 1], sums[c][TEXT + 1 : TEXT + META + 2])[v] / n
                own = train & (y == c)
                r = ((sigmoid(odds(v)) - c) * own).astype(np.float32) / own.sum()
                tilt += (y[train].mean() if c else 1 - y[train].mean()) * (passed - np.append(r @ views[v], r.sum()))
            share = PASSED_WEIGHT / (1 + PASSED_WEIGHT)
            weights[v] = fit_logistic(views[v], y, l2[v], 60, weights[v], on=train, tilt=(share * tilt).astype(np.float32), near=1e-3)
    out = model()
    votes = np.column_stack(out.calibrated(odds(0)[aside], odds(1)[aside])).astype(np.float32)
    out.vote = fit_logistic(votes, y[aside], 1e-3, 300).astype(np.float64)
    return out


def _scored(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, **options) -> DataFrame:
    """(row: struct of docs' columns, p_text, p_meta, p)."""
    model = fit(docs, labels, label_col, id_col, **options)

    def make():
        def fn(texts, table):
            if model is None:
                return [pa.array(np.full(len(texts), 0.5))] * 3
            return [pa.array(p) for p in model.probabilities(texts, *(table.column(k).to_pylist() for k in ("lang", "source", "n_chars")))]

        return fn

    rows = spread(docs.select(packed_row(docs), F.col("text").cast("string").alias("text"), "lang", "source", F.col("n_chars").cast("long").alias("n_chars")))
    return append_columns(rows, "text", "p_text double, p_meta double, p double", make).select("row", "p_text", "p_meta", "p")


def score_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", **options) -> DataFrame:
    """docs with three more columns: p_text and p_meta, each view's calibrated probability, and p, their vote's.

    The text view reads the text only, the metadata view the columns lang, source and n_chars only. Every row and whole text is scored; a
    row's result does not depend on the rows beside it. Null text counts as empty; null lang, source or n_chars is a value of its
    own. Labels other than 0 and 1 and labels of unknown or null ids are ignored; of an id labelled twice the larger label counts; without
    both classes every probability is 0.5. Rows repeating an id are scored each. Columns of docs named like the three are replaced. An
    empty table gives an empty result. options: see fit.
    """
    stay = [F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in ("p_text", "p_meta", "p")]
    return _scored(docs, labels, label_col, id_col, **options).select(*stay, "p_text", "p_meta", "p")


def drop_low_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The rows of docs whose probability of good quality reaches the threshold, with the columns of docs, whatever their names."""
    return _scored(docs, labels, "quality", "doc_id", **options).filter(F.col("p") >= threshold).select("row.*")
