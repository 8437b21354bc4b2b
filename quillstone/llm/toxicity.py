"""Toxicity by a weighted lexicon: Aho-Corasick over folded text, exception phrases, evidence normalised by length."""

from __future__ import annotations

import bisect
import itertools
import re
from collections import Counter
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import append_columns, bounded_sample, fit_logistic, fold_of, packed_row, sigmoid

#: A term needs at least so many toxic documents, such a share of them (copies of one text bring its rare words), and such precision.
MIN_TOXIC, MIN_SHARE, MIN_PRECISION = 4, 0.02, 0.95
STEM = (3, 4, 5, 6, 7, 8)  # lengths of word beginnings tried as terms, beside whole words

# Letters that look like the Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "з": "e", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ɡ": "g",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ℓ": "l",
}
# Digits and signs written for letters. l, i and 1 fold together, as 1 stands for either.
DIGITS = {"0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "|": "i", "l": "i"}

_ODD = re.compile("[ıɐ-ʯͰ-ϿЀ-ԯ​-‏⁠ℓ﻿！-～]")
#: Numbers, with the signs within them, stand for no word: their digits fold to nothing.
_NUMBER = re.compile(rb"(?<![^\s.,;:()\[\]/+\-])[0-9][0-9.,:/+\-]*(?![^\s.,;:()\[\]/+\-!?])")
_ODD_MAP = str.maketrans(
    HOMOGLYPHS
    | {a.upper(): b for a, b in HOMOGLYPHS.items() if len(a.upper()) == 1}
    | {chr(0xFF01 + k): chr(0x21 + k).lower() for k in range(94)}
    | dict.fromkeys("​‌‍‎‏⁠﻿", "")
)
_PLAIN = bytearray(range(256))
for _c in range(128):
    _s = chr(_c).lower()
    _PLAIN[_c] = ord(DIGITS.get(_s, _s)) if _s.isalnum() or _s in DIGITS else 32
_PLAIN = bytes(_PLAIN)


def fold(text: bytes) -> str:
    """Folded text, one character for each byte of UTF-8, words parted by single or more spaces, a space at both ends."""
    if not text.isascii():
        s = text.decode("utf-8", "replace").lower()
        if _ODD.search(s):
            s = s.translate(_ODD_MAP)
        text = s.encode()
    text = _NUMBER.sub(lambda m: b" " * len(m[0]), text)
    return f" {text.translate(_PLAIN).decode('latin-1')} "


def terms_of(folded: str) -> set[str]:
    """Whole words and word beginnings, as they stand in folded text: ' word ' and ' begi'."""
    out = set()
    for w in set(folded.split(" ")):
        if len(w) >= 3:
            out.add(f" {w} ")
            out.update(f" {w[:k]}" for k in STEM if k <= len(w))
    return out


@dataclass
class Lexicon:
    """Weights of terms, phrases that excuse the terms within them, and the calibration of both evidence figures."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = ()
    calibration: np.ndarray | None = None

    def automaton(self):
        auto = ahocorasick.Automaton()
        for term, w in self.weights.items():
            auto.add_word(term, (len(term), w))
        for phrase in self.exceptions:
            auto.add_word(phrase, (len(phrase), None))
        if len(auto):
            auto.make_automaton()
        return auto

    def matches(self, auto, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of terms outside exception phrases, in order; of terms that overlap the heaviest stays, then the first, then the longest.

        Terms begin and may end with the space that parts words; sharing that one space is no overlap.
        """
        if not len(auto):
            return []
        hits, excused = [], []
        for end, (n, w) in auto.iter(folded):
            (excused if w is None else hits).append((end - n + 1, end + 1, w))
        if excused:
            excused.sort(key=lambda x: x[0])
            begins, reach = [x[0] for x in excused], list(itertools.accumulate((x[1] for x in excused), max))  # how far phrases that begin by then extend
            hits = [h for h in hits if not (k := bisect.bisect_right(begins, h[0] + 1)) or reach[k - 1] < h[1] - 1]
        out: list[tuple[int, int, float]] = []
        for h in sorted(hits, key=lambda x: (-x[2], x[0], -x[1])):
            at = bisect.bisect(out, h)
            if (at == 0 or out[at - 1][1] - 1 <= h[0]) and (at == len(out) or h[1] - 1 <= out[at][0]):
                out.insert(at, h)
        return out

    def evidence(self, texts: list[bytes], auto) -> np.ndarray:
        """(n, 3): log of the summed weight, the same per square root of length, whether any term occurs."""
        out = np.zeros((len(texts), 3), np.float32)
        for i, t in enumerate(texts):
            folded = fold(t)
            found = self.matches(auto, folded)
            if found:
                total = sum(w for _, _, w in found)
                out[i] = np.log1p(total), np.log1p(100 * total / np.sqrt(len(folded))), 1
        return out

    def scores(self, evidence: np.ndarray) -> np.ndarray:
        if self.calibration is None:
            return np.zeros(len(evidence))
        return sigmoid(evidence.astype(np.float64) @ self.calibration[:-1] + self.calibration[-1])


def _count_terms(batches):
    """Documents that hold each term, by label, summed within the task in bounded tables."""
    held: tuple[Counter, Counter] = (Counter(), Counter())

    def out():
        for y, c in enumerate(held):
            if c:
                yield pa.record_batch([pa.array(list(c)), pa.array([y] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64())], names=["term", "y", "n"])
                c.clear()

    for b in batches:
        for text, y in zip(b.column(0), b.column(1).to_pylist()):
            held[y].update(terms_of(fold((text.as_py() or "").encode("utf-8", "surrogatepass"))))
            if len(held[0]) + len(held[1]) > 400_000:
                yield from out()
    yield from out()


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", exceptions: tuple[str, ...] = (), labelled_rows: int = 20_000) -> Lexicon:
    """A lexicon from a bounded sample of labelled rows: terms that hardly occur in clean texts, in their maximal form.

    labelled_rows bounds the sample, and with it all else: a term is in MIN_SHARE of the toxic texts, so there are at most as many terms
    as 1 / MIN_SHARE texts have word beginnings, and an exception phrase is in MIN_TOXIC clean texts of the sample. Every term and phrase that qualifies is taken.
    Exception phrases are given, or learned: a clean text's words around a term, seen in MIN_TOXIC clean texts and in no toxic one.
    """
    known = labels.filter(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("y"))
    known = bounded_sample(known, labelled_rows, "__id")
    seen = docs.select(F.col(id_col).alias("__id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "__id").select("text", "y")
    totals = {r.y: r.n for r in seen.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(totals) < 2:
        return Lexicon({})
    counts = seen.mapInArrow(_count_terms, "term string, y int, n long").groupBy("term").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("b"))
    odds = F.log((F.col("a") + 0.5) / F.lit(totals[1] + 1.0)) - F.log((F.col("b") + 0.5) / F.lit(totals[0] + 1.0))
    rows = counts.withColumn("w", odds).filter((F.col("a") >= max(MIN_TOXIC, MIN_SHARE * totals[1])) & (F.col("a") >= MIN_PRECISION * (F.col("a") + F.col("b")))).orderBy(F.desc("w"), "term").collect()
    odds_of, support = {r.term: float(r.w) for r in rows}, {r.term: r.a for r in rows}
    weights: dict[str, float] = {}
    longer: dict[str, list[str]] = {t: [] for t in support}
    for t in support:
        for k in range(2, len(t)):
            if t[:k] in longer:
                longer[t[:k]].append(t)
    for term in sorted(support, key=lambda t: (len(t), t)):
        if any(support[t] >= 0.9 * support[term] for t in longer[term]):
            continue  # a longer form says the same of nearly the same documents
        if any(term[:k] in weights for k in range(3, len(term))):
            continue  # a shorter form, with more documents, holds already
        weights[term] = odds_of[term]
    lexicon = Lexicon(weights, tuple(fold(p.encode()) for p in exceptions))
    if not exceptions:
        lexicon.exceptions = _learn_exceptions(seen, lexicon)
    pairs = append_columns(seen, "text", "__e array<float>", lambda: lambda texts, table, lx=lexicon, a=lexicon.automaton(): [pa.array(list(lx.evidence(texts, a)), pa.list_(pa.float32()))])
    data: pd.DataFrame = pairs.select("y", "__e").toPandas()
    x, y = np.stack(data["__e"]).astype(np.float32), data["y"].to_numpy(np.float32)
    order = np.lexsort((*x.T, y))  # the fit must not depend on the order rows arrive in
    lexicon.calibration = fit_logistic(x[order], y[order], 1e-4, 800)
    return lexicon


def _learn_exceptions(seen: DataFrame, lexicon: Lexicon) -> tuple[str, ...]:
    def around(batches):
        auto = lexicon.automaton()
        for b in batches:
            phrases, labels = [], []
            for text, y in zip(b.column(0), b.column(1).to_pylist()):
                folded, found = fold((text.as_py() or "").encode("utf-8", "surrogatepass")), set()
                for a, e, _ in lexicon.matches(auto, folded):
                    stop = folded.find(" ", max(e - 1, a + 1))
                    after, before = folded.find(" ", stop + 1), folded.rfind(" ", 0, max(a, 0))
                    if 0 <= stop < after:
                        found.add(folded[a : after + 1])
                    if before >= 0:
                        found.add(folded[before : stop + 1])
                phrases += found
                labels += [y] * len(found)
            yield pa.record_batch([pa.array(phrases, pa.string()), pa.array(labels, pa.int32())], names=["phrase", "y"])

    counts = seen.mapInArrow(around, "phrase string, y int").groupBy("phrase").agg(F.sum("y").alias("a"), F.count(F.lit(1)).alias("n"))
    rows = counts.filter((F.col("a") == 0) & (F.col("n") >= MIN_TOXIC)).orderBy(F.desc("n"), "phrase").collect()
    return tuple(r.phrase for r in rows)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", folds: int = 5, held_fold: int | None = 0, lexicon: Lexicon | None = None) -> DataFrame:
    """docs with score (0 to 1, higher: more likely toxic), which replaces a column of that name.

    Every whole text is scored from its text alone. The lexicon is learned from labels outside held_fold of the ids' crc32 (all labels if
    None) unless given. Null and empty texts hold no term and get the score of a text without any. Without both classes
    all scores are 0. Labels other than 0 and 1 and labels of null ids are ignored; of an id labelled twice the larger label counts. Rows repeating
    an id are scored each; an empty table gives an empty result.
    """
    if lexicon is None:
        lexicon = learn(docs, labels if held_fold is None else labels.filter(fold_of(F.col(id_col), folds) != held_fold), id_col=id_col)

    def make():
        auto = lexicon.automaton()
        return lambda texts, table: [pa.array(lexicon.scores(lexicon.evidence(texts, auto)))]

    rows = docs.select(packed_row(docs), F.col("text").cast("string").alias("text"))
    stay = [F.col(f"row.`{c}`") for c in docs.columns if c.lower() != "score"]
    return append_columns(rows, "text", "score double", make).select(*stay, "score")
