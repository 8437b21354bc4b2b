"""Space restoration: boundary contexts counted over the corpus, log odds averaged per boundary, spaces put in, and scores over thresholds."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from quillstone.session import cut

# Characters (left, right) of the contexts of a boundary, sightings a context needs, the bound of its log odds, thresholds tried.
WINDOWS = ((1, 1), (2, 1), (1, 2), (2, 2), (3, 2), (2, 3))
MIN_COUNT, CLAMP = 3, 4.0
THRESHOLDS = (-1.0, -0.5, -0.25, 0.0, 0.25, 0.5, 1.0)
JUNK = "[\\x{0}-\\x{8}\\x{b}-\\x{1f}\\x{7f}\\x{ad}\\x{200b}-\\x{200f}\\x{2028}\\x{2029}\\x{2244}\\x{feff}]"
_EDGE = "\x01"  # JUNK removes it from texts, so it can stand for what is beyond a line's ends
PIECE = 1 << 18  # characters of lines worked on at once


def lines_of(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 4) -> DataFrame:
    """(id, line, raw): the lines of each text without junk, blanks in one; lines shorter than least are left out."""
    clean = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), JUNK, "")
    out = rows.select(F.col(id_col).alias("id"), F.posexplode(F.split(clean, "\n")).alias("line", "raw"))
    out = out.withColumn("raw", F.trim(F.regexp_replace("raw", "[ \t]+", " ")))
    return out.filter(F.char_length("raw") >= least)


class _Places:
    """The boundaries between two characters of lines without their spaces, and the contexts that lie within a line, of many lines at once."""

    def __init__(self, lines: list[str]):
        every = np.frombuffer((_EDGE + _EDGE.join(lines) + _EDGE).encode("utf-32-le", "surrogatepass"), np.uint32)
        kept = np.flatnonzero(every != ord(" "))
        self.chars = every[kept]
        edge = self.chars == ord(_EDGE)
        where = np.arange(len(edge))
        left = where - np.maximum.accumulate(np.where(edge, where, 0))  # characters of the line up to this one, itself included
        right = np.minimum.accumulate(np.where(edge, where, len(edge))[::-1])[::-1] - where - 1  # and after it
        self.at = np.flatnonzero(~edge & (right > 0))  # the character before each boundary
        self.left, self.right = left[self.at], right[self.at]
        self.line = np.cumsum(edge)[self.at] - 1
        self.spaced = (every[np.minimum(kept[self.at] + 1, len(every) - 1)] == ord(" ")).astype(np.int64)
        self.letters, self.code = np.unique(self.chars, return_inverse=True)

    def contexts(self):
        """For each window: which boundaries it fits, the number of each one's context, and the distinct contexts as strings."""
        for a, b in WINDOWS:
            on = np.flatnonzero((self.left >= a) & (self.right >= b))
            first = self.at[on] - a + 1
            key, size = np.zeros(len(on), np.int64), 1
            for k in range(a + b):
                if size * len(self.letters) >= 1 << 62:  # as dense numbers, so that the key fits
                    _, key = np.unique(key, return_inverse=True)
                    size = len(on)
                key, size = key * len(self.letters) + self.code[first + k], size * len(self.letters)
            _, one, number = np.unique(key, return_index=True, return_inverse=True)
            held = np.ascontiguousarray(self.chars[first[one, None] + np.arange(a + b)]).view(f"<U{a + b}").ravel()
            yield on, number, pc.binary_join_element_wise(pa.scalar(f"{a}_{b}:"), pa.array(held.tolist(), pa.string()), pa.scalar(""))


def _pieces(batches, column: str):
    """Lists of rows of the batches whose texts in column have about PIECE characters, a longer one by itself."""
    rows, n = [], 0
    for batch in batches:
        for row in batch.to_pylist():
            rows.append(row)
            n += len(row[column])
            if n >= PIECE:
                yield rows
                rows, n = [], 0
    if rows:
        yield rows


def counted(lines: DataFrame) -> DataFrame:
    """(context, s, n): how many boundaries of a piece of the lines have the context, and how many of them are spaced: one row a piece and context."""

    def run(batches):
        for rows in _pieces(batches, "raw"):
            p = _Places([r["raw"] for r in rows])
            for on, number, names in p.contexts():
                n = np.bincount(number, minlength=len(names))
                s = np.bincount(number[p.spaced[on] == 1], minlength=len(names))
                yield pa.RecordBatch.from_arrays([names, pa.array(s), pa.array(n)], ["context", "s", "n"])

    return lines.select("raw").mapInArrow(run, "context string, s long, n long")


def train(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, float]:
    """(context, odds) of the contexts seen at least MIN_COUNT times, their log odds of a space clamped; and the log odds of all of them together."""
    seen = counted(lines_of(rows, id_col, text_col)).groupBy("context").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT)
    odds = F.log((F.col("s") + 0.5) / (F.col("n") - F.col("s") + 0.5))
    model = cut(seen.select("context", "s", "n", F.greatest(F.lit(-CLAMP), F.least(F.lit(CLAMP), odds)).alias("odds")))
    s, n = (x or 0 for x in model.agg(F.sum("s"), F.sum("n")).first())
    return model.select("context", "odds"), math.log((s + 1) / (n - s + 1))


def _with_scores(model: tuple[DataFrame, float], lines: DataFrame, told, schema: str) -> DataFrame:
    """told(ids, lines, texts, places, scores) of pieces of the lines (id, line, raw), as rows of schema.

    A boundary's score is the mean log odds of its known contexts, that of the whole model where none is known. Only a piece's distinct contexts meet
    the model, and come back to the piece with their odds.
    """
    table, prior = model
    kind = lines.schema["id"].dataType.simpleString()

    def pack(batches):
        from pyspark import TaskContext

        k = TaskContext.get().partitionId() << 33
        for rows in _pieces(batches, "raw"):
            yield pa.RecordBatch.from_pylist([{"piece": k, **{c: [r[o] for r in rows] for c, o in (("ids", "id"), ("lines", "line"), ("raws", "raw"))}}], packed_schema)
            k += 1

    wanted = f"piece long, ids array<{kind}>, lines array<int>, raws array<string>"
    packed_schema = to_arrow_schema(_parse_datatype_string(wanted))
    pieces = cut(lines.select("id", "line", "raw").mapInArrow(pack, wanted))

    def ask(batches):
        for batch in batches:
            for row in batch.select(["piece", "raws"]).to_pylist():
                for w, (_, _, names) in enumerate(_Places(row["raws"]).contexts()):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), row["piece"])), pa.array(np.full(len(names), w, np.int32)), pa.array(np.arange(len(names))), names], ["piece", "w", "number", "context"])

    known = pieces.mapInArrow(ask, "piece long, w int, number long, context string").join(table, "context").select("piece", "w", "number", "odds")

    def run(key, piece, odds):
        row = piece.select(["ids", "lines", "raws"]).to_pylist()[0]
        p = _Places(row["raws"])
        w, number, x = (odds.column(c).to_numpy() for c in ("w", "number", "odds"))
        total, many = np.zeros(len(p.at)), np.zeros(len(p.at), np.int64)
        for k, (on, place, names) in enumerate(p.contexts()):
            held = np.full(len(names), np.nan)
            held[number[w == k]] = x[w == k]
            here = held[place]
            ok = ~np.isnan(here)
            total[on[ok]] += here[ok]
            many[on[ok]] += 1
        return told(row["ids"], row["lines"], row["raws"], p, np.where(many > 0, total / np.maximum(many, 1), prior))

    return pieces.groupBy("piece").cogroup(known.groupBy("piece")).applyInArrow(run, schema)


def scored(model: tuple[DataFrame, float], lines: DataFrame) -> DataFrame:
    """(id, line, i, spaced, score): every boundary of the lines (id, line, raw), after the i-th character, and its score."""
    kind = lines.schema["id"].dataType.simpleString()
    schema = f"id {kind}, line int, i int, spaced int, score double"
    held = to_arrow_schema(_parse_datatype_string(schema))

    def told(ids, numbers, _, p, score):
        where = pa.array(p.line)
        cols = [pa.array(ids, held.field("id").type).take(where), pa.array(numbers, pa.int32()).take(where), pa.array(p.left.astype(np.int32)), pa.array(p.spaced.astype(np.int32)), pa.array(score)]
        return pa.Table.from_arrays(cols, names=held.names)

    return _with_scores(model, lines, told, schema)


def restore(model: tuple[DataFrame, float], rows: DataFrame, threshold: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, restored): every text with a space at each boundary whose score is above the threshold; spaces that are there stay.

    Junk goes, as in training. Null text counts as empty. Lines of any length take part; texts without two characters come back without junk.
    """
    clean = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), JUNK, "")
    lines = rows.select(F.col(id_col).alias("id"), F.posexplode(F.split(clean, "\n")).alias("line", "raw"))
    schema = f"id {lines.schema['id'].dataType.simpleString()}, line int, t string"
    held = to_arrow_schema(_parse_datatype_string(schema))

    def told(ids, numbers, raws, p, score):
        put = p.at[(p.spaced == 1) | (score > threshold)] + 1
        texts = np.insert(p.chars, put, ord(" ")).tobytes().decode("utf-32-le", "surrogatepass")[1:-1].split(_EDGE)
        some = np.zeros(len(raws), bool)  # lines that have a boundary
        some[p.line] = True
        return pa.Table.from_arrays([pa.array(ids, held.field("id").type), pa.array(numbers, pa.int32()), pa.array([t if on else raw for t, on, raw in zip(texts, some, raws)], pa.string())], names=held.names)

    done = _with_scores(model, lines, told, schema)
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "t"))), lambda x: x["t"]), "\n")
    return done.groupBy("id").agg(whole.alias("restored")).withColumnRenamed("id", id_col)


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def evaluate(model: tuple[DataFrame, float], rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(threshold, tp, predicted, gold, precision_, recall, f1, best) for every threshold; best is the first of largest F1."""
    s = scored(model, lines_of(rows, id_col, text_col))
    s = s.select(F.col("spaced").cast("long").alias("spaced"), F.round("score", 9).alias("score"))
    hit = lambda t: (F.col("score") > t).cast("long")
    each = [F.struct(F.lit(t).alias("threshold"), F.sum(hit(t) * F.col("spaced")).alias("tp"), F.sum(hit(t)).alias("predicted"), F.sum("spaced").alias("gold")) for t in THRESHOLDS]
    out = s.agg(F.array(*each).alias("x"), F.count(F.lit(1)).alias("n")).filter("n > 0").select(F.inline("x"))
    p, r = _ratio(F.col("tp"), F.col("predicted")), _ratio(F.col("tp"), F.col("gold"))
    out = out.select("*", F.round(p, 6).alias("precision_"), F.round(r, 6).alias("recall"), F.round(_ratio(2 * p * r, p + r), 6).alias("f1"))
    first = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("f1"), "threshold"))  # one row a threshold
    return out.withColumn("best", first == 1)
