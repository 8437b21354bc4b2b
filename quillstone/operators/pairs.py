"""Question-and-answer pairs: a case whose question and answer are numbered alike gives one pair a number, any other case one pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as T

NAMES = ["pair_index", "pair_count", "split_mode", "has_enumeration", "question", "answer", "mark_mismatch"]
MISMATCH = "mark_mismatch"


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def pairs_of(question: Column, answer: Column) -> Column:
    """The pairs of one case as an array of structs with the fields NAMES.

    Both sides' marks are read as chains 1, 2, 3 ...; since a chain has no gap, two of one length carry the same numbers, and part i
    of the one goes with part i of the other. Where only one side is numbered, or both but not alike, a number may mark a list inside a single question, so
    nothing is cut; the second case is a mismatch.
    """
    qm, am = T.sequence_marks(question), T.sequence_marks(answer)
    n, m = F.size(qm), F.size(am)
    row = lambda *cols: F.struct(*[c.alias(k) for c, k in zip(cols, NAMES)])
    paired = F.zip_with(
        T.slice_by_marks(question, qm),
        T.slice_by_marks(answer, am),
        lambda x, y: row(x["num"], n, F.lit("paired"), F.lit(True), _stripped(x["part"]), _stripped(y["part"]), F.lit(False)),
    )
    single = F.array(row(F.lit(1), F.lit(1), F.lit("single"), (n > 0) | (m > 0), question, answer, (n > 0) & (m > 0)))
    return F.when((n > 0) & (n == m), paired).otherwise(single)


def split_pairs(cases: DataFrame, question: str = "question", answer: str = "answer", warnings: str | None = None) -> DataFrame:
    """cases with one row a pair and the columns NAMES instead of the two texts; a case's other columns ride along.

    Null texts count as empty. warnings: an array column that gets MISMATCH where both sides are numbered but not alike; without it the boolean
    column of that name stays. One generator over each row: nothing is shuffled. A column of cases with one of the new names is replaced.
    """
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    stay = [c for c in cases.columns if c not in (question, answer) and (c == warnings or c not in NAMES)]
    made = cases.withColumn("__pair", F.explode(pairs_of(text(question), text(answer))))
    none = F.array().cast("array<string>")
    told = lambda c: F.concat(F.coalesce(F.col(f"`{c}`"), none), F.when(F.col("__pair.mark_mismatch"), F.array(F.lit(MISMATCH))).otherwise(none)).alias(c)
    kept = [told(c) if c == warnings else F.col(f"`{c}`") for c in stay]
    return made.select(*kept, *[F.col(f"__pair.{n}").alias(n) for n in NAMES if warnings is None or n != MISMATCH])


def turns_as_cases(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, question, answer): each user turn followed by an assistant's."""
    from pyspark.sql import Window

    after = Window.partitionBy("conv_id").orderBy("turn")
    seen = conversations.select("conv_id", "turn", "role", F.col("text").alias("question"), F.lead("role").over(after).alias("next"), F.lead("text").over(after).alias("answer"))
    return seen.filter((F.col("role") == "user") & (F.col("next") == "assistant")).select("conv_id", "turn", "question", "answer")
