"""Cross-check of written reports: figures and tables are read from text as rows and met with the results they restate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The words that open and close a marked section.
OPENS, CLOSES = "시작", "끝"


def section(text: str | Column, tag: str) -> Column:
    """What stands between the marks of a tag, line breaks included; null where either mark is absent or they stand in the wrong order."""
    text = F.col(text) if isinstance(text, str) else text
    found = F.regexp_extract_all(text, F.lit(rf"(?s)<!-- \Q{tag}\E:{OPENS} -->(.*?)<!-- \Q{tag}\E:{CLOSES} -->"), F.lit(1))
    return F.get(found, F.lit(0))


def table_rows(docs: DataFrame, tag: str, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, line, cells): the rows of the tables in a section, cells trimmed; header rules and lines that are no table rows are left out.

    A heading is a row like any other: it goes where its cells are read as figures. Null text and text without the section give no rows.
    """
    lines = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(section(text_col, tag), "\r?\n")).alias("line", "raw"))
    rows = lines.filter(F.col("raw").rlike(r"^\s*\|.*\|\s*$") & ~F.col("raw").rlike(r"^[\s|:-]+$"))
    inner = F.regexp_replace("raw", r"^\s*\||\|\s*$", "")
    return rows.select("id", "line", F.transform(F.split(inner, r"\|"), lambda c: F.trim(c)).alias("cells"))


def without_section(docs: DataFrame, tag: str, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id): documents that lack the section, which is a finding of its own and no agreement."""
    return docs.filter(section(text_col, tag).isNull()).select(F.col(id_col).alias("id"))


def reconcile(claimed: DataFrame, actual: DataFrame, keys: list[str], fields: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(keys, field, claimed, actual, kind): every disagreement of written rows with results, one row each.

    fields gives for each compared column how a result's value is written; what is written must be that text, so 0.1 is not 0.100. kind is missing (a
    result that is not written; field is row), unknown (a written row without a result) or differs. A row written twice is met twice. Null keys meet
    null keys. Both sides shuffle once, on the keys.
    """
    a = claimed.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias("said"))
    b = actual.select(*keys, F.struct(*[write(F.col(f)).cast("string").alias(f) for f, write in fields.items()]).alias("true"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(f"k{i}").eqNullSafe(F.col(k))
    both = a.join(b, same, "full_outer")
    row = lambda kind: F.array(F.struct(F.lit("row").alias("field"), F.lit(None).cast("string").alias("claimed"), F.lit(None).cast("string").alias("actual"), F.lit(kind).alias("kind")))
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"said.{f}").alias("claimed"), F.col(f"true.{f}").alias("actual"), F.lit("differs").alias("kind")) for f in fields])
    found = F.when(F.col("said").isNull(), row("missing")).when(F.col("true").isNull(), row("unknown")).otherwise(F.filter(each, lambda x: ~x["claimed"].eqNullSafe(x["actual"])))
    key = [F.coalesce(F.col(k), F.col(f"k{i}")).alias(k) for i, k in enumerate(keys)]
    return both.select(*key, F.explode(found).alias("f")).select(*keys, "f.*")


def restatements(docs: DataFrame, patterns: list[tuple[str, str]], truth: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, unit, nth, claimed, actual, agrees): every place where a text restates a figure.

    patterns are (unit, pattern), the pattern's first group being digits with or without thousands commas; a unit may have several. truth (id, unit,
    value). One right place does not excuse the others; numbers of other units are not looked at. A unit without a true value never agrees.
    """
    parts = None
    for unit, pattern in patterns:
        found = F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(1))
        one = docs.select(F.col(id_col).alias("id"), F.lit(unit).alias("unit"), F.posexplode(found).alias("nth", "raw"))
        parts = one if parts is None else parts.unionByName(one)
    said = parts.withColumn("claimed", F.replace("raw", F.lit(","), F.lit("")).try_cast("long")).drop("raw")
    out = said.join(truth.select("id", "unit", F.col("value").cast("long").alias("actual")), ["id", "unit"], "left")
    return out.withColumn("agrees", F.col("claimed").eqNullSafe(F.col("actual")) & F.col("actual").isNotNull())


def signed(places: int = 3) -> Callable[[Column], Column]:
    """A number written with its sign and so many places."""
    return lambda c: F.format_string(f"%+.{places}f", c.cast("double"))


def fixed(places: int = 3) -> Callable[[Column], Column]:
    """A number written with so many places."""
    return lambda c: F.format_string(f"%.{places}f", c.cast("double"))
