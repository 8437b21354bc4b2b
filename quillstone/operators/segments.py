"""Document structure: health, offsets, section fill, segments, inventories."""

from __future__ import annotations

import re
import unicodedata
from itertools import combinations_with_replacement

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillstone.functions.text import control_squeeze, squeeze


# How far extraction looks to tell a readable text, a text that lost its spaces, a case's decision and a divider page.
HEALTH_CHARS, SPACING_CHARS, DECISION_CHARS, DIVIDER_CHARS = 20_000, 4000, 200, 90


def healthy(df: DataFrame, text: str, least: float = 0.8, chars: int = HEALTH_CHARS) -> DataFrame:
    """df with healthy: whether the share of readable characters among the first ones reaches the limit; this gate reads no further by definition."""
    head = F.substring(text, 1, chars)
    readable = F.length(F.regexp_replace(head, "[^\\x20-\\x7e\\x{a0}-\\x{ffff}\\n\\t]", ""))
    return df.withColumn("healthy", F.try_divide(readable, F.length(head)) >= least)


@F.pandas_udf(StringType())
def composed(name: pd.Series) -> pd.Series:
    """Names with combining characters composed (NFC), as file systems that decompose them need; null stays null."""
    return name.map(lambda x: x if x is None else unicodedata.normalize("NFC", x))


def divider(text: Column, patterns: list[str], chars: int = DIVIDER_CHARS) -> Column:
    """The title a page divides sections by: the page is that short, without its blanks, and a pattern is in it; else null."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when((F.char_length(flat) <= chars) & flat.rlike("|".join(patterns)), flat)


def case_fields(part: Column, serial: str, decisions: list[str], chars: int = DECISION_CHARS) -> tuple[Column, Column, Column, Column]:
    """(serial, decisions, label, warnings) of a segment: the serial's first match, the distinct decisions in its head in order, the label if there is one only."""
    number = F.nullif(F.regexp_extract(part, serial, 1), F.lit(""))
    said = F.array_distinct(F.regexp_extract_all(F.substring(part, 1, chars), F.lit(f"({'|'.join(decisions)})"), F.lit(1)))
    label = F.when(F.size(said) == 1, said[0])
    warnings = F.array_compact(F.array(F.when(number.isNull(), "no_serial"), F.when(F.size(said) == 0, "no_decision"), F.when(F.size(said) > 1, "several_decisions")))
    return number, said, label, warnings


def extraction_report(cases: DataFrame) -> DataFrame:
    """(kind, value, n): cases by label, by warning and, where there are such columns, by type and sector; serials that occur more than once; of each type the serials in all.

    cases has label, serial and warnings, and may have type and sector. What is null counts as none. Serials are told apart within their type, named before them.
    """
    tallies = [c for c in ("label", "type", "sector") if c in cases.columns]
    kinds = F.array(*[F.struct(F.lit(c).alias("kind"), F.coalesce(F.col(c), F.lit("none")).alias("value")) for c in tallies])
    told = F.transform(F.coalesce("warnings", F.array().cast("array<string>")), lambda w: F.struct(F.lit("warning").alias("kind"), w.alias("value")))
    out = cases.select(F.explode(F.concat(kinds, told)).alias("k")).groupBy("k.kind", "k.value").agg(F.count(F.lit(1)).alias("n"))
    named = F.concat_ws(":", "type", "serial") if "type" in cases.columns else F.col("serial")
    seen = cases.filter("serial is not null").groupBy(*[c for c in ("type",) if c in cases.columns], named.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    out = out.union(seen.filter("n > 1").select(F.lit("duplicate_serial"), "value", "n"))
    if "type" in cases.columns:
        out = out.union(seen.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit("serials"), F.coalesce("type", F.lit("none")), "n"))
    return out


# Characters that may stand as check marks, and the least fill rates of a known format.
CHECK_MARKS = "☑☒þ■▣◉√✓Vv●"
LEAST_RATES = {"decision": 0.90, "serial": 0.95, "sector": 0.95}
LEAST_FIELD_RATE = 0.80


def format_drift(rates: DataFrame, least: dict[str, float] = LEAST_RATES, others: float = LEAST_FIELD_RATE) -> DataFrame:
    """fill_rates with the least rate each field should have and whether the source falls below it, a sign that its format has changed."""
    bound = F.lit(others)
    for field, x in least.items():
        bound = F.when(F.col("field") == field, x).otherwise(bound)
    return rates.withColumn("least", bound).withColumn("drift", F.coalesce(F.col("rate"), F.lit(0.0)) < F.col("least"))


def unknown_marks(histogram: DataFrame, known: str) -> DataFrame:
    """mark_histogram with the characters of each pattern that are none of the known ones, each once in its order; empty: nothing new."""
    letters = F.array_distinct(F.filter(F.split("pattern", ""), lambda c: (c != "") & ~F.contains(F.lit(known), c)))
    return histogram.withColumn("unknown", F.array_join(letters, ""))


def fill_rates(rows: DataFrame, source: str, fields: list[str]) -> DataFrame:
    """(source, field, rate): the share of a source's rows in which each field says something, to four places."""
    filled = [F.round(F.avg((F.length(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))) > 0).cast("double")), 4).alias(c) for c in fields]
    return rows.groupBy(source).agg(*filled).unpivot(source, fields, "field", "rate")


def mark_histogram(rows: DataFrame, source: str, text: str, marks: str) -> DataFrame:
    """(source, pattern, n): how often each sequence of check marks, as it stands in a row, occurs in a source; rows without any are left out."""
    seen = F.array_join(F.regexp_extract_all(F.col(text), F.lit(f"([{marks}])"), F.lit(1)), "")
    return rows.select(source, seen.alias("pattern")).filter("pattern <> ''").groupBy(source, "pattern").agg(F.count(F.lit(1)).alias("n"))


def page_recon(pages: DataFrame, html: str, least: int = 5) -> DataFrame:
    """(kind, value, n): tags, class tokens used at least so often, link targets' first path parts, and pages with tables and forms."""
    found = lambda kind, pattern: pages.select(F.lit(kind).alias("kind"), F.explode(F.regexp_extract_all(html, F.lit(pattern), F.lit(1))).alias("value"))
    classes = found("class", 'class="([^"]*)"').select("kind", F.explode(F.split("value", " +")).alias("value"))
    rows = found("tag", "<([a-z0-9]+)").union(classes).union(found("link", '<a [^>]*href="/([A-Za-z]*)')).filter("value <> ''")
    counts = rows.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n")).filter((F.col("kind") != "class") | (F.col("n") >= least))
    have = pages.agg(*[F.sum(F.contains(html, F.lit(f"<{t}")).cast("long")).alias(t) for t in ("table", "form")]).unpivot([], ["table", "form"], "value", "n")
    return counts.union(have.select(F.lit("pages_with"), "value", "n"))


def offsets(pages: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """pages with begins and ends: character offsets in the concatenation of a key's pages, each followed by one separator."""
    ends = F.sum(F.length(text) + 1).over(Window.partitionBy(key).orderBy(order))
    return pages.withColumn("ends", ends).withColumn("begins", F.col("ends") - F.length(text) - 1)


def page_of(positions: DataFrame, offsets_: DataFrame, key: str) -> DataFrame:
    """positions (key, pos) with the page whose range holds each."""
    return positions.join(offsets_, key).filter("begins <= pos and pos < ends")


def fill_sections(df: DataFrame, key: str, order: list[str], major: Column, minor: Column) -> DataFrame:
    """df with section and subsection carried forward; a new section clears the subsection."""
    w = Window.partitionBy(key).orderBy(*order)
    df = df.withColumn("section", F.last(major, ignorenulls=True).over(w)).withColumn("__part", F.count(major).over(w))
    return df.withColumn("subsection", F.last(minor, ignorenulls=True).over(Window.partitionBy(key, "__part").orderBy(*order))).drop("__part")


def canonical(name: Column, aliases: dict[str, str]) -> Column:
    out = name
    for a, b in aliases.items():
        out = F.when(name == a, b).otherwise(out)
    return out


def slices(df: DataFrame, text: str, header: str) -> DataFrame:
    """One row per segment: from each header match to the next; what stands before the first header is dropped."""
    return df.select("*", F.posexplode(F.split(text, header, -1)).alias("pos", "part")).filter("pos > 0")


def spacing_lost(text: Column, not_letter: str = "[^가-힣]", chars: int = SPACING_CHARS) -> Column:
    """Whether a text lost its spaces in extraction: of its first characters at least 200 are letters, and blanks are less than a twentieth of those."""
    head = F.substring(text, 1, chars)
    letters, blanks = F.length(F.regexp_replace(head, not_letter, "")), F.length(F.regexp_replace(head, "[^ ]", ""))
    return (letters >= 200) & (blanks < 0.05 * letters)


def inventory(docs: DataFrame) -> DataFrame:
    return docs.groupBy("source").agg(
        F.count(F.lit(1)).alias("docs"),
        F.countDistinct("text").alias("texts"),
        F.sum((F.col("lang") == "en").cast("int")).alias("english"),
        F.round(F.avg((F.col("n_chars") >= 1000).cast("double")), 4).alias("fill"),
    )


def tag_counts(pages: DataFrame, html: str, least: int = 5) -> DataFrame:
    tags = pages.select("page_id", F.explode(F.regexp_extract_all(html, F.lit("<([a-z0-9]+)"), F.lit(1))).alias("tag"))
    return tags.groupBy("tag").agg(F.count(F.lit(1)).alias("uses"), F.countDistinct("page_id").alias("on_pages")).filter(F.col("uses") >= least)


def _on_lines(name: str) -> str:
    """A pattern of name, blanks allowed between its letters, standing alone on one to three lines."""
    blank, letters = r"[^\S\n]*", [re.escape(c) for c in name]
    ways = []
    for breaks in range(3 if len(letters) > 1 else 1):
        for gaps in combinations_with_replacement(range(1, len(letters)), breaks):
            ways.append("".join((blank if i else "") + f"\\n{blank}" * gaps.count(i) + c for i, c in enumerate(letters)))
    return "|".join(ways)


def split_fields(text: Column, names: list[str]) -> tuple[Column, Column]:
    """(fields, warnings): what follows each name that stands alone on one to three lines, and the names not found.

    A longer name wins over one that begins it. A name's later parts are appended on a new line. What stands before the first name is dropped;
    blank lines around names belong to no field. Null text has no field. Names are a short fixed list; each row is one expression, without a shuffle.
    """
    whole = "|".join(_on_lines(n) for n in sorted(names, key=len, reverse=True))
    body = F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x{1}\\x{2}]", " ")
    body = F.regexp_replace(body, F.lit(rf"(?mdU)^[^\S\n]*({whole})[^\S\n]*$"), F.lit("\x01$1\x02"))
    parts = F.split(body, "\x01", -1)
    parts = F.slice(parts, F.lit(2), F.size(parts))
    name = lambda p: squeeze(F.substring_index(p, "\x02", 1))
    marked = F.transform(parts, lambda p: F.struct(name(p).alias("name"), control_squeeze(F.split(p, "\x02", 2)[1]).alias("value")))

    def entries(m):
        held = lambda n: F.transform(F.filter(m, lambda x: x["name"] == n), lambda x: x["value"])
        return F.array_compact(F.array(*[F.when(F.exists(m, lambda x: x["name"] == n), F.struct(F.lit(n).alias("key"), F.array_join(held(n), "\n").alias("value"))) for n in names]))

    # bound as the variable of a lambda, so that a text is parted once and not once a name
    fields = F.map_from_entries(F.transform(F.array(marked), entries)[0])
    lacking = lambda found: F.array_compact(F.array(*[F.when(~F.array_contains(found, n), F.lit(f"missing_field:{n}")) for n in names]))
    warnings = F.transform(F.array(F.transform(parts, name)), lacking)[0]
    return fields, warnings
