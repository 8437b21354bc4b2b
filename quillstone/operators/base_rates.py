"""Base rates of labels, overall and by sector, and the sentences that say them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows a sector needs before its own rates are said.
RELIABLE = 5


def rates(gold: DataFrame, sector: str, labels: list[str]) -> DataFrame:
    """(sector, n, rates: array in the labels' order) for each sector and, with a null sector, for all rows."""
    counts = [F.sum((F.col("label") == x).cast("long")).alias(f"c{i}") for i, x in enumerate(labels)]
    out = gold.groupingSets([[sector], []], sector).agg(F.grouping(sector).alias("all"), F.count(F.lit(1)).alias("n"), *counts)
    return out.select(F.col(sector).alias("sector"), (F.col("all") == 1).alias("all"), "n", F.array(*[F.col(f"c{i}") / F.col("n") for i in range(len(labels))]).alias("rates"))


def sentences(gold: DataFrame, sector: str, labels: list[str]) -> DataFrame:
    """(sector, sentence): the shares of each label among a sector's past cases, those of all cases where it has too few; percents round half to even."""
    table = rates(gold, sector, labels)
    percent = lambda i: F.concat(F.lit(f"{labels[i]} "), F.bround(100 * F.col("rates")[i], 0).cast("int").cast("string"), F.lit("%"))
    parts = F.concat_ws(", ", *[percent(i) for i in range(len(labels))])
    absent = F.array_compact(F.array(*[F.when(F.col("rates")[i] == 0, F.lit(x)) for i, x in enumerate(labels)]))
    never = F.when(F.size(absent) > 0, F.concat(F.lit(" Never: "), F.array_join(absent, ", "), F.lit("."))).otherwise("")
    own = F.concat(F.lit("Of "), F.col("n").cast("string"), F.lit(" past cases of "), F.col("sector"), F.lit(": "), parts, F.lit("."), never)
    overall = table.filter("all").select(F.concat(F.lit("Of "), F.col("n").cast("string"), F.lit(" past cases: "), parts, F.lit(".")).alias("whole"))
    out = table.filter(~F.col("all")).select("sector", "n", own.alias("own")).join(F.broadcast(overall))
    return out.select(F.col("sector").alias(sector), F.when(F.col("n") >= RELIABLE, F.col("own")).otherwise(F.col("whole")).alias("sentence"))
