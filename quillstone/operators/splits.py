"""Splits and samples: global positions without a single-task window, group-safe splits, systematic samples, discard logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.session import cut


def indexed(df: DataFrame, *order: str, keep_part: bool = False) -> DataFrame:
    """df with pos: 0-based place in the global order; with keep_part also part, the range partition a row is in.

    Rows are range-partitioned; a row's place is its place in its partition plus the sizes of the partitions before, so only
    one row per partition is ever brought together.
    """
    parts = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__part", before.alias("__start"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    out = parts.withColumn("__at", place).join(starts, "__part").withColumn("pos", (F.col("__start") + F.col("__at")).cast("long"))
    out = out.withColumn("part", F.col("__part")) if keep_part else out
    return out.drop("__part", "__at", "__start")


def grouped_places(df: DataFrame, groups: list[str], order: list[str], name: str = "pos") -> DataFrame:
    """df with a column for each row's 0-based place in its group's order; null is a group like any other.

    indexed() within groups: rows are range-partitioned by group and order, so a large group lies in several ranges. A row's place is its place among
    the group's rows of its range plus the group's rows of the ranges before, of which one number a group and range is brought together.
    """
    parts = cut(df.repartitionByRange(*groups, *order).withColumn("__part", F.spark_partition_id()))
    mine = [F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)]
    sizes = parts.groupBy(F.col("__part").alias("__p"), *mine).agg(F.count(F.lit(1)).alias("__n"))
    own = Window.partitionBy(*[f"__g{i}" for i in range(len(groups))]).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("__start", F.coalesce(F.sum("__n").over(own), F.lit(0))).drop("__n")
    same = F.col("__part") == F.col("__p")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    at = F.row_number().over(Window.partitionBy("__part", *groups).orderBy(*order)) - 1
    out = parts.withColumn("__at", at).join(starts, same)
    return out.withColumn(name, (F.col("__start") + F.col("__at")).cast("long")).drop("__part", "__at", "__start", "__p", *[f"__g{i}" for i in range(len(groups))])


def group_split(rows: DataFrame, ranks: dict[str, int], every: int = 3, id_col: str = "doc_id") -> DataFrame:
    """rows with stratum (rank of the rarest label in the row's group) and is_dev (whole groups, every third of a stratum by first key as text)."""
    rank = F.lit(len(ranks))
    for label, r in ranks.items():
        rank = F.when(F.col("label") == label, r).otherwise(rank)
    groups = rows.groupBy("grp").agg(F.min(rank).alias("stratum"), F.min(F.col(id_col).cast("string")).alias("first_key"))
    groups = grouped_places(groups, ["stratum"], ["first_key"]).withColumn("is_dev", F.col("pos") % every == 0)
    return rows.join(groups.select("grp", "stratum", "is_dev"), "grp")


def stratified(rows: DataFrame, strata: list[str], order: str, size: int) -> DataFrame:
    """Systematic sample: each stratum gives its rounded share of size, at least one row, taken at an even step."""
    counts = rows.groupBy(*strata).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 1
    want = F.greatest(F.lit(1), F.bround(F.lit(size) * F.col("n") / F.lit(total), 0).cast("long"))
    counts = counts.withColumn("want", want).withColumn("step", F.greatest(F.lit(1), F.expr("n div want")))
    out = grouped_places(rows.join(counts, strata), strata, [order], "i")
    return out.filter("i % step = 0 and i div step < want").drop("n", "want", "step", "i")


def discards(rows: DataFrame, reasons: list[tuple[Column, str]]) -> DataFrame:
    """rows with rejected_for: every reason that holds, in order; a row is kept when it is empty."""
    return rows.withColumn("rejected_for", F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in reasons])))
