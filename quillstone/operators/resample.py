"""Bootstrap over cell counts: rows with equal label and predictions are one cell, and a round draws how often each cell occurs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.session import cut

#: Rounds of the paired difference, of an interval and of the risk-coverage area.
PAIRED_ROUNDS, INTERVAL_ROUNDS, AREA_ROUNDS = 5000, 2000, 2000
_CHUNK = 1 << 20


def joint_cells(scored: DataFrame, models: list[str]) -> DataFrame:
    """(cell, label, k, begins, predicted and rnk: arrays in the models' order): the distinct outcomes of rows that every model has scored, with their counts.

    scored: (doc_id, model, label, predicted, rnk). Labels, models and ranks are few, so cells are few however many the rows; begins is
    a cell's first place when all rows are ordered by cell.
    """
    own = [F.max(F.when(F.col("model") == m, F.struct("predicted", "rnk"))).alias(f"m{i}") for i, m in enumerate(models)]
    rows = scored.groupBy("doc_id", "label").agg(F.countDistinct("model").alias("seen"), *own).filter(F.col("seen") == len(models))
    shape = [F.array(*[F.col(f"m{i}.{c}") for i in range(len(models))]).alias(c) for c in ("predicted", "rnk")]
    cells = cut(rows.select("label", *shape).groupBy("label", "predicted", "rnk").agg(F.count(F.lit(1)).alias("k")))
    order = Window.partitionBy(F.lit(0)).orderBy("label", "predicted", "rnk")  # cells, not rows
    begins = F.coalesce(F.sum("k").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    return cells.select((F.row_number().over(order) - 1).cast("long").alias("cell"), "label", "predicted", "rnk", "k", begins.alias("begins"))


def place(rounds: np.ndarray, draws: np.ndarray, n: int) -> np.ndarray:
    """The place among n rows of each draw of a round: a fixed mix of both numbers in 31 bits, so any engine draws the same."""
    h = (rounds * 40_503 + draws * 69_069 + 12_345) % 2**31
    for factor in (1_274_126_177, 1_812_433_253, 747_796_405):
        h = (h ^ (h >> 15)) * factor % 2**31
    return h * n >> 31


def resampled(cells: DataFrame, rounds: int) -> DataFrame:
    """(r, cell, k): how often each cell occurs in each round of as many draws as there are rows; cells not drawn are absent.

    Every model sees the same draws. Rounds are dealt over the tasks; a task draws in chunks of a million, so its memory does not grow with the rows.
    """
    held = cells.orderBy("cell").select("begins", "k").toPandas()  # cells are few
    begins, n = held["begins"].to_numpy(np.int64), int(held["k"].sum())

    def draw(frames):
        for frame in frames:
            for r in frame["id"]:
                counts = np.zeros(len(begins), np.int64)
                for i in range(0, n, _CHUNK):
                    at = place(np.int64(r), np.arange(i, min(n, i + _CHUNK), dtype=np.int64), n)
                    counts += np.bincount(np.searchsorted(begins, at, "right") - 1, minlength=len(begins))
                on = np.flatnonzero(counts)
                yield pd.DataFrame({"r": np.full(len(on), r), "cell": on, "k": counts[on]})

    spark = cells.sparkSession
    return spark.range(0, rounds if n else 0, 1, spark.sparkContext.defaultParallelism).mapInPandas(draw, "r long, cell long, k long")


def redrawn(sizes: np.ndarray, round_: int, seed: int = 0) -> np.ndarray:
    """How often each cell occurs in one round of as many draws as the cells have rows: binomials, each conditional on those before it.

    The generator counts from the seed and the round, so a round is the same in whatever task it is drawn.
    """
    n = int(sizes.sum())
    return np.random.Generator(np.random.Philox(key=[seed, round_])).multinomial(n, sizes / n) if n else np.zeros(len(sizes), np.int64)


def resampled_cells(cells: DataFrame, rounds: int, seed: int = 0) -> DataFrame:
    """resampled's rows drawn from the cells' counts: work grows with rounds and cells, not with the rows, of which there may be any number."""
    sizes = cells.orderBy("cell").select("k").toPandas()["k"].to_numpy(np.int64)  # cells are few

    def draw(frames):
        for frame in frames:
            for r in frame["id"]:
                counts = redrawn(sizes, int(r), seed)
                on = np.flatnonzero(counts)
                yield pd.DataFrame({"r": np.full(len(on), r), "cell": on, "k": counts[on]})

    spark = cells.sparkSession
    return spark.range(0, rounds if len(sizes) else 0, 1, spark.sparkContext.defaultParallelism).mapInPandas(draw, "r long, cell long, k long")


def macro_f1(outcomes: DataFrame, models: list[str], labels: list[str]) -> DataFrame:
    """(r, model, f): macro-F1 over the labels that occur, of every round and model, from outcomes (r, label, predicted, k)."""
    by_model = outcomes.select("r", "label", "k", F.posexplode("predicted").alias("i", "said"))
    sums = []
    for j, x in enumerate(labels):
        is_, said = F.col("label") == x, F.col("said") == x
        sums += [F.sum(F.when(c, F.col("k")).otherwise(0)).alias(f"{name}{j}") for name, c in (("tp", is_ & said), ("fp", ~is_ & said), ("fn", is_ & ~said))]
    agg = by_model.groupBy("r", "i").agg(*sums)
    f = [F.when(F.col(f"tp{j}") + F.col(f"fn{j}") > 0, 2.0 * F.col(f"tp{j}") / (2 * F.col(f"tp{j}") + F.col(f"fp{j}") + F.col(f"fn{j}"))) for j in range(len(labels))]
    name = F.element_at(F.array(*[F.lit(m) for m in models]), F.col("i") + 1)
    return agg.select("r", name.alias("model"), F.aggregate(F.array_compact(F.array(*f)), F.lit(0.0), lambda a, x: a + x, lambda a: a / F.size(F.array_compact(F.array(*f)))).alias("f"))


def risk_areas(outcomes: DataFrame, models: list[str], most_rank: int = 3) -> DataFrame:
    """(r, model, f): area under the risk-coverage curve over the confidence ranks, from outcomes (r, label, predicted, rnk, k)."""
    rows = outcomes.select("r", "label", "k", F.posexplode(F.arrays_zip("predicted", "rnk")).alias("i", "m"))
    levels = [x for j in range(most_rank, -1, -1) for x in (F.sum(F.when(F.col("m.rnk") == j, F.col("k")).otherwise(0)).alias(f"n{j}"), F.sum(F.when((F.col("m.rnk") == j) & (F.col("m.predicted") != F.col("label")), F.col("k")).otherwise(0)).alias(f"w{j}"))]
    agg = rows.groupBy("r", "i").agg(F.sum("k").alias("all"), *levels)
    area, covered, wrong = F.lit(0.0), F.lit(0), F.lit(0)
    for j in range(most_rank, -1, -1):
        covered, wrong = covered + F.col(f"n{j}"), wrong + F.col(f"w{j}")
        area = area + F.when(F.col(f"n{j}") > 0, wrong / covered * F.col(f"n{j}") / F.col("all")).otherwise(0.0)
    name = F.element_at(F.array(*[F.lit(m) for m in models]), F.col("i") + 1)
    return agg.select("r", name.alias("model"), area.alias("f"))


def intervals(scores: DataFrame, rounds: int, n: int | None = None) -> DataFrame:
    """(model, lo, hi): the 2.5 and 97.5 per cent places of each model's rounds; (0, 0) where fewer than two of n rows were there to draw from."""
    if n is not None and n < 2:
        return scores.select("model").distinct().select("model", F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"))
    k = F.row_number().over(Window.partitionBy("model").orderBy("f")) - 1
    at = lambda j: F.max(F.when(F.col("k") == j, F.col("f")))
    return scores.withColumn("k", k).groupBy("model").agg(at(int(0.025 * rounds)).alias("lo"), at(int(0.975 * rounds) - 1).alias("hi"))


def differences(scores: DataFrame, rounds: int) -> DataFrame:
    """(m1, m2, lo, hi, p, p_holm): the interval of each pair's difference and its two-sided p, stepped down over the pairs."""
    a, b = scores.select("r", F.col("model").alias("m1"), F.col("f").alias("f1")), scores.select("r", F.col("model").alias("m2"), F.col("f").alias("f2"))
    both = a.join(b, "r").filter("m1 < m2").withColumn("d", F.round(F.col("f1") - F.col("f2"), 12))
    k = F.row_number().over(Window.partitionBy("m1", "m2").orderBy("d")) - 1
    at = lambda j: F.max(F.when(F.col("k") == j, F.col("d")))
    out = both.withColumn("k", k).groupBy("m1", "m2").agg(at(int(0.025 * rounds)).alias("lo"), at(int(0.975 * rounds) - 1).alias("hi"), F.avg((F.col("d") <= 0).cast("double")).alias("w"))
    from quillstone.functions.stats import holm

    return holm(out.withColumn("p", 2 * F.least(F.col("w"), 1 - F.col("w"))), "p", "m1", "m2").drop("w")
