"""Gold meets predictions: who was scored, who was not and why, and the metrics of the scored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The prediction of a rule set that matched nothing; it is no label.
UNKNOWN = "미분류"


def last_of(predictions: DataFrame, keys: list[str], order: str | None) -> DataFrame:
    """One prediction a key: the last in the given order, as when later rows of a file replace earlier ones."""
    if order is None:
        return predictions
    rest = [c for c in predictions.columns if c not in keys]
    last = predictions.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("last"))
    return last.select(*keys, "last.*")


def matched(gold: DataFrame, predictions: DataFrame, id_col: str = "doc_id", order: str | None = None) -> DataFrame:
    """Every labelled gold row for every model with its status: missing, errored, unknown or scored.

    gold (id, label); rows with a null or empty label take no part. predictions (model, id, predicted, error[, evidence_grounded]). An errored row has an
    error; an unknown one says UNKNOWN; one that is both is errored, and counts in both of harness()'s figures.
    """
    kept = gold.filter(F.col("label").isNotNull() & (F.col("label") != "")).select(id_col, "label")
    said = last_of(predictions, ["model", id_col], order).withColumn("here", F.lit(True))
    models = predictions.select("model").distinct()  # a handful
    out = kept.crossJoin(F.broadcast(models)).join(said, ["model", id_col], "left")
    status = F.when(F.col("here").isNull(), "missing").when(F.col("error").isNotNull(), "errored").when(F.col("predicted") == UNKNOWN, "unknown").otherwise("scored")
    return out.withColumn("status", status).drop("here")


def macro_f1(keys: str | list[str], label: str, predicted: str, rows: DataFrame, labels: list[str]) -> DataFrame:
    """(keys, macro_f1): the mean F1 over the given labels that the gold of the rows holds; 0 where it holds none."""
    is_ = lambda c: F.sum(F.when(c, 1).otherwise(0))
    g, p = F.col(label), F.col(predicted)
    keys = [keys] if isinstance(keys, str) else keys
    sums = rows.groupBy(*keys).agg(*[is_(c).alias(f"{k}{i}") for i, x in enumerate(labels) for k, c in (("tp", (g == x) & (p == x)), ("n", g == x), ("m", p == x))])
    f1 = [F.when(F.col(f"n{i}") > 0, 2.0 * F.col(f"tp{i}") / (F.col(f"n{i}") + F.col(f"m{i}"))) for i in range(len(labels))]
    present = F.array_compact(F.array(*f1))
    mean: Column = F.aggregate(present, F.lit(0.0), lambda a, x: a + x) / F.size(present)
    return sums.select(*keys, F.when(F.size(present) > 0, mean).otherwise(F.lit(0.0)).alias("macro_f1"))


def harness(gold: DataFrame, predictions: DataFrame, labels: list[str], id_col: str = "doc_id", order: str | None = None) -> DataFrame:
    """One row a model: gold_size, matched, missing, unknown, errors, n_scored, coverage (scored of gold), accuracy and macro_f1 of the scored, and how
    many of them have ungrounded evidence (false, not null). Unknown and errored predictions are neither right nor wrong and not covered."""
    if "evidence_grounded" not in predictions.columns:
        predictions = predictions.withColumn("evidence_grounded", F.lit(None).cast("boolean"))
    rows = matched(gold, predictions, id_col, order)
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    scored = F.col("status") == "scored"
    got = rows.groupBy("model").agg(
        F.count(F.lit(1)).alias("gold_size"), n(F.col("status") != "missing").alias("matched"), n(F.col("status") == "missing").alias("missing"),
        n(F.col("predicted") == UNKNOWN).alias("unknown"), n(F.col("status") == "errored").alias("errors"), n(scored).alias("n_scored"),
        n(scored & (F.col("predicted") == F.col("label"))).alias("right"), n(scored & ~F.col("evidence_grounded")).alias("ungrounded"),
    )
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    f1 = macro_f1("model", "label", "predicted", rows.filter(scored), labels)
    got = got.join(f1, "model", "left").withColumns({"coverage": share("n_scored", "gold_size"), "accuracy": share("right", "n_scored"), "macro_f1": F.coalesce("macro_f1", F.lit(0.0))})
    return got.select("model", "gold_size", "matched", "missing", "unknown", "errors", "n_scored", "coverage", "accuracy", "macro_f1", "ungrounded")


#: Sectors with fewer rows are set apart as small; those with fewer than LISTED are not listed by accuracy at all.
SMALL, LISTED = 8, 3


def sector_table(scored: DataFrame, labels: list[str], sector: str = "source", id_col: str = "doc_id", small: int = SMALL, listed: int = LISTED) -> DataFrame:
    """How each model does in each sector against the sector's own most frequent label, from scored (model, id, sector, label, predicted).

    (model, sector, n, correct, accuracy, base_label, majority_correct, base, lift, norm_lift, items_vs_majority, macro_f1, small, listed). base_label: on ties the
    label of the sector's first row. norm_lift: the part of what the base leaves that is gained; 0 where it leaves nothing. A null or empty sector is named UNKNOWN.
    """
    rows = scored.withColumn("__s", F.coalesce(F.nullif(F.col(sector), F.lit("")), F.lit(UNKNOWN)))
    per = rows.groupBy("model", "__s", "label").agg(F.count(F.lit(1)).alias("c"), F.min(id_col).alias("first"), F.sum((F.col("predicted") == F.col("label")).cast("long")).alias("ok"))
    best = F.max_by(F.struct("label", "c"), F.struct("c", -F.col("first"))).alias("b")
    got = per.groupBy("model", "__s").agg(F.sum("c").alias("n"), F.coalesce(F.sum("ok"), F.lit(0)).alias("correct"), best)
    got = got.join(macro_f1(["model", "__s"], "label", "predicted", rows, labels), ["model", "__s"])
    acc, base = F.col("correct") / F.col("n"), F.col("b.c") / F.col("n")
    return got.select(
        "model", F.col("__s").alias(sector), "n", "correct", acc.alias("accuracy"), F.col("b.label").alias("base_label"), F.col("b.c").alias("majority_correct"), base.alias("base"), (acc - base).alias("lift"),
        F.when(base < 1, (acc - base) / (1 - base)).otherwise(0.0).alias("norm_lift"), (F.col("correct") - F.col("b.c")).alias("items_vs_majority"), "macro_f1", (F.col("n") < small).alias("small"), (F.col("n") >= listed).alias("listed"),
    )
