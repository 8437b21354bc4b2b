"""Temperature mixing of sources, realised as budgeted permutations of blocks. DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import keyed_rows, n_words
from quillstone.session import cut

#: Bisection steps answered by one aggregation: it evaluates all midpoints those steps could ask for.
DEPTH = 5


def _spread(shares: DataFrame, exponents: list[float]) -> dict[float, tuple[float, float]]:
    """For each exponent: entropy (nats) of the tempered shares, and the most a source repeats per token of its largest peer.

    One aggregation over the table of sources, however long it is; a few numbers reach the driver.
    """
    grid = F.explode(F.array(*[F.lit(float(x)) for x in exponents]))
    top = F.log(F.lit(shares.agg(F.max("share")).first()[0] or 1.0))
    part = F.exp(F.col("x") * (F.col("lp") - top))  # relative to the largest, so steep exponents do not vanish
    rows = (
        shares.select("share", F.log("share").alias("lp"), grid.alias("x"))
        .groupBy("x")
        .agg(
            F.sum(part).alias("z"),
            F.sum(part * (F.col("lp") - top)).alias("zl"),
            F.first(top).alias("top"),
            F.max((F.col("x") - 1) * F.col("lp")).alias("hi"),
            F.min((F.col("x") - 1) * F.col("lp")).alias("lo"),
        )
        .collect()
    )
    return {r.x: (math.log(r.z) - r.x * r.zl / r.z, math.exp(min(r.hi - r.lo, 700.0)), math.exp(min(r.hi - r.x * r.top - math.log(r.z), 700.0))) for r in rows}


def _steepest(shares: DataFrame) -> float:
    """The exponent at which the second largest share, relative to the largest, is below what a double's sum over sources can tell from nothing."""
    top = shares.agg(F.max("share")).first()[0] or 1.0
    gap = shares.filter(F.col("share") < top).agg(F.max(F.log(F.col("share") / F.lit(top)))).first()[0]
    return 1.0 if gap is None else max(1.0, -45.0 / gap)


def find_exponent(shares: DataFrame, target_entropy: float | None, max_repeats: float | None, budget_ratio: float | None, steps: int = 30) -> float:
    """The exponent by bisection: the one whose entropy is the target, or the flattest within the repetition limit.

    Exponents from 0 (all sources alike) to 1 (their natural shares) flatten; a target below the natural entropy needs one above 1, so
    the bracket doubles until it holds the target, however near the shares are to one another. Entropies no exponent reaches give the nearest end: 0
    above the logarithm of the number of sources; at or below that of the largest sources alone, the exponent at which all others weigh nothing. budget_ratio: budget over all tokens; None: the least budget that shows every source once.
    """

    def too_flat(at):
        entropy, against_peer, ratio = at
        if target_entropy is not None:
            return entropy > target_entropy
        repeats = against_peer if budget_ratio is None else ratio * budget_ratio
        return repeats > max_repeats * (1 + 1e-12)

    ends = [0.0, 1.0]  # without a target nothing is beyond 1: the large sources would be the repeated ones
    flat = {x: too_flat(at) for x, at in _spread(shares, ends).items()}
    if not flat[0.0]:
        return 0.0
    while flat[ends[-1]] and target_entropy is not None and ends[-1] < (enough := _steepest(shares)):
        more = [min(ends[-1] * 2**k, enough) for k in range(1, DEPTH + 1)]
        flat |= {x: too_flat(at) for x, at in _spread(shares, more).items()}
        ends += more
    hi = min((x for x in ends if not flat[x]), default=ends[-1])
    lo = max(x for x in ends if x < hi)
    for _ in range(math.ceil(steps / DEPTH)):
        points = [lo + (hi - lo) * k / 2**DEPTH for k in range(1, 2**DEPTH)]
        seen, a, b = _spread(shares, points), 0, 2**DEPTH
        while b - a > 1:
            mid = (a + b) // 2
            a, b = (mid, b) if too_flat(seen[points[mid - 1]]) else (a, mid)
        lo, hi = lo + (hi - lo) * a / 2**DEPTH, lo + (hi - lo) * b / 2**DEPTH
    return hi


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    tokens: Column | None = None,
    target_entropy: float | None = None,
    max_repeats: float | None = 1.25,
    budget: int | None = None,
    block_tokens: int = 1 << 15,
    seed: int = 17,
) -> DataFrame:
    """One row per copy that the mixture shows: id, source, epoch, n_tokens, start, weight, budget_tokens, mix_key.

    Source shares of all tokens (words by default) are raised to an exponent found by bisection and normalised.
    Each source's budget is its weight of the total budget; with budget None the total is the least that shows
    every source once. A source's blocks (documents by hash) come in a fresh hash permutation every
    epoch, and so do the documents of a block; a copy belongs to the result when it ends within the source's budget.
    start counts tokens within the source's stream; mix_key in [0, 1) interleaves the sources by weight.

    Positions are prefix sums on three levels (groups of blocks, blocks, documents), so no window holds more than
    about the square root of a source's blocks or one block. A null source is a source of its own. Null or empty texts have no tokens
    and come once per full epoch of their source; a source without tokens comes once. Rows repeating an id, or without one, stay apart; of those with one
    source the order is by a hash of id, tokens and a running number, so equal input gives equal output whatever order its rows come in.
    An empty table gives an empty result. Further columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), (n_words(F.col("text")) if tokens is None else F.coalesce(tokens, F.lit(0))).cast("long").alias("n_tokens"))
    rows = cut(rows.withColumn("src", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))))
    by_source = cut(rows.groupBy("src").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")))
    total, n_rows = (x or 0 for x in by_source.agg(F.sum("tokens"), F.sum("rows")).first())
    shares = by_source.filter("tokens > 0").select("src", "tokens", (F.col("tokens") / F.lit(float(max(total, 1)))).alias("share"))
    ratio = None if budget is None else budget / max(total, 1)
    x = find_exponent(shares, target_entropy, max_repeats, ratio) if total else 1.0
    top = shares.agg(F.max("share")).first()[0] or 1.0
    part = F.pow(F.col("share") / F.lit(top), F.lit(x))  # relative to the largest share, so steep exponents do not vanish
    z, rarest = shares.agg(F.sum(part), F.max(F.col("share") / part)).first()
    whole = budget if budget is not None else math.ceil(total * (rarest or 1.0) * (z or 1.0))
    if whole > 1 << 62:
        raise ValueError("no budget shows every source once at this entropy; give one")
    tempered = F.pow(F.col("tokens") / F.lit(float(max(total, 1)) * top), F.lit(x)) / F.lit(z or 1.0)
    weights = by_source.withColumn("weight", F.when(F.col("tokens") > 0, tempered).otherwise(0.0))
    share = F.round(F.col("weight") * F.lit(float(whole))).cast("long")
    weights = weights.withColumn("budget_tokens", share if budget is not None else F.greatest(share, F.col("tokens")))
    epochs = F.when(F.col("tokens") > 0, F.ceil(F.col("budget_tokens") / F.col("tokens"))).otherwise(1).cast("long")
    weights = cut(weights.withColumn("epochs", epochs))

    blocks = max(1, math.ceil(total / block_tokens), math.ceil(8 * n_rows / block_tokens))  # rows without tokens fill blocks too
    wide = max(1, math.isqrt(blocks))
    rank = lambda *cols: F.xxhash64(*cols, F.lit(seed))
    # rows alike in id, source and size are counted and numbered, so those of one id, or without one, spread over the blocks and have a stated order
    rows = _numbered(rows.groupBy("id", "source", "src", "n_tokens").agg(F.count(F.lit(1)).alias("alike")), "alike", "same").drop("alike")
    own = [F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("id").isNull(), F.col("n_tokens"), F.col("same")]
    rows = cut(rows.withColumn("block", F.pmod(rank(*own), F.lit(blocks))))
    sized = rows.groupBy("src", "block").agg(F.sum("n_tokens").alias("b_tokens"))
    sized = sized.join(weights.select("src", "epochs", "tokens", "budget_tokens", "weight").filter("epochs > 0"), "src")
    sized = _numbered(sized, "epochs", "epoch")
    sized = cut(sized.withColumn("key", rank("block", "epoch")).withColumn("team", F.pmod(F.col("key"), F.lit(wide))))
    # order of blocks in an epoch: teams, then the permuted key within a team
    before = lambda value, *keys, order: F.coalesce(F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    teams = sized.groupBy("src", "epoch", "team").agg(F.sum("b_tokens").alias("t_tokens"))
    teams = teams.select("src", "epoch", "team", before("t_tokens", "src", "epoch", order=["team"]).alias("t_start"))
    placed = sized.withColumn("b_start", before("b_tokens", "src", "epoch", "team", order=["key", "block"])).join(teams, ["src", "epoch", "team"])
    base = F.col("epoch") * F.col("tokens") + F.col("t_start") + F.col("b_start")
    placed = placed.select("src", "block", "epoch", "weight", "budget_tokens", base.alias("base"), "b_tokens")
    placed = placed.filter("base <= budget_tokens")
    out = rows.join(placed, ["src", "block"])
    out = out.withColumn("start", F.col("base") + before("n_tokens", "src", "block", "epoch", order=[rank(*own, F.col("epoch")), "id", "n_tokens", "same"]))
    out = out.filter("start + n_tokens <= budget_tokens")
    mid = (F.col("start") + F.col("n_tokens") / 2) / F.greatest(F.col("budget_tokens"), F.lit(1))
    return out.select(F.col("id").alias(id_col), "source", "epoch", "n_tokens", "start", "weight", "budget_tokens", mid.alias("mix_key"))


def _numbered(df: DataFrame, many: str, name: str) -> DataFrame:
    """Each row of df as often as its column many says, numbered from 0 as name; in two steps, so that no array is longer than about the root of the number, or 1024."""
    teams = df.withColumn("__step", F.greatest(F.lit(1024), F.ceil(F.sqrt(many))).cast("long"))
    teams = teams.withColumn("__team", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({many} - 1) div __step"))))
    within = F.sequence(F.col("__team") * F.col("__step"), F.least(F.col(many), (F.col("__team") + 1) * F.col("__step")) - 1)
    return teams.select(*df.columns, F.explode(within).alias(name))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", tokens: Column | None = None, **options) -> DataFrame:
    """The rows of docs, once for each copy in the mixture, with the columns of docs, whatever their names. Rows repeating an id, or without one, each have their own copies."""
    rows = keyed_rows(docs, id_col, source=F.col(source_col), n=n_words(F.col("text")) if tokens is None else tokens)
    counts = mix_sources(rows.select("key", "source", "n"), "key", "source", F.col("n"), **options).groupBy("key").agg(F.count(F.lit(1)).alias("times"))
    return _numbered(rows.select("row", "key").join(counts, "key"), "times", "again").select("row.*")
