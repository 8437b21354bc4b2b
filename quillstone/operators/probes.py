"""Probes: named invariants counted as metrics of jobs that read the frames anyway, and a case registry held against their results."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

Frame = DataFrame | Callable[[], DataFrame]
_SCHEMA = "probe string, ran boolean, rows long, failing long, passed boolean, detail string"


@dataclass(frozen=True)
class Probe:
    """An invariant of a frame's rows: it holds where no row meets the failing condition (null: not met)."""

    name: str
    frame: str
    failing: str  # a SQL condition over the frame's columns


def observed(df: DataFrame, probes: Iterable[Probe]) -> tuple[DataFrame, Observation]:
    """df with the probes' counts as metrics of whatever job next reads it whole; the observation has them once that job is done."""
    seen = Observation()
    counts = [F.count(F.when(F.expr(p.failing), 1)).alias(f"f{i}") for i, p in enumerate(probes)]
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *counts), seen


def _told(p: Probe, rows: int, failing: int) -> tuple:
    return (p.name, True, rows, failing, failing == 0, f"{failing} of {rows} rows fail")


def _run(frame: Frame, probes: list[Probe]) -> list[tuple]:
    """The rows of probes of one frame: one job for all; if it breaks, each alone, so that one broken probe does not hide the rest."""
    try:
        df, seen = observed(frame() if callable(frame) else frame, probes)
        df.write.format("noop").mode("overwrite").save()
        got = seen.get
        return [_told(p, got["rows"], got[f"f{i}"]) for i, p in enumerate(probes)]
    except Exception as e:  # a probe that breaks is a result
        if len(probes) > 1:
            return [x for p in probes for x in _run(frame, [p])]
        return [(probes[0].name, True, None, None, False, f"exception {type(e).__name__}")]


def run_probes(spark: SparkSession, probes: list[Probe], frames: dict[str, Frame]) -> DataFrame:
    """(probe, ran, rows, failing, passed, detail): every probe in order; frames are read once each, and only counts reach the driver.

    A frame is a DataFrame or makes one. A probe of an unknown frame did not run; one that raises has failed. An empty frame holds every invariant.
    """
    done: dict[str, tuple] = {}
    for name in dict.fromkeys(p.frame for p in probes):
        own = [p for p in probes if p.frame == name]
        rows = _run(frames[name], own) if name in frames else [(p.name, False, None, None, None, f"no frame {name}") for p in own]
        done |= {r[0]: r for r in rows}
    return spark.createDataFrame([done[p.name] for p in probes], _SCHEMA)


def case_problems(cases: DataFrame, categories: DataFrame, patterns: list[str]) -> DataFrame:
    """(id, problem): faults of form of registered cases, one row each.

    cases (id, layer, category, title, symptom, fix, pattern, probe, metric: struct of name, before, after, kind and source or null); categories (layer, category): the scheme, small.
    """
    layers = categories.select(F.col("layer").alias("known_layer")).distinct()
    pairs = categories.select(F.col("layer").alias("l"), F.col("category").alias("c")).distinct()
    x = cases.join(F.broadcast(layers), F.col("layer") == F.col("known_layer"), "left").join(F.broadcast(pairs), (F.col("layer") == F.col("l")) & (F.col("category") == F.col("c")), "left")
    m, kind = F.col("metric"), F.col("metric.kind")
    fault = lambda c, text: F.when(c, text if isinstance(text, Column) else F.lit(text))
    faults = [fault(F.col(c).isNull(), f"no {c}") for c in ("layer", "category", "title", "symptom", "fix")]
    faults += [
        fault(F.col("layer").isNotNull() & F.col("known_layer").isNull(), F.concat(F.lit("unknown layer "), F.col("layer"))),
        fault(F.col("known_layer").isNotNull() & F.col("category").isNotNull() & F.col("c").isNull(), F.concat(F.lit("no category "), F.col("category"), F.lit(" in "), F.col("layer"))),
        *[fault(m.isNotNull() & F.col(f"metric.{c}").isNull(), f"metric without {c}") for c in ("name", "before", "after", "kind")],
        fault((kind == "measured") & (F.coalesce("metric.source", F.lit("")) == ""), "measured figure without source"),
        fault(~kind.isin("measured", "live"), F.concat(F.lit("unknown kind of figure "), kind)),
        fault(~F.col("pattern").isin(*patterns), F.concat(F.lit("unknown pattern "), F.col("pattern"))),
    ]
    return x.select("id", F.explode(F.array_compact(F.array(*faults))).alias("problem"))


def patterns_without_guard(cases: DataFrame, guards: dict[str, str], least: int = 2) -> DataFrame:
    """(pattern, n): patterns that at least so many cases share and no probe guards."""
    return cases.filter("pattern is not null").groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") >= least) & ~F.coalesce(F.col("pattern").isin(*guards), F.lit(False)))


def standing(cases: DataFrame, results: DataFrame) -> DataFrame:
    """(id, probe, status, passed, standing): each case against its probe's result.

    standing: recorded (has no probe), not run, holds, open (recorded open, fails), stale (recorded open, passes: the registry is behind) or regressed
    (recorded as mended, fails).
    """
    x = cases.select("id", "probe", "status").join(F.broadcast(results.select("probe", "ran", "passed")), "probe", "left")  # probes are few
    is_open = F.coalesce(F.col("status") == "open", F.lit(False))
    how = F.when(F.col("probe").isNull(), "recorded").when(~F.coalesce("ran", F.lit(False)), "not run")
    how = how.when(F.col("passed"), F.when(is_open, "stale").otherwise("holds")).otherwise(F.when(is_open, "open").otherwise("regressed"))
    return x.select("id", "probe", "status", "passed", how.alias("standing"))
