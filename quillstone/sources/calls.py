"""Structured calls as a source: a pluggable caller answers a prompt a row; failures are rows too, and a later run repeats only those.

A caller is fn(prompt, attempt) -> {"output": dict, "input_tokens": int, "output_tokens": int}. It may raise CallError, which is tried again within the
retry budget and then kept as an error row, or FatalCallError, which says that no further call can succeed.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from quillstone.functions.schema import problems
from quillstone.functions.text import fingerprint
from quillstone.streaming.resume import pending


class CallError(Exception):
    """A call that failed; kind names the failure, again says whether another attempt may succeed."""

    def __init__(self, kind: str, detail: str = "", again: bool = True) -> None:
        super().__init__(kind, detail, again)
        self.kind, self.detail, self.again = kind, detail, again


class FatalCallError(Exception):
    """An account, contract or configuration failure: every other call would fail as well."""


RESULT = "output string, error string, error_detail string, attempts int, input_tokens long, output_tokens long"
FATAL = "fatal"


def _misfit(output: object, schema: dict) -> str:
    """Why an output is none of the schema's, or nothing: its required fields are there and listed values kept to."""
    if not isinstance(output, dict):
        return "not an object"
    for name in schema.get("required", []):
        if name not in output:
            return f"{name} is missing"
    for name, part in schema.get("properties", {}).items():
        if name in output and "enum" in part and output[name] not in part["enum"]:
            return f"{name} is none of {part['enum']}"
    return ""


def _answered(prompt: str, caller: Callable, schema: dict, retries: int) -> tuple:
    """One row of RESULT; tokens are those of the attempt that answered, or of none."""
    for attempt in range(1, retries + 2):
        try:
            got = caller(prompt, attempt)
            if why := _misfit(got.get("output"), schema):
                raise CallError("unparseable_output", why)
            return json.dumps(got["output"], ensure_ascii=False, sort_keys=True), None, None, attempt, got.get("input_tokens", 0), got.get("output_tokens", 0)
        except CallError as e:
            if not e.again or attempt > retries:
                return None, e.kind, e.detail[:600], attempt, None, None
    raise AssertionError("unreachable")


def structured_calls(rows: DataFrame, caller: Callable, schema: dict, prompt: str, retries: int = 2) -> DataFrame:
    """rows with the columns of RESULT: one answered or failed call a row, made where the row is.

    The schema is checked before anything is called. A FatalCallError ends its task's calls: the row that met it has the error FATAL, and the task's
    later rows are left out, so that they are still to do. A null prompt is an error row, "no_prompt", without a call.
    """
    if found := problems(schema):
        raise ValueError("the output schema would be refused: " + "; ".join(found))
    from pyspark.sql.types import StructType

    at, out_schema = rows.columns.index(prompt), StructType(rows.schema.fields + StructType.fromDDL(RESULT).fields)
    names = [f.split()[0] for f in RESULT.split(", ")]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()]

    def run(batches):
        for b in batches:
            got, stop = [], False
            for text in b.column(at).to_pylist():
                try:
                    got.append((None, "no_prompt", None, 0, None, None) if text is None else _answered(text, caller, schema, retries))
                except FatalCallError as e:
                    got.append((None, FATAL, str(e)[:600], 1, None, None))
                    stop = True
                    break
            cols = [pa.array(c, k) for c, k in zip(zip(*got), kinds)] if got else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([*b.slice(0, len(got)).columns, *cols], [*b.schema.names, *names])
            if stop:
                return

    return rows.mapInArrow(run, out_schema)


def run_calls(rows: DataFrame, out: str, caller: Callable, schema: dict, keys: list[str], prompt: str, price_in: float = 0.0, price_out: float = 0.0, **options) -> dict:
    """Call for the rows without a successful result in the Parquet folder out, append what comes back, and say what it took.

    A row is its keys and the fingerprint of its prompt, so a changed prompt is called again and an error is retried, while nothing else is touched.
    Returned: pending, answered, errors and cost (tokens by price a million), observed while the results are written. After a fatal error what was
    answered is kept, and FatalCallError is raised.
    """
    spark = rows.sparkSession
    fresh = rows.withColumn("input_sha", fingerprint(F.coalesce(F.col(prompt), F.lit(""))))
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    run = 1
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        before = spark.read.parquet(out)
        run = (before.agg(F.max("run")).first()[0] or 0) + 1
        fresh = pending(fresh, before.filter("error is null"), [*keys, "input_sha"])
    seen = Observation()
    cost = (F.coalesce("input_tokens", F.lit(0)) * price_in + F.coalesce("output_tokens", F.lit(0)) * price_out) / 1e6
    made = structured_calls(fresh, caller, schema, prompt, **options).withColumns({"cost": cost, "run": F.lit(run)}).select(*keys, "input_sha", *[f.split()[0] for f in RESULT.split(", ")], "cost", "run")
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    told = made.observe(
        seen, F.count(F.lit(1)).alias("pending"), count(F.col("error").isNull()).alias("answered"), count(F.col("error").isNotNull()).alias("errors"),
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"), F.max(F.when(F.col("error") == FATAL, F.col("error_detail"))).alias("fatal"),
    )
    told.write.mode("append").parquet(out)
    metrics = dict(seen.get)
    if why := metrics.pop("fatal"):
        raise FatalCallError(why)
    return metrics


def latest(results: DataFrame, keys: list[str]) -> DataFrame:
    """One result a row and prompt: the successful one, else the last error."""
    order = Window.partitionBy(*keys, "input_sha").orderBy(F.col("error").isNotNull(), F.desc("run"))
    return results.withColumn("__k", F.row_number().over(order)).filter("__k = 1").drop("__k")
