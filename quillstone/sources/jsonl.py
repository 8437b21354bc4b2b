"""JSON-Lines sources and sinks: explicit schemas, globbed scans, counted writes, one-object reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, path: str, schema: StructType, stage: str = "an earlier stage") -> DataFrame:
    """The rows of one path or glob, blank lines skipped; a missing path names the stage that should have written it."""
    try:
        return spark.read.schema(schema).json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(f"{path} is missing: run {stage} first") from e
        raise


def write_jsonl(df: DataFrame, path: str) -> int:
    """Writes df and returns its rows, counted while they are written."""
    seen = Observation("written")
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(path)
    return seen.get["n"]


def report(df: DataFrame) -> DataFrame:
    """Each row as one JSON object, nulls included."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("report"))
