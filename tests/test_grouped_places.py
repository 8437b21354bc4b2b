"""Places within groups, whatever the ranges, against sorting each group; the interval of too few rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstone.operators import resample
from quillstone.operators.splits import grouped_places


@pytest.mark.parametrize("parts", [1, 7])
def test_places_equal_a_window(spark, parts):
    rng = random.Random(1)
    rows = [(rng.choice(["big", "big", "big", "a", "", None]), rng.choice([1, 2, None]), i) for i in range(400)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, h int, id int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(map(str, grouped_places(df, ["g", "h"], ["id"]).select("g", "h", "id", "pos").collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = df.withColumn("pos", (F.row_number().over(Window.partitionBy("g", "h").orderBy("id")) - 1).cast("long"))
    assert got == sorted(map(str, want.collect()))
    assert grouped_places(df.limit(0), ["g"], ["id"]).count() == 0


def test_interval_of_fewer_than_two_rows(spark):
    scores = spark.createDataFrame([(0, "m", 1.0), (1, "m", 0.5)], "r long, model string, f double")
    assert [tuple(r) for r in resample.intervals(scores, 2, 1).collect()] == [("m", 0.0, 0.0)]
