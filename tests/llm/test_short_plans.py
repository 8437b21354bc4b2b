"""Joins without a hot key broadcast nothing, and components stay right with and without hubs."""

from pyspark.sql import functions as F

from quillstone.llm.common import any_hot, components, hot_join


def test_joins_without_a_hot_key_hold_no_broadcast(spark):
    left = spark.range(2000).select((F.col("id") % 1000).alias("k"), F.col("id").alias("x"))
    right = spark.range(1000).select(F.col("id").alias("k"), F.lit(2).alias("c"), (F.col("id") * 3).alias("y"))
    assert not any_hot(right, "c", 2000) and any_hot(right.withColumn("c", F.lit(8)), "c", 2000)
    plain, both = hot_join(left, right, ["k"], "c", 2000, hot=False), hot_join(left, right, ["k"], "c", 2000)
    text = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert "strategy=broadcast" not in text(plain) and "strategy=broadcast" in text(both)
    assert plain.columns == both.columns and sorted(plain.collect()) == sorted(both.collect())


def test_components_of_chains_and_of_a_star(spark):
    chains = [(i, i + 1) for i in range(900) if i % 6 != 5]
    star = [(1000, i) for i in range(1001, 1400)]
    for edges in (chains, chains + star):
        got = dict(components(spark.createDataFrame(edges, "a long, b long")).select("node", "comp").collect())
        want = {x: x // 6 * 6 for e in chains for x in e} | ({x: 1000 for e in star for x in e} if edges is not chains else {})
        assert got == want
