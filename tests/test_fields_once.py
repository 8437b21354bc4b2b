"""A text is parted into its sections once for the fields and once for the names, however many names there are."""

from pyspark.sql import functions as F

from quillstone.operators import segments


def test_sections_are_cleaned_once(spark):
    names = ["one", "two", "three", "four", "five", "six"]
    df = spark.createDataFrame([("one\n a\ntwo\nb\none\nc",), ("x",), (None,)], "t string")
    fields, warnings = segments.split_fields(F.col("t"), names)
    out = df.select(fields.alias("f"), warnings.alias("w"))
    assert [dict(r.f) for r in out.collect()] == [{"one": "a\nc", "two": "b"}, {}, {}]
    assert [len(r.w) for r in out.collect()] == [4, 6, 6]
    plan = out._jdf.queryExecution().analyzed().expressions().mkString("")
    assert plan.count("\\x{b}-\\x{1f}") <= 2
