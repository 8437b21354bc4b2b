"""Enumeration marks are met by ranges of characters, all fifty and no other."""

import re

from pyspark.sql import functions as F

from quillstone.functions import text as T


def test_ranges_hold_all_marks_and_no_other():
    held = {chr(c) for c in range(0x2400, 0x2800) if re.match(T.CIRCLED_CLASS, chr(c))}
    assert held == set("".join(T.CIRCLED))


def test_every_kind_of_mark_is_found(spark):
    rows = [(i, f"x {marks[0]} a  {marks[1]} b\n{marks[2]} c") for i, marks in enumerate(T.CIRCLED)] + [(9, "( 질의 1 ) a 질 의2: b\n[질의 3] c질의4d")]
    df = spark.createDataFrame(rows, "id int, t string")
    out = {r.id: [(m.num, rows[i][1][m.pos]) for m in r.m] for i, r in enumerate(df.select("id", T.sequence_marks(F.col("t")).alias("m")).orderBy("id").collect())}
    assert all([n for n, _ in out[i]] == [1, 2, 3] and [c for _, c in out[i]] == list(T.CIRCLED[i][:3]) for i in range(5))
    assert [n for n, _ in out[9]] == [1, 2, 3]
