"""Contexts of boundaries are counted where the lines are, and only distinct ones meet the model; small pieces give the same scores."""

from pyspark.sql import functions as F

from quillstone.operators import spacing


def test_equal_lines_give_one_row_a_context_and_piece(spark):
    lines = spark.range(3000).coalesce(1).select(F.col("id"), F.lit(0).alias("line"), F.lit("ab cd ab").alias("raw"))
    got = spacing.counted(lines).collect()
    assert len(got) < 40 and {(r.s, r.n) for r in got if r.context == "1_1:bc"} == {(3000, 3000)}


def test_small_pieces_score_alike(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"ab cd{'x' * (i % 3)} ab\né\U0001f600b cab dd") for i in range(40)], "doc_id long, text string")
    model = spacing.train(rows)
    key = lambda df: sorted(map(tuple, df.collect()))
    lines = spacing.lines_of(rows)
    whole, odds = key(spacing.scored(model, lines)), key(model[0])
    monkeypatch.setattr(spacing, "PIECE", 5)
    assert key(spacing.scored(model, lines)) == whole and key(spacing.train(rows)[0]) == odds
    assert len(whole) == 40 * (5 + 7) + sum(i % 3 for i in range(40))
