"""Question-and-answer pairs: numbered alike, unlike, on one side, not at all; what rides along."""

import pytest
from pyspark.sql import functions as F

from quillstone.operators.pairs import NAMES, split_pairs

SCHEMA = "id int, question string, answer string, notes array<string>, pair_index string"


def split(spark, q, a, **kw):
    df = spark.createDataFrame([(1, q, a, ["old"], "mine")], SCHEMA)
    return split_pairs(df, **kw).orderBy("pair_index").collect()


CASES = [
    ("① 가? ② 나?", "① 네 ② 아니오", [(1, 2, "paired", True, "① 가?", "① 네", False), (2, 2, "paired", True, "② 나?", "② 아니오", False)]),
    ("➊ 가 \n ➋ 나", "(질의1) 네\n(질의 2) 아니오", [(1, 2, "paired", True, "➊ 가", "(질의1) 네", False), (2, 2, "paired", True, "➋ 나", "(질의 2) 아니오", False)]),
    ("➊ a ➋ b ➌ c", "① x ② y", [(1, 1, "single", True, "➊ a ➋ b ➌ c", "① x ② y", True)]),
    ("plain", "① x ② y", [(1, 1, "single", True, "plain", "① x ② y", False)]),
    ("① x ② y", "plain", [(1, 1, "single", True, "① x ② y", "plain", False)]),
    ("① only one", "① only one", [(1, 1, "single", False, "① only one", "① only one", False)]),
    ("② first ① then ② again", "① x ③ skipped ② y", [(1, 2, "paired", True, "① then", "① x ③ skipped", False), (2, 2, "paired", True, "② again", "② y", False)]),
    (None, None, [(1, 1, "single", False, "", "", False)]),
    ("", "answer", [(1, 1, "single", False, "", "answer", False)]),
]


@pytest.mark.parametrize("q,a,want", CASES)
def test_cases(spark, q, a, want):
    got = split(spark, q, a)
    assert [tuple(r[n] for n in NAMES) for r in got] == want
    assert all(r.id == 1 and r.notes == ["old"] for r in got)


def test_mismatch_is_told_in_the_warnings(spark):
    r = split(spark, "① a ② b ③ c", "① x ② y", warnings="notes")[0]
    assert r.notes == ["old", "mark_mismatch"] and "mark_mismatch" not in r.asDict()
    assert split(spark, "① a ② b", "① x ② y", warnings="notes")[0].notes == ["old"]
    none = spark.createDataFrame([(1, "① a ② b ③ c", "① x ② y", None, None)], SCHEMA)
    assert split_pairs(none, warnings="notes").first().notes == ["mark_mismatch"]


def test_nothing_is_shuffled_and_empty_stays_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    out = split_pairs(df)
    assert out.count() == 0 and "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    long = spark.createDataFrame([(1, "① " + "w " * 50_000 + "② b", "① x ② " + "v " * 50_000, None, None)], SCHEMA)
    assert split_pairs(long).agg(F.sum(F.length("question"))).first()[0] > 99_000
