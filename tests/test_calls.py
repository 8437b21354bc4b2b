"""Structured calls: error rows, retries, resume, fatal errors, costs, schema checks before the first call."""

import json
import sys

import pytest
from pyspark import cloudpickle

from quillstone.functions.schema import schema_problems
from quillstone.sources.calls import CallError, FatalCallError, latest, run_calls, structured_calls

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not see the tests' folder
SCHEMA = {"type": "object", "required": ["label"], "properties": {"label": {"enum": ["a", "b"]}}}


def stub(prompt, attempt):
    word = prompt.split()[0]
    if word == "flaky" and attempt < 3:
        raise CallError("timeout", f"try {attempt}")
    if word == "down":
        raise CallError("timeout", "still")
    if word == "refuse":
        raise CallError("refusal", again=False)
    if word == "odd":
        return {"output": {"label": "c"}}
    if word == "text":
        return {"output": "label a"}
    if word == "bare":
        return {"output": {}}
    if word == "account":
        raise FatalCallError("no credit")
    return {"output": {"label": "a"}, "input_tokens": 1000, "output_tokens": 10}


def test_each_row_is_answered_or_an_error(spark):
    rows = [(i, p) for i, p in enumerate(["fine", "flaky x", "down", "refuse", "odd", "text", "bare", None, ""])]
    rows[8] = (8, "fine again")
    got = {r.id: r for r in structured_calls(spark.createDataFrame(rows, "id int, prompt string"), stub, SCHEMA, "prompt").collect()}
    assert {i: (r.error, r.attempts) for i, r in got.items()} == {
        0: (None, 1), 1: (None, 3), 2: ("timeout", 3), 3: ("refusal", 1), 4: ("unparseable_output", 3), 5: ("unparseable_output", 3), 6: ("unparseable_output", 3), 7: ("no_prompt", 0), 8: (None, 1),
    }
    assert json.loads(got[0].output) == {"label": "a"} and got[2].error_detail == "still" and got[2].input_tokens is None
    assert "none of" in got[4].error_detail and got[6].error_detail == "label is missing"


def test_a_rerun_touches_failures_and_changed_prompts_only(spark, tmp_path):
    out, go = str(tmp_path / "out"), dict(schema=SCHEMA, keys=["id"], prompt="prompt", price_in=3.0, price_out=15.0)
    rows = [(1, "fine"), (2, "down"), (3, "refuse"), (4, "fine too")]
    df = lambda r: spark.createDataFrame(r, "id int, prompt string")
    first = run_calls(df(rows), out, stub, **go)
    assert (first["pending"], first["answered"], first["errors"]) == (4, 2, 2) and first["cost"] == pytest.approx(2 * (3000 + 150) / 1e6)
    again = run_calls(df(rows), out, stub, **go)
    assert (again["pending"], again["answered"], again["errors"], again["cost"]) == (2, 0, 2, 0)
    fixed = run_calls(df(rows[:1] + [(2, "down"), (3, "fine now"), (4, "fine changed")]), out, lambda p, a: stub("fine", a), **go)
    assert (fixed["pending"], fixed["answered"]) == (3, 3)
    assert run_calls(df(rows[:1]), out, stub, **go)["pending"] == 0
    last = latest(spark.read.parquet(out), ["id"]).collect()
    # a prompt that changed is a result of its own beside the one of the old prompt
    assert sorted((r.id, str(r.error), r.run) for r in last) == [(1, "None", 1), (2, "None", 3), (3, "None", 3), (3, "refusal", 2), (4, "None", 1), (4, "None", 3)]


def test_a_fatal_error_stops_and_keeps_what_was_answered(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = spark.createDataFrame([(1, "fine"), (2, "account"), (3, "fine")], "id int, prompt string").coalesce(1)
    with pytest.raises(FatalCallError, match="no credit"):
        run_calls(rows, out, stub, SCHEMA, ["id"], "prompt")
    assert sorted((r.id, str(r.error)) for r in spark.read.parquet(out).collect()) == [(1, "None"), (2, "fatal")]
    assert run_calls(rows, out, lambda p, a: stub("fine", a), SCHEMA, ["id"], "prompt")["pending"] == 2


def test_the_schema_is_checked_before_the_first_call(spark):
    rows = spark.createDataFrame([(1, "fine")], "id int, prompt string")
    with pytest.raises(ValueError, match="maxItems"):
        structured_calls(rows, stub, {"type": "array", "maxItems": 3}, "prompt")


def test_schema_rows(spark):
    rows = [(1, '{"maxItems": 1, "a": [{"minItems": 2}]}'), (2, "{}"), (3, None), (4, "{"), (5, '["maxItems"]')]
    got = sorted((r.id, r.place, r.path) for r in schema_problems(spark.createDataFrame(rows, "id int, body string"), "body").collect())
    assert got == [(1, 1, "$.maxItems"), (1, 2, "$.a[0].minItems"), (4, 1, "$")]
