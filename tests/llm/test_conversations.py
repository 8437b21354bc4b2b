"""Conversation repair: costs and audits against plain search, segments of any size, long runs, defined results for odd rows."""

import hashlib
import random
import re
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from quillstone.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, extra string"
EMPTY = hashlib.sha256(b"").hexdigest()


def brute(rows):
    """Report of one conversation by a search over rows and states; rows: (turn, role, text) after damage."""
    rows = [(t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append(1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0)
        seen.add((role, text))
    go = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @lru_cache(None)
    def best(i, q, room):  # least (cost, audit, output) from row i in state q with at most room insertions in a row
        out = [(0, "", ())] if i == len(rows) and q in ("", "a") else []
        for new in "ua":
            if room and (q, new) in go:
                c, a, o = best(i, new, room - 1)
                out.append((c + 5, "I" + a, ((new, ""),) + o))
        if i < len(rows):
            _, role, text = rows[i]
            c, a, o = best(i + 1, q, 4)
            out.append((c + 2, "D" + a, o))
            if faults[i] not in (1, 2):
                more = 5 * (faults[i] == 3)
                if (q, role[:1]) in go:
                    c, a, o = best(i + 1, go[q, role[:1]], 4)
                    out.append((c + more, "K" + a, ((role, text),) + o))
                for new in "ua":
                    if (q, new) in go:
                        c, a, o = best(i + 1, new, 4)
                        out.append((c + more + 1, "R" + a, ((new, text),) + o))
        return min(out) if out else (10**9, "", ())

    cost, audit, kept = best(0, "", 4)
    name = {"u": "user", "a": "assistant"}
    text = "\n".join(f"{name.get(r, r)}:{t}" for r, t in kept)
    turns = [t for t, *_ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(k) for k in (1, 2, 3)), sum(p not in ("su", "ua", "au") for p in pairs),
        cost, audit, hashlib.sha256(text.encode()).hexdigest(),
    )


def reported(df, **options):
    return {r[0]: tuple(r)[1:] for r in C.repair_report(df, **options).collect()}


def table(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for c in [*range(n), None]:
        for _ in range(rng.randrange(1, 13)):
            turn = rng.choice([None, *range(14)])
            rows.append((c, turn, rng.choice(["system", "user", "user", "assistant", "assistant", "tool", None, "user"]), rng.choice(["a.", "b!", "cut", "", " \n", None, "d? ", "é."]), "x"))
    return rows


@pytest.mark.parametrize("bits", [1, 3, C.SEGMENT_BITS])
def test_reports_equal_a_plain_search_whatever_the_segments(spark, bits):
    rows = table(4)
    want = {c: brute([r[1:4] for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    assert reported(spark.createDataFrame(rows, SCHEMA).repartition(5), segment_bits=bits) == want


@pytest.mark.parametrize("symbol", range(12))
def test_powers_equal_single_steps(symbol):
    v = w = C.END
    for _ in range(77):
        v = C.across(symbol, 1, v)
    assert C.across(symbol, 77, w) == v
    assert C._applied(C.matrix_of(bytes([symbol]) * 77), w) == v


def test_a_long_conversation_of_long_runs(spark):
    rows = [(1, i, "user" if i < 3000 else "assistant", f"t{i}.", None) for i in range(6000)]
    got = reported(spark.createDataFrame(rows, SCHEMA), segment_bits=8)[1]
    # every second row takes the other role
    assert got[:5] == (0, 0, 0, 0, 5998) and got[5] == 3000 and got[6].count("R") == 3000
    assert reported(spark.createDataFrame(rows, SCHEMA))[1] == got


def test_rows_spell_out_the_report(spark):
    rows = table(9, 20)
    df = spark.createDataFrame(rows, SCHEMA)
    kept = C.repaired_rows(df, segment_bits=2).orderBy("place", "step").collect()
    want = reported(df)
    for c, w in want.items():
        own = [r for r in kept if r.conv == ("" if c is None else f"={c}")]
        assert "".join(r.edit for r in own) == w[6]
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in own if r.edit != "D"))


def test_empty_dropped_and_repeated(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert reported(none) == {}
    ids = spark.createDataFrame([(1,), (None,)], "conv_id long")
    assert reported(none, ids=ids) == dict.fromkeys([1, None], (0, 0, 0, 0, 0, 0, "", EMPTY))
    long = "w " * 200_000 + "end."
    rows = [(1, 0, "user", long, None), (1, 0, "user", long, None), (1, 1, "assistant", "ok.", None)]
    assert reported(spark.createDataFrame(rows, SCHEMA))[1] == brute([r[1:4] for r in rows])


def test_damage(spark):
    import zlib

    rows = [(c, t, "assistant", "A. b!", None) for c in range(40) for t in [None, 0, 1, 2]] + [(None, 3, None, None, None)]
    got = sorted(C.damaged(spark.createDataFrame(rows, SCHEMA)).collect(), key=str)
    want = []
    for c, t, role, text, _ in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text, role = " " if text is None else text, " " if role is None else role
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        want += [(c, t, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    assert [tuple(r) for r in got] == sorted(want, key=lambda r: str(C_row(*r)))


def C_row(conv_id, turn, role, text):
    from pyspark.sql import Row

    return Row(conv_id=conv_id, turn=turn, role=role, text=text)


def test_extra_columns_with_clashing_names(spark):
    df = spark.createDataFrame(table(2, 5), SCHEMA)
    odd = df.withColumns({c: F.lit("x") for c in ("conv", "place", "fault", "edits", "seg", "step")})
    assert reported(odd) == reported(df)
