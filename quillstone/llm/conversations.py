"""Repair of conversation structure: the cheapest edits that give a conversation alternating turns, by run-length dynamic programming.

Each row becomes a symbol of its role and fault. Equal symbols in a row are one run, which the cost vector crosses by cached binary
powers of the symbol's min-plus matrix; choices are unrolled afterwards. Rows are sorted over ranges and cut into segments of bounded
length, so a conversation of any size is worked in parts: matrices of its segments give the cost after each, end states of its segments the
state before each, and then every segment unrolls its own choices.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import hot_join
from quillstone.session import cut

#: Rows of a segment, as a power of two: what a task holds at once.
SEGMENT_BITS = 14
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
INF = 1 << 60
DELETE, REROLE, INSERT, LEFT_TRUNCATED = 2, 1, 5, 5
_ROLES = "sua"  # initials with a place in the pattern; any other is class 3
# States by what was put out last: 0 nothing, 1 system, 2 user, 3 assistant; the pattern (s?(ua)+)? ends in 0 or 3.
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_TURN = ("u", "u", "a", "u")  # the one role that may be inserted or given in each state
END = (0, 2 * INSERT, INSERT, 0)

Matrix = tuple[tuple[int, ...], ...]


def _times(a: Matrix, b: Matrix) -> Matrix:
    """Min-plus product."""
    return tuple(tuple(min(INF, min(a[q][k] + b[k][p] for k in range(4))) for p in range(4)) for q in range(4))


def _applied(m: Matrix, v: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(min(m[q][p] + v[p] for p in range(4)) for q in range(4))


def _edits(symbol: int, q: int) -> list[tuple[str, int, int]]:
    """(edit, next state, cost) of the ways to use up a row in state q, least initial first; insertions are not among them."""
    role, fault = divmod(symbol, 3)
    out = [("D-", q, DELETE)]
    if fault < 2:
        more = LEFT_TRUNCATED * fault
        if role < 3 and (q, _ROLES[role]) in _NEXT:
            out.append(("K-", _NEXT[q, _ROLES[role]], more))
        out.append(("R" + _TURN[q], _NEXT[q, _TURN[q]], REROLE + more))
    return out


#: Powers and steps met so far; plain tables, as they travel to executors by value with the functions that fill them.
_powers_met: dict[tuple[int, int], Matrix] = {}
_steps_met: dict[tuple, tuple] = {}


def power(symbol: int, k: int) -> Matrix:
    """The matrix of 2**k rows with one symbol: least cost from each state before them to each state after them."""
    if (symbol, k) not in _powers_met:
        _powers_met[symbol, k] = _times(power(symbol, k - 1), power(symbol, k - 1)) if k else _one_row(symbol)
    return _powers_met[symbol, k]


def _one_row(symbol: int) -> Matrix:
    inserted = [[INF] * 4 for _ in range(4)]
    for q in range(4):
        p, cost = q, 0
        for _ in range(3):
            inserted[q][p] = min(inserted[q][p], cost)
            p, cost = _NEXT[p, _TURN[p]], cost + INSERT
    used = [[INF] * 4 for _ in range(4)]
    for q in range(4):
        for _, p, cost in _edits(symbol, q):
            used[q][p] = min(used[q][p], cost)
    return _times(inserted, used)


def _bits(n: int) -> list[int]:
    return [k for k in range(n.bit_length()) if n >> k & 1]


def across(symbol: int, n: int, v: tuple[int, ...]) -> tuple[int, ...]:
    """Costs before a run of n rows from the costs after it."""
    for k in _bits(n):
        v = _applied(power(symbol, k), v)
    return v


def runs_of(symbols: bytes) -> list[tuple[int, int]]:
    return [(s, sum(1 for _ in g)) for s, g in groupby(symbols)]


def matrix_of(symbols: bytes) -> Matrix:
    """Least costs from each state before the rows to each state after them."""
    out = tuple(tuple(0 if p == q else INF for p in range(4)) for q in range(4))
    for s, n in runs_of(symbols):
        for k in _bits(n):
            out = _times(out, power(s, k))
    return out


def _step(symbol: int, after: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[tuple[str, int], ...]]:
    """Costs before one row, less their minimum, and for each state the edits that use it up, ASCII-least first, with the state after.

    Costs less their minimum differ by a few edits at most, so few are ever met.
    """
    if (symbol, after) in _steps_met:
        return _steps_met[symbol, after]
    before, choice = across(symbol, 1, after), []
    for q in range(4):
        done = ""
        while True:
            taken = [(e, p) for e, p, c in _edits(symbol, q) if c + after[p] == before[q]]
            to = _NEXT[q, _TURN[q]]
            if taken and taken[0][0] == "D-" or INSERT + before[to] != before[q]:
                choice.append((done + taken[0][0], taken[0][1]))
                break
            done, q = done + "I" + _TURN[q], to
    low = min(before)
    _steps_met[symbol, after] = tuple(x - low for x in before), tuple(choice)
    return _steps_met[symbol, after]


def unrolled(symbols: bytes, after: tuple[int, ...], start: int) -> tuple[list[str], int]:
    """The edits of each row, two characters each (initial, then the new role's or -), and the state after the last."""
    low = min(after)
    ends = [tuple(x - low for x in after)]
    runs = runs_of(symbols)
    for s, n in reversed(runs[1:]):
        v = across(s, n, ends[-1])
        ends.append(tuple(x - min(v) for x in v))
    out, q = [], start
    for (s, n), v in zip(runs, reversed(ends)):
        steps = []
        for _ in range(n):
            v, choice = _step(s, v)
            steps.append(choice)
        for choice in reversed(steps):
            edits, q = choice[q]
            out.append(edits)
    return out, q


def closing(q: int) -> str:
    """Insertions that end a conversation in state q."""
    out = ""
    while END[q]:
        out, q = out + "I" + _TURN[q], _NEXT[q, _TURN[q]]
    return out


def _segments(batches):
    """(segment, conversation, its mark or None, places, symbols, initials) from rows sorted by segment, conversation and place; marks come first."""
    at, mark, places, symbols, initials = None, None, [], bytearray(), []
    for b in batches:
        for seg, conv, place, symbol, initial, m in zip(*(b.column(k).to_pylist() for k in range(6))):
            if (seg, conv) != at:
                if places:
                    yield *at, mark, places, bytes(symbols), initials
                at, mark, places, symbols, initials = (seg, conv), None, [], bytearray(), []
            if place < 0:
                mark = m
            else:
                places.append(place)
                symbols.append(symbol)
                initials.append(initial)
    if places:
        yield *at, mark, places, bytes(symbols), initials


def _matrices(batches):
    for seg, conv, _, _, symbols, initials in _segments(batches):
        yield pa.RecordBatch.from_pylist([{"conv": conv, "seg": seg, "matrix": [x for row in matrix_of(symbols) for x in row], "last": initials[-1]}], _schema("conv string, seg long, matrix array<long>, last string"))


def _ends(batches):
    for seg, conv, mark, _, symbols, _ in _segments(batches):
        ends = [unrolled(symbols, tuple(mark["after"]), q)[1] for q in range(4)]
        yield pa.RecordBatch.from_pylist([{"conv": conv, "seg": seg, "ends": ends}], _schema("conv string, seg long, ends array<int>"))


_LEGAL = {"su", "ua", "au"}


def _plans(batches):
    for _, _, mark, places, symbols, initials in _segments(batches):
        mark = mark or {"after": END, "start": 0, "before": None, "last": True}
        edits, q = unrolled(symbols, tuple(mark["after"]), mark["start"])
        if mark["last"]:
            edits[-1] += closing(q)
        before = [mark["before"], *initials[:-1]]
        bad = [int(a is not None and a + b not in _LEGAL) for a, b in zip(before, initials)]
        yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(edits), pa.array(bad, pa.int32())], ["place", "edits", "illegal"])


def _schema(ddl: str) -> pa.Schema:
    kind = {"string": pa.string(), "long": pa.int64(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(n, kind[t]) for n, t in (f.split(" ") for f in ddl.split(", "))])


def _costs_after(group: pd.DataFrame) -> pd.DataFrame:
    """For each segment of one conversation: the costs after it and the last initial before it. One small row a segment."""
    group = group.sort_values("seg")
    v, after = END, []
    for m in reversed(list(group["matrix"])):
        after.append(list(v))
        v = _applied(tuple(tuple(int(x) for x in m[q * 4 : q * 4 + 4]) for q in range(4)), v)
    return pd.DataFrame({"conv": group["conv"], "seg": group["seg"], "after": after[::-1], "before": [None, *group["last"][:-1]]})


def _starts(group: pd.DataFrame) -> pd.DataFrame:
    """For each segment of one conversation: the state it starts in and whether it is the last."""
    group = group.sort_values("seg")
    q, start = 0, []
    for ends in group["ends"]:
        start.append(q)
        q = int(ends[q])
    return pd.DataFrame({"conv": group["conv"], "seg": group["seg"], "start": start, "last": [False] * (len(group) - 1) + [True]})


def _plan(rows: DataFrame, spanning: DataFrame) -> DataFrame:
    """(place, edits, illegal) from rows (seg, conv, place, symbol, initial); spanning: conversations in several segments."""
    mark = "struct<after: array<bigint>, start: int, before: string, last: boolean>"
    plain = rows.select("seg", "conv", "place", "symbol", "initial", F.lit(None).cast(mark).alias("mark"))
    wide = cut(plain.join(spanning, "conv", "left_semi").select(plain.columns))  # at most two conversations a segment lie in others too

    def run(df, fn, schema):
        return df.repartition("seg").sortWithinPartitions("seg", "conv", "place").mapInArrow(fn, schema)

    def marked(df, marks, *names):
        given = {n: F.col(n) if n in names else F.lit(None) for n in ("after", "start", "before", "last")}
        row = F.struct(*[c.alias(n) for n, c in given.items()]).cast(mark).alias("mark")
        return df.unionByName(marks.select("seg", "conv", F.lit(-1).cast("long").alias("place"), F.lit(0).alias("symbol"), F.lit("").alias("initial"), row))

    matrices = run(wide, _matrices, "conv string, seg long, matrix array<long>, last string")
    after = cut(matrices.groupBy("conv").applyInPandas(_costs_after, "conv string, seg long, after array<long>, before string"))
    ends = run(marked(wide, after, "after"), _ends, "conv string, seg long, ends array<int>")
    starts = ends.groupBy("conv").applyInPandas(_starts, "conv string, seg long, start int, last boolean")
    marks = cut(after.join(starts, ["conv", "seg"]))
    return run(marked(plain, marks, "after", "start", "before", "last"), _plans, "place long, edits string, illegal int")


def _key(conv: Column) -> Column:
    """A conversation's key; that of a null id is the empty string."""
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))


def planned_rows(conversations: DataFrame, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """(conv, place, turn, role, text, fault, edits, illegal): every row in its place with its fault and edits, in a written table.

    place orders rows over all conversations: by conversation, turn (nulls first), role and a digest of the text. fault: 0 none, 1 blank, 2
    duplicate, 3 truncated. illegal is 1 where the row's role initial may not follow that of the row before.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select(_key(F.col("conv_id")).alias("conv"), "turn", role.alias("role"), text.alias("text"), F.sha2(text, 256).alias("digest"))
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "digest"]
    rows = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    tail = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    slim = cut(rows.select("conv", "place", F.shiftright("place", segment_bits).alias("seg"), "role", "digest", tail.alias("tail")))
    seen = cut(slim.groupBy("conv", "role", "digest").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1"))
    total = slim.count()
    again = hot_join(slim.select("conv", "role", "digest", "place"), seen, ["conv", "role", "digest"], "c", total).filter("place > first").select("place", F.lit(True).alias("again"))
    fault = F.when(F.col("tail") == "", BLANK).when(F.col("again"), DUPLICATE).when(~F.col("tail").isin(".", "!", "?"), TRUNCATED).otherwise(0)
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    marked = slim.join(again, "place", "left").select("conv", "place", "seg", initial.alias("initial"), kind.alias("kind"), fault.alias("fault"))
    symbol = F.col("kind") * 3 + F.when(F.col("fault").isin(BLANK, DUPLICATE), 2).when(F.col("fault") == TRUNCATED, 1).otherwise(0)
    marked = cut(marked.withColumn("symbol", symbol.cast("int")))
    spanning = marked.groupBy("conv").agg(F.min("seg").alias("a"), F.max("seg").alias("b")).filter("a < b").select("conv")
    plan = _plan(marked, spanning)
    return cut(rows.drop("digest").join(marked.select("place", "fault"), "place").join(plan, "place"))


def _steps(planned: DataFrame) -> DataFrame:
    """One row an edit: (conv, place, step, edit, role, text, cost)."""
    out = planned.select("*", F.posexplode(F.expr("transform(sequence(0, length(edits) div 2 - 1), i -> substring(edits, 2 * i + 1, 2))")).alias("step", "code"))
    edit, given = F.substring("code", 1, 1), F.substring("code", 2, 1)
    cost = F.when(edit == "D", DELETE).when(edit == "I", INSERT).otherwise(F.when(edit == "R", REROLE).otherwise(0) + F.when(F.col("fault") == TRUNCATED, LEFT_TRUNCATED).otherwise(0))
    role = F.when(given == "u", "user").when(given == "a", "assistant").otherwise(F.col("role"))
    return out.select("conv", "place", "step", edit.alias("edit"), role.alias("role"), F.when(edit == "I", "").otherwise(F.col("text")).alias("text"), cost.alias("cost"))


def repaired_rows(conversations: DataFrame, **options) -> DataFrame:
    """The edits that repair conversations (conv_id, turn, role, text), one row each in order of place and step: edit K, R, D or I, the role after
    it and the text; rows with edit D are those to leave out. conv is "=" and the id, or empty for a null id. See repair_report."""
    return _steps(planned_rows(conversations, **options)).drop("cost")


def _digests(batches):
    """Audit, cost and digest of each conversation from its edits in order; a conversation is one stream, of which a batch is held at a time."""
    at, audit, cost, sha, started = None, [], 0, None, False

    def row():
        return pa.RecordBatch.from_arrays([pa.array([at]), pa.array(["".join(audit)]), pa.array([cost], pa.int64()), pa.array([sha.hexdigest()])], ["conv", "audit", "cost", "repaired_sha256"])

    for b in batches:
        for conv, edit, role, text, c in zip(*(b.column(k).to_pylist() for k in range(5))):
            if conv != at:
                if at is not None:
                    yield row()
                at, audit, cost, sha, started = conv, [], 0, hashlib.sha256(), False
            audit.append(edit)
            cost += c
            if edit != "D":
                sha.update((("\n" if started else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                started = True
    if at is not None:
        yield row()


def repair_report(conversations: DataFrame, ids: DataFrame | None = None, **options) -> DataFrame:
    """One row a conversation: its faults, and the cheapest edits that give role initials (s?(ua)+)?, ties broken by the ASCII-least audit.

    (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256). Keep costs 0, giving a row another role 1, deleting 2
    and required of blank and duplicate rows, inserting an empty turn 5; a truncated row that stays adds 5.

    Rows stand by turn, null turns first, then by role and a digest of the text. Null roles and texts are one space. A null conv_id is a
    conversation of its own. ids: a table whose conv_id values are all to be reported, those without rows with zeros, an empty audit and the
    digest of the empty string; default those of conversations. gaps counts the turns missing between the least and the largest, null turns aside.
    Conversations of any length are worked in segments; the digest alone is one stream per conversation, as it is one value of all
    its text in order. Empty tables give no rows. Further columns are not read.
    """
    planned = planned_rows(conversations, **options)
    count = lambda k: F.sum((F.col("fault") == k).cast("long"))
    stats = planned.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        count(BLANK).alias("blank"), count(DUPLICATE).alias("duplicate"), count(TRUNCATED).alias("truncated"), F.sum("illegal").cast("long").alias("illegal"),
    )
    steps = _steps(planned).select("conv", "edit", "role", "text", "cost", "place", "step")
    digests = steps.repartition("conv").sortWithinPartitions("conv", "place", "step").mapInArrow(_digests, "conv string, audit string, cost long, repaired_sha256 string")
    every = (conversations if ids is None else ids).select("conv_id").distinct().withColumn("conv", _key(F.col("conv_id")))
    out = every.join(stats, "conv", "left").join(digests, "conv", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with the faults that a row's crc32 of conv_id:turn (null: one space), modulo 20, says: 0 drops the row, 1 empties its text,
    2 takes its .!? away, 3 repeats it, 4 makes its role user."""
    kind = F.crc32(F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c else F.lit(":") for c in ("conv_id", "", "turn")])) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    rows = conversations.filter(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"), kind.alias("kind"))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")
