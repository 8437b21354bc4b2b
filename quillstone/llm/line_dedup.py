"""Line dedup: a suffix array over line ids by distributed prefix doubling, and the repeated runs its LCP intervals show."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import WORD, hot_join, keyed_rows
from quillstone.session import cut


def _ranked(windows: DataFrame, *keys: str) -> DataFrame:
    """windows (doc, i, *keys) with rank r: equal keys, equal rank; ranks in the order of the keys; keys of one window only go.

    Counts are taken map-side; only distinct repeated keys are sorted, so a key of any frequency is one row there, and the
    ranks of very frequent keys (a blank line) are broadcast to their windows.
    """
    names = windows.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    names = cut(names.orderBy(*keys).select(*keys, "c", F.monotonically_increasing_id().alias("r")))
    return hot_join(windows, names, list(keys), "c", names.agg(F.sum("c")).first()[0] or 0).select("doc", "i", "r")


def repeated_runs(lines: DataFrame, levels_out: list | None = None) -> DataFrame:
    """(doc, i, run): for every position of lines (doc, i, line) the longest run of lines from it that occurs at an earlier position.

    Prefix doubling: the rank of the window of 2^(k+1) lines at i comes from the ranks of the windows of 2^k lines at i and
    i + 2^k. Windows that occur once have no rank and drop out, so each level holds repeated runs only; doubling ends when
    none is left. Suffixes sharing a prefix are an LCP interval. Descending the levels, each interval is split by the rank of the next 2^k lines:
    members that are not the first of their part go on with it, and its first stays and also attends the part as a
    guest, so that every earlier occurrence is represented; each position ends with its longest earlier match.
    Positions order by doc, then line number. Positions without an earlier match are absent.
    """
    levels = [cut(_ranked(lines.select("doc", "i", "line"), "line"))]
    while True:
        half, step = levels[-1], 1 << (len(levels) - 1)
        after = half.select("doc", (F.col("i") - step).cast("int").alias("i"), F.col("r").alias("r2"))
        both = half.join(after, ["doc", "i"])
        top = cut(_ranked(both.withColumnRenamed("r", "r1"), "r1", "r2"))
        if top.isEmpty():
            break
        levels.append(top)
    if levels_out is not None:
        levels_out += levels
    # a membership: position (doc, i) in the interval g of suffixes sharing the first m lines
    state = levels[-1].select("doc", "i", F.lit(0).alias("m"), F.lit("").alias("g"), F.lit(False).alias("guest")).limit(0)
    start = None
    for k in range(len(levels) - 1, -1, -1):
        step, rank = 1 << k, levels[k]
        fresh = rank.select("doc", "i", F.lit(0).alias("m"), F.lit("").alias("g"), F.lit(False).alias("guest"))
        if start is not None:
            fresh = fresh.join(start, ["doc", "i"], "left_anti")
        members = state.unionByName(fresh)
        at = rank.select("doc", F.col("i").alias("p"), "r")
        tried = members.withColumn("p", (F.col("i") + F.col("m")).cast("int")).join(at, ["doc", "p"]).select("doc", "i", "m", "g", "guest", "r")
        first = F.min(F.struct("doc", "i")).alias("f")
        parts = tried.groupBy("g", "m", "r").agg(first, F.count(F.lit(1)).alias("c")).filter("c > 1").select("g", "m", "r", "f", "c")
        tried, parts = cut(tried), cut(parts)
        moved = hot_join(tried, parts, ["g", "m", "r"], "c", parts.agg(F.sum("c")).first()[0] or 0)
        moved = cut(moved.withColumn("lead", (F.col("doc") == F.col("f.doc")) & (F.col("i") == F.col("f.i"))))
        onward = moved.select("doc", "i", (F.col("m") + step).alias("m"), F.md5(F.concat_ws(",", "g", "m", "r", F.lit(k))).alias("g"), (F.col("guest") | F.col("lead")).alias("guest"), "lead")
        # who stays behind in the old interval: all but those that moved on as proper members, and firsts
        left = moved.filter("not lead").select("doc", "i", "m", "g")
        stay = members.filter("m > 0").join(left, ["doc", "i", "m", "g"], "left_anti")
        state = cut(stay.unionByName(onward.drop("lead")))
        started = moved.filter("m = 0 and not lead").select("doc", "i")
        start = started if start is None else start.union(started)
    return state.filter("not guest").groupBy("doc", "i").agg(F.max("m").alias("run"))


def repeated_lines(rows: DataFrame, min_words: int = 10) -> DataFrame:
    """(doc, spans): for each row of rows (doc, text) with something to delete its ranges {from, a, b} of line numbers, in order and apart.

    Lines a up to b (exclusive) go; from is where the range before ended, so lines from up to a stay.
    """
    lines = rows.select("doc", F.posexplode(F.split("text", "\n")).alias("i", "raw"))
    lines = cut(lines.select("doc", "i", F.unhex(F.md5("raw")).alias("line"), F.regexp_count("raw", F.lit(WORD)).alias("w")))
    common = cut(lines.groupBy("line").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"))
    lines = cut(hot_join(lines, common, ["line"], "c", common.agg(F.sum("c")).first()[0] or 0).select("doc", "i", "line", "w"))
    runs = repeated_runs(lines)
    # words of a run from running sums over the document's repeated lines: a run holds no other lines
    own = Window.partitionBy("doc").orderBy("i")
    sums = lines.select("doc", "i", F.sum("w").over(own).alias("upto"), "w")
    ends = sums.select("doc", F.col("i").alias("e"), F.col("upto").alias("end"))
    runs = runs.withColumn("e", (F.col("i") + F.col("run") - 1).cast("int")).join(sums, ["doc", "i"]).join(ends, ["doc", "e"])
    runs = runs.filter(F.col("end") - F.col("upto") + F.col("w") >= min_words)
    # overlapping runs become one range, before anything is collected
    reach = F.max("e").over(own.rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("doc", "i", "e", F.coalesce((F.col("i") > reach + 1).cast("int"), F.lit(0)).alias("fresh"))
    ranges = runs.select("doc", "i", "e", F.sum("fresh").over(own).alias("k")).groupBy("doc", "k").agg(F.min("i").alias("a"), (F.max("e") + 1).alias("b"))
    ranges = ranges.select("doc", F.struct(F.coalesce(F.lag("b").over(Window.partitionBy("doc").orderBy("a")), F.lit(0)).alias("from"), "a", "b").alias("s"))
    return ranges.groupBy("doc").agg(F.sort_array(F.collect_list("s")).alias("spans"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 10) -> DataFrame:
    """One row per input row: id, n_lines, n_dropped, text without the dropped lines.

    A maximal run of lines that occurs at an earlier position (by id, then line number) and has at least min_words words is
    deleted; its first copy stays. A document may lose all its lines: its text is then empty. Rows that share an id come one after
    the other, those with equal hash of the text in any order; rows without an id come last.
    Null text counts as empty (one empty line, no words). An empty table gives an empty result; further columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    plain = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    rows = keyed_rows(plain, "id", id=F.col("id"), text=F.col("text"))
    if rows.schema["key"].dataType != rows.schema["id"].dataType:
        rows = rows.select("id", "text", F.struct("key.none", "key.id", F.xxhash64("text").alias("h"), "key.k").alias("doc"))
    else:
        rows = rows.select("id", "text", F.col("key").alias("doc"))
    spans = cut(repeated_lines(rows.select("doc", "text"), min_words))
    out = rows.hint("merge").join(spans, "doc", "left")  # spans grow with the corpus: no broadcast at any size
    lines = F.split("text", "\n")
    stay = F.flatten(F.transform("spans", lambda s: F.slice(lines, s["from"] + 1, s["a"] - s["from"])))
    rest = F.slice(lines, F.element_at("spans", -1)["b"] + 1, F.size(lines))
    kept = F.when(F.col("spans").isNotNull(), F.concat(stay, rest))
    out = out.select("id", "text", F.size(lines).alias("n_lines"), kept.alias("kept"))
    dropped = F.coalesce(F.col("n_lines") - F.size("kept"), F.lit(0))
    return out.select(F.col("id").alias(id_col), "n_lines", F.when(F.col("kept").isNull(), 0).otherwise(dropped).alias("n_dropped"), F.coalesce(F.array_join("kept", "\n"), F.col("text")).alias("text"))
