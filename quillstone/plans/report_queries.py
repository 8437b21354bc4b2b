"""Queries of the report cross-check and of the probes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.operators import probes, reports
from quillstone.plans.views import run_sql, with_views
from quillstone.session import cut, read_table

QUERIES: dict = {}
ORACLES: dict = {}

_TAG = "SPACING"
_STALE_COUNT = "documents in all"


def _figures(spark, d):
    """(id, item, diff, chars, verdict): for each document its share of spaces against 0.150, in thousandths, and what that says; id is its report."""
    text = F.coalesce("text", F.lit(""))
    n, spaces = F.char_length(text).cast("long"), F.char_length(F.regexp_replace(text, "[^ ]", "")).cast("long")
    x = read_table(spark, d, "documents").select(F.expr("doc_id div 50").alias("id"), F.col("doc_id").alias("item"), n.alias("chars"), spaces.alias("spaces"))
    x = x.withColumn("milli", F.coalesce(F.expr("(2000 * spaces + chars) div nullif(2 * chars, 0)"), F.lit(0)))
    verdict = F.when(F.col("milli") >= 180, "**wide**").when(F.col("milli") >= 140, "even").otherwise("tight")
    return x.select("id", "item", ((F.col("milli") - 150) / F.lit(1000).cast("decimal(4,0)")).cast("decimal(10,3)").alias("diff"), "chars", verdict.alias("verdict"))


def _written(figures):
    """(id, text): a report of 50 documents, into which staleness is put: old differences, verdicts and rows, rows of gone documents, one count of two."""
    item = F.col("item")
    diff = reports.signed(3)(F.col("diff") + F.when(item % 13 == 0, F.lit(0.001)).otherwise(0).cast("decimal(4,3)"))
    line = lambda key, verdict: F.format_string("| %d − base | %s | %d | %s |", key, diff, F.col("chars"), verdict)
    own = F.when(item % 17 != 0, line(item, F.when(item % 19 == 0, "even").otherwise(F.col("verdict"))))
    gone = F.when(item % 23 == 0, line(item + 10**9, F.col("verdict")))
    rows = figures.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("item", F.array_compact(F.array(own, gone)).alias("lines")))).alias("rows"))
    body = F.array_join(F.flatten(F.transform("rows", lambda r: r["lines"])), "\n")
    stale = F.col("n") + F.when(F.col("id") % 3 == 0, 2000).otherwise(0)
    count = lambda c: F.format_string("%,d", c)
    text = F.concat(
        F.lit("# Spacing\n\nOf "), count(F.col("n")), F.lit(f" {_STALE_COUNT}, 58 of other kinds.\n\n<!-- {_TAG}:{reports.OPENS} -->\n| document | difference | characters | verdict |\n|-|-|-|-|\n"), body,
        F.lit(f"\n<!-- {_TAG}:{reports.CLOSES} -->\n\n| 1 − base | +9.999 | 1 | outside |\n\nAgain: "), count(stale), F.lit(f" {_STALE_COUNT}.\n"),
    )
    return rows.select("id", text.alias("text"))


_MILLI = "coalesce((2000 * (length(t) - length(replace(t, ' ', ''))) + length(t)) // nullif(2 * length(t), 0), 0)"


def report_crosscheck(spark, d):
    """Reports written from the documents and gone stale by rule, read back and held against what they restate: every mismatch, and every stale count."""
    figures = cut(_figures(spark, d))
    written = cut(_written(figures))
    cells = reports.table_rows(written, _TAG)
    key = F.regexp_extract(F.col("cells")[0], r"^(\d+) − base$", 1)
    claimed = cells.filter(key != "").select("id", key.cast("long").alias("item"), *[F.col("cells")[i].alias(c) for i, c in enumerate(("diff", "chars", "verdict"), 1)])
    plain = lambda c: c.cast("string")
    rows = reports.reconcile(claimed, figures, ["id", "item"], {"diff": reports.signed(3), "chars": plain, "verdict": plain})
    truth = figures.groupBy("id").agg(F.count(F.lit(1)).alias("value")).withColumn("unit", F.lit("documents"))
    counts = reports.restatements(written, [("documents", rf"([\d,]+) {_STALE_COUNT}")], truth).filter("not agrees")
    counts = counts.select("id", F.col("nth").cast("long").alias("item"), F.col("unit").alias("field"), F.col("claimed").cast("string").alias("claimed"), F.col("actual").cast("string").alias("actual"), F.lit("restated").alias("kind"))
    return rows.unionByName(counts).withColumnRenamed("id", "report")


QUERIES["report_crosscheck"] = report_crosscheck
ORACLES["report_crosscheck"] = f"""WITH x AS (SELECT doc_id, doc_id // 50 AS report, coalesce(text, '') AS t FROM documents), m AS (SELECT doc_id, report, {_MILLI} AS milli FROM x),
  v AS (SELECT *, CASE WHEN milli >= 180 THEN '**wide**' WHEN milli >= 140 THEN 'even' ELSE 'tight' END AS verdict FROM m), n AS (SELECT report, count(*) AS n FROM m GROUP BY report)
  SELECT report, doc_id AS item, 'row' AS field, NULL AS claimed, NULL AS actual, 'missing' AS kind FROM v WHERE doc_id % 17 = 0
  UNION ALL SELECT report, doc_id, 'diff', printf('%+.3f', (milli - 149) / 1000e0), printf('%+.3f', (milli - 150) / 1000e0), 'differs' FROM v WHERE doc_id % 13 = 0 AND doc_id % 17 <> 0
  UNION ALL SELECT report, doc_id, 'verdict', 'even', verdict, 'differs' FROM v WHERE doc_id % 19 = 0 AND doc_id % 17 <> 0 AND verdict <> 'even'
  UNION ALL SELECT report, doc_id + 1000000000, 'row', NULL, NULL, 'unknown' FROM v WHERE doc_id % 23 = 0
  UNION ALL SELECT report, 1, 'documents', CAST(n + 2000 AS VARCHAR), CAST(n AS VARCHAR), 'restated' FROM n WHERE report % 3 = 0"""

#: Invariants of the tables and of the views made from them; some do not hold on purpose of the data.
PROBES = [
    probes.Probe("document ids are distinct", "ids", "c > 1"),
    probes.Probe("every document has a text", "texts", "text IS NULL OR trim(text) = ''"),
    probes.Probe("recorded sizes are the texts'", "texts", "n_chars <> length(text)"),
    probes.Probe("labels meet documents", "labelled", "text_id IS NULL"),
    probes.Probe("labels are of the scheme", "answers", "label NOT IN ('major', 'other', 'rare')"),
    probes.Probe("answers are of the scheme", "answers", "predicted IS NULL OR predicted NOT IN ('major', 'other', 'rare')"),
    probes.Probe("ranks stand for confidences", "answers", "(confidence = 'high') <> (rnk = 3) OR rnk < 1"),
    probes.Probe("one answer a model and document", "said", "c > 1"),
    probes.Probe("models answer one sample", "covered", "c < n"),
    probes.Probe("no document is in both parts", "parts", "c > 1"),
    probes.Probe("roles are known", "turns", "role IS NULL OR role NOT IN ('system', 'user', 'assistant')"),
    probes.Probe("turns are one a place", "places", "c > 1"),
]
FRAMES = {
    "ids": "SELECT doc_id, count(*) AS c FROM documents GROUP BY doc_id",
    "texts": "SELECT text, n_chars FROM documents",
    "labelled": "SELECT l.doc_id, d.doc_id AS text_id FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id",
    "answers": "SELECT label, predicted, confidence, rnk FROM scored",
    "said": "SELECT model, doc_id, count(*) AS c FROM pred GROUP BY model, doc_id",
    "covered": "SELECT p.model, count(*) AS c, max(g.n) AS n FROM pred p CROSS JOIN (SELECT count(*) AS n FROM gold) g GROUP BY p.model",
    "parts": "SELECT doc_id, count(*) AS c FROM (SELECT doc_id FROM dev UNION ALL SELECT doc_id FROM test) u GROUP BY doc_id",
    "turns": "SELECT role FROM conversations",
    "places": "SELECT conv_id, turn, count(*) AS c FROM conversations GROUP BY conv_id, turn",
}


def core_probes(spark, d):
    """The invariants of PROBES over whole tables: rows seen, rows failing, and whether each holds."""
    frames = {name: (lambda body=body: run_sql(spark, d, body)) for name, body in FRAMES.items()}
    return probes.run_probes(spark, PROBES, frames).drop("detail")


QUERIES["core_probes"] = core_probes
ORACLES["core_probes"] = with_views(
    " UNION ALL ".join(f"SELECT '{p.name.replace(chr(39), chr(39) * 2)}' AS probe, true AS ran, count(*) AS \"rows\", count(CASE WHEN {p.failing} THEN 1 END) AS failing, count(CASE WHEN {p.failing} THEN 1 END) = 0 AS passed FROM ({FRAMES[p.frame]}) f_{i}" for i, p in enumerate(PROBES)),
    duck=True,
)
