"""Evaluation queries: joins of gold and predictions, metrics, curves, tables, intervals, resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import stats
from quillstone.operators import resample
from quillstone.plans.views import run_sql, with_views
from quillstone.session import cut

QUERIES: dict = {}
ORACLES: dict = {}


def both(name: str, body: str) -> None:
    """A query whose SQL is standard enough for Spark and the oracle alike."""
    QUERIES[name] = lambda spark, d, body=body: run_sql(spark, d, body)
    ORACLES[name] = with_views(body, duck=True)


def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = with_views(oracle, duck=True)
        return fn

    return add


_LABELS = "labels3 AS (SELECT 'major' AS l UNION ALL SELECT 'other' UNION ALL SELECT 'rare'), models AS (SELECT 'majority' AS model UNION ALL SELECT 'keyword' UNION ALL SELECT 'length')"
_F1 = """cells AS (
  SELECT s.model, t.l, CAST(sum(CASE WHEN s.label = t.l AND s.predicted = t.l THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN s.label <> t.l AND s.predicted = t.l THEN 1 ELSE 0 END) AS BIGINT) AS fp,
    CAST(sum(CASE WHEN s.label = t.l AND s.predicted <> t.l THEN 1 ELSE 0 END) AS BIGINT) AS fn FROM scored s CROSS JOIN labels3 t GROUP BY s.model, t.l),
f1 AS (SELECT *, coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0.0) AS pr, coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0.0) AS rc, coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0.0) AS f FROM cells)"""

#: Predictions as they come: the keyword model matches nothing on every 13th row, the length model fails on every 17th, and its answers to every 5th are revised.
_ANSWERS = """answers AS (
  SELECT model, doc_id, CASE WHEN model = 'keyword' AND doc_id % 13 = 0 THEN '미분류' ELSE predicted END AS predicted, CASE WHEN model = 'length' AND doc_id % 17 = 0 THEN 'timeout' END AS error,
    CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id % 3 <> 0 END AS evidence_grounded, 0 AS seq FROM pred
  UNION ALL SELECT model, doc_id, 'major', NULL, true, 1 FROM pred WHERE model = 'length' AND doc_id % 5 = 0)"""


@query(
    f"""WITH {_ANSWERS}, final AS (SELECT * FROM answers QUALIFY row_number() OVER (PARTITION BY model, doc_id ORDER BY seq DESC) = 1),
    m AS (SELECT m.model, g.doc_id, g.label, f.predicted, f.doc_id IS NOT NULL AS here, f.error, f.evidence_grounded, f.doc_id IS NOT NULL AND f.error IS NULL AND f.predicted <> '미분류' AS scored
      FROM gold g CROSS JOIN (SELECT DISTINCT model FROM pred) m LEFT JOIN final f ON f.doc_id = g.doc_id AND f.model = m.model),
    l AS (SELECT model, l, count(*) FILTER (label = l AND predicted = l) AS tp, count(*) FILTER (label = l) AS n, count(*) FILTER (predicted = l) AS k FROM m, (SELECT unnest(['major', 'other', 'rare']) AS l) WHERE scored GROUP BY ALL),
    f AS (SELECT model, avg(2e0 * tp / (n + k)) FILTER (n > 0) AS macro_f1 FROM l GROUP BY model)
    SELECT m.model, count(*) AS gold_size, count(*) FILTER (here) AS matched, count(*) FILTER (NOT here) AS missing, count(*) FILTER (predicted = '미분류') AS "unknown", count(*) FILTER (here AND error IS NOT NULL) AS errors,
      count(*) FILTER (scored) AS n_scored, round(count(*) FILTER (scored) / count(*)::DOUBLE, 6) AS coverage, round(count(*) FILTER (scored AND predicted = label) / count(*) FILTER (scored)::DOUBLE, 6) AS accuracy,
      round(any_value(f.macro_f1), 6) AS macro_f1, count(*) FILTER (scored AND evidence_grounded = false) AS ungrounded FROM m JOIN f ON f.model = m.model GROUP BY m.model"""
)
def j1_a4_harness(spark, d):
    """Each model against gold: matched, missing, unknown and errored, and the metrics of what is left."""
    from quillstone.operators.harness import harness

    answers = run_sql(spark, d, f"WITH {_ANSWERS} SELECT * FROM answers")
    out = harness(run_sql(spark, d, "SELECT doc_id, label FROM gold"), answers, ["major", "other", "rare"], order="seq")
    return out.withColumns({c: F.round(c, 6) for c in ("coverage", "accuracy", "macro_f1")})


both("j2_common_keys", "SELECT doc_id, count(DISTINCT model) AS models FROM pred GROUP BY doc_id HAVING count(DISTINCT model) = 3")
both("j3_semi_dev", "SELECT d.doc_id, d.source FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM dev)")
both(
    "j6_lookup",
    """WITH v AS (SELECT event_id, CASE WHEN value >= 0.6 THEN 'trust' WHEN value >= 0.15 THEN 'middle' ELSE 'doubt' END AS band, event_type = 'purchase' AS wrong FROM events),
    risk AS (SELECT band, avg(CASE WHEN wrong THEN 1e0 ELSE 0e0 END) AS risk FROM v WHERE band <> 'doubt' GROUP BY band), overall AS (SELECT avg(CASE WHEN wrong THEN 1e0 ELSE 0e0 END) AS risk FROM v)
    SELECT v.event_id, v.band, round(coalesce(r.risk, o.risk), 6) AS risk FROM v CROSS JOIN overall o LEFT JOIN risk r ON v.band = r.band""",
)
both(
    "j9_w16_integrity",
    """SELECT (SELECT count(*) FROM dev WHERE doc_id IN (SELECT doc_id FROM test)) AS overlap, (SELECT count(*) FROM (SELECT doc_id FROM dev UNION SELECT doc_id FROM test) u) AS together,
    (SELECT count(*) FROM (SELECT doc_id FROM gold EXCEPT (SELECT doc_id FROM dev UNION SELECT doc_id FROM test)) x) AS lost, (SELECT count(*) FROM (SELECT text FROM gold GROUP BY text HAVING count(*) > 1) c) AS shared_texts,
    (SELECT count(*) FROM gold WHERE text IS NULL OR text = '') AS empty_texts, (SELECT count(*) - count(DISTINCT doc_id) FROM gold) AS duplicate_rows,
    (SELECT count(*) FROM (SELECT lang, source, length(text) AS n FROM test GROUP BY lang, source, length(text) HAVING count(*) > 1) c) AS triple_collisions, (SELECT count(*) FROM test WHERE text LIKE '%idiot%' OR text LIKE '%stupid%') AS masked_rows,
    (SELECT count(*) FROM (SELECT doc_id FROM dev INTERSECT SELECT doc_id FROM test) x) AS seen_in_both""",
)
both(
    "a1_base_rates",
    f"""WITH {_LABELS}, s AS (SELECT coalesce(source, '미분류') AS sector, label FROM gold UNION ALL SELECT '*', label FROM gold), n AS (SELECT sector, count(*) AS n FROM s GROUP BY sector)
    SELECT n.sector, t.l AS label, n.n, round(count(s.label) / CAST(n.n AS DOUBLE), 6) AS rate, n.n >= 5 AS reliable FROM n CROSS JOIN labels3 t LEFT JOIN s ON s.sector = n.sector AND s.label = t.l GROUP BY n.sector, t.l, n.n""",
)
both(
    "a2_w15_mode",
    "WITH c AS (SELECT source, label, count(*) AS n, min(doc_id) AS first_id FROM gold GROUP BY source, label), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, first_id) AS k FROM c) SELECT source, label, n FROM r WHERE k = 1",
)
both("a3_label_prf", f"WITH {_LABELS}, {_F1} SELECT model, l AS label, round(pr, 6) AS precision_, round(rc, 6) AS recall, round(f, 6) AS f1, tp + fn AS support FROM f1")
both(
    "a31_leaderboard",
    f"""WITH {_LABELS}, {_F1}, m AS (SELECT model, round(avg(CASE WHEN tp + fn > 0 THEN f END), 6) AS macro_f1 FROM f1 GROUP BY model), s AS (SELECT model, count(*) AS n_scored, avg(CASE WHEN label = predicted THEN 1e0 ELSE 0e0 END) AS acc FROM scored GROUP BY model)
    SELECT s.model, s.n_scored, round(s.n_scored / CAST((SELECT count(*) FROM gold) AS DOUBLE), 6) AS coverage, round(s.acc, 6) AS accuracy, m.macro_f1, s.n_scored = (SELECT count(*) FROM gold) AS complete FROM s JOIN m ON s.model = m.model""",
)
both(
    "a32_completeness",
    f"WITH {_LABELS} SELECT m.model, count(*) AS absent FROM gold g CROSS JOIN models m WHERE NOT EXISTS (SELECT 1 FROM pred p WHERE p.doc_id = g.doc_id AND p.model = m.model) GROUP BY m.model",
)
both(
    "a5_confusions",
    "WITH c AS (SELECT model, label, predicted, count(*) AS n FROM scored WHERE label <> predicted GROUP BY model, label, predicted), r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY n DESC, label, predicted) AS k FROM c) SELECT model, label, predicted, n FROM r WHERE k <= 8",
)
both(
    "a6_ungrounded",
    "SELECT s.model, CAST(sum(CASE WHEN (CASE WHEN b.item_id IS NULL THEN NULL ELSE strpos_(g.text, b.text) END) = false THEN 1 ELSE 0 END) AS BIGINT) AS ungrounded FROM scored s JOIN gold g ON s.doc_id = g.doc_id LEFT JOIN benchmark b ON b.item_id = s.doc_id GROUP BY s.model".replace(
        "strpos_(g.text, b.text)", "(position(b.text IN g.text) > 0)"
    ),
)
_POINTS = f"""WITH {_LABELS}, ranks AS (SELECT 3 AS r UNION ALL SELECT 2 UNION ALL SELECT 1 UNION ALL SELECT 0),
  acc AS (SELECT s.model, k.r, s.label, s.predicted FROM scored s JOIN ranks k ON s.rnk >= k.r WHERE k.r IN (SELECT x.rnk FROM scored x WHERE x.model = s.model)),
  n AS (SELECT model, count(*) AS total FROM scored GROUP BY model),
  c AS (SELECT a.model, a.r, t.l, sum(CASE WHEN a.label = t.l AND a.predicted = t.l THEN 1e0 ELSE 0e0 END) AS tp, sum(CASE WHEN a.label <> t.l AND a.predicted = t.l THEN 1e0 ELSE 0e0 END) AS fp, sum(CASE WHEN a.label = t.l AND a.predicted <> t.l THEN 1e0 ELSE 0e0 END) AS fn
    FROM acc a CROSS JOIN labels3 t GROUP BY a.model, a.r, t.l),
  f AS (SELECT model, r, avg(CASE WHEN tp + fn > 0 THEN coalesce(CAST(2 * tp AS DOUBLE) / CAST(nullif(2 * tp + fp + fn, 0) AS DOUBLE), 0.0) END) AS macro_f1 FROM c GROUP BY model, r),
  p AS (SELECT a.model, a.r, count(*) AS n, count(*) / CAST(max(n.total) AS DOUBLE) AS coverage, avg(CASE WHEN a.label = a.predicted THEN 0e0 ELSE 1e0 END) AS risk FROM acc a JOIN n ON a.model = n.model GROUP BY a.model, a.r),
  points AS (SELECT p.model, p.r, p.n, CAST(p.coverage AS DOUBLE) AS coverage, CAST(p.risk AS DOUBLE) AS risk, f.macro_f1 FROM p JOIN f ON p.model = f.model AND p.r = f.r)"""
both("a7_operating_points", _POINTS + " SELECT model, r AS confidence_rank, n, round(coverage, 6) AS coverage, round(risk, 6) AS risk, round(1 - risk, 6) AS accuracy, round(macro_f1, 6) AS macro_f1 FROM points")
both(
    "a8_aurc",
    _POINTS
    + ", d AS (SELECT model, risk * (coverage - coalesce(lag(coverage) OVER (PARTITION BY model ORDER BY coverage), 0)) AS area, coverage FROM points) SELECT model, round(sum(area) / max(coverage), 6) AS aurc FROM d GROUP BY model",
)
both(
    "a9_closest_coverage",
    _POINTS
    + ", x AS (SELECT a.r, a.n AS n_a, b.n AS n_b, abs(a.coverage - b.coverage) AS gap, a.risk AS risk_a, b.risk AS risk_b, row_number() OVER (PARTITION BY a.r ORDER BY abs(a.coverage - b.coverage), b.n) AS k FROM points a CROSS JOIN points b WHERE a.model = 'keyword' AND b.model = 'length') SELECT DISTINCT n_a, n_b, round(gap, 6) AS gap, gap > 0.1 AS far, round(risk_a, 6) AS risk_a, round(risk_b, 6) AS risk_b FROM x WHERE k = 1",
)
@query(
    """WITH c AS (SELECT model, source, label, count(*) AS c, min(doc_id) AS first_doc FROM scored GROUP BY ALL),
    b AS (SELECT model, source, label AS base_label, c AS base_n FROM c QUALIFY row_number() OVER (PARTITION BY model, source ORDER BY c DESC, first_doc) = 1),
    a AS (SELECT model, source, count(*) AS n, count(*) FILTER (label = predicted) AS correct FROM scored GROUP BY ALL),
    l AS (SELECT model, source, l, count(*) FILTER (label = l AND predicted = l) AS tp, count(*) FILTER (label = l) AS n, count(*) FILTER (predicted = l) AS k FROM scored, (SELECT unnest(['major', 'other', 'rare']) AS l) GROUP BY ALL),
    f AS (SELECT model, source, coalesce(avg(2e0 * tp / (n + k)) FILTER (n > 0), 0) AS macro_f1 FROM l GROUP BY ALL)
    SELECT a.model, a.source, n, correct, round(correct / n::DOUBLE, 6) AS accuracy, base_label, base_n AS majority_correct, round(base_n / n::DOUBLE, 6) AS base, round(correct / n::DOUBLE - base_n / n::DOUBLE, 6) AS lift,
      round(CASE WHEN base_n < n THEN (correct / n::DOUBLE - base_n / n::DOUBLE) / (1 - base_n / n::DOUBLE) ELSE 0e0 END, 6) AS norm_lift, correct - base_n AS items_vs_majority, round(macro_f1, 6) AS macro_f1, n < 8 AS small, n >= 3 AS listed
    FROM a JOIN b USING (model, source) JOIN f USING (model, source)"""
)
def a10_sectors(spark, d):
    """Every model in every sector against the sector's most frequent label."""
    from quillstone.operators.harness import sector_table

    out = sector_table(run_sql(spark, d, "SELECT model, doc_id, source, label, predicted FROM scored"), ["major", "other", "rare"])
    return out.withColumns({c: F.round(c, 6) for c in ("accuracy", "base", "lift", "norm_lift", "macro_f1")})


both(
    "a11_sector_confidence",
    "SELECT model, source, CAST(sum(CASE WHEN rnk >= 2 THEN 1 ELSE 0 END) AS BIGINT) AS sure, CAST(sum(CASE WHEN rnk < 2 THEN 1 ELSE 0 END) AS BIGINT) AS unsure, round(avg(CASE WHEN rnk >= 2 THEN CASE WHEN label = predicted THEN 1e0 ELSE 0e0 END END), 6) AS acc_sure, round(avg(CASE WHEN rnk < 2 THEN CASE WHEN label = predicted THEN 1e0 ELSE 0e0 END END), 6) AS acc_unsure FROM scored GROUP BY model, source",
)
both(
    "a12_calibration",
    "WITH a AS (SELECT model, rnk, count(*) AS n, CAST(avg(CASE WHEN label = predicted THEN 1e0 ELSE 0e0 END) AS DOUBLE) AS acc FROM scored GROUP BY model, rnk), l AS (SELECT *, lag(acc) OVER (PARTITION BY model ORDER BY rnk DESC) AS above FROM a) SELECT model, count(*) AS levels, min(CASE WHEN above IS NULL OR acc <= above THEN 1 ELSE 0 END) = 1 AS monotone FROM l GROUP BY model",
)
both(
    "a13_acceptance",
    "SELECT s.model, k.name AS accepted, count(*) AS n, round(avg(CASE WHEN s.label = s.predicted THEN 1e0 ELSE 0e0 END), 6) AS accuracy FROM scored s JOIN (SELECT 'high' AS name, 3 AS r UNION ALL SELECT 'high+medium', 2 UNION ALL SELECT 'all', 0) k ON s.rnk >= k.r GROUP BY s.model, k.name",
)
both(
    "a14_exemplars",
    "WITH e AS (SELECT model, label, predicted, doc_id, count(*) OVER (PARTITION BY model, label, predicted) AS n, row_number() OVER (PARTITION BY model, label, predicted ORDER BY doc_id) AS k FROM scored WHERE label <> predicted), t AS (SELECT *, dense_rank() OVER (PARTITION BY model ORDER BY n DESC, label, predicted) AS top FROM e) SELECT model, label, predicted, n, doc_id FROM t WHERE top <= 2 AND k <= 3",
)
both(
    "a19_distribution",
    "SELECT 'label' AS kind, label AS value, count(*) AS n FROM gold GROUP BY label UNION ALL SELECT 'lang', coalesce(lang, '—'), count(*) FROM gold GROUP BY 2 UNION ALL SELECT 'source', coalesce(source, '—'), count(*) FROM gold GROUP BY 2",
)

_WILSON = """CASE WHEN n > 0 THEN greatest(0.0, (h / n + 1.9208 / n - 1.96 * sqrt(h / n * (1 - h / n) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n)) ELSE 0.0 END AS lo,
  CASE WHEN n > 0 THEN least(1.0, (h / n + 1.9208 / n + 1.96 * sqrt(h / n * (1 - h / n) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n)) ELSE 1.0 END AS hi"""


@query(
    f"""WITH c AS (SELECT model, source, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CASE WHEN label = predicted THEN 1 ELSE 0 END) AS DOUBLE) AS h FROM scored GROUP BY model, source), w AS (SELECT *, {_WILSON} FROM c)
    SELECT model, source, round(lo, 6) AS lo, round(hi, 6) AS hi, CASE WHEN lo > 0.7 THEN 'above' WHEN hi < 0.7 THEN 'below' ELSE 'undecided' END AS verdict FROM w"""
)
def w12_w13_wilson(spark, d):
    c = run_sql(spark, d, "SELECT model, source, label, predicted FROM scored").groupBy("model", "source").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("label") == F.col("predicted")).cast("int")).alias("h"))
    lo, hi = stats.wilson(F.col("h"), F.col("n"))
    return c.select("model", "source", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"), stats.verdict_against(lo, hi, 0.7).alias("verdict"))


_TESTS = "c AS (SELECT source, count(*) AS n, CAST(sum(CASE WHEN label = 'rare' THEN 1 ELSE 0 END) AS BIGINT) AS k FROM gold GROUP BY source), p AS (SELECT avg(CASE WHEN label = 'rare' THEN 1e0 ELSE 0e0 END) AS prior FROM gold)"


@query(
    f"""WITH {_TESTS}, t AS (SELECT c.source, c.n, c.k, CAST(p.prior AS DOUBLE) AS prior, unnest(range(c.k, c.n + 1)) AS i FROM c CROSS JOIN p),
    s AS (SELECT source, n, k, least(1.0, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(prior) + (n - i) * ln(1 - prior)))) AS tail FROM t GROUP BY source, n, k),
    r AS (SELECT *, least(1.0, tail * (count(*) OVER () - row_number() OVER (ORDER BY tail, source) + 1)) AS raw FROM s)
    SELECT source, n, k, round(tail, 6) AS p, round(max(raw) OVER (ORDER BY tail, source ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM r"""
)
def w8_w14_holm(spark, d):
    c = run_sql(spark, d, f"WITH {_TESTS} SELECT c.source, c.n, c.k, CAST(p.prior AS DOUBLE) AS prior FROM c CROSS JOIN p")
    c = c.withColumn("tail", stats.binomial_tail("k", "n", "prior"))
    return stats.holm(c, "tail", "source").select("source", "n", "k", F.round("tail", 6).alias("p"), F.round("p_holm", 6).alias("p_holm"))


_REACH = """WITH g AS (SELECT count(*) AS total FROM gold), r AS (SELECT label, count(*) / CAST((SELECT total FROM g) AS DOUBLE) AS share FROM gold GROUP BY label), m AS (SELECT model, count(*) AS n, sum(CASE WHEN label = predicted THEN 1 ELSE 0 END) AS k FROM scored GROUP BY model),
  s AS (SELECT model, label, count(*) AS n FROM scored GROUP BY model, label), e AS (SELECT m.model, r.label, m.n * r.share AS expected, coalesce(s.n, 0) AS n FROM m CROSS JOIN r LEFT JOIN s ON s.model = m.model AND s.label = r.label),
  sk AS (SELECT model, count(CASE WHEN expected >= 1 AND (n / expected >= 1.5 OR n / expected <= 0.67) THEN 1 END) AS skewed FROM e GROUP BY model)"""


@query(
    f"""{_REACH}, t AS (SELECT model, n AS denominator, CAST(unnest(range(0, n + 1)) AS DOUBLE) AS h, CAST(n AS DOUBLE) AS n FROM m), w AS (SELECT model, h, {_WILSON} FROM t),
    v AS (SELECT model, count(*) FILTER (lo > 0.7) > 0 AS can_exceed, count(*) FILTER (hi < 0.7) > 0 AS can_fall_short FROM w GROUP BY model),
    o AS (SELECT model, CAST(k AS DOUBLE) AS h, CAST(n AS DOUBLE) AS n FROM m), own AS (SELECT model, {_WILSON} FROM o)
    SELECT m.model, m.n AS sample, m.n < (SELECT total FROM g) AS partial_, sk.skewed, v.can_exceed, v.can_fall_short,
      CASE WHEN m.n < (SELECT total FROM g) OR sk.skewed > 0 OR NOT (v.can_exceed OR v.can_fall_short) THEN 'invalid' WHEN own.lo > 0.7 THEN 'above' WHEN own.hi < 0.7 THEN 'below' ELSE 'undecided' END AS verdict
    FROM m JOIN sk USING (model) JOIN v USING (model) JOIN own USING (model)"""
)
def w17_validity(spark, d):
    """Whether each model's accuracy may be judged against 0.7 at all: a whole sample, like its population, whose size allows a verdict.

    The lower bound rises and the upper bound falls with the hits, so the ends 0 and n say which verdicts any number of hits could reach.
    """
    rows = run_sql(spark, d, _REACH + " SELECT m.model, m.n, CAST(m.k AS BIGINT) AS k, (SELECT total FROM g) AS total, sk.skewed FROM m JOIN sk ON m.model = sk.model")
    lo, hi = stats.wilson(F.col("k"), F.col("n"))
    up, down = stats.wilson(F.col("n"), F.col("n"))[0] > 0.7, stats.wilson(F.lit(0), F.col("n"))[1] < 0.7
    bad = (F.col("n") < F.col("total")) | (F.col("skewed") > 0) | ~(up | down)
    return rows.select("model", F.col("n").alias("sample"), (F.col("n") < F.col("total")).alias("partial_"), "skewed", up.alias("can_exceed"), down.alias("can_fall_short"), F.when(bad, "invalid").otherwise(stats.verdict_against(lo, hi, 0.7)).alias("verdict"))


# --- resampling: draws are a fixed mix of (round, draw), so both engines and all models see the same ones
MODELS, LABELS = ["keyword", "length", "majority"], ["major", "other", "rare"]


def _cells(spark, d):
    return cut(resample.joint_cells(run_sql(spark, d, "SELECT doc_id, model, label, predicted, rnk FROM scored"), MODELS))


def _outcomes(spark, d, rounds: int, cells=None, draw=resample.resampled):
    """(r, label, predicted, rnk, k): each round's cells with their outcomes."""
    cells = _cells(spark, d) if cells is None else cells
    return draw(cells, rounds).join(F.broadcast(cells.drop("k", "begins")), "cell")  # cells are few


def _draws_sql(rounds: int) -> str:
    """The oracle's cells, and every single draw by the same mix of numbers, each looked up among the cells."""
    mix = lambda h, f: f"(xor({h}, {h} >> 15) * {f}) % 2147483648"
    one = ", ".join(f"max(CASE WHEN model = '{m}' THEN {c} END) AS {c}_{m}" for m in MODELS for c in ("predicted", "rnk"))
    order = "label, " + ", ".join(f"{c}_{m}" for c in ("predicted", "rnk") for m in MODELS)
    return f"""joint AS (SELECT doc_id, label, {one} FROM scored GROUP BY doc_id, label HAVING count(DISTINCT model) = 3), cells0 AS (SELECT {order}, count(*) AS k FROM joint GROUP BY ALL),
    cells AS (SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS cell, sum(k) OVER (ORDER BY {order}) - k AS lo, sum(k) OVER (ORDER BY {order}) AS hi FROM cells0), tot AS (SELECT sum(k) AS n FROM cells),
    d0 AS (SELECT r, CAST((r * 40503 + i * 69069 + 12345) % 2147483648 AS BIGINT) AS h FROM (SELECT unnest(range({rounds})) AS r) CROSS JOIN (SELECT unnest(range((SELECT CAST(n AS BIGINT) FROM tot))) AS i)),
    d1 AS (SELECT r, {mix("h", 1274126177)} AS h FROM d0), d2 AS (SELECT r, {mix("h", 1812433253)} AS h FROM d1), d3 AS (SELECT r, {mix("h", 747796405)} AS h FROM d2),
    d4 AS (SELECT r, CAST(h * (SELECT CAST(n AS BIGINT) FROM tot) >> 31 AS BIGINT) AS pos, count(*) AS m FROM d3 GROUP BY ALL),
    drawn AS (SELECT d.r, c.cell, sum(d.m) AS k FROM d4 d JOIN cells c ON d.pos >= c.lo AND d.pos < c.hi GROUP BY ALL),
    said AS ({" UNION ALL ".join(f"SELECT d.r, '{m}' AS model, c.label, c.predicted_{m} AS predicted, c.rnk_{m} AS rnk, d.k FROM drawn d JOIN cells c ON d.cell = c.cell" for m in MODELS)})"""


_F1_SQL = """, cl AS (SELECT r, model, l, sum(k) FILTER (label = l AND predicted = l) AS tp, sum(k) FILTER (label <> l AND predicted = l) AS fp, sum(k) FILTER (label = l AND predicted <> l) AS fn
      FROM said CROSS JOIN (SELECT unnest(['major', 'other', 'rare']) AS l) GROUP BY r, model, l),
    sc AS (SELECT r, model, avg(2 * coalesce(tp, 0) / CAST(2 * coalesce(tp, 0) + coalesce(fp, 0) + coalesce(fn, 0) AS DOUBLE)) FILTER (coalesce(tp, 0) + coalesce(fn, 0) > 0) AS f FROM cl GROUP BY r, model)"""
_AREA_SQL = """, lv AS (SELECT r, model, rnk, sum(k) AS n, sum(CASE WHEN label <> predicted THEN k ELSE 0 END) AS bad FROM said GROUP BY ALL),
    cu AS (SELECT r, model, n, sum(n) OVER w AS cn, sum(bad) OVER w AS cb, sum(n) OVER (PARTITION BY r, model) AS tot FROM lv WINDOW w AS (PARTITION BY r, model ORDER BY rnk DESC)),
    sc AS (SELECT r, model, sum(CAST(cb AS DOUBLE) / cn * n / tot) AS f FROM cu GROUP BY r, model)"""


def _ends(rounds: int, value: str) -> str:
    return f"round(max(CASE WHEN k = {int(0.025 * rounds)} THEN {value} END), 6) AS lo, round(max(CASE WHEN k = {int(0.975 * rounds) - 1} THEN {value} END), 6) AS hi"


def _pairs_sql(rounds: int) -> str:
    return f""", df AS (SELECT a.r, a.model AS m1, b.model AS m2, round(a.f - b.f, 12) AS diff FROM sc a JOIN sc b ON a.r = b.r AND a.model < b.model),
    o AS (SELECT *, row_number() OVER (PARTITION BY m1, m2 ORDER BY diff) - 1 AS k FROM df),
    t AS (SELECT m1, m2, {_ends(rounds, "diff")}, avg(CASE WHEN diff <= 0 THEN 1e0 ELSE 0e0 END) AS w FROM o GROUP BY m1, m2), u AS (SELECT *, 2 * least(w, 1 - w) AS p FROM t),
    h AS (SELECT *, least(1.0, p * (count(*) OVER () - row_number() OVER (ORDER BY p, m1, m2) + 1)) AS raw FROM u)
    SELECT m1, m2, lo, hi, round(p, 6) AS p, round(max(raw) OVER (ORDER BY p, m1, m2 ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM h"""


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(f"WITH {_draws_sql(resample.PAIRED_ROUNDS)}{_F1_SQL}{_pairs_sql(resample.PAIRED_ROUNDS)}")
def w9_paired_bootstrap(spark, d):
    scores = resample.macro_f1(_outcomes(spark, d, resample.PAIRED_ROUNDS), MODELS, LABELS)
    return _rounded(resample.differences(scores, resample.PAIRED_ROUNDS))


@query(f"WITH {_draws_sql(resample.INTERVAL_ROUNDS)}{_F1_SQL}, o AS (SELECT model, f, row_number() OVER (PARTITION BY model ORDER BY f) - 1 AS k FROM sc) SELECT model, {_ends(resample.INTERVAL_ROUNDS, 'f')} FROM o GROUP BY model")
def w10_bootstrap_ci(spark, d):
    cells = _cells(spark, d)
    scores = resample.macro_f1(_outcomes(spark, d, resample.INTERVAL_ROUNDS, cells), MODELS, LABELS)
    return _rounded(resample.intervals(scores, resample.INTERVAL_ROUNDS, cells.agg(F.sum("k")).first()[0] or 0))


@query(f"WITH {_draws_sql(resample.AREA_ROUNDS)}{_AREA_SQL}{_pairs_sql(resample.AREA_ROUNDS)}")
def w11_aurc_bootstrap(spark, d):
    scores = resample.risk_areas(_outcomes(spark, d, resample.AREA_ROUNDS), MODELS)
    return _rounded(resample.differences(scores, resample.AREA_ROUNDS))


@query()
def w9_w10_w11_from_cells(spark, d):
    """Paired differences of macro-F1 and of the risk-coverage area, with intervals, drawn from cell counts by conditional binomials."""
    cells = _cells(spark, d)
    f = resample.macro_f1(_outcomes(spark, d, resample.PAIRED_ROUNDS, cells, resample.resampled_cells), MODELS, LABELS)
    area = resample.risk_areas(_outcomes(spark, d, resample.AREA_ROUNDS, cells, resample.resampled_cells), MODELS)
    parts = [resample.differences(scores, rounds).select(F.lit(name).alias("metric"), "*") for name, scores, rounds in (("macro_f1", f, resample.PAIRED_ROUNDS), ("aurc", area, resample.AREA_ROUNDS))]
    return _rounded(parts[0].unionByName(parts[1]))
