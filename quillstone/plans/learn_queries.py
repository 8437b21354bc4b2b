"""Queries of learners and audits: induced rules, criteria votes, leakage, spacing."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import stats
from quillstone.functions.text import squeeze
from quillstone.operators import base_rates, criteria, passages, spacing
from quillstone.operators import rules as R
from quillstone.operators.ngrams import char_grams
from quillstone.plans.views import run_sql, with_views
from quillstone.session import cut, read_table

QUERIES: dict = {}
ORACLES: dict = {}

_LABELS3 = "labels3 AS (SELECT 'major' AS label UNION ALL SELECT 'other' UNION ALL SELECT 'rare')"


def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = with_views(oracle, duck=True)
        return fn

    return add


def both(name: str, body: str, duck: str | None = None) -> None:
    QUERIES[name] = lambda spark, d, body=body: run_sql(spark, d, body)
    ORACLES[name] = with_views(duck or body, duck=True)


@query(
    "WITH i AS (SELECT 'length' AS kind, CASE WHEN length(regexp_replace(text, '\\s', '', 'g')) < 200 THEN 'short' WHEN length(regexp_replace(text, '\\s', '', 'g')) < 600 THEN 'medium' ELSE 'long' END AS value, doc_id, label FROM gold UNION ALL SELECT 'sector', source, doc_id, label FROM gold) SELECT kind, value, count(*) AS covered, round((greatest(count(*) FILTER (label = 'major'), count(*) FILTER (label = 'other'), count(*) FILTER (label = 'rare')) + 1) / CAST(count(*) + 3 AS DOUBLE), 6) AS laplace FROM i GROUP BY kind, value"
)
def r2_r6_atoms_laplace(spark, d):
    g = run_sql(spark, d, "SELECT doc_id, text, source, label FROM gold")
    held = R.incidence(g, sizes=()).join(g.select(F.col("doc_id").alias("doc"), "label"), "doc")
    return R._counted(held, ["kind", "value"], ["major", "other", "rare"]).select("kind", "value", "covered", F.round("laplace", 6).alias("laplace"))


@query()
def r1_r9_a21_induced_rules(spark, d):
    """Rules learned on dev, applied to test: the prediction and the rule that made it."""
    s = cut(run_sql(spark, d, "SELECT doc_id, text, source, label, pos FROM split"))
    rules, default = R.induce(s.filter("pos % 3 = 0"))
    return R.apply_rules(rules, default, s.filter("pos % 3 <> 0"))


@query()
def r9_a21_rule_transfer(spark, d):
    """Each rule learned on dev as it fares on test, first match wins; rules that never fire, the default and the whole list in rows of their own."""
    s = cut(run_sql(spark, d, "SELECT doc_id, text, source, label, pos FROM split"))
    rules, default = R.induce(s.filter("pos % 3 = 0"))
    return R.transfer(rules, default, s.filter("pos % 3 <> 0"))


@query()
def r7_rule_discards(spark, d):
    """Candidates that reached a beam on dev and fell below the least precision, with the order of the rule they stood for."""
    learned = R.induce_with_discards(cut(run_sql(spark, d, "SELECT doc_id, text, source, label FROM split WHERE pos % 3 = 0")))
    listed = [(r.order, " AND ".join(f"{kind}:{value}" for kind, value in sorted(r.atoms)), r.label, r.support, round(r.precision, 3)) for r in learned.dropped]
    return spark.createDataFrame(listed, "ord int, conditions string, label string, support long, precision_ double")


@query()
def r4_maximal_forms(spark, d):
    """The n-grams of a rule list learned on dev and the phrases they are pieces of."""
    dev = cut(run_sql(spark, d, "SELECT doc_id, text, source, label FROM split WHERE pos % 3 = 0"))
    rules, _ = R.induce(dev)
    forms = R.maximal_forms([v for r in rules for kind, v in r.atoms if kind == "ngram"], dev)
    return spark.createDataFrame(sorted(forms.items()), "term string, form string")


@query()
def r10_rule_stability(spark, d):
    s = run_sql(spark, d, "SELECT doc_id, text, source, label, pos FROM split WHERE pos % 3 = 0")
    return R.stability(cut(s.withColumn("pos", F.expr("cast(pos / 3 as bigint)"))))


_TERMS = " UNION ALL ".join(f"SELECT doc_id, label, unnest(list_distinct(list_transform(range(1, length(t) - {k} + 2), lambda i: substr(t, i, {k})))) AS term FROM sq" for k in (2, 3, 4, 5, 6))


@query(
    rf"""WITH sq AS (SELECT doc_id, label, regexp_replace(text, '[\s\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}]+', '', 'g') AS t FROM gold), posts AS ({_TERMS}),
    terms AS (SELECT term, count(*) AS support, md5(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id)) AS docs FROM posts GROUP BY term HAVING count(*) >= 12),
    sets AS (SELECT (min({{'l': length(term), 't': term}})).t AS term, support, count(*) AS surface_forms FROM terms GROUP BY support, docs),
    led AS (SELECT s.term, s.support, s.surface_forms, p.label, count(*) AS hits, min(doc_id) AS first_doc FROM sets s JOIN posts p USING (term) GROUP BY ALL),
    best AS (SELECT term, support, surface_forms, label, hits FROM led QUALIFY row_number() OVER (PARTITION BY term ORDER BY hits DESC, first_doc) = 1),
    prior AS (SELECT label, count(*) / CAST((SELECT count(*) FROM gold) AS DOUBLE) AS prior FROM gold GROUP BY label),
    cases AS (SELECT DISTINCT support, hits, label FROM best),
    tails AS (SELECT support, hits, label, sum(exp(lgamma(support + 1) - lgamma(i + 1) - lgamma(support - i + 1) + i * ln(prior) + (support - i) * ln(1 - prior))) AS p FROM (SELECT c.*, prior, unnest(range(hits, support + 1)) AS i FROM cases c JOIN prior USING (label)) GROUP BY ALL),
    o AS (SELECT b.*, prior, b.hits / CAST(b.support AS DOUBLE) AS concentration, b.hits / CAST(b.support AS DOUBLE) - prior AS lift, round(least(1.0, t.p), 12) AS p FROM best b JOIN prior USING (label) JOIN tails t ON t.support = b.support AND t.hits = b.hits AND t.label = b.label),
    k AS (SELECT *, row_number() OVER (ORDER BY p, round(lift, 9) DESC, support DESC, term) AS place, count(*) OVER () AS m FROM o),
    h AS (SELECT *, max(least(1.0, p * (m - place + 1))) OVER (ORDER BY place ROWS UNBOUNDED PRECEDING) AS p_holm FROM k)
    SELECT place, term, surface_forms, label, support, hits, round(concentration, 6) AS concentration, round(prior, 6) AS prior, round(lift, 6) AS lift, round(p, 6) AS p, round(p_holm, 5) AS p_holm, p_holm < 0.05 AS significant FROM h"""
)
def a17_leakage_audit(spark, d):
    """Terms whose documents lean to one label more than chance allows, Holm-adjusted: one row per distinct document set."""
    from quillstone.operators.leakage import leakage

    found = leakage(run_sql(spark, d, "SELECT doc_id, text, label FROM gold"))
    six = {c: F.round(c, 6) for c in ("concentration", "prior", "lift", "p")}
    return found.withColumns({**six, "p_holm": F.round("p_holm", 5)})


@query(
    r"WITH c AS (SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(trim(regexp_replace(d.text, '\s+', ' ', 'g')), trim(regexp_replace(b.text, '\s+', ' ', 'g')))) SELECT item_id, count(*) AS docs, min(doc_id) AS first_doc FROM c GROUP BY item_id"
)
def a17_benchmark_passages(spark, d):
    return passages.found(read_table(spark, d, "documents"), read_table(spark, d, "benchmark"))


_ANS = """ans AS (SELECT doc_id, label, 0 AS j, CASE WHEN text LIKE '%***%' THEN 1 ELSE 0 END AS yes FROM gold UNION ALL SELECT doc_id, label, 1, CASE WHEN text LIKE '%!!%' THEN 1 ELSE 0 END FROM gold
 UNION ALL SELECT doc_id, label, 2, CASE WHEN text LIKE '%stupid%' OR text LIKE '%idiot%' OR text LIKE '%trash%' THEN 1 ELSE 0 END FROM gold UNION ALL SELECT doc_id, label, 3, CASE WHEN length(text) > 1500 THEN 1 ELSE 0 END FROM gold),
nl AS (SELECT label, count(*) AS n FROM gold GROUP BY label), tot AS (SELECT count(*) AS n FROM gold), yj AS (SELECT j, sum(yes) AS y FROM ans GROUP BY j), yjl AS (SELECT j, label, sum(yes) AS y FROM ans GROUP BY j, label)"""
_W = "ln(((yjl.y + 3e0 * nl.n / tot.n) / (yj.y + 3e0)) / (nl.n / CAST(tot.n AS DOUBLE)))"
both("a28_criteria_weights", f"WITH {_ANS} SELECT yjl.j, yjl.label, round({_W}, 6) AS weight FROM yjl JOIN yj ON yjl.j = yj.j JOIN nl ON nl.label = yjl.label CROSS JOIN tot")
_SCORE = """sc AS (SELECT a.doc_id, w.label, sum(CASE WHEN a.yes = 1 THEN w.weight ELSE 0e0 END) AS score, sum(a.yes) AS fired FROM ans a JOIN w ON a.j = w.j GROUP BY a.doc_id, w.label),
 rk AS (SELECT sc.doc_id, sc.label, sc.score, sc.fired, row_number() OVER (PARTITION BY sc.doc_id ORDER BY round(sc.score, 9) DESC, nl.n DESC, sc.label) AS k FROM sc JOIN nl ON nl.label = sc.label)"""
_VOTE = "SELECT doc_id, max(CASE WHEN k = 1 THEN label END) AS predicted, round(max(CASE WHEN k = 1 THEN score END) - max(CASE WHEN k = 2 THEN score END), 6) AS margin, CASE WHEN max(fired) = 0 THEN 'low' WHEN max(CASE WHEN k = 1 THEN score END) - max(CASE WHEN k = 2 THEN score END) >= 1e0 THEN 'high' WHEN max(CASE WHEN k = 1 THEN score END) - max(CASE WHEN k = 2 THEN score END) >= 4e-1 THEN 'medium' ELSE 'low' END AS confidence FROM rk GROUP BY doc_id"
both("a29_criteria_vote", f"WITH {_ANS}, w AS (SELECT yjl.j, yjl.label, {_W} AS weight FROM yjl JOIN yj ON yjl.j = yj.j JOIN nl ON nl.label = yjl.label CROSS JOIN tot), {_SCORE} {_VOTE}")
#: Leave-one-out in closed form: every row's own answers are subtracted from the totals it would be scored with.
_LOO_W = """me AS (SELECT a.doc_id, a.label AS own, a.j, a.yes, yj.y - a.yes AS y, tot.n - 1 AS n FROM ans a JOIN yj ON a.j = yj.j CROSS JOIN tot),
 ml AS (SELECT me.doc_id, me.j, me.yes, me.y AS ya, me.n AS na, yjl.label, yjl.y - CASE WHEN yjl.label = me.own THEN me.yes ELSE 0 END AS yl, nl.n - CASE WHEN yjl.label = me.own THEN 1 ELSE 0 END AS ln_ FROM me JOIN yjl ON yjl.j = me.j JOIN nl ON nl.label = yjl.label),
 sc AS (SELECT doc_id, label, sum(CASE WHEN yes = 1 AND ln_ > 0 THEN ln(((yl + 3e0 * ln_ / na) / (ya + 3e0)) / (ln_ / CAST(na AS DOUBLE))) ELSE 0e0 END) AS score, sum(yes) AS fired, max(ln_) AS n FROM ml GROUP BY doc_id, label),
 rk AS (SELECT doc_id, label, score, fired, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, n DESC, label) AS k FROM sc)"""
both("a30_criteria_loo", f"WITH {_ANS}, {_LOO_W} {_VOTE}")
both(
    "a27_criteria_floor",
    "WITH n AS (SELECT label, count(*) AS n FROM gold GROUP BY label), m AS (SELECT max(n) AS top FROM n) SELECT n.label, greatest(1, CAST(bround(5e0 * n.n / m.top, 0) AS INT)) AS floor_ FROM n CROSS JOIN m",
    "WITH n AS (SELECT label, count(*) AS n FROM gold GROUP BY label), m AS (SELECT max(n) AS top FROM n) SELECT n.label, greatest(1, CAST(round_even(5e0 * n.n / m.top, 0) AS INT)) AS floor_ FROM n CROSS JOIN m",
)


_CHARS = "list_transform(range(1, length(raw) + 1), lambda i: substr(raw, i, 1))"
_SPACED = """ln0 AS (SELECT doc_id, pos, unnest(string_split(regexp_replace(text, '[\\x{0}-\\x{8}\\x{b}-\\x{1f}\\x{7f}\\x{ad}\\x{200b}-\\x{200f}\\x{2028}\\x{2029}\\x{2244}\\x{feff}]', '', 'g'), chr(10))) AS raw0, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM split),
  ln1 AS (SELECT doc_id, pos, line, trim(regexp_replace(raw0, '[ \t]+', ' ', 'g')) AS raw FROM ln0), ln AS (SELECT *, replace(raw, ' ', '') AS t FROM ln1 WHERE length(raw) >= 4),
  ch AS (SELECT doc_id, line, pos, t, raw, unnest(range(1, length(raw) + 1)) AS k FROM ln), at0 AS (SELECT doc_id, line, pos, t, k, substr(raw, k, 1) = ' ' AS blank, count(*) FILTER (substr(raw, k, 1) <> ' ') OVER (PARTITION BY doc_id, line ORDER BY k) AS i FROM ch),
  bd AS (SELECT doc_id, line, pos, t, i, max(CAST(blank AS INT)) AS spaced FROM at0 WHERE i < length(t) GROUP BY ALL),
  cx AS (SELECT doc_id, line, pos, i, spaced, unnest([{ctx}]) AS context FROM bd)""".replace("{ctx}", ", ".join(f"CASE WHEN i >= {a} AND i + {b} <= length(t) THEN '{a}_{b}:' || substr(t, CAST(i AS BIGINT) - {a - 1}, {a + b}) END" for a, b in spacing.WINDOWS))


@query(
    f"""WITH {_SPACED}, mo AS (SELECT context, sum(spaced) AS s, count(*) AS n FROM cx WHERE pos % 10 <> 0 AND context IS NOT NULL GROUP BY context HAVING count(*) >= 3),
    od AS (SELECT context, greatest(-4.0, least(4.0, ln((s + 0.5) / (n - s + 0.5)))) AS odds FROM mo), pr AS (SELECT ln((sum(s) + 1) / (sum(n) - sum(s) + 1)) AS prior FROM mo),
    sc AS (SELECT doc_id, line, i, max(spaced) AS spaced, round(coalesce(avg(odds), (SELECT prior FROM pr)), 9) AS score FROM cx LEFT JOIN od USING (context) WHERE pos % 10 = 0 GROUP BY ALL),
    th AS (SELECT CAST(unnest([-1.0, -0.5, -0.25, 0.0, 0.25, 0.5, 1.0]) AS DOUBLE) AS threshold), k AS (SELECT threshold, CAST(sum(CASE WHEN score > threshold THEN spaced ELSE 0 END) AS BIGINT) AS tp, count(*) FILTER (score > threshold) AS predicted, CAST(sum(spaced) AS BIGINT) AS gold_ FROM sc CROSS JOIN th GROUP BY threshold),
    f AS (SELECT threshold, tp, predicted, gold_ AS spaces, round(coalesce(tp / nullif(CAST(predicted AS DOUBLE), 0), 0), 6) AS precision_, round(coalesce(tp / nullif(CAST(gold_ AS DOUBLE), 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(CAST(predicted + gold_ AS DOUBLE), 0), 0), 6) AS f1 FROM k)
    SELECT *, row_number() OVER (ORDER BY f1 DESC, threshold) = 1 AS best FROM f"""
)
def p25_p26_spacing(spark, d):
    """Spaces restored in held-out texts by boundary contexts learned on the rest: precision, recall and F1 over the thresholds, and the best."""
    g = cut(run_sql(spark, d, "SELECT doc_id, text, pos FROM split"))
    return spacing.evaluate(spacing.train(g.filter("pos % 10 <> 0")), g.filter("pos % 10 = 0")).withColumnRenamed("gold", "spaces")


@query()
def p25_restored(spark, d):
    """Held-out texts whose spaces were all taken out, with those the model puts in."""
    g = cut(run_sql(spark, d, "SELECT doc_id, text, pos FROM split"))
    bare = g.filter("pos % 10 = 0").withColumn("text", F.replace("text", F.lit(" "), F.lit("")))
    return spacing.restore(spacing.train(g.filter("pos % 10 <> 0")), bare)


@query(
    f"""WITH {_LABELS3}, s AS (SELECT source, label FROM gold UNION ALL SELECT '*', label FROM gold), n AS (SELECT source, count(*) AS n FROM s GROUP BY source),
    r AS (SELECT n.source, n.n, l.label, count(s.label) / CAST(n.n AS DOUBLE) AS rate FROM n CROSS JOIN labels3 l LEFT JOIN s ON s.source = n.source AND s.label = l.label GROUP BY n.source, n.n, l.label),
    t AS (SELECT source, max(n) AS n, string_agg(label || ' ' || CAST(CAST(round_even(100 * rate, 0) AS INT) AS VARCHAR) || '%', ', ' ORDER BY label) AS parts, coalesce(string_agg(CASE WHEN rate = 0 THEN label END, ', ' ORDER BY label), '') AS absent FROM r GROUP BY source)
    SELECT t.source, CASE WHEN t.n >= 5 THEN 'Of ' || t.n || ' past cases of ' || t.source || ': ' || t.parts || '.' || CASE WHEN t.absent <> '' THEN ' Never: ' || t.absent || '.' ELSE '' END ELSE 'Of ' || a.n || ' past cases: ' || a.parts || '.' END AS sentence
    FROM t CROSS JOIN (SELECT * FROM t WHERE source = '*') a WHERE t.source <> '*'"""
)
def p27_base_rate_sentences(spark, d):
    return base_rates.sentences(run_sql(spark, d, "SELECT source, label FROM gold"), "source", ["major", "other", "rare"])


_ASKED = """c AS (SELECT u.conv_id, u.turn, u.text AS question, a.text AS reasoning, CASE WHEN u.turn % 4 = 1 THEN '' ELSE substr(u.text, 1, 12) END AS name,
  CASE WHEN u.turn % 3 = 0 THEN substr(u.text, 1, 30) ELSE substr(a.text, 5, 30) END AS quote, CASE WHEN u.conv_id % 5 = 0 THEN 'unknown' ELSE 'major' END AS implies
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"""
_NORM = r"regexp_replace(regexp_replace(regexp_replace({}, '[\x{{0}}-\x{{8}}\x{{b}}-\x{{1f}}\x{{7f}}\x{{ad}}\x{{200b}}-\x{{200f}}\x{{2028}}\x{{2029}}\x{{2044}}\x{{2244}}\x{{feff}}]', '', 'g'), '[□○◦▪●·•▶◆∙]', '', 'g'), '\s+', '', 'g')"


@query(
    f"""WITH {_ASKED}, r AS (SELECT *, {_NORM.format("quote")} AS q, {_NORM.format("reasoning")} AS s FROM c)
    SELECT conv_id, turn, concat_ws(';', CASE WHEN trim(name) = '' THEN 'no_name' END, CASE WHEN trim(question) = '' THEN 'no_question' END, CASE WHEN trim(question) <> '' AND regexp_matches(question, 'the [a-z]*tion|which outcome') THEN 'circular' END,
      CASE WHEN q = '' OR NOT contains(s, q) THEN 'ungrounded' END, CASE WHEN implies <> 'major' THEN 'unknown_label' END) AS problems FROM r"""
)
def p19_p20_criteria(spark, d):
    """Questions of users as criteria, quotations of the answers as their grounds; a stand-in pattern for questions that ask for the conclusion."""
    rows = run_sql(spark, d, f"WITH {_ASKED} SELECT * FROM c")
    why = criteria.problems(F.col("name"), F.col("question"), F.col("quote"), F.col("implies"), F.col("reasoning"), ["major", "other", "rare"], ("the [a-z]*tion", "which outcome"))
    return rows.select("conv_id", "turn", F.array_join(why, ";").alias("problems"))


@query()
def a27_consolidated_criteria(spark, d):
    """First lines of labelled documents as criteria, those that ask alike as one, where their decision's share of support is reached."""
    g = cut(run_sql(spark, d, "SELECT doc_id, text, label, source FROM gold"))
    items = g.select(F.col("doc_id").alias("id"), F.substring(F.split("text", "\n")[0], 1, 80).alias("question"), F.col("source").alias("name"), F.col("label").alias("implies"), F.col("doc_id").alias("serial"), F.col("label").alias("decision"))
    return criteria.consolidate(items, g.select("label"))
