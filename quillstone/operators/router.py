"""Routing of requests to a precedent, a rule or an abstention: one decision table over signals, in SQL over three frames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the decision table.
RISK_CEILING, MIN_AGREEMENT, MIN_MARGIN, MAX_YEAR_GAP, TOP = 0.20, 0.60, 0.02, 5, 3
DOUBT, TRUST, HIGH_PRECISION = 0.15, 0.60, 0.95


@dataclass(frozen=True)
class Policy:
    """What a variant switches off: the router, rules, abstention, validation, the similarity floor, and how many precedents it reads."""

    use_router: bool = True
    use_rules: bool = True
    allow_abstain: bool = True
    validate: bool = True
    floor: float = DOUBT
    top_k: int = 5
    fallback: str = "major"
    labels: tuple[str, ...] = ()  # the label scheme; without one every label is known


_SCHEME = ("major", "other", "rare")
POLICIES = {
    "naive": Policy(use_router=False, use_rules=False, allow_abstain=False, validate=False, floor=0.0, top_k=1, labels=_SCHEME),
    "always-precedent": Policy(use_router=False, use_rules=False, labels=_SCHEME),
    "router": Policy(labels=_SCHEME),
    "router-noabstain": Policy(allow_abstain=False, labels=_SCHEME),
    "router-novalidate": Policy(validate=False, labels=_SCHEME),
}


def route_sql(p: Policy, hits: str = "hits", fired: str = "fired", risk: str = "risk", requests: str = "requests") -> str:
    """CTEs sig, routed, voted and decided over hits (q, rank, label, s, source, year, grounded), fired (q, ord, label, prec), risk (band, risk) and requests (q, year).

    grounded says whether a precedent's quotation stands in its text; null: it has none. Validation, after the decision: V3 drops precedents whose
    quotation does not; V1 (a known label) and V5 (evidence left that has the decision's label) withdraw the decision; V3, V4 (no
    precise rule against it) and V6 (one label in all evidence) lower medium confidence. V2 (what is cited exists) holds, as only evidence at hand is cited.
    """
    rules = fired if p.use_rules else f"(SELECT * FROM {fired} WHERE false)"
    to_rules = lambda r: f"CASE WHEN rule_ok THEN 'rule:{r}' WHEN rule_conflict THEN 'abstain:R1' ELSE 'abstain:{r}' END"
    table = f"""CASE WHEN n_evidence = 0 AND n_rules = 0 THEN 'abstain:R2' WHEN n_evidence = 0 THEN {to_rules('R3')} WHEN trap_risk > {RISK_CEILING} THEN {to_rules('R5')}
      WHEN agreement < {MIN_AGREEMENT} AND sources >= 2 THEN 'abstain:R6' WHEN gap > {MAX_YEAR_GAP} AND rule_ok THEN 'rule:R7'
      WHEN n_evidence >= 2 AND margin < {MIN_MARGIN} AND agreement < 1 THEN 'abstain:R9' WHEN top_s >= {TRUST} THEN 'precedent:R8' ELSE 'precedent:R10' END"""
    if not p.use_router:
        table = f"CASE WHEN coalesce(best, 0) >= {p.floor} AND best IS NOT NULL THEN 'precedent:always-A' ELSE 'abstain:no-evidence' END"
    vote = lambda name, src: f"""{name} AS (SELECT q, label FROM (SELECT q, label, row_number() OVER (PARTITION BY q ORDER BY votes DESC, total DESC, seen) AS k
      FROM (SELECT q, label, count(*) AS votes, round(sum(s), 9) AS total, min(rank) AS seen FROM {src} GROUP BY q, label) v) w WHERE k = 1)"""  # noqa: E731
    fails = "(high_against > 0 OR labels_seen > 1 OR dropped > 0)" if p.validate else "false"
    unknown = f"decision NOT IN ({', '.join(repr(x) for x in p.labels)})" if p.labels else "false"
    blocked = f"(decision IS NOT NULL AND ({unknown} OR backing = 0))" if p.validate else "false"
    return f"""top AS (SELECT * FROM {hits} WHERE rank < {p.top_k}), use_ AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY rank) - 1 AS u FROM top WHERE s >= {DOUBT}),
    lead_ AS (SELECT q, label, s, year FROM use_ WHERE u = 0), rr AS (SELECT q, ord AS rank, label, prec AS s FROM {rules}),
    ev AS (SELECT x.q, count(*) AS n_evidence, max(CASE WHEN u = 0 THEN x.s END) AS top_s, max(CASE WHEN u = 1 THEN x.s END) AS second_s,
      sum(CASE WHEN u < {TOP} AND x.label = l.label THEN 1e0 ELSE 0e0 END) / sum(CASE WHEN u < {TOP} THEN 1 ELSE 0 END) AS agreement, count(DISTINCT CASE WHEN u < {TOP} THEN source END) AS sources
      FROM use_ x JOIN lead_ l ON x.q = l.q GROUP BY x.q),
    ru AS (SELECT q, count(*) AS n_rules, count(DISTINCT label) > 1 AS rule_conflict FROM rr GROUP BY q), bs AS (SELECT q, max(s) AS best FROM top GROUP BY q),
    sig AS (SELECT r.q, coalesce(e.n_evidence, 0) AS n_evidence, coalesce(e.top_s, 0e0) AS top_s, coalesce(e.top_s - e.second_s, e.top_s, 0e0) AS margin, coalesce(e.agreement, 1e0) AS agreement, coalesce(e.sources, 0) AS sources,
      r.year - l.year AS gap, coalesce(ru.n_rules, 0) AS n_rules, coalesce(ru.rule_conflict, false) AS rule_conflict, coalesce(ru.n_rules, 0) > 0 AND NOT coalesce(ru.rule_conflict, false) AS rule_ok, bs.best,
      (SELECT max(risk) FROM {risk} k WHERE k.band = CASE WHEN bs.best >= {TRUST} THEN 'trust' WHEN bs.best >= {DOUBT} THEN 'middle' ELSE 'doubt' END) AS trap_risk
      FROM {requests} r LEFT JOIN ev e ON r.q = e.q LEFT JOIN lead_ l ON r.q = l.q LEFT JOIN ru ON r.q = ru.q LEFT JOIN bs ON r.q = bs.q),
    routed AS (SELECT *, {table} AS pr FROM sig),
    floored AS (SELECT q, rank, label, s FROM top WHERE s >= {p.floor}), {vote('v_prec', 'floored')}, {vote('v_all', 'top')}, {vote('v_rule', 'rr')},
    left_ AS (SELECT q, label FROM top WHERE coalesce(grounded, true) UNION ALL SELECT q, label FROM rr),
    val AS (SELECT q, count(DISTINCT label) AS labels_seen FROM left_ GROUP BY q), gone AS (SELECT q, count(*) AS dropped FROM top WHERE NOT coalesce(grounded, true) GROUP BY q),
    decided AS (SELECT d.q, split_part(pr, ':', 1) AS path, split_part(pr, ':', 2) AS reason, margin, coalesce(vp.label, va.label, vr.label, '{p.fallback}') AS guess,
      CASE split_part(pr, ':', 1) WHEN 'precedent' THEN vp.label WHEN 'rule' THEN vr.label ELSE {"NULL" if p.allow_abstain else f"coalesce(vp.label, vr.label, '{p.fallback}')"} END AS decision, v.labels_seen, coalesce(gone.dropped, 0) AS dropped
      FROM routed d LEFT JOIN v_prec vp ON d.q = vp.q LEFT JOIN v_all va ON d.q = va.q LEFT JOIN v_rule vr ON d.q = vr.q LEFT JOIN val v ON d.q = v.q LEFT JOIN gone ON d.q = gone.q),
    against AS (SELECT d.q, count(*) AS high_against FROM decided d JOIN rr ON rr.q = d.q WHERE rr.s >= {HIGH_PRECISION} AND rr.label <> d.decision GROUP BY d.q),
    backed AS (SELECT d.q, count(*) AS backing FROM decided d JOIN left_ e ON e.q = d.q AND e.label = d.decision GROUP BY d.q),
    checked AS (SELECT *, {blocked} AS blocked FROM (SELECT d.*, coalesce(g.high_against, 0) AS high_against, coalesce(b.backing, 0) AS backing FROM decided d LEFT JOIN against g ON d.q = g.q LEFT JOIN backed b ON d.q = b.q) x),
    outcome AS (SELECT q, path, reason, CASE WHEN blocked THEN NULL ELSE decision END AS decision, decision IS NULL OR blocked AS abstained, coalesce(decision, guess) AS predicted,
      CASE WHEN blocked THEN 'validation_failed' WHEN decision IS NOT NULL THEN NULL WHEN reason IN ('R1', 'R6') THEN 'conflicting' WHEN reason = 'R5' THEN 'surface' WHEN reason = 'R9' THEN 'ambiguous' ELSE 'no_evidence' END AS abstain_reason,
      CASE WHEN decision IS NULL OR blocked OR path = 'abstain' THEN 'low' WHEN margin >= 0.30 THEN 'high' WHEN margin >= 0.10 AND NOT {fails} THEN 'medium' ELSE 'low' END AS confidence FROM checked)"""


def route(policy: Policy, hits: DataFrame, fired: DataFrame, risk: DataFrame, requests: DataFrame) -> DataFrame:
    """(q, path, reason, decision, abstained, predicted, abstain_reason, confidence) for every request."""
    if "grounded" not in hits.columns:  # no precedent has a quotation
        hits = hits.withColumn("grounded", F.lit(None).cast("boolean"))
    text = f"WITH {route_sql(policy, '{hits}', '{fired}', '{risk}', '{requests}')} SELECT * FROM outcome"
    return hits.sparkSession.sql(text, hits=hits, fired=fired, risk=risk, requests=requests)


def unsupported(policy: Policy, outcome: DataFrame, hits: DataFrame, fired: DataFrame) -> DataFrame:
    """(n, coverage, answered, unsupported, unsupported_rate): how many of the answers have no precedent read and no rule fired of the label they give.

    Every precedent that the policy reads is evidence, below the floor and with an ungrounded quotation too. Shares of nothing are 0.
    """
    evidence = hits.filter(F.col("rank") < policy.top_k).select("q", F.col("label").alias("decision"))
    if policy.use_rules:
        evidence = evidence.unionByName(fired.select("q", F.col("label").alias("decision")))
    held = outcome.join(evidence.distinct().withColumn("backed", F.lit(True)), ["q", "decision"], "left")
    n = lambda c: F.count(F.when(c, 1))
    got = held.agg(F.count(F.lit(1)).alias("n"), n(~F.col("abstained")).alias("answered"), n(~F.col("abstained") & F.col("backed").isNull()).alias("unsupported"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return got.select("n", share("answered", "n").alias("coverage"), "answered", "unsupported", share("unsupported", "answered").alias("unsupported_rate"))


def recover(outcome: DataFrame, hits: DataFrame, verdicts: DataFrame) -> DataFrame:
    """outcome with the abstentions that a verdict on the top precedent withdraws, and recovered.

    verdicts (q, verdict) may come from any judge. An abstention is withdrawn only on 'applies', when the top precedent reaches
    the floor and no other precedent that does has another label; the answer is then the top precedent's, of medium confidence.
    """
    text = f"""WITH lead_ AS (SELECT q, label, s FROM {{hits}} WHERE rank = 0),
    against AS (SELECT DISTINCT h.q FROM {{hits}} h JOIN lead_ l ON h.q = l.q WHERE h.rank > 0 AND h.s >= {DOUBT} AND h.label <> l.label),
    marked AS (SELECT o.*, l.label AS lead_label, o.abstained AND coalesce(l.s >= {DOUBT}, false) AND coalesce(v.verdict = 'applies', false) AND a.q IS NULL AS recovered
      FROM {{outcome}} o LEFT JOIN lead_ l ON o.q = l.q LEFT JOIN {{verdicts}} v ON o.q = v.q LEFT JOIN against a ON o.q = a.q)
    SELECT q, CASE WHEN recovered THEN 'precedent' ELSE path END AS path, CASE WHEN recovered THEN 'V3+' ELSE reason END AS reason, CASE WHEN recovered THEN lead_label ELSE decision END AS decision,
      abstained AND NOT recovered AS abstained, CASE WHEN recovered THEN lead_label ELSE predicted END AS predicted, CASE WHEN NOT recovered THEN abstain_reason END AS abstain_reason,
      CASE WHEN recovered THEN 'medium' ELSE confidence END AS confidence, recovered FROM marked"""
    return hits.sparkSession.sql(text, outcome=outcome, hits=hits, verdicts=verdicts)
