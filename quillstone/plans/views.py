"""Analysis views over the tables: the same definitions as CTEs for Spark SQL and for the SQL oracles."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from quillstone.session import read_table

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Stand-in rules for keyword predictions on the invented prose: (label, pattern).
KEYWORDS = [("rare", "idiot|stupid|moron|trash|loser"), ("other", r"[*]{3}|!!|%%%|&&&|\$\$\$|###")]

_GOLD = "gold AS (SELECT d.doc_id, d.text, d.lang, d.source, CASE WHEN l.toxic = 1 THEN 'rare' WHEN l.quality = 0 THEN 'other' ELSE 'major' END AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
_SPLIT = "split AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM gold)"
_DEV_TEST = "dev AS (SELECT * FROM split WHERE pos % 3 = 0), test AS (SELECT * FROM split WHERE pos % 3 <> 0)"
_PRED = """pred AS (
  SELECT 'majority' AS model, doc_id, 'major' AS predicted, 'low' AS confidence FROM gold
  UNION ALL SELECT 'keyword', doc_id, CASE WHEN {rare} THEN 'rare' WHEN {other} THEN 'other' ELSE 'major' END, CASE WHEN {rare} OR {other} THEN 'high' ELSE 'low' END FROM gold
  UNION ALL SELECT 'length', doc_id, CASE WHEN length(text) < 300 THEN 'rare' WHEN length(text) > 6000 THEN 'other' ELSE 'major' END,
    CASE WHEN length(text) < 300 THEN 'low' WHEN length(text) > 6000 THEN 'medium' ELSE 'high' END FROM gold WHERE doc_id % 11 <> 0
)"""
_CONF = "scored AS (SELECT p.model, g.doc_id, g.label, g.source, g.lang, p.predicted, p.confidence, CASE p.confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS rnk FROM gold g JOIN pred p ON g.doc_id = p.doc_id)"


def with_views(body: str, duck: bool) -> str:
    """body with the views it names put before it as CTEs, in the dialect of Spark or DuckDB."""
    quote = lambda p: p if duck else p.replace("\\", "\\\\")
    hit = lambda p: f"regexp_matches(text, '{quote(p)}')" if duck else f"text RLIKE '{quote(p)}'"
    split = _SPLIT + ", " if duck else ""  # Spark gets split as a frame whose places come from range partitions
    parts = [("gold", _GOLD), ("split|dev|test", split + _DEV_TEST), ("pred", _PRED.format(**{k: hit(p) for k, p in KEYWORDS})), ("scored", _CONF)]
    needs = {"split|dev|test": ["gold"], "pred": ["gold"], "scored": ["gold", "pred"]}
    used = {name for name, _ in parts if re.search(rf"\b(?:{name})\b", body)}
    for name in [*used]:
        used.update(needs.get(name, ()))
    ctes = [sql for name, sql in parts if name in used]
    body = body.strip()
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join([*ctes, body[5:]]) if ctes else body
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split view: labelled documents in the order of their ids, with their places."""
    from quillstone.operators.splits import indexed

    return indexed(run_sql(spark, sf_dir, "SELECT * FROM gold"), "doc_id")


def tables_of(body: str) -> list[str]:
    return [t for t in TABLES if re.search(rf"\b{t}\b", body)]


def run_sql(spark: SparkSession, sf_dir: str, body: str) -> DataFrame:
    """A query over the views; tables are named per directory, so runs over several directories do not mix."""
    text = with_views(body, duck=False)
    frames = {t: read_table(spark, sf_dir, t) for t in tables_of(text)}
    if re.search(r"\b(?:split|dev|test)\b", body):
        frames["split"] = labelled(spark, sf_dir)
    text = re.sub(rf"\b({'|'.join(frames)})\b(?=(?:[^']*'[^']*')*[^']*$)", r"{\1}", text.replace("{", "{{").replace("}", "}}")) if frames else text
    return spark.sql(text, **frames)
