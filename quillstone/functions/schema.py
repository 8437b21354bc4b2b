"""Checks of output schemas (nested dicts and lists) before they are sent to a structured-output service."""

from __future__ import annotations

# Keywords such services refuse, and what to do instead.
REFUSED = {"maxItems": "cut the list afterwards", "minItems": "check the list afterwards", "uniqueItems": "remove repeated entries afterwards"}


def problems(schema: object, path: str = "$") -> list[str]:
    """Where refused keywords stand in a schema, in order, and what to do instead; none: it is accepted."""
    out, open_ = [], [(path, schema)]
    while open_:
        at, part = open_.pop(0)
        children = [(f"{at}.{k}", v) for k, v in part.items()] if isinstance(part, dict) else [(f"{at}[{i}]", v) for i, v in enumerate(part)] if isinstance(part, list) else []
        if isinstance(part, dict):
            out += [f"{at}.{k}: {REFUSED[k]}" for k in part if k in REFUSED]
        open_ = children + open_
    return out


def schema_problems(rows, column: str):
    """rows (a DataFrame) with one row a problem of the JSON schema in a column: place (from 1), path and remedy; schemas without problems give none.

    What is no JSON is one problem, at $. Null has none.
    """
    import json

    from pyspark.sql import functions as F

    @F.udf("array<struct<place: int, path: string, remedy: string>>")
    def found(text):
        try:
            told = problems(json.loads(text)) if text is not None else []
        except ValueError:
            told = ["$: write valid JSON"]
        return [(i, *p.split(": ", 1)) for i, p in enumerate(told, 1)]

    return rows.withColumn("__p", F.explode(found(F.col(column)))).select(*rows.columns, "__p.place", "__p.path", "__p.remedy")
