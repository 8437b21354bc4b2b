"""Queries of text scalars, sources and splits, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import grounding, segments, splits
from quillstone.plans.views import KEYWORDS, run_sql, with_views
from quillstone.session import read_table

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None, views: bool = True):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = with_views(oracle, duck=True) if views else oracle
        return fn

    return add


def _docs(spark, sf_dir):
    return read_table(spark, sf_dir, "documents")


_WS = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_INV = r"[\x{0}-\x{8}\x{b}-\x{1f}\x{7f}\x{ad}\x{200b}-\x{200f}\x{2028}\x{2029}\x{2044}\x{2244}\x{feff}]"


@query(rf"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '{_INV}', '', 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9)) AS cleaned FROM documents")
def p1_clean_for_prompt(spark, d):
    return _docs(spark, d).select("doc_id", T.clean_for_prompt(F.col("text")).alias("cleaned"))


@query(rf"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '{_INV}', '', 'g'), '{T.BULLETS}', '', 'g'), '{_WS}', '', 'g') AS norm FROM documents")
def p2_normalize_for_match(spark, d):
    return _docs(spark, d).select("doc_id", T.normalize_for_match(F.col("text")).alias("norm"))


@query(rf"SELECT doc_id, regexp_replace(t, '{_WS}', '', 'g') AS squeezed, regexp_replace(t, '(?:{_WS}|[\x{{200b}}\x{{feff}}])+', '', 'g') AS norm FROM (SELECT doc_id, replace(text, '. ', '.' || chr(8203) || ' ' || chr(65279)) AS t FROM documents)")
def p3_p4_squeeze(spark, d):
    """Zero-width spaces and byte order marks put after sentences tell the two apart: only the second drops them."""
    t = F.replace("text", F.lit(". "), F.lit(".\u200b \ufeff"))
    return _docs(spark, d).select("doc_id", T.squeeze(t).alias("squeezed"), T.normalize_grams(t).alias("norm"))


@query(rf"SELECT CASE WHEN n < 200 THEN 'short' WHEN n < 600 THEN 'medium' ELSE 'long' END AS bucket, count(*) AS docs FROM (SELECT length(regexp_replace(text, '{_WS}', '', 'g')) AS n FROM documents) GROUP BY 1")
def p5_length_bucket(spark, d):
    return _docs(spark, d).groupBy(T.length_bucket(F.col("text")).alias("bucket")).agg(F.count(F.lit(1)).alias("docs"))


@query("SELECT event_id, CASE WHEN value >= 0.6 THEN 'trust' WHEN value >= 0.15 THEN 'middle' ELSE 'doubt' END AS band, CASE WHEN value >= 0.3 THEN 'high' WHEN value >= 0.1 THEN 'medium' ELSE 'low' END AS grade FROM events")
def p6_p7_bands(spark, d):
    v = F.col("value")
    return read_table(spark, d, "events").select("event_id", T.similarity_band(v).alias("band"), T.margin_grade(v).alias("grade"))


@query("SELECT confidence, CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS rnk, count(*) AS n, CAST(sum(CASE WHEN confidence IN ('high', 'medium') THEN 1 ELSE 0 END) AS BIGINT) AS meets_medium FROM pred GROUP BY 1, 2")
def p8_confidence_rank(spark, d):
    p = run_sql(spark, d, "SELECT * FROM pred")
    r = T.confidence_rank(F.col("confidence"))
    return p.groupBy("confidence", r.alias("rnk")).agg(F.count(F.lit(1)).alias("n"), F.sum((r >= 2).cast("int")).alias("meets_medium"))


@query("SELECT o_orderkey, CAST(nullif(regexp_extract(CAST(o_orderdate AS VARCHAR), '20\\d{2}'), '') AS INT) AS yr FROM orders")
def p9_year_of(spark, d):
    return read_table(spark, d, "orders").select("o_orderkey", T.year_of(F.col("o_orderdate").cast("string")).alias("yr"))


_MASK = r"\b(stupid|idiot|moron|trash)\b\s*"


@query(rf"SELECT doc_id, regexp_replace(text, '{_MASK}', ' ', 'g') AS masked, len(regexp_extract_all(text, '{_MASK}')) AS leaks FROM documents")
def p10_leak_mask(spark, d):
    masked, leaks = T.mask_leaks(F.col("text"), _MASK)
    return _docs(spark, d).select("doc_id", masked.alias("masked"), leaks.alias("leaks"))


@query(rf"SELECT doc_id, trim(regexp_replace(regexp_replace(text, '{_INV}', '', 'g'), '[ \t]+', ' ', 'g'), ' ' || chr(10) || chr(9)) AS request FROM gold")
def p11_gold_clean(spark, d):
    return run_sql(spark, d, "SELECT doc_id, text FROM gold").select("doc_id", T.clean_gold(F.col("text")).alias("request"))


_TEN = "①②③④⑤⑥⑦⑧⑨⑩"


@query(
    f"""WITH s AS (SELECT doc_id AS id, string_split(replace(text, chr(10), ' '), '. ') AS parts FROM documents), n AS (SELECT id, parts, least(10, len(parts)) AS n FROM s)
    SELECT id, CAST(i AS INT) AS num, trim('{_TEN}'[i] || ' ' || CASE WHEN i < n THEN parts[i] ELSE array_to_string(parts[i:], '. ') END) AS part FROM (SELECT id, parts, n, unnest(range(1, n + 1)) AS i FROM n WHERE n >= 2)
    UNION ALL SELECT id, NULL, NULL FROM n WHERE n < 2 OR n IS NULL"""
)
def p12_p13_marked_sentences(spark, d):
    """Each document's sentences under enumeration marks, all from the tenth on under the tenth, found again as a rising chain and sliced; one mark is no chain."""
    parts = F.split(F.replace("text", F.lit("\n"), F.lit(" ")), r"\. ", -1)
    marks = F.array(*[F.lit(x) for x in _TEN])
    first = F.transform(F.slice(parts, 1, 9), lambda p, i: F.concat(F.element_at(marks, i + 1), F.lit(" "), p))
    rest = F.when(F.size(parts) > 9, F.array(F.concat(F.lit(_TEN[9] + " "), F.array_join(F.slice(parts, F.lit(10), F.greatest(F.size(parts), F.lit(1))), ". ")))).otherwise(F.array().cast("array<string>"))
    body = F.array_join(F.concat(first, rest), " ")
    rows = _docs(spark, d).select(F.col("doc_id").alias("id"), body.alias("text")).withColumn("marks", T.sequence_marks(F.col("text")))
    found = rows.select("id", F.explode_outer(T.slice_by_marks(F.col("text"), F.col("marks"))).alias("p"))
    return found.select("id", F.col("p.num").alias("num"), F.col("p.part").alias("part"))


@query()
def p12_p13_marks(spark, d):
    """Enumeration marks as they stand in the documents, and the text from each to the next."""
    rows = _docs(spark, d).select(F.col("doc_id").alias("id"), "text")
    rows = rows.withColumn("marks", T.sequence_marks(F.col("text")))
    parts = rows.select("id", F.explode_outer(T.slice_by_marks(F.col("text"), F.col("marks"))).alias("p"))
    return parts.select("id", F.col("p.num").alias("num"), F.col("p.part").alias("part"))


_NUMBERED = "list_transform(range(1, len({0}) + 1), lambda i: CASE WHEN i <= 10 THEN '①②③④⑤⑥⑦⑧⑨⑩'[i] || ' ' ELSE '' END || {0}[i])"
_PART = "trim(CASE WHEN i < n THEN {0}[i] ELSE array_to_string({0}[i:], ' ') END, ' ' || chr(9) || chr(10) || chr(13))"


@query(
    f"""WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS q, lead(role) OVER w AS next, coalesce(lead(text) OVER w, '') AS a FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    s AS (SELECT conv_id, turn, string_split(q, '. ') AS qs, string_split(a, '. ') AS ans FROM t WHERE role = 'user' AND next = 'assistant'),
    m AS (SELECT conv_id, turn, {_NUMBERED.format('qs')} AS qs, {_NUMBERED.format('ans')} AS ans, least(10, len(qs)) AS n, least(10, len(ans)) AS k FROM s),
    one AS (SELECT *, n >= 2 AND n = k AS alike FROM m)
    SELECT conv_id, turn, i::INT AS pair_index, n::INT AS pair_count, 'paired' AS split_mode, true AS has_enumeration, {_PART.format('qs')} AS question, {_PART.format('ans')} AS answer, false AS mark_mismatch
    FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM one WHERE alike)
    UNION ALL SELECT conv_id, turn, 1, 1, 'single', n >= 2 OR k >= 2, array_to_string(qs, ' '), array_to_string(ans, ' '), n >= 2 AND k >= 2 FROM one WHERE NOT alike"""
)
def p12_p13_question_answer_pairs(spark, d):
    """User turns and the answers to them, their sentences numbered on both sides, split into pairs where the numbers agree."""
    from quillstone.operators.pairs import split_pairs, turns_as_cases

    marks = F.array(*[F.lit(x) for x in "①②③④⑤⑥⑦⑧⑨⑩"])

    def numbered(c):
        said = F.split(F.coalesce(c, F.lit("")), r"\. ", -1)
        return F.array_join(F.transform(said, lambda p, i: F.when(i < 10, F.concat(F.try_element_at(marks, i + 1), F.lit(" "), p)).otherwise(p)), " ")

    cases = turns_as_cases(read_table(spark, d, "conversations"))
    return split_pairs(cases.withColumns({c: numbered(F.col(c)) for c in ("question", "answer")}))


@query("SELECT g.doc_id, p.predicted, p.confidence FROM gold g JOIN pred p ON g.doc_id = p.doc_id WHERE p.model = 'keyword'")
def p14_keyword(spark, d):
    label, _, conf = T.keyword_label(F.col("text"), KEYWORDS, "major")
    return run_sql(spark, d, "SELECT doc_id, text FROM gold").select("doc_id", label.alias("predicted"), conf.alias("confidence"))


@query("SELECT doc_id, 'major' AS predicted, 'majority' AS rule, 'low' AS confidence FROM gold")
def p15_majority(spark, d):
    return run_sql(spark, d, "SELECT doc_id FROM gold").select("doc_id", F.lit("major").alias("predicted"), F.lit("majority").alias("rule"), F.lit("low").alias("confidence"))


_VERDICT = {"hold": "avec|pour", "condition": "with the", "deny": "not|nicht", "affirm": "and|und"}


@query(
    """WITH a AS (SELECT conv_id, turn, right(trim(regexp_replace(text, '\\s+', ' ', 'g')), 300) AS t FROM conversations WHERE role = 'assistant'),
    b AS (SELECT *, strpos(t, regexp_extract(t, 'not|nicht')) * CAST(regexp_matches(t, 'not|nicht') AS INT) AS dn, strpos(t, regexp_extract(t, 'and|und')) * CAST(regexp_matches(t, 'and|und') AS INT) AS af FROM a)
    SELECT conv_id, turn, CASE WHEN t = '' THEN '미분류' WHEN regexp_matches(t, 'avec|pour') THEN 'hold' WHEN regexp_matches(t, 'with the') THEN 'condition'
      WHEN dn > 0 AND af > 0 AND dn > af THEN 'deny' WHEN dn > 0 AND af > 0 THEN 'affirm' WHEN dn > 0 THEN 'deny' WHEN af > 0 THEN 'affirm' ELSE '미분류' END AS verdict,
      CASE WHEN t = '' THEN 'empty' WHEN regexp_matches(t, 'avec|pour') THEN 'abstain' WHEN regexp_matches(t, 'with the') THEN 'conditional'
      WHEN dn > 0 AND af > 0 AND dn > af THEN 'deny>affirm' WHEN dn > 0 AND af > 0 THEN 'affirm>deny' WHEN dn > 0 THEN 'deny' WHEN af > 0 THEN 'affirm' ELSE 'no_match' END AS rule FROM b"""
)
def p16_verdict(spark, d):
    label, rule = T.verdict(F.col("text"), _VERDICT)
    return read_table(spark, d, "conversations").filter("role = 'assistant'").select("conv_id", "turn", label.alias("verdict"), rule.alias("rule"))


@query(rf"SELECT d.doc_id, b.item_id, true AS grounded FROM documents d JOIN benchmark b ON contains(regexp_replace(d.text, '{_WS}', '', 'g'), regexp_replace(b.text, '{_WS}', '', 'g'))")
def p17_p18_grounding(spark, d):
    """The (document, item) pairs of all documents and all items in which the item is grounded; a pair without a row is not."""
    docs, items = _docs(spark, d).select("doc_id", "text"), read_table(spark, d, "benchmark").select("item_id", F.col("text").alias("quote"))
    return grounding.grounded(docs, items)


_QUOTED = "CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 7 = 0 THEN concat('#', substr(text, 10, 30)) WHEN doc_id % 3 = 0 THEN concat('• ', substr(text, 10, 30)) ELSE substr(text, 10, 30) END"


@query(
    rf"""WITH q AS (SELECT doc_id, regexp_replace(text, '{_WS}', '', 'g') AS t, regexp_replace({_QUOTED}, '{_WS}', '', 'g') AS q FROM documents WHERE length(text) >= 40)
    SELECT doc_id, replace(q, '•', '') <> '' AND contains(t, replace(q, '•', '')) AS quote_grounded, contains(t, q) AS evidence_grounded FROM q"""
)
def p17_p18_both_checks(spark, d):
    """Both checks of one quotation a document: plain, after a bullet, garbled, and empty, where they part."""
    rows = _docs(spark, d).filter("length(text) >= 40").withColumn("quote", F.expr(_QUOTED))
    return rows.select("doc_id", T.quote_grounded(F.col("quote"), F.col("text")).alias("quote_grounded"), T.evidence_grounded(F.col("quote"), F.col("text")).alias("evidence_grounded"))


@query("""SELECT p.page_id, u.reason FROM (SELECT page_id, [CASE WHEN length(html) < 3000 THEN 'short' END, CASE WHEN NOT contains(html, '<h1') THEN 'no_heading' END, CASE WHEN contains(url, '?') THEN 'query_url' END] AS r FROM pages) p, UNNEST(p.r) AS u(reason) WHERE u.reason IS NOT NULL""")
def p19_p20_a33_discards(spark, d):
    """All reasons a row fails for, one row each, as a discard log keeps them."""
    reasons = [(F.length("html") < 3000, "short"), (~F.contains("html", F.lit("<h1")), "no_heading"), (F.contains("url", F.lit("?")), "query_url")]
    return splits.discards(read_table(spark, d, "pages"), reasons).select("page_id", F.explode("rejected_for").alias("reason"))


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS sha FROM documents")
def p23_fingerprint(spark, d):
    return _docs(spark, d).select("doc_id", T.fingerprint(F.col("text")).alias("sha"))


@query(rf"SELECT regexp_replace(text, '{_WS}', '', 'g') AS grp, count(*) AS members, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def p24_group_key(spark, d):
    g = _docs(spark, d).groupBy(T.group_key(F.col("text")).alias("grp")).agg(F.count(F.lit(1)).alias("members"), F.min("doc_id").alias("first_id"))
    return g.filter("members > 1")


# --- splits and samples


@query("SELECT doc_id, label, pos % 3 = 0 AS is_dev, pos % 10 = 0 AS held, CAST(pos % 5 AS INT) AS fold FROM split")
def w1_w2_w3_split(spark, d):
    g = splits.indexed(run_sql(spark, d, "SELECT doc_id, label FROM gold"), "doc_id")
    p = F.col("pos")
    return g.select("doc_id", "label", (p % 3 == 0).alias("is_dev"), (p % 10 == 0).alias("held"), (p % 5).cast("int").alias("fold"))


@query(
    rf"""WITH k AS (SELECT doc_id, regexp_replace(text, '{_WS}', '', 'g') AS grp, CASE label WHEN 'rare' THEN 0 WHEN 'other' THEN 1 ELSE 2 END AS r, CAST(doc_id AS VARCHAR) AS key FROM gold),
    g AS (SELECT grp, min(r) AS stratum, min(key) AS first_key, count(*) AS members FROM k GROUP BY 1),
    o AS (SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY first_key) - 1) % 3 = 0 AS is_dev FROM g)
    SELECT k.doc_id, o.stratum, o.is_dev FROM k JOIN o ON k.grp = o.grp"""
)
def w4_group_split(spark, d):
    g = run_sql(spark, d, "SELECT doc_id, text, label FROM gold")
    return splits.group_split(g.withColumn("grp", T.group_key(F.col("text"))), {"rare": 0, "other": 1, "major": 2}).select("doc_id", "stratum", "is_dev")


@query(
    rf"""WITH k AS (SELECT doc_id, regexp_replace(text, '{_WS}', '', 'g') AS grp, CASE label WHEN 'rare' THEN 0 WHEN 'other' THEN 1 ELSE 2 END AS r, CAST(doc_id AS VARCHAR) AS key FROM gold),
    g AS (SELECT grp, min(r) AS stratum, min(key) AS first_key FROM k GROUP BY 1), o AS (SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY first_key) - 1) % 3 = 0 AS is_dev FROM g),
    rows_ AS (SELECT k.grp, o.is_dev FROM k JOIN o ON k.grp = o.grp) SELECT count(*) AS shared FROM (SELECT grp FROM rows_ WHERE is_dev INTERSECT SELECT grp FROM rows_ WHERE NOT is_dev)"""
)
def w5_shared_groups_none(spark, d):
    g = run_sql(spark, d, "SELECT doc_id, text, label FROM gold").withColumn("grp", T.group_key(F.col("text")))
    s = splits.group_split(g, {"rare": 0, "other": 1, "major": 2})
    return s.groupBy("grp").agg(F.countDistinct("is_dev").alias("c")).filter("c > 1").agg(F.count(F.lit(1)).alias("shared"))


@query(
    """WITH s AS (SELECT doc_id, source, lang, count(*) OVER (PARTITION BY source, lang) AS n, count(*) OVER () AS total, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) - 1 AS i FROM documents),
    w AS (SELECT *, greatest(1, CAST(round_even(200 * n / total, 0) AS BIGINT)) AS want FROM s), t AS (SELECT *, greatest(1, n // want) AS step FROM w)
    SELECT doc_id, source, lang FROM t WHERE i % step = 0 AND i // step < want"""
)
def w6_stratified_sample(spark, d):
    return splits.stratified(_docs(spark, d), ["source", "lang"], "doc_id", 200).select("doc_id", "source", "lang")


# --- sources and segments


@query("SELECT page_id, nfc_normalize(replace(url, 'e', 'e' || chr(769))) AS name FROM pages")
def s5_composed_names(spark, d):
    """File names with decomposed accents, made from the pages' addresses, composed again."""
    return read_table(spark, d, "pages").select("page_id", segments.composed(F.replace("url", F.lit("e"), F.lit("e\u0301"))).alias("name"))


@query("SELECT page_id, length(html) AS n, length(regexp_replace(substr(html, 1, 20000), '[^\\x20-\\x7e\\x{a0}-\\x{ffff}\\n\\t]', '', 'g')) / length(substr(html, 1, 20000)) >= 0.8 AS healthy FROM pages")
def s5_health(spark, d):
    return segments.healthy(read_table(spark, d, "pages"), "html").select("page_id", F.length("html").cast("long").alias("n"), "healthy")


@query(
    """WITH o AS (SELECT conv_id, turn, role, sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn) - length(text) - 1 AS begins, sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn) AS ends FROM conversations),
    t AS (SELECT conv_id, (max(ends)) // 2 AS pos FROM o GROUP BY 1)
    SELECT t.conv_id, CAST(t.pos AS BIGINT) AS pos, o.turn FROM t JOIN o ON t.conv_id = o.conv_id AND o.begins <= t.pos AND t.pos < o.ends"""
)
def s6_j8_position_to_page(spark, d):
    """The turn that holds the middle character of each conversation: an as-of join of positions on running offsets."""
    c = read_table(spark, d, "conversations")
    offsets = segments.offsets(c, "conv_id", "turn", "text")
    middle = offsets.groupBy("conv_id").agg((F.max("ends") / 2).cast("long").alias("pos"))
    return segments.page_of(middle, offsets, "conv_id").select("conv_id", "pos", "turn")


@query(
    """WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'purchase' THEN event_id END AS major, CASE WHEN event_type IN ('click', 'login') THEN event_id END AS minor FROM events),
    f AS (SELECT *, last_value(major IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS section, count(major) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS part FROM e)
    SELECT event_id, section, last_value(minor IGNORE NULLS) OVER (PARTITION BY user_id, part ORDER BY ts, event_id) AS subsection FROM f"""
)
def s7_divider_fill(spark, d):
    e = read_table(spark, d, "events")
    major = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    minor = F.when(F.col("event_type").isin("click", "login"), F.col("event_id"))
    return segments.fill_sections(e, "user_id", ["ts", "event_id"], major, minor).select("event_id", "section", "subsection")


_DIVIDES = {"major": "^[A-Z][a-z]+ [a-z]+", "minor": "^[A-Z][a-z]+[.]"}


@query(
    r"""WITH p AS (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations), m AS (SELECT *, CASE WHEN length(t) <= 90 AND regexp_matches(t, '^[A-Z][a-z]+ [a-z]+') THEN t END AS major, CASE WHEN length(t) <= 90 AND regexp_matches(t, '^[A-Z][a-z]+[.]') THEN t END AS minor FROM p),
    f AS (SELECT *, last_value(major IGNORE NULLS) OVER w AS section, count(major) OVER w AS part FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id, turn, section, last_value(minor IGNORE NULLS) OVER (PARTITION BY conv_id, part ORDER BY turn) AS subsection FROM f"""
)
def s7_divider_pages(spark, d):
    """Turns as pages: short ones that match a pattern head the section or subsection of those after them."""
    c = read_table(spark, d, "conversations")
    major, minor = (segments.divider(F.col("text"), [_DIVIDES[k]]) for k in ("major", "minor"))
    return segments.fill_sections(c, "conv_id", ["turn"], major, minor).select("conv_id", "turn", "section", "subsection")


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'english' WHEN 'fr' THEN 'french' WHEN 'de' THEN 'german' ELSE lang END AS name FROM documents")
def s8_alias(spark, d):
    return _docs(spark, d).select("doc_id", segments.canonical(F.col("lang"), {"en": "english", "fr": "french", "de": "german"}).alias("name"))


_CASES = r"""p AS (SELECT page_id, regexp_split_to_array(html, '<p[^>]*>') AS parts FROM pages), q AS (SELECT page_id, generate_subscripts(parts, 1) - 1 AS pos, unnest(parts) AS part FROM p),
  b AS (SELECT page_id, CAST(pos AS INT) AS pos, trim(regexp_replace(part, '<[^>]*>', '', 'g'), ' ' || chr(10)) AS body FROM q WHERE pos > 0),
  c0 AS (SELECT *, nullif(regexp_extract(body, '([A-Z][a-z]{9,})', 1), '') AS serial, regexp_extract_all(substr(body, 1, 200), '(and|the|der|que)', 1) AS every FROM b),
  c AS (SELECT *, list_sort(list_distinct(every), 'ASC', 'NULLS LAST') AS said FROM c0),
  cases AS (SELECT *, CASE WHEN len(said) = 1 THEN said[1] END AS label, list_filter([CASE WHEN serial IS NULL THEN 'no_serial' END, CASE WHEN len(said) = 0 THEN 'no_decision' END, CASE WHEN len(said) > 1 THEN 'several_decisions' END], lambda x: x IS NOT NULL) AS warnings FROM c)"""


def _cases(spark, d):
    parts = segments.slices(read_table(spark, d, "pages"), "html", "<p[^>]*>").select("page_id", "pos", F.trim(F.regexp_replace("part", "<[^>]*>", ""), F.lit(" \n")).alias("body"))
    serial, said, label, warnings = segments.case_fields(F.col("body"), "([A-Z][a-z]{9,})", ["and", "the", "der", "que"])
    return parts.select("page_id", "pos", "body", serial.alias("serial"), said.alias("said"), label.alias("label"), warnings.alias("warnings"))


@query(f"WITH {_CASES} SELECT page_id, pos, body, serial, array_to_string(said, ',') AS decisions, label, array_to_string(warnings, ',') AS warnings FROM cases")
def s9_s10_segments(spark, d):
    """Paragraphs of pages as cases, each with a serial, the decisions its head names, a label if it is one, and warnings."""
    c = _cases(spark, d)
    return c.select("page_id", "pos", "body", "serial", F.array_join(F.sort_array("said"), ",").alias("decisions"), "label", F.array_join("warnings", ",").alias("warnings"))


@query(
    f"""WITH {_CASES}, k AS (SELECT c.*, CASE WHEN c.page_id % 2 = 0 THEN 'nonaction' ELSE 'interpretation' END AS type, nullif(regexp_extract(p.url, '^https?://([^/]+)', 1), '') AS sector FROM cases c JOIN pages p ON p.page_id = c.page_id)
    SELECT 'label' AS kind, coalesce(label, 'none') AS value, count(*) AS n FROM k GROUP BY 2 UNION ALL SELECT 'type', type, count(*) FROM k GROUP BY 2 UNION ALL SELECT 'sector', coalesce(sector, 'none'), count(*) FROM k GROUP BY 2
    UNION ALL SELECT 'warning', w, count(*) FROM (SELECT unnest(warnings) AS w FROM k) GROUP BY 2
    UNION ALL SELECT 'duplicate_serial', type || ':' || serial, count(*) FROM k WHERE serial IS NOT NULL GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'serials', type, count(DISTINCT serial) FROM k WHERE serial IS NOT NULL GROUP BY 2"""
)
def s14_extraction_report(spark, d):
    """Cases by label, type (even pages and odd ones), sector (the page's host) and warning, serials met twice, and serials in all."""
    pages = read_table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 2 == 0, "nonaction").otherwise("interpretation").alias("type"), F.nullif(F.regexp_extract("url", "^https?://([^/]+)", 1), F.lit("")).alias("sector"))
    return segments.extraction_report(_cases(spark, d).join(pages, "page_id"))


@query(
    " UNION ALL ".join(f"SELECT source, '{c}' AS field, round(avg(CASE WHEN length(trim(coalesce(CAST({c} AS VARCHAR), ''))) > 0 THEN 1e0 ELSE 0e0 END), 4) AS rate FROM f GROUP BY source" for c in ("lang", "label", "quality", "toxic", "masked")).join(
        ["WITH f AS (SELECT d.source, d.lang, CASE WHEN l.toxic = 1 THEN 'rare' ELSE '' END AS label, l.quality, l.toxic, CASE WHEN contains(d.text, '@') THEN 'x' ELSE ' ' END AS masked FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) ", ""]
    )
)
def s15_fill_rates(spark, d):
    rows = _docs(spark, d).join(read_table(spark, d, "labels"), "doc_id", "left")
    rows = rows.select("source", "lang", F.when(F.col("toxic") == 1, "rare").otherwise("").alias("label"), "quality", "toxic", F.when(F.contains("text", F.lit("@")), "x").otherwise(" ").alias("masked"))
    return segments.fill_rates(rows, "source", ["lang", "label", "quality", "toxic", "masked"])


@query(
    """WITH f AS (SELECT d.source, CASE WHEN l.quality IS NOT NULL THEN 'x' END AS decision, d.lang AS serial, CASE WHEN length(d.text) > 60 THEN 'x' ELSE ' ' END AS sector, CASE WHEN contains(d.text, '.') THEN 'x' ELSE '' END AS body FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
    r AS (SELECT source, unnest([{'field': 'decision', 'rate': avg((decision IS NOT NULL)::INT), 'least': 0.9e0}, {'field': 'serial', 'rate': avg((trim(coalesce(serial, '')) <> '')::INT), 'least': 0.95e0},
      {'field': 'sector', 'rate': avg((trim(sector) <> '')::INT), 'least': 0.95e0}, {'field': 'body', 'rate': avg((body <> '')::INT), 'least': 0.8e0}]) AS x FROM f GROUP BY source)
    SELECT source, x.field AS field, round(x.rate, 4) AS rate, x.least AS least, round(x.rate, 4) < x.least AS drift FROM r"""
)
def s15_format_drift(spark, d):
    """Fill rates of each source against the least rates of a known format."""
    rows = _docs(spark, d).join(read_table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    some = lambda c, e: F.when(c, "x").otherwise(e)
    rows = rows.select("source", some(F.col("quality").isNotNull(), None).alias("decision"), F.col("lang").alias("serial"), some(F.length("text") > 60, " ").alias("sector"), some(F.contains("text", F.lit(".")), "").alias("body"))
    return segments.format_drift(segments.fill_rates(rows, "source", ["decision", "serial", "sector", "body"]))


@query("""WITH h AS (SELECT source, array_to_string(regexp_extract_all(text, '([#%&$])', 1), '') AS pattern, count(*) AS n FROM documents WHERE regexp_matches(text, '[#%&$]') GROUP BY 1, 2)
    SELECT source, pattern, n, CASE WHEN contains(pattern, '$') THEN '$' ELSE '' END AS unknown FROM h""")
def s15_unknown_marks(spark, d):
    """Sequences of marks of each source, and the marks among them that no known format has."""
    return segments.unknown_marks(segments.mark_histogram(_docs(spark, d), "source", "text", "#%&$"), "#%&")


@query("SELECT source, array_to_string(regexp_extract_all(text, '([#%&$])', 1), '') AS pattern, count(*) AS n FROM documents WHERE regexp_matches(text, '[#%&$]') GROUP BY 1, 2")
def s15_mark_histogram(spark, d):
    return segments.mark_histogram(_docs(spark, d), "source", "text", "#%&$")


_S12 = r"trim(regexp_replace(regexp_replace(regexp_replace({}, '[\x{{0}}-\x{{9}}\x{{b}}-\x{{1f}}]', '', 'g'), ' +', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10))"


@query(" UNION ALL ".join(f"SELECT doc_id, '{n}' AS name, {_S12.format(n)} AS value, 'missing_field:notes' AS warnings FROM documents" for n in ("lang", "source", "text")))
def s11_fields(spark, d):
    """Documents written out as named sections, one name broken over two lines, and split again."""
    x = _docs(spark, d)
    body = F.concat_ws("\n", F.lit("lang"), "lang", F.lit("so"), F.lit("urce"), "source", F.lit(" te xt "), "text")
    fields, warnings = segments.split_fields(body, ["lang", "source", "text", "notes"])
    x = x.select("doc_id", fields.alias("fields"), F.array_join(warnings, ";").alias("warnings"))
    return x.select("doc_id", F.explode("fields").alias("name", "value"), "warnings")


@query(f"SELECT doc_id, {_S12.format('text')} AS body FROM documents")
def s12_control_squeeze(spark, d):
    return _docs(spark, d).select("doc_id", T.control_squeeze(F.col("text")).alias("body"))


@query(r"SELECT doc_id, length(regexp_replace(t, '[^a-z]', '', 'g')) >= 200 AND length(regexp_replace(t, '[^ ]', '', 'g')) < 0.05 * length(regexp_replace(t, '[^a-z]', '', 'g')) AS lost FROM (SELECT doc_id, substr(text, 1, 4000) AS t FROM documents)")
def s13_spacing_lost(spark, d):
    return _docs(spark, d).select("doc_id", segments.spacing_lost(F.col("text"), "[^a-z]").alias("lost"))


@query("SELECT source, count(*) AS docs, count(DISTINCT text) AS texts, CAST(sum(CASE WHEN lang = 'en' THEN 1 ELSE 0 END) AS BIGINT) AS english, round(avg(CASE WHEN n_chars >= 1000 THEN 1.0 ELSE 0.0 END), 4) AS fill FROM documents GROUP BY 1")
def s14_s15_inventory(spark, d):
    return segments.inventory(_docs(spark, d))


@query(
    r"""WITH r AS (SELECT 'tag' AS kind, unnest(regexp_extract_all(html, '<([a-z0-9]+)', 1)) AS value FROM pages UNION ALL SELECT 'class', unnest(string_split_regex(c, ' +')) FROM (SELECT unnest(regexp_extract_all(html, 'class="([^"]*)"', 1)) AS c FROM pages)
      UNION ALL SELECT 'link', unnest(regexp_extract_all(html, '<a [^>]*href="/([A-Za-z]*)', 1)) FROM pages)
    SELECT kind, value, count(*) AS n FROM r WHERE value <> '' GROUP BY kind, value HAVING kind <> 'class' OR count(*) >= 5
    UNION ALL SELECT 'pages_with', 'table', count(*) FILTER (contains(html, '<table')) FROM pages UNION ALL SELECT 'pages_with', 'form', count(*) FILTER (contains(html, '<form')) FROM pages"""
)
def s16_site_recon(spark, d):
    return segments.page_recon(read_table(spark, d, "pages"), "html")


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS sha, length(text) AS n FROM documents")
def s17_append_new(spark, d):
    """Documents streamed into a sink twice: the second run, with a checkpoint of its own, finds every key done and adds nothing."""
    import uuid

    from quillstone.session import cut, shared_dir
    from quillstone.streaming.resume import append_new

    rows = cut(_docs(spark, d).select("doc_id", "text").withColumn("sha", T.fingerprint(F.col("text"))))
    base = f"{shared_dir(spark)}/quillstone-stream-{uuid.uuid4().hex}"
    for k in range(2):
        stream = spark.readStream.schema(rows.schema).parquet(rows.inputFiles()[0].rpartition("/")[0])
        append_new(stream, f"{base}/out", ["doc_id", "sha"], f"{base}/checkpoint{k}", lambda df: df.select("doc_id", "sha", F.length("text").cast("long").alias("n"))).awaitTermination()
    return spark.read.parquet(f"{base}/out")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def s17_s18_j4_resume(spark, d):
    """Rows whose (key, fingerprint) has no successful result yet: the anti join a resumed run starts from."""
    from quillstone.streaming.resume import pending

    docs = _docs(spark, d).select("doc_id", T.fingerprint(F.col("text")).alias("sha"))
    done = docs.join(read_table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    return pending(docs, done, ["doc_id", "sha"]).select("doc_id")


def _stub(run: int):
    """A deterministic caller: labels by length; every 5th row fails once, every 7th fails in the first run, every 11th always."""
    from quillstone.sources.calls import CallError

    def call(prompt: str, attempt: int) -> dict:
        head, _, text = prompt.partition("\n")
        k = int(head)
        if k % 11 == 0:
            raise CallError("refusal", again=False)
        if k % 7 == 0 and run == 1 or k % 5 == 0 and attempt == 1:
            raise CallError("timeout", f"attempt {attempt}")
        return {"output": {"label": ["major", "other", "rare"][len(text) % 3]}, "input_tokens": len(prompt) // 4, "output_tokens": 5}

    return call


@query(
    """WITH g AS (SELECT doc_id, text, doc_id || chr(10) || text AS prompt, doc_id % 11 = 0 AS refused FROM gold)
    SELECT doc_id, CASE WHEN NOT refused THEN ['major', 'other', 'rare'][length(text) % 3 + 1] END AS label, CASE WHEN refused THEN 'refusal' END AS error,
      CASE WHEN refused THEN 1 WHEN doc_id % 5 = 0 THEN 2 ELSE 1 END::INT AS attempts, CASE WHEN refused OR doc_id % 7 = 0 THEN 2 ELSE 1 END::INT AS run,
      round(CASE WHEN refused THEN 0e0 ELSE (length(prompt) // 4 * 3e0 + 5 * 15e0) / 1e6 END, 9) AS cost, substr(sha256(prompt), 1, 16) AS input_sha FROM g"""
)
def s19_structured_calls(spark, d):
    """Labels asked of a stub that fails now and then, in two runs: the second asks only for what failed in the first."""
    import uuid

    from quillstone.session import shared_dir
    from quillstone.sources.calls import latest, run_calls

    schema = {"type": "object", "required": ["label"], "properties": {"label": {"type": "string", "enum": ["major", "other", "rare"]}}}
    rows = run_sql(spark, d, "SELECT doc_id, text FROM gold").select("doc_id", F.concat_ws("\n", F.col("doc_id").cast("string"), "text").alias("prompt"))
    out = f"{shared_dir(spark)}/quillstone-calls-{uuid.uuid4().hex}"
    for run in (1, 2):
        run_calls(rows, out, _stub(run), schema, ["doc_id"], "prompt", price_in=3.0, price_out=15.0)
    return latest(spark.read.parquet(out), ["doc_id"]).select("doc_id", F.get_json_object("output", "$.label").alias("label"), "error", "attempts", "run", F.round("cost", 9).alias("cost"), "input_sha")


_SCHEMA_ROWS = """SELECT source, CASE WHEN count(*) % 2 = 0 THEN concat('{"type":"array","maxItems":', CAST(count(*) AS {0}), ',"items":{"tags":[{"minItems":1},{"uniqueItems":true}]}}') ELSE '{"type":"object","properties":{"a":{"enum":["maxItems"]}}}' END AS body FROM documents GROUP BY source"""


@query(
    f"""WITH s AS ({_SCHEMA_ROWS.replace("{0}", "VARCHAR")}) SELECT source, body, p.place::INT AS place, p.path AS path, p.remedy AS remedy
    FROM (SELECT source, body, unnest([{{'place': 1, 'path': '$.maxItems', 'remedy': 'cut the list afterwards'}}, {{'place': 2, 'path': '$.items.tags[0].minItems', 'remedy': 'check the list afterwards'}},
      {{'place': 3, 'path': '$.items.tags[1].uniqueItems', 'remedy': 'remove repeated entries afterwards'}}]) AS p FROM s WHERE body LIKE '%minItems%')"""
)
def s20_schema_problems(spark, d):
    """Output schemas, one a source, and what a structured-output service would refuse in them."""
    from quillstone.functions.schema import schema_problems

    return schema_problems(run_sql(spark, d, _SCHEMA_ROWS.replace("{0}", "STRING")), "body")


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def s1_s2_s4_jsonl(spark, d):
    """Documents written as JSON Lines to the shared folder and scanned again through a glob."""
    import uuid

    from quillstone.session import shared_dir
    from quillstone.sources.jsonl import read_jsonl, write_jsonl

    docs, path = _docs(spark, d), f"{shared_dir(spark)}/quillstone-jsonl-{uuid.uuid4().hex}"
    write_jsonl(docs, path)
    return read_jsonl(spark, f"{path}/*.json", docs.schema)


@query("SELECT CAST(to_json({'source': source, 'docs': count(*)}) AS VARCHAR) AS report FROM documents GROUP BY source")
def s3_report(spark, d):
    from quillstone.sources.jsonl import report

    return report(_docs(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("docs")))
