"""Text scalars as Spark columns: cleaning, normalising, masking, marks, bands, keyword and verdict rules, grounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes of the normalisers, and patterns the labels are defined by.
INVISIBLE = "[\\x{0}-\\x{8}\\x{b}-\\x{1f}\\x{7f}\\x{ad}\\x{200b}-\\x{200f}\\x{2028}\\x{2029}\\x{2044}\\x{2244}\\x{feff}]"
BULLETS = "[□○◦▪●·•▶◆∙]"
SPACE = "[\\s\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
ZERO_WIDTH_SPACE = SPACE[:-1] + "\\x{200b}\\x{feff}]"
LEAK = r"(비조치|조치하지\s*않|제재하지\s*않|조치(?:를)?\s*(?:취하|하)(?:지\s*않|기로))\s*(?:를|을|이|가|의|에|은|는)?\s*"
LEADING_FIELD = r"^\s*행위\s*\n"
SERIAL_MARK = r"일련번호\s*[:：]?\s*\d{6}"
DATE_MARKS = (
    r"20\d{2}\s*[.\-년]\s*\d{1,2}\s*[.\-월]?\s*(?:말)?\s*\d{0,2}\s*[.일]?",
    r"['’‘]\s?\d{2}\s*\.\s*\d{1,2}\s*\.\s*(?:\d{1,2}\s*\.)?",
    r"\d{1,2}\s*월\s*말",
)
DATE_TOKEN = " 〈기한〉 "
CIRCLED = ("①②③④⑤⑥⑦⑧⑨⑩", "➀➁➂➃➄➅➆➇➈➉", "❶❷❸❹❺❻❼❽❾❿", "➊➋➌➍➎➏➐➑➒➓", "⑴⑵⑶⑷⑸⑹⑺⑻⑼⑽")
#: All of CIRCLED as three ranges, which a pattern tests a character against at once.
CIRCLED_CLASS = "[①-⑩⑴-⑽❶-➓]"
TEXT_MARK = r"[(<\[]?\s*질\s*의\s*(\d)\s*[.):>\]]"
TRUST, DOUBT = 0.60, 0.15
HIGH_MARGIN, MEDIUM_MARGIN = 0.30, 0.10
CONFIDENCE = {"high": 3, "medium": 2, "low": 1, "?": 0}
TAIL_CHARS = 300
UNREAD = "미분류"
VERDICTS = {
    "판단유보": r"(개별적으로\s*판단|구체적\s*사실관계|사실관계에\s*따라|일률적으로\s*(말하기|판단하기)|답변\s*(드리기\s*)?어렵|소관\s*(사항\s*)?이\s*아니|판단할\s*사항이\s*아니|해당\s*기관에\s*문의|별도\s*검토가\s*필요)",
    "조건부": r"((?:요건|조건)을?\s*(?:갖춘|충족(?:하는|한)|모두\s*충족)[^.]{0,40}?(?:경우에\s*한(?:하여|해)|한(?:하여|해)|경우에는)|다만[^.]{0,60}?(?:경우에\s*한|한(?:하여|해)\s*(?:가능|허용))|(?:하는|한)\s*경우에\s*한(?:하여|해)\s*(?:가능|허용|인정))",
    "부정": r"(해당하지\s*(?:않는|아니)|포함되지\s*(?:않는|아니)|볼\s*수\s*없|허용되지\s*(?:않|아니)|가능하지\s*(?:않|아니)|할\s*수\s*없|위반(?:에\s*해당|됩니다|입니다)|불가(?:능)?(?:합니다|하다|한\s*것))",
    "긍정": r"(해당(?:하는\s*것으로\s*(?:보|판단)|합니다|됩니다|한다고\s*보)|포함(?:되는\s*것으로|됩니다)|가능(?:합니다|하다고|한\s*것으로)|허용(?:됩니다|되는\s*것으로|할\s*수)|볼\s*수\s*있|할\s*수\s*있(?:습니다|는\s*것으로)|무방(?:합니다|하다))",
}


def _drop(text: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(text, pattern, by)


def clean_for_prompt(text: Column) -> Column:
    """Invisible characters gone, blanks and line breaks collapsed, bullets kept."""
    out = _drop(F.coalesce(text, F.lit("")), INVISIBLE)
    return F.regexp_replace(_drop(_drop(out, "[ \t]+", " "), "\n{3,}", "\n\n"), f"^{SPACE}+|{SPACE}+$", "")


def normalize_for_match(text: Column) -> Column:
    """Invisible characters, bullets and all white space gone; the form quotations are compared in."""
    return _drop(_drop(_drop(F.coalesce(text, F.lit("")), INVISIBLE), BULLETS), f"{SPACE}+")


def squeeze(text: Column) -> Column:
    """All (Unicode) white space gone."""
    return _drop(F.coalesce(text, F.lit("")), f"{SPACE}+")


def normalize_grams(text: Column) -> Column:
    """White space, zero-width spaces and byte-order marks gone; the form n-grams are cut from."""
    return _drop(F.coalesce(text, F.lit("")), f"{ZERO_WIDTH_SPACE}+")


def control_squeeze(text: Column) -> Column:
    """Control characters but line breaks gone, blanks collapsed, at most two line breaks, white space trimmed from both ends."""
    out = _drop(F.coalesce(text, F.lit("")), "[\\x{0}-\\x{9}\\x{b}-\\x{1f}]")
    return _drop(_drop(_drop(out, " +", " "), "\n{3,}", "\n\n"), "(?U)^\\s+|\\s+$")


def length_bucket(text: Column) -> Column:
    n = F.char_length(squeeze(text))
    return F.when(n < 200, "short").when(n < 600, "medium").otherwise("long")


def similarity_band(similarity: Column) -> Column:
    return F.when(similarity >= TRUST, "trust").when(similarity >= DOUBT, "middle").otherwise("doubt")


def margin_grade(margin: Column) -> Column:
    return F.when(margin >= HIGH_MARGIN, "high").when(margin >= MEDIUM_MARGIN, "medium").otherwise("low")


def confidence_rank(confidence: Column) -> Column:
    """3, 2, 1 for high, medium, low; 0 for anything else, null included."""
    out = F.lit(0)
    for name, rank in CONFIDENCE.items():
        out = F.when(confidence == name, rank).otherwise(out)
    return out


def year_of(source: Column) -> Column:
    return F.nullif(F.regexp_extract(source, r"20\d{2}", 0), F.lit("")).cast("int")


def mask_leaks(text: Column, pattern: str = LEAK) -> tuple[Column, Column]:
    """The text with every conclusion word (and its particle) replaced by a blank, and how many there were."""
    return F.regexp_replace(text, pattern, " "), F.regexp_count(text, F.lit(pattern))


def clean_gold(text: Column) -> Column:
    out = _drop(_drop(F.coalesce(text, F.lit("")), INVISIBLE), LEADING_FIELD)
    return F.regexp_replace(_drop(out, "[ \t]+", " "), f"^{SPACE}+|{SPACE}+$", "")


def group_key(text: Column) -> Column:
    """What rows of one case share: serial and date marks replaced, then normalised."""
    out = _drop(F.coalesce(text, F.lit("")), SERIAL_MARK, " ")
    for pattern in DATE_MARKS:
        out = _drop(out, pattern, DATE_TOKEN)
    return normalize_for_match(out)


def fingerprint(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def keyword_label(text: Column, rules: list[tuple[str, str]], majority: str) -> tuple[Column, Column, Column]:
    """(label, rule, confidence) of the first pattern that occurs; the majority label with low confidence if none does."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", " "))
    label, rule, confidence = F.lit(majority), F.lit("fallback:majority"), F.lit("low")
    for name, pattern in reversed(rules):
        hit = flat.rlike(pattern)
        label, rule, confidence = F.when(hit, name).otherwise(label), F.when(hit, f"rule:{name}").otherwise(rule), F.when(hit, "high").otherwise(confidence)
    return label, rule, confidence


def verdict(answer: Column, patterns: dict[str, str] | None = None) -> tuple[Column, Column]:
    """(verdict, rule) from the last TAIL_CHARS characters: abstention, then a condition, then the later of denial and affirmation."""
    p = patterns or VERDICTS
    abstain, conditional, deny, affirm = list(p)
    flat = F.trim(F.regexp_replace(F.coalesce(answer, F.lit("")), f"{SPACE}+", " "))
    tail = F.right(flat, F.lit(TAIL_CHARS))
    no, yes = F.regexp_instr(tail, F.lit(p[deny])), F.regexp_instr(tail, F.lit(p[affirm]))
    cases = [
        (flat == "", UNREAD, "empty"),
        (tail.rlike(p[abstain]), abstain, "abstain"),
        (tail.rlike(p[conditional]), conditional, "conditional"),
        ((no > 0) & (yes > 0) & (no > yes), deny, "deny>affirm"),
        ((no > 0) & (yes > 0), affirm, "affirm>deny"),
        (no > 0, deny, "deny"),
        (yes > 0, affirm, "affirm"),
    ]
    label, rule = F.lit(UNREAD), F.lit("no_match")
    for when, name, why in reversed(cases):
        label, rule = F.when(when, name).otherwise(label), F.when(when, why).otherwise(rule)
    return label, rule


def quote_grounded(quote: Column, source: Column) -> Column:
    """Whether a quotation stands in the source, typography aside; an empty quotation does not."""
    q = normalize_for_match(quote)
    return (q != "") & normalize_for_match(source).contains(q)


def evidence_grounded(evidence: Column, source: Column) -> Column:
    """Whether evidence stands in the source, white space aside; empty evidence does."""
    return squeeze(source).contains(squeeze(evidence))


def sequence_marks(text: Column) -> Column:
    """The first chain 1, 2, 3 ... of enumeration marks as array of {pos, num} (0-based positions); empty when shorter than two."""
    every = CIRCLED_CLASS + r"|(?=[(<\[\s질])" + TEXT_MARK.replace("(\\d)", "\\d")
    gaps, marks = F.split(text, every, -1), F.regexp_extract_all(text, F.lit(every), F.lit(0))
    number = lambda m: F.when(F.char_length(m) == 1, F.pmod(F.instr(F.lit("".join(CIRCLED)), m) - 1, F.lit(10)) + 1).otherwise(F.regexp_extract(m, r"(\d)", 1).cast("int"))
    start = F.struct(F.lit(0).alias("at"), F.lit(1).alias("want"), F.array().cast("array<struct<pos:int,num:int>>").alias("out"))

    def step(s, x):
        pos, num = s["at"] + F.char_length(x["gap"]), x["num"]
        hit = num == s["want"]
        return F.struct(
            (pos + F.char_length(x["mark"])).alias("at"),
            F.when(hit, s["want"] + 1).otherwise(s["want"]).alias("want"),
            F.when(hit, F.concat(s["out"], F.array(F.struct(pos.alias("pos"), num.alias("num"))))).otherwise(s["out"]).alias("out"),
        )

    # zipped, so the text is split once and not once a mark; the gap after the last mark has none
    pairs = F.zip_with(gaps, marks, lambda g, m: F.struct(g.alias("gap"), m.alias("mark"), number(m).cast("int").alias("num")))
    chain = F.aggregate(F.filter(pairs, lambda x: x["mark"].isNotNull()), start, step)["out"]
    return F.when(F.size(chain) >= 2, chain).otherwise(F.array().cast("array<struct<pos:int,num:int>>"))


def slice_by_marks(text: Column, marks: Column) -> Column:
    """The trimmed text from each mark to the next, as array of {num, part}."""
    end = lambda i: F.when(i + 1 < F.size(marks), F.element_at(marks, (i + 2).cast("int"))["pos"]).otherwise(F.char_length(text))
    return F.when(F.size(marks) == 0, F.array().cast("array<struct<num:int,part:string>>")).otherwise(
        F.transform(marks, lambda m, i: F.struct(m["num"].alias("num"), F.trim(F.substring(text, m["pos"] + 1, end(i) - m["pos"])).alias("part")))
    )
