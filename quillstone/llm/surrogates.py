"""PII surrogates: detected entities get keyed replacements of the same type, gender, script and format."""

from __future__ import annotations

import hashlib
import hmac
import re
from bisect import bisect_left
from collections import Counter
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import append_columns, spread
from quillstone.session import cut

# Honorifics by gender, and given names by script and gender.
HONORIFICS = {"m": ("Mr", "Herr", "Monsieur", "Sr", "Señor", "г-н"), "f": ("Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Mlle", "Sra", "Señora", "г-жа"), "n": ("Dr", "Prof")}
GIVEN = {
    ("latin", "m"): ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Martin", "Noel", "Oscar", "Paul"),
    ("latin", "f"): ("Ada", "Bella", "Clara", "Dora", "Emma", "Flora", "Greta", "Helen", "Ida", "Julia", "Klara", "Laura", "Maria", "Nora", "Olga", "Paula"),
    ("cyrillic", "m"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл"),
    ("cyrillic", "f"): ("Анна", "Белла", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Клара"),
}
_SYLLABLES = {"latin": ("ba", "den", "fo", "gar", "hel", "ker", "lo", "mar", "nes", "po", "ris", "son", "tal", "vik", "wen", "zor"), "cyrillic": ("ба", "вен", "го", "дар", "жел", "кер", "ло", "мар", "нес", "по", "рис", "сон", "тал", "вик", "фен", "зор")}

_UP, _LOW = "A-ZÀ-ÖØ-ÞА-ЯЁ", "a-zß-öø-ÿа-яё"
# Small words of family names, and words of the calendar, which are names only after a title.
PARTICLES = ("al", "bin", "da", "de", "del", "den", "der", "di", "du", "el", "la", "le", "ten", "ter", "van", "von", "zu")
CALENDAR = (
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
    "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday",
)
_HONORIFICS = {form: g for g, hs in HONORIFICS.items() for h in hs for form in (h, h.upper())}
_TITLE = "|".join(sorted(_HONORIFICS, key=lambda h: (-len(h), h)))
_SECRET = re.compile(r"""(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key)\b["']?\s*[=:]\s*["']?)([^\s"',;]{6,})""")
_EMAIL = re.compile(r"[A-Za-z0-9][\w.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_ACCESS = re.compile(r"\bAKIA[0-9A-Z]{12,20}\b")
_IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)\b")
_IP6 = re.compile(r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:.])")
#: Entities of digits, looked for only in stretches of digits and the signs between them.
_STRETCH = re.compile(r"[+(]?[0-9](?:[0-9 ().-]*[0-9])?")
_DIGITS = re.compile(
    r"""
    (?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d|[A-Za-z_]))
  | (?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))
  | (?P<card>(?<![\w.-])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{13,19})(?![\w-]))
  | (?P<phone>(?<![\w.+-])(?:
        \+\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d{2,4}){2,5}     # with a country code
      | (?:1[ .-])?\(\d{2,5}\)[ .-]?\d{3,4}(?:[ .-]\d{2,4}){1,2}  # with an area code in brackets
      | (?:1[ .-])?[2-9]\d{2}([.-])[2-9]\d{2}\5\d{4}              # area, exchange and number
      | (?:1[ ])?[2-9]\d{2}[ ]\d{3}[ ]\d{4}                      # the same set apart by spaces
      | 0\d{1,4}[ -]\d{2,4}(?:[ -]\d{2,4}){1,3}                   # with the trunk digit
    )(?![\w-]|\.\d))
    """,
    re.VERBOSE,
)
#: A word of a name: inner capitals, apostrophes before capitals and hyphens are parts of it, a genitive's ending is not.
_PART = rf"[{_UP}](?:[{_UP}{_LOW}]|['’](?![sS]\b)[{_UP}])+"
_WORD = rf"(?:(?:{'|'.join(PARTICLES)})\s+)*{_PART}(?:-{_PART})*"
#: One title or several, initials, and up to three words with their particles.
_NAME = re.compile(rf"\b(?P<titles>(?:(?:{_TITLE})(?:\.\s*|\s+))+)(?:[{_UP}]\.\s*)*(?P<name>{_WORD}(?:\s+(?:[{_UP}]\.\s+)?{_WORD}){{0,2}})")
_HYPHENED = re.compile(rf"[{_UP}][\w'’]*-$")
_RELEASE = re.compile(r"(?i:\b(?:version|ver|v|release|build|firmware)\.?\s*)$")
_WORDS_OF_SECRETS = ("password", "passwd", "pwd", "secret", "token", "api")
_DATE = re.compile(r"(?:\d{4}([ .-])\d{1,2}\1\d{1,2}|\d{1,2}([ .-])\d{1,2}\2\d{4})$")


def _check97(iban: str) -> int:
    """The number an IBAN stands for, modulo 97; 1 when its check digits hold."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _is_phone(said: str) -> bool:
    """Whether digits that look like a phone number are one: 8 to 15 of them, 9 without a country code, no date, and no number grouped by threes."""
    n = sum(c.isdigit() for c in said)
    return (8 if said[0] == "+" else 9) <= n <= 15 and not _DATE.match(said) and not re.fullmatch(r"\d{3}(?: \d{3})+", said)


def _is_card(digits: str) -> bool:
    """Whether digits without gaps are a card's: a valid last digit, or sixteen of them, but for a mere count (1234...)."""
    return _luhn_sum(digits) % 10 == 0 or len(digits) == 16 and any((int(b) - int(a)) % 10 != 1 for a, b in zip(digits, digits[1:]))


def _person(name: str) -> tuple[list[str], str]:
    """Given names and the family name (from its first particle on) of a folded name; a family name alone has no given ones."""
    words = [w for w in name.split() if not w.endswith(".")]
    at = next((i for i, w in enumerate(words) if w in PARTICLES), len(words) - 1)
    return words[:at], " ".join(words[at:])


def _forms(name: str) -> tuple[set[str], set[str]]:
    """How a person with a full name is called beside it: by family name (whole, without particles, with the first name), and by given names."""
    given, family = _person(name)
    return {family, family.split()[-1], f"{given[0]} {family}"}, {*given, " ".join(given)}


def _by_person(text: str, spans: list, titled: list[tuple[int, int, str, str]]) -> list:
    """The name spans of a text with titled names (start, end, gender, name), and its mentions without a title outside spans.

    A full name is one person for each gender its titles give; a family name alone is the one person of that name and gender, else its own.
    Capital initials are asked for, so a word that is also a name is replaced where it is written like one; words of the calendar, and parts of
    longer hyphenated names, are not.
    """
    full: dict[str, set[str]] = {}
    lone: dict[str, set[str]] = {}
    for _, _, g, name in titled:
        (full if _person(name)[0] else lone).setdefault(name, set()).add(g)
    bearers = Counter(_person(name)[1] for name in full)
    by_family: dict[str, list[str]] = {}
    by_given: dict[str, list[str]] = {}
    for name, gs in full.items():
        family = _person(name)[1]
        told = lone.get(family, set()) - {"n"}
        full[name] = gs - {"n"} or (told if bearers[family] == 1 and len(told) == 1 else {"n"})
        for index, forms in zip((by_family, by_given), _forms(name)):
            for form in forms:
                index.setdefault(form, []).append(name)

    @cache
    def key(name: str, g: str) -> str:
        if name in full:
            return f"{g if g in full[name] else min(full[name])}:{name}"
        for index in (by_family, by_given):
            fits = [(n, x) for n in index.get(name, ()) for x in sorted(full[n]) if "n" in (g, x) or g == x]
            if len(fits) == 1:
                return f"{fits[0][1]}:{fits[0][0]}"
        gs = lone.get(name, set()) - {"n"}
        return f"{g if g != 'n' or len(gs) != 1 else min(gs)}:{name}"

    out = spans + [(a, b, "name", key(name, g)) for a, b, g, name in titled]
    taken = sorted((a, b) for a, b, _, _ in out)
    said = {" ".join(text[a:b].split()) for a, b, _, _ in titled}
    forms = {*said, *lone, *full, *by_family, *by_given} - {*CALENDAR, *(x.title() for x in CALENDAR), *(x.upper() for x in CALENDAR)}
    any_form = re.compile(r"(?<!\w)(?:" + "|".join(r"\s+".join(re.escape(w) for w in x.split()) for x in sorted(forms, key=lambda x: (-len(x), x)) or ["(?!)"]) + r")(?!\w)", re.IGNORECASE)
    at = 0
    for m in any_form.finditer(text):
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        words = m[0].split()
        inside = text[m.end() : m.end() + 1] == "-" and text[m.end() + 1 : m.end() + 2].isupper() or _HYPHENED.search(text, max(0, m.start() - 40), m.start())
        if (at == len(taken) or taken[at][0] >= m.end()) and not inside and words[-1][0].isupper() and all(w[0].isupper() or w in PARTICLES for w in words):
            out.append((m.start(), m.end(), "name", key(" ".join(m[0].casefold().split()), "n")))
    return sorted(out)


def _unnamed(text: str) -> list[tuple[int, int, str, str]]:
    """Entities other than names; each pattern runs only where a sign of it stands in the text."""
    found = []
    if "=" in text or ":" in text:
        low = text.lower()
        if any(w in low for w in _WORDS_OF_SECRETS):
            found += [(m.start(1), m.end(1), "secret", m[1]) for m in _SECRET.finditer(text)]
    if "@" in text:
        found += [(m.start(), m.end(), "email", m[0].lower()) for m in _EMAIL.finditer(text)]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access", m[0]) for m in _ACCESS.finditer(text)]
    digits = False
    for stretch in _STRETCH.finditer(text):
        digits = True
        if stretch.end() - stretch.start() < 7:
            continue
        for m in _DIGITS.finditer(text, stretch.start(), min(len(text), stretch.end() + 2)):
            kind = m.lastgroup if m.lastgroup else "phone"
            key = re.sub(r"\D", "", m[0])
            if kind == "ip":
                if _RELEASE.search(text, max(0, m.start() - 16), m.start()):
                    continue
                key = m[0]
            elif kind == "card" and key == m[0] and not _is_card(key):
                continue  # a long number
            elif kind == "phone":
                if not _is_phone(m[0]):
                    continue
                key = "+" * (m[0][0] == "+") + key
            found.append((m.start(), m.end(), kind, key))
    if digits:
        for m in _IBAN.finditer(text):
            if _check97(key := m[0].replace(" ", "")) == 1:
                found.append((m.start(), m.end(), "iban", key))
    if "::" in text or text.count(":") >= 7:
        found += [(m.start(), m.end(), "ip6", m[0].lower()) for m in _IP6.finditer(text) if any(c.isdigit() for c in m[0])]
    out: list[tuple[int, int, str, str]] = []
    for x in sorted(found, key=lambda x: (x[0], -x[1])):  # of overlapping ones the first, then the longest
        if not out or out[-1][1] <= x[0]:
            out.append(x)
    return out


def find_entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, key) of the entities of a text in order; mentions of one entity have one key whatever their format.

    Types: secret (a value given for a password, token or key), email, access (a cloud key's id), iban (with valid check digits), ip, ip6, ssn,
    card (in groups, of 16 digits, or with a valid last digit), phone, name (up to three words after one title or several, and all its mentions in
    the text). Dates, versions and lists of numbers are none of them; initials before a name stay. A title in capitals needs a name in capitals.
    """
    out = _unnamed(text)
    titled = []
    if any(h in text for h in _HONORIFICS):
        for m in _NAME.finditer(text):
            titles = re.split(r"[.\s]+", m["titles"].strip(". \t\r\n"))
            words = list(re.finditer(r"\S+", m["name"]))
            while len(words) > 1 and words[-1][0].casefold() in CALENDAR:
                words.pop()
            a, b = m.start("name"), m.start("name") + words[-1].end()
            if all(len(t) > 1 and t.isupper() for t in titles) and not text[a:b].isupper():
                continue
            gender = next((g for t in titles if (g := _HONORIFICS.get(t, "n")) != "n"), "n")
            if not any(x < b and a < y for x, y, _, _ in out[max(0, bisect_left(out, (a,)) - 1) :][:2]):
                titled.append((a, b, gender, " ".join(w for w in text[a:b].casefold().split() if not w.endswith("."))))
    return _by_person(text, out, titled) if titled else out


def _stream(secret: bytes, *parts: object):
    """Endless keyed bytes."""
    k, base = 0, "\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass")
    while True:
        yield from hmac.digest(secret, base + b"\x1f%d" % k, hashlib.sha256)
        k += 1


def _like(s: str, stream) -> str:
    """A string of the same character classes; hexadecimal stays hexadecimal."""
    hexadecimal = re.fullmatch(r"[0-9a-fA-F]+", s) and not s.isdigit()
    out = []
    for c in s:
        if "0" <= c <= "9":
            out.append(chr(48 + next(stream) % 10))
        elif c.isalpha():
            base, span = (("а", 32) if "а" <= c.lower() <= "я" else ("a", 6 if hexadecimal else 26))
            new = chr(ord(base) + next(stream) % span)
            out.append(new.upper() if c.isupper() else new)
        else:
            out.append(c)
    return "".join(out)


def _luhn_sum(digits: str) -> int:
    return sum(d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2) for i, d in enumerate(map(int, reversed(digits))))


def surrogate(secret: bytes, kind: str, key: str, attempt: int = 0) -> str:
    """The replacement's key for an entity's key; the same for every mention anywhere, different for each attempt.

    Later attempts are longer, so there are always enough: names and mail names from the second on, other formats, which are kept
    as long as they can be, from the fourth. Addresses, all of which are open to each, become those of the longer kind from the 16th.
    """
    stream = _stream(secret, kind, key, attempt)
    if kind == "email":
        local, _, domain = key.rpartition("@")
        labels = domain.split(".")
        hosts = [_like(x, _stream(secret, "host", x)) for x in labels[:-1]]  # one domain keeps one surrogate
        return f"{_like(local + 'x' * (attempt // 2), stream)}@{'.'.join([*hosts, labels[-1]])}"
    if kind == "ip6" or kind == "ip" and attempt >= 16:
        groups = ["%x" % (next(stream) * 256 + next(stream)) for _ in range(6)]
        return ":".join(["2001", "db8", *groups])  # the prefix set aside for examples
    if kind == "ip":
        return ".".join(str(1 + next(stream) % 254) for _ in range(4))
    if kind == "access":
        return key[:4] + _like(key[4:] + "0" * (attempt // 4), stream)
    if kind == "iban":
        body = _like(key[4:] + "0" * (attempt // 4), stream)
        return f"{key[:2]}{98 - _check97(key[:2] + '00' + body):02d}{body}"
    if kind in ("phone", "card", "ssn"):
        sign, digits = key[: key[0] == "+"], key.lstrip("+")
        new = digits[0] + _like(digits[1:] + "0" * (attempt // 4), stream)
        if kind == "card" and _luhn_sum(digits) % 10 == 0:
            new = new[:-1] + "0"
            new = new[:-1] + str(-_luhn_sum(new) % 10)
        return sign + new
    if kind == "name":
        gender, _, name = key.partition(":")
        script = "cyrillic" if re.search("[а-яё]", name) else "latin"
        given = GIVEN[script, gender if gender in "mf" else "mf"[next(stream) % 2]]
        family = "".join(_SYLLABLES[script][next(stream) % 16] for _ in range(4 + attempt // 2))
        return f"{gender}:" + (f"{given[next(stream) % len(given)].casefold()} {family}" if _person(name)[0] else family)
    return _like(key + "0" * (attempt // 4), stream)


def _distinct(kind: str, key: str) -> str:
    """What no two entities may share: of a name the family name, as it also stands alone."""
    return re.split("[ :]", key)[-1] if kind == "name" else key


def render(kind: str, key: str, mention: str, entity: str = "") -> str:
    """A surrogate key in the format of the mention it replaces; entity is the key of what is replaced."""
    if kind in ("phone", "card", "ssn"):
        digits = iter(key.lstrip("+"))
        return "".join(next(digits) if c.isdigit() else c for c in mention) + "".join(digits)
    if kind == "iban" and " " in mention:
        return " ".join(key[i : i + 4] for i in range(0, len(key), 4))
    if kind == "name":
        new, said = key.partition(":")[2].split(), " ".join(w for w in mention.casefold().split() if not w.endswith("."))
        given, family = _person(entity.partition(":")[2])
        if len(new) == 2 and said in (family, family.split()[-1]):
            new = new[1:]
        elif len(new) == 2 and said in (*given, " ".join(given)):
            new = new[:1]
        return " ".join(new).upper() if len(mention) > 1 and mention.isupper() else " ".join(new).title()
    if kind == "email" and mention != mention.lower():
        return key.upper() if mention == mention.upper() else key
    return key


def _entities(batches):
    for b in batches:
        ids, kinds, keys = [], [], []
        for i, t in zip(b.column(0), b.column(1)):
            for kind, key in sorted({(k, v) for _, _, k, v in find_entities(t.as_py() or "")}):
                ids.append(i)
                kinds.append(kind)
                keys.append(key)
        if ids:
            yield pa.record_batch([pa.array([i.as_py() for i in ids], b.column(0).type), pa.array(kinds), pa.array(keys)], names=["id", "kind", "key"])


def assign(found: DataFrame, secret: bytes) -> DataFrame:
    """(kind, key, attempt) for all entities, where no two share a surrogate and no surrogate is itself an entity of the corpus.

    Rounds go on while any collide; each draws the few that do again, and later draws are longer, so the rounds end.
    """

    def made(batches):
        for b in batches:
            rows = zip(*(c.to_pylist() for c in b.columns))
            yield pa.record_batch([*b.columns, pa.array([_distinct(k, surrogate(secret, k, v, n)) for k, v, n in rows], pa.string())], names=["kind", "key", "attempt", "new"])

    held = cut(found.select("kind", "key").distinct().withColumn("attempt", F.lit(0)))
    real = held.select("kind", F.when(F.col("kind") == "name", F.element_at(F.split("key", "[ :]"), -1)).otherwise(F.col("key")).alias("new"))
    while True:
        tried = cut(held.mapInArrow(made, "kind string, key string, attempt int, new string"))
        shared = tried.groupBy("kind", "new").agg(F.min("key").alias("owner"), F.count(F.lit(1)).alias("c")).filter("c > 1")
        again = tried.join(shared, ["kind", "new"]).filter("key <> owner").select("kind", "key")
        again = cut(again.union(tried.join(real, ["kind", "new"], "left_semi").select("kind", "key")).distinct().withColumn("more", F.lit(1)))
        if again.isEmpty():
            return held
        held = cut(held.join(again, ["kind", "key"], "left").select("kind", "key", (F.col("attempt") + F.coalesce("more", F.lit(0))).alias("attempt")))


def replace_entities(docs: DataFrame, secret: bytes, id_col: str = "doc_id", text_col: str = "text", most_broadcast: int = 50_000) -> DataFrame:
    """docs' ids and texts with every entity replaced: id, text, n_entities (mentions), kinds (sorted, distinct).

    A surrogate depends on the secret, the type and the entity, so all mentions of an entity in the corpus agree without a
    join; of names, those within a document that a title there connects. Surrogates of distinct entities, and surrogates and real entities, are
    checked for collisions over the whole corpus; the few that collide are drawn again. Up to most_broadcast of those travel to
    every task as a dictionary, more reach the documents that hold them in a join: the same result either way.

    Null text stays null with no entities; texts without entities are returned byte for byte. Null ids and repeated rows are replaced
    like any other. An empty table gives an empty result; further columns are ignored.
    """
    rows = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")))
    kind = rows.schema["id"].dataType.simpleString()
    found = cut(rows.mapInArrow(_entities, f"id {kind}, kind string, key string"))
    fixes = cut(assign(found, secret).filter("attempt > 0"))
    few = fixes.limit(most_broadcast + 1).collect()
    known = {(r.kind, r.key): r.attempt for r in few}
    if len(few) > most_broadcast:
        known = {}
        pairs = found.join(fixes, ["kind", "key"]).select("id", F.concat("kind", F.lit("\x1f"), "key").alias("k"), "attempt").distinct()
        own = pairs.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("k", "attempt"))).alias("fix"))
        rows = rows.join(own.withColumnRenamed("id", "own_id"), F.col("id").eqNullSafe(F.col("own_id")), "left").drop("own_id")

    def make():
        def fn(texts, table):
            fix = table.column("fix").to_pylist() if "fix" in table.schema.names else [None] * len(texts)
            valid = table.column("text").is_valid().to_pylist()
            out, counts, kinds = [], [], []
            for raw, own, ok in zip(texts, fix, valid):
                text = raw.decode("utf-8", "surrogatepass")
                parts, at, seen = [], 0, set()
                spans = find_entities(text)
                own = dict(own or ())
                for a, b, k, v in spans:
                    n = known.get((k, v), own.get(f"{k}\x1f{v}", 0))
                    parts += [text[at:a], render(k, surrogate(secret, k, v, n), text[a:b], v)]
                    at = b
                    seen.add(k)
                out.append("".join([*parts, text[at:]]) if ok else None)
                counts.append(len(spans))
                kinds.append(sorted(seen))
            return [pa.array(out, pa.string()), pa.array(counts, pa.int64()), pa.array(kinds, pa.list_(pa.string()))]

        return fn

    done = append_columns(rows, "text", "masked string, n_entities long, kinds array<string>", make)
    return done.select(F.col("id").alias(id_col), F.col("masked").alias("text"), "n_entities", "kinds")
