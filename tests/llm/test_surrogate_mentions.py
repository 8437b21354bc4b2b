"""Mentions of one person agree with and without titles, and surrogates never run out."""

import re

from quillstone.llm import surrogates as s

KEY = b"k"


def _masked(text):
    parts, at = [], 0
    for a, b, k, v in s.find_entities(text):
        parts += [text[at:a], s.render(k, s.surrogate(KEY, k, v), text[a:b], v)]
        at = b
    return "".join([*parts, text[at:]])


def test_all_mentions_of_a_person_have_one_key():
    text = "Mr John Smith came. Then Smith said, and Dr Smith too; John Smith's dog, SMITH, a smith, Smithson. John left."
    assert {k for *_, k in s.find_entities(text)} == {"m:john smith"} and len(s.find_entities(text)) == 6
    out = _masked(text)
    given, family = re.match(r"Mr (\w+) (\w+) came", out).groups()
    assert out == f"Mr {given} {family} came. Then {family} said, and Dr {family} too; {given} {family}'s dog, {family.upper()}, a smith, Smithson. {given} left."


def test_genders_and_shared_family_names():
    keys = lambda t: [k for *_, k in s.find_entities(t)]
    assert keys("Mr John Smith, Mrs Anna Smith: Mr Smith, Mrs Smith") == ["m:john smith", "f:anna smith"] * 2
    assert keys("Dr Ann Lee and Mrs Lee, Lee") == ["f:ann lee"] * 3
    assert keys("Prof Stone, Mrs Stone, Stone") == ["f:stone"] * 3
    assert keys("Herr Weiß, dann Weiß") == ["m:weiss"] * 2
    assert keys("Smith and John Smith stand alone, 4") == []


def test_later_attempts_are_longer_and_end(spark):
    found = spark.createDataFrame([(0, "email", f"{c}@x.org") for c in "abcdefghijklmnopqrstuvwxyz"], "id long, kind string, key string")
    rows = s.assign(found, KEY).collect()  # all one-letter names are taken: none is left for a surrogate of one letter
    new = {s.surrogate(KEY, r.kind, r.key, r.attempt) for r in rows}
    assert len(rows) == 26 == len(new)
    assert len(s.surrogate(KEY, "name", "m:smith", 8)) > len(s.surrogate(KEY, "name", "m:smith", 0))
    assert len(s.render("ssn", s.surrogate(KEY, "ssn", "123456789", 4), "123-45-6789")) == 12


def test_family_names_are_distinct(spark):
    found = spark.createDataFrame([(0, "name", f"m:ab{i} cd{i}") for i in range(3000)], "id long, kind string, key string")
    rows = s.assign(found, KEY).collect()
    assert len({s.surrogate(KEY, r.kind, r.key, r.attempt).split()[-1] for r in rows}) == 3000
