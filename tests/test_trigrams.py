"""Browsing by the trigram index against a plain scan."""

import random
import re

import pytest
from pyspark.sql import functions as F

from wosearch.operators import trigrams
from wosearch.operators.inspection import browse
from wosearch.operators.trigrams import BrowseIndex, condition_of
from wosearch.schema import SEQ

TEXTS = [
    "Pump leaks in room 12", "pumping station", "PUMP-LEAK", "\u212aelvin pump", "mi\u017ftake", "D\u0130SK", "d\u0131sk", "\u03a3\u03c3\u03c2 sigma",
    "a.b", "axb", "foo\nbar", "foobar", "fire alarm, fire door", "fir", "fi", "", None, "ab]c", "x[y", "caf\u00e9 roof", "CAF\u00c9",
    "heating heating heating", "hheeaattiinngg", "tab\there", "1234-5678", "a\\b", "pu mp", "\U0001f525\U0001f525\U0001f525 fire", "stra\u00dfe", "STRASSE",
]
PATTERNS = [
    "pump", "PUMP", "pump|fire", "pump.*leak", "(pump|fire) ?(door|leak)s?", "^pump", "leak$", "kelvin", "mistake", "disk", "sigma",
    "\u03c3\u03c2", "a\\.b", "a.b", "foo.bar", "(?s)foo.bar", "foo\\nbar", "fo{2}bar", "(fire.*){2}", "(heating ?){3}", "h{2}e{2}", "[pf]i?re",
    "[^p]ump", "\\d{4}-\\d{4}", "\\bpump\\b", "(?=pump)pu", "(?!x)fire", "caf\u00e9", "stra\u00dfe", "\\Qa.b\\E", "[a[b]x]b", "[]a]b", "ab\\]c",
    "x\\[y", "a\\\\b", "\\x66ire", "\\x{66}ire", "(f)i\\1?re", "(?<n>fire)", "fire{1,2}", "fi(re)?", "(?:fire|fi)", "f|", "p{0}fire", "\\p{L}ire",
    "tab\\there", "(?>pump)ing", "pump++", "pump*+", "(?i)Fire", "(?-i)fire", "fire #x", "\U0001f525 fire", "pu[m]p", "[Pp][Uu][Mm][Pp]",
    "a{3}", "(pump){0,1}leak", "no such text", "\\vfire", "\\Apump", "leak\\z", "leak\\Z",
]


def table(spark, texts):
    rows = [(i, f"W{i}", f"B{i % 3}", "hall", "research" if i % 2 else "other", "hvac" if i % 3 else "roofing", t)
            for i, t in enumerate(texts)]
    return spark.createDataFrame(
        rows, f"{SEQ} long, WOID string, BuildingID string, BuildingName string, Type string, equipment string, WODescription string")


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    rows = table(spark, TEXTS).cache()
    return rows, BrowseIndex(spark, str(tmp_path_factory.mktemp("index") / "i")).append(rows, 1)


def test_same_rows_as_the_scan(spark, small):
    """One query over all patterns: which rows match, and which the index leaves as candidates."""
    rows, index = small
    postings = {}
    for r in index.postings.collect():
        postings.setdefault(r.block, set()).add(r.gram)
    pruned = 0
    for pattern in PATTERNS:
        want = {r[SEQ] for r in rows.filter(F.col("WODescription").rlike("(?iu)" + pattern)).select(SEQ).collect()}
        condition = condition_of(pattern)
        left = {i for i in range(len(TEXTS)) if condition is None or meets(condition, postings.get(i, set()))}
        assert want <= left, (pattern, condition)
        pruned += len(left) < len(TEXTS) / 2
    assert pruned > len(PATTERNS) / 2


def meets(condition, grams):
    if isinstance(condition, str):
        return condition in grams
    return (all if condition[0] == "and" else any)(meets(part, grams) for part in condition[1])


@pytest.mark.parametrize("how", [
    {"pattern": "pump"}, {"pattern": "fire|pump.*leak", "kind": "research"}, {"pattern": "a.b"}, {"equipment": "hvac"},
    {"pattern": "no such text"}, {"pattern": "heating", "limit": 1}, {},
])
def test_browse(spark, small, how):
    rows, index = small
    assert index.browse(**how).collect() == browse(rows, **how).collect()


def test_more_blocks_than_are_listed(spark, small, monkeypatch):
    rows, index = small
    monkeypatch.setattr(trigrams, "MOST_LISTED", 1)
    assert index.browse(pattern="pump|fire").collect() == browse(rows, pattern="pump|fire").collect()


def test_conditions():
    assert condition_of("pump") == ("and", ("pum", "ump"))
    assert condition_of("fire|door") == ("or", (("and", ("doo", "oor")), ("and", ("fir", "ire"))))
    assert condition_of("abc.*def") == ("and", ("abc", "def"))
    assert condition_of("(abc|x).*") is None and condition_of("ab") is None and condition_of("(") is None
    assert condition_of("colou?r") == condition_of("color|colour")
    many = "|".join(f"word{i}" for i in range(200))
    assert condition_of(many) is None or len(trigrams.grams_in(condition_of(many))) <= trigrams.MOST_GRAMS


def test_random_patterns_never_lose_a_match():
    """Conditions against Python's own engine, on texts made of the same few letters."""
    rng = random.Random(7)

    def pattern(depth=0):
        kind = rng.randint(0, 8 if depth < 3 else 2)
        if kind <= 2:
            return "".join(rng.choice("abAB.c") for _ in range(rng.randint(1, 4)))
        if kind == 3:
            return f"({pattern(depth + 1)}|{pattern(depth + 1)})"
        if kind == 4:
            return f"({pattern(depth + 1)}){rng.choice(['?', '*', '+', '{2}', '{1,3}', '*?', '{0,1}'])}"
        if kind == 5:
            return rng.choice(["[ab]", "[a-c]", "[^a]", r"\w", r"\b", "^", "$"])
        if kind == 6:
            return f"(?={pattern(depth + 1)})" + pattern(depth + 1)
        return pattern(depth + 1) + pattern(depth + 1)

    checked = 0
    for _ in range(3000):
        p = pattern()
        condition = condition_of(p)
        if condition is None:
            continue
        for _ in range(8):
            text = "".join(rng.choice("abcAB") for _ in range(rng.randint(0, 14)))
            if re.search(p, text, re.I):
                grams = {text.lower()[i:i + 3] for i in range(len(text) - 2)}
                assert meets(condition, grams), (p, text, condition)
                checked += 1
    assert checked > 300


def test_few_rows_are_read(spark, tmp_path):
    """A rare word among many rows: the scan reads the blocks that hold it."""
    from tests.test_lookup import scanned_rows

    texts = [f"work order {i} about {'zebra crossing' if i % 5000 == 77 else 'pump ' + str(i * 7919 % 10007)} and more "
             + "text " * 20 for i in range(20_000)]
    rows = table(spark, texts)
    index = BrowseIndex(spark, str(tmp_path / "i"))
    trigrams.ROW_GROUP_BYTES, kept = 100_000, trigrams.ROW_GROUP_BYTES
    try:
        index.append(rows.filter(f"{SEQ} < 12000")).append(rows.filter(f"{SEQ} >= 12000"))
    finally:
        trigrams.ROW_GROUP_BYTES = kept
    found = index.browse(pattern="zebra  ?crossing|zebra cross")
    assert [r.WOID for r in found.collect()] == [f"W{i}" for i in range(77, 20_000, 5000)]
    assert scanned_rows(index.candidates("zebra")) < 5000
    assert scanned_rows(index.postings.filter("gram = 'zeb'")) < index.postings.count() / 4


def test_postings_are_made_per_block_not_per_row(spark, tmp_path):
    texts = ["pump leaks", "leaks ¶ab", None, "", "ab", "cde", "x\U0001f600abcİj"] * 5
    rows = spark.createDataFrame(list(enumerate(texts)), "ingest_seq bigint, WODescription string")
    index = BrowseIndex(spark, str(tmp_path / "index")).append(rows, rows_per_block=4)
    want = set()
    for i, text in enumerate(texts):
        low = (text or "").replace("İ", "i").lower()
        want |= {(i // 4, low[j:j + 3]) for j in range(len(low) - 2) if low[j:j + 3].isascii()}
    got = [(r["block"], r["gram"]) for r in index.postings.collect()]
    assert sorted(got) == sorted(want)
    assert "RLIKE" not in trigrams.trigrams(F.col("t"))._jc.toString()
