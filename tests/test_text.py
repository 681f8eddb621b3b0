"""Column functions on literal rows, against plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from wosearch.functions.representation import mice_repr, text_repr
from wosearch.functions.text import (
    na_to_empty, search_text, strict_text, strip, strip_identifiers,
)
from wosearch.operators.evalset import constrained_query

SAMPLES = [
    None, "", "a & b", '"x"', "O'Neil", "A/B;C|D,E", "tab\tand nbsp", "é² ½ ñ",
    "  two  spaces ", "line\r\nbreak", "x_y-z.w", "& edge &", "हिन्दी text", " em ", "\x1cfs\x1c",
    "日本語 テキスト", "a\u0085b", "UPPER ÄÖÜ", "-- . --", "ends with ,",
]


def python_search_text(text):
    if text is None:
        return ""
    text = re.sub(r"[\n\r,;|/]", " ", text).replace('"', "").replace("'", "")
    return re.sub(r"[^\w\s\-.]", "", re.sub(r"\s+", " ", text.lower().strip()))


def python_strict_text(text):
    if not text:
        return ""
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s\-]", " ", text.lower())).strip()


def values(spark, column, rows, schema="t string"):
    rows = [r if isinstance(r, tuple) else (r,) for r in rows]
    numbered = [(i, *r) for i, r in enumerate(rows)]
    df = spark.createDataFrame(numbered, "i int, " + schema)
    return [r[0] for r in df.orderBy("i").select(column.alias("v")).collect()]


def test_search_text(spark):
    # Combining marks count as word characters in neither; Python drops them too.
    got = values(spark, search_text(F.col("t")), SAMPLES)
    assert got == [python_search_text(t) for t in SAMPLES]
    assert got[2] == "a  b"


def test_strict_text(spark):
    assert values(spark, strict_text(F.col("t")), SAMPLES) == [python_strict_text(t) for t in SAMPLES]


def test_strip(spark):
    texts = [t for t in SAMPLES if t is not None]
    assert values(spark, strip(F.col("t")), texts) == [t.strip() for t in texts]


def test_na_to_empty(spark):
    assert values(spark, na_to_empty(F.col("t")), [None, "", "NA", "nan", "None", "none", "x"]) == [
        "", "", "", "", "", "none", "x",
    ]


@pytest.mark.parametrize("desc,name,want", [
    ("Leak in Hall One a123 zone 4", "Hall One", "leak in"),
    ("pm check wo991 done", "", "check done"),
    ("code ab-cd-ef here", "unknown_building", "code here"),
    ("a-bb-cc-dd stays a", "", "a- stays a"),
    (" - fan, broken.", "x1", "fan, broken"),
    ("über-alles-ja kaputt", "", "kaputt"),
    ("a12 and za123 kept", "", "a12 and za123 kept"),
])
def test_strip_identifiers(spark, desc, name, want):
    column = strip_identifiers(F.col("d"), F.col("n"))
    assert values(spark, column, [(desc, name)], "d string, n string") == [want]


def test_constrained_query(spark):
    column = constrained_query(F.col("d"), F.col("n"), F.col("e"), F.col("k"))
    rows = [("fan broken", "", "hvac", "research"), ("fan broken", "", "", "UNKNOWN_TYPE"),
            ("fan broken", "", "hvac", "unknown_type")]
    assert values(spark, column, rows, "d string, n string, e string, k string") == [
        "hvac research: fan broken", "fan broken", "hvac: fan broken",
    ]


FIELDS = ("BuildingID string, BuildingName string, Type string, equipment string, "
          "WOStartDate string, WOEndDate string, WODescription string")


def test_representations(spark):
    rows = [("",) * 7, ("UNK_3", "UNKNOWN_BUILDING", "UNKNOWN_TYPE", "HVAC", " 2024 ", "ONGOING", " Fan "),
            ("nan", "None", "research", "", "", "", "x")]
    assert values(spark, text_repr(), rows, FIELDS) == [
        "", "UNKNOWN_BUILDING | UNKNOWN_TYPE | Fan", "None | research | x",
    ]
    got = values(spark, mice_repr(), rows, FIELDS)
    assert got[0] == (
        "building id: unknown. building name: unknown. facility type: unknown. equipment system: "
        "unknown. work period: unknown to unknown. work order description: unknown."
    )
    assert got[1] == (
        "building id: unk_3. building name: unknown. facility type: unknown. equipment system: "
        "hvac. work period: 2024 to ongoing. work order description: fan."
    )
    assert values(spark, mice_repr("\n"), rows, FIELDS)[2].count("\n") == 5


def test_strip_takes_every_white_space_character(spark):
    import sys
    from wosearch.functions.text import SPACE, SPACES

    every = "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    (spaces,) = values(spark, F.regexp_replace(F.col("t"), f"[^{SPACE}]+", ""), [every])
    assert sorted(spaces) == sorted(SPACES)
    assert values(spark, strip(F.col("t")), [SPACES + "a b" + SPACES, SPACES]) == ["a b", ""]


def test_strip_looks_at_the_ends_only():
    assert "regexp" not in strip(F.col("t"))._jc.toString().lower()
