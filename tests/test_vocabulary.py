"""The vocabulary join against one pattern per term."""

import random

import pytest
from pyspark.sql import functions as F

from wosearch.config import EQUIPMENT_TERMS
from wosearch.operators.router import find_term
from wosearch.operators.vocabulary import longest_terms


def vocabulary(spark, terms):
    return spark.createDataFrame([(t,) for t in terms], "term string")


def both(spark, texts, terms):
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {r.id: r.term for r in longest_terms(rows, "id", "t", vocabulary(spark, terms)).collect()}
    known = sorted({t for t in terms if t is not None})
    want = {r.id: r.term for r in rows.select("id", find_term(F.col("t"), known).alias("term")).collect()}
    assert got == want
    return [got[i] for i in range(len(texts))]


def test_edges(spark):
    terms = ["fire protection", "fire", "site", "c++", "24/7 on-call", "(a)", "élan", "x_1", "site", None, "ab", "ba"]
    texts = [
        "fire protection", "the fire  protection", "fireprotection fire", "site.", "_site", "site_", "a c++ b", "c+++",
        "c++", "xc++", "c++x", "++c++", "24/7 on-call!", "124/7 on-call", "(a)", "((a))", "x(a)", "(a)x", " (a) x",
        "élan é", "x_1 x", "x_12", "ba ab", "", " ", None, "a", "fire\nprotection", "c++ (a)", "c++(a)",
    ]
    found = both(spark, texts, terms)
    assert found[0] == "fire protection" and found[1] == "fire" and found[6] == "c++" and found[22] == "ab"
    assert found[24] is None and found[25] is None


def test_random_texts(spark):
    rng = random.Random(1)
    words, seps = ["a", "b", "ab", "1", "é", "_"], [" ", "  ", "-", "+", "/", ""]

    def text(n):
        return "".join(rng.choice(words) + rng.choice(seps) for _ in range(n))

    terms = {text(rng.randint(1, 3)) for _ in range(40)} | {"+" + text(1) for _ in range(5)}
    both(spark, [rng.choice(["", "+", " "]) + text(rng.randint(0, 9)) for _ in range(300)], sorted(terms))


def test_router_vocabulary(spark):
    texts = ["hvac failure in teaching building", "fire protection and plumbing", "nothing", "elevator plumbing site"]
    assert both(spark, texts, EQUIPMENT_TERMS) == ["hvac", "fire protection", None, "elevator"]


def test_large_vocabulary(spark):
    """100 000 terms of one to four words; one text in three is the same."""
    terms = spark.range(100_000).select(F.concat_ws(
        " ", F.concat(F.lit("w"), F.col("id") % 1000), F.when(F.col("id") % 4 > 0, F.concat(F.lit("v"), F.col("id") % 777)),
        F.when(F.col("id") % 4 > 1, F.concat(F.lit("u"), F.col("id"))), F.when(F.col("id") % 4 > 2, F.lit("end")),
    ).alias("term"))
    some = [r.term for r in terms.filter("id % 977 = 3").collect()]
    texts = [f"it is {t} here" for t in some] + ["the same text of w1 and w2"] * len(some)
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {r.id: r.term for r in longest_terms(rows, "id", "t", terms).collect()}
    known = set(terms.toPandas()["term"])

    def longest(text):
        words = text.split()
        found = {" ".join(words[i:j]) for i in range(len(words)) for j in range(i + 1, i + 5)} & known
        return min(found, key=lambda t: (-len(t), t), default=None)

    assert got == {i: longest(t) for i, t in enumerate(texts)}
    assert [got[i] for i in range(len(some))] == some


def test_empty_inputs(spark):
    rows = spark.createDataFrame([(1, "hvac")], "id long, t string")
    none = vocabulary(spark, []).limit(0)
    assert [tuple(r) for r in longest_terms(rows, "id", "t", none).collect()] == [(1, None)]
    assert longest_terms(rows.limit(0), "id", "t", vocabulary(spark, ["a"])).count() == 0
    with pytest.raises(Exception, match="a term has no word"):
        longest_terms(rows, "id", "t", vocabulary(spark, ["a", "--"])).collect()
