"""Rule-based routing of query texts. Column expressions only, so that the same code runs
on a batch and on a stream of queries.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wosearch.config import EQUIPMENT_TERMS, TOP_K, TYPE_TERMS
from wosearch.functions.text import SPACE, WORD, contains_term, strip
from wosearch.operators.encoding import Encoder
from wosearch.operators.strategies import FILTERS, retrieve_named


def building_code(text) -> Column:
    """First capital letter with three or four digits that stands alone, else null."""
    code = F.regexp_extract(text, rf"(?<![{WORD}])([A-Z]\p{{Nd}}{{3,4}})(?![{WORD}])", 1)
    return F.nullif(code, F.lit(""))


def find_term(text, terms) -> Column:
    """Longest term that occurs as whole words; equal lengths in alphabetical order."""
    ordered = sorted(terms, key=lambda t: (-len(t), t))
    return F.coalesce(*[F.when(contains_term(text, t), F.lit(t)) for t in ordered])


def classify(queries: DataFrame) -> DataFrame:
    """Add the extracted fields (they become the filter), the signal and the strategy."""
    lowered = F.lower("query_text")
    found = queries.withColumns({
        "building_id": building_code(F.col("query_text")),
        "building_type": find_term(lowered, TYPE_TERMS),
        "equipment": find_term(lowered, EQUIPMENT_TERMS),
    })
    equip, kind = F.col("equipment").isNotNull(), F.col("building_type").isNotNull()
    signal = (
        F.when(equip & kind, "mixed").when(equip, "equipment").when(kind, "type")
        .when(F.col("building_id").isNotNull(), "building_id").otherwise("none")
    )
    strategy = (
        F.when(equip | kind, "B_prime").when(F.col("building_id").isNotNull(), "B").otherwise("A")
    )
    return found.withColumns({"signal": signal, "strategy": strategy})


def route_and_retrieve(
    corpus: DataFrame, queries: DataFrame, encoder: Encoder, k: int = TOP_K,
    force: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(hits, routing decisions). ``force`` overrides the strategy, not the filter."""
    routed = classify(queries)
    wanted = routed
    if force is not None:
        wanted = routed.withColumn("strategy", F.coalesce(F.lit(force), "strategy"))
    return retrieve_named(corpus, wanted, encoder, k), routed


def explain_routing(queries: DataFrame) -> DataFrame:
    routed = classify(queries)
    shown = {c: F.coalesce(c, F.lit("—")) for c in FILTERS}
    return routed.withColumns(shown).select("query_id", "query_text", "signal", *FILTERS, "strategy")


def override_filters(routed: DataFrame, prefix: str = "manual_") -> DataFrame:
    """A filter value given by hand beats the extracted one; ``''`` means not given."""
    return routed.withColumns({
        c: F.coalesce(F.nullif(F.col(prefix + c), F.lit("")), c) for c in FILTERS
    }).drop(*[prefix + c for c in FILTERS])


def query_class(routed: DataFrame) -> DataFrame:
    """Constrained or semantic, and the number of whitespace-separated tokens."""
    text = strip(F.col("query_text"))
    tokens = F.when(text == "", 0).otherwise(F.size(F.split(text, f"[{SPACE}]+")))
    return routed.withColumns({
        "query_class": F.when(F.col("signal") == "none", "semantic").otherwise("constrained"),
        "n_tokens": tokens,
    })
