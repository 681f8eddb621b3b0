"""Evaluation queries with relevance judgements, built from the cleaned table.

Rows of one (equipment, Type) group are relevant to each other. One row of the group, the
seed, gives the query text; the others are the relevant set. The cleaned table holds one
row per WOID, which makes group sizes equal to set sizes.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wosearch.config import (
    CONSTRAINED_FRACTION, EVAL_QUERIES, EVAL_SEED, MIN_GROUP_ROWS, MIN_QUERY_CHARS, MIN_RELEVANT,
)
from wosearch.functions.text import md5_number, seeded_md5, strip_identifiers
from wosearch.session import materialise

CASE_COLUMNS = (
    "query_id", "query_text", "building_id", "building_type", "equipment", "query_type",
    "group_equipment", "group_type", "description", "seed_woid", "n_relevant",
)


def _seed_hash(seed: int) -> Column:
    return md5_number(seeded_md5(seed, F.col("WOID")))


def _groupable(cleaned: DataFrame) -> DataFrame:
    named = [~F.col(c).isin("", "UNKNOWN_TYPE") for c in ("equipment", "Type")]
    return cleaned.filter(named[0] & named[1])


def relevance_groups(
    cleaned: DataFrame, min_rows: int = MIN_GROUP_ROWS, seed: int = EVAL_SEED
) -> DataFrame:
    """Groups large enough to judge. ``seed_hash`` marks the seed row: the smallest hash,
    kept as a number so that the aggregate hashes and combines on the map side.
    """
    return (
        _groupable(cleaned).groupBy("equipment", "Type")
        .agg(F.count("*").alias("n_rows"), F.min(_seed_hash(seed)).alias("seed_hash"))
        .filter((F.col("n_rows") >= min_rows) & (F.col("n_rows") - 1 >= MIN_RELEVANT))
    )


def seed_rows(cleaned: DataFrame, groups: DataFrame, seed: int = EVAL_SEED) -> DataFrame:
    """One seed row per group, in the seeded order of ``query_id``."""
    marked = _groupable(cleaned).withColumn("seed_hash", _seed_hash(seed))
    found = marked.join(groups, ["equipment", "Type", "seed_hash"])
    row = F.struct("WOID", "BuildingName", "WODescription")
    return (
        found.groupBy("equipment", "Type", "n_rows")
        .agg(F.min_by(row, F.col("WOID")).alias("seed"))
        .select(
            seeded_md5(seed, F.col("equipment"), F.col("Type")).alias("query_id"),
            F.col("equipment").alias("group_equipment"), F.col("Type").alias("group_type"),
            F.col("seed.WOID").alias("seed_woid"),
            F.col("seed.BuildingName").alias("seed_building"),
            F.col("seed.WODescription").alias("seed_text"),
            (F.col("n_rows") - 1).alias("n_relevant"),
        )
    )


def semantic_query(description, building_name) -> Column:
    return strip_identifiers(description, building_name)


def constrained_query(description, building_name, equipment, kind) -> Column:
    """``equipment type: text``; empty and placeholder tokens are left out."""
    base = strip_identifiers(description, building_name)
    tokens = [
        F.when(~t.isin("", "unknown_type", "UNKNOWN_TYPE"), t) for t in (equipment, kind)
    ]
    prefix = F.concat_ws(" ", *tokens)
    return F.when(prefix == "", base).otherwise(F.concat(prefix, F.lit(": "), base))


def build_cases(
    cleaned: DataFrame,
    n_queries: int | None = EVAL_QUERIES,
    seed: int = EVAL_SEED,
    min_rows: int = MIN_GROUP_ROWS,
) -> DataFrame:
    """Query set of at most ``n_queries`` cases (None: as many as there are groups).

    Groups are taken in seeded order. The first 60 % of the accepted cases carry metadata
    in text and filter, the rest are plain. A text under ten characters rejects its group.
    Whether a case is constrained depends on how many were accepted before it, which comes
    down to two ordered takes: the first constrained ones, then plain ones behind them.
    """
    groups = materialise(relevance_groups(cleaned, min_rows, seed), "relevance-groups")
    if groups.isEmpty():
        raise ValueError("no (equipment, Type) group is large enough")
    desc, name = F.col("seed_text"), F.col("seed_building")
    equipment, kind = F.col("group_equipment"), F.col("group_type")
    candidates = materialise(
        seed_rows(cleaned, groups, seed).withColumns({
            "plain": semantic_query(desc, name),
            "constrained": constrained_query(desc, name, equipment, kind),
        }),
        "case-candidates",
    )
    n = candidates.count() if n_queries is None else n_queries
    n_constrained = int(n * CONSTRAINED_FRACTION)

    def take(rows: DataFrame, text: str, limit: int) -> DataFrame:
        usable = rows.filter(F.length(text) >= MIN_QUERY_CHARS)
        return usable.orderBy("query_id").limit(limit)

    first = take(candidates, "constrained", n_constrained)
    accepted, last = first.agg(F.count("*"), F.max("query_id")).first()
    behind = candidates.filter(F.col("query_id") > (last or ""))
    rest = take(behind, "plain", n - n_constrained if accepted == n_constrained else 0)

    def as_cases(rows: DataFrame, query_type: str, text: str, filtered: bool) -> DataFrame:
        none = F.lit(None).cast("string")
        return rows.select(
            "query_id", F.col(text).alias("query_text"), none.alias("building_id"),
            (kind if filtered else none).alias("building_type"),
            (equipment if filtered else none).alias("equipment"),
            F.lit(query_type).alias("query_type"), "group_equipment", "group_type",
            F.concat(
                F.lit(f"[{query_type}] "), equipment, F.lit("/"), kind,
                F.lit(" src:"), "seed_woid",
            ).alias("description"),
            "seed_woid", "n_relevant",
        )

    cases = as_cases(first, "constrained", "constrained", True).unionByName(
        as_cases(rest, "semantic", "plain", False)
    )
    return materialise(cases.select(*CASE_COLUMNS), "cases")


def relevant_rows(cleaned: DataFrame, cases: DataFrame) -> DataFrame:
    """(query_id, woid) for every relevant row. The case table was written, so Catalyst
    knows its size when it picks the join.
    """
    keys = cases.select(
        "query_id", F.col("group_equipment").alias("equipment"),
        F.col("group_type").alias("Type"), "seed_woid",
    )
    members = cleaned.select("equipment", "Type", F.col("WOID").alias("woid"))
    return (
        members.join(keys, ["equipment", "Type"])
        .filter("woid <> seed_woid").select("query_id", "woid")
    )
