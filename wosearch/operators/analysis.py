"""Strategies compared query by query."""

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wosearch.config import STRATEGIES, TOP_K

_MEASURES = ("recall", "mrr", "ndcg", "first_hit")
_CASE = (
    "query_id", "query_text", "query_type", "group_equipment", "group_type", "description",
    "n_relevant",
)


def compare(per_query: DataFrame, k: int = TOP_K, strategies=STRATEGIES) -> DataFrame:
    """One row per query with every strategy side by side, the metadata gain (best recall
    with metadata minus recall of A) and the best and worst strategy by recall.
    """
    source = {
        "recall": f"recall_{k}", "mrr": "mrr", "ndcg": f"ndcg_{k}", "first_hit": "first_hit_rank",
    }
    wide = per_query.groupBy(*_CASE).agg(*[
        F.max(F.when(F.col("strategy") == s, F.col(source[m]))).alias(f"{s}_{m}")
        for s in strategies for m in _MEASURES
    ])
    recalls = {s: F.coalesce(f"{s}_recall", F.lit(0.0)) for s in strategies}
    with_metadata = [recalls[s] for s in strategies if s != "A"]

    def first_with(value):
        return F.coalesce(*[F.when(r == value, F.lit(s)) for s, r in recalls.items()])

    return wide.withColumns({
        "metadata_gain": F.greatest(*with_metadata) - recalls["A"],
        "best_strategy": first_with(F.greatest(*recalls.values())),
        "worst_strategy": first_with(F.least(*recalls.values())),
    })


def helped(comparisons: DataFrame, threshold: float = 0.2) -> DataFrame:
    """Queries metadata helps by at least ``threshold``, largest gain first."""
    return comparisons.filter(F.col("metadata_gain") >= threshold).orderBy(
        F.desc("metadata_gain"), "query_id"
    )


def hurt(comparisons: DataFrame, threshold: float = 0.2) -> DataFrame:
    """Queries where every metadata strategy loses at least ``threshold``, worst first."""
    return comparisons.filter(-F.col("metadata_gain") >= threshold).orderBy(
        "metadata_gain", "query_id"
    )


def win_matrix(comparisons: DataFrame, strategies=STRATEGIES) -> DataFrame:
    """Wins, losses and ties of recall for every pair of strategies."""
    pairs = [
        F.struct(
            F.lit(a).alias("s1"), F.lit(b).alias("s2"),
            F.col(f"{a}_recall").alias("r1"), F.col(f"{b}_recall").alias("r2"),
        )
        for a, b in combinations(strategies, 2)
    ]
    rows = comparisons.select(F.inline(F.array(*pairs)).alias("s1", "s2", "r1", "r2"))

    def counted(condition, name):
        return F.count(F.when(condition, 1)).alias(name)

    return rows.groupBy("s1", "s2").agg(
        counted(F.col("r1") > F.col("r2"), "wins"),
        counted(F.col("r1") < F.col("r2"), "losses"),
        counted(F.col("r1") == F.col("r2"), "ties"),
    )


def impact_summary(comparisons: DataFrame, threshold: float = 0.1) -> DataFrame:
    """How many queries metadata helps, hurts or leaves alone, and the two extremes."""
    gain = F.col("metadata_gain")
    up, down = gain >= threshold, -gain >= threshold
    counted = comparisons.agg(
        F.count("*").alias("n_queries"),
        F.count(F.when(up, 1)).alias("n_helped"),
        F.count(F.when(down, 1)).alias("n_hurt"),
        F.max(F.when(up, gain)).alias("largest_gain"),
        F.min(F.when(up, F.struct(-gain, "query_id", "description")))["description"].alias(
            "largest_gain_query"
        ),
        F.min(F.when(down, gain)).alias("largest_loss"),
        F.min(F.when(down, F.struct(gain, "query_id", "description")))["description"].alias(
            "largest_loss_query"
        ),
    )
    n = F.greatest("n_queries", F.lit(1))
    neutral = F.col("n_queries") - F.col("n_helped") - F.col("n_hurt")
    return counted.withColumn("n_neutral", neutral).withColumns({
        f"{name}_share": F.col(f"n_{name}") / n for name in ("helped", "hurt", "neutral")
    })


def query_cards(comparisons: DataFrame, judged: DataFrame, n_hits: int = 3) -> DataFrame:
    """First hits of the best strategy of each query, with their relevance."""
    top = judged.filter(F.col("rank") <= n_hits).select(
        "query_id", F.col("strategy").alias("best_strategy"), "rank", "woid",
        F.col("score").cast("double").alias("score"), "relevant",
        F.substring("wo_description", 1, 60).alias("preview"),
    )
    return comparisons.select(
        "query_id", F.substring("query_text", 1, 120).alias("query_text"), "query_type",
        "n_relevant", "metadata_gain", "best_strategy",
    ).join(top, ["query_id", "best_strategy"], "left")


def example_queries(comparisons: DataFrame, n: int = 5, threshold: float = 0.2) -> DataFrame:
    """Queries worth showing: the most helped ones, or the first ones when none is."""
    order = [
        F.when(F.col("metadata_gain") >= threshold, 0).otherwise(1),
        F.when(F.col("metadata_gain") >= threshold, -F.col("metadata_gain")),
        F.col("query_id"),
    ]
    first_kind = comparisons.select(F.min(order[0])).scalar()
    return comparisons.filter(order[0] == first_kind).orderBy(*order).limit(n)


def comparison_rows(per_query: DataFrame, comparisons: DataFrame, k: int = TOP_K) -> DataFrame:
    """Export form: one row per query and strategy, texts cut to 200 characters."""
    gains = comparisons.select("query_id", "metadata_gain")
    return per_query.join(gains, "query_id").select(
        "description", "query_type", F.col("group_equipment").alias("equipment"),
        F.col("group_type").alias("facility_type"), "n_relevant",
        F.substring("query_text", 1, 200).alias("query_text"), "strategy",
        F.round(f"recall_{k}", 6).alias("recall"), F.round("mrr", 6).alias("mrr"),
        F.round(f"ndcg_{k}", 6).alias("ndcg"), "first_hit_rank",
        F.round("metadata_gain", 6).alias("metadata_gain"),
    )
