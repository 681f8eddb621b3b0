"""Aggregations behind the result views: gains, overlap, latency, charts."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wosearch.config import EVAL_KS, STRATEGIES
from wosearch.operators.metrics import rounded


def gain_classes(rows: DataFrame, limit: float = 0.05) -> DataFrame:
    """Positive, negative and neutral gains; every description counts once."""
    once = rows.groupBy("description").agg(
        F.min_by("metadata_gain", F.col("strategy")).alias("gain")
    ).filter("gain IS NOT NULL")
    up, down = F.col("gain") > limit, F.col("gain") < -limit
    return once.agg(
        F.count("*").alias("total"),
        F.count(F.when(up, 1)).alias("positive"),
        F.count(F.when(down, 1)).alias("negative"),
        F.count(F.when(~up & ~down, 1)).alias("neutral"),
    )


def histogram(df: DataFrame, value: str, bins: int, by: str | None = None) -> DataFrame:
    """Equal-width histogram between minimum and maximum, per ``by`` when given.

    The bounds are a tiny table of their own, so no group is gathered in one task.
    """
    keys = [by] if by else []
    values = df.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL")
    if by:
        bounds = values.groupBy(by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        placed = values.join(bounds, by)
    else:
        placed = values.withColumns({
            "_lo": values.select(F.min("_v")).scalar(),
            "_hi": values.select(F.max("_v")).scalar(),
        })
    width = F.col("_hi") - F.col("_lo")
    position = F.floor(F.try_divide(F.col("_v") - F.col("_lo"), width) * bins)
    bin_no = F.least(F.coalesce(position, F.lit(0)), F.lit(bins - 1))
    counted = placed.groupBy(*keys, bin_no.alias("bin"), "_lo", "_hi").agg(
        F.count("*").alias("n_values")
    )
    lower = F.col("_lo") + F.col("bin") * (F.col("_hi") - F.col("_lo")) / bins
    return counted.withColumn("lower", lower).select(*keys, "bin", "lower", "n_values")


def gain_extremes(rows: DataFrame) -> DataFrame:
    """Most improved and most degraded query; equal gains by description."""
    base = rows.filter((F.col("strategy") == "A") & F.col("metadata_gain").isNotNull())
    gain = F.col("metadata_gain")

    def extreme(kind: str, order: Column) -> DataFrame:
        return base.orderBy(order, "description").limit(1).select(
            F.lit(kind).alias("kind"), "description", "query_text", "metadata_gain"
        )

    return extreme("improved", gain.desc()).unionByName(extreme("degraded", gain.asc()))


def _place(strategy: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in STRATEGIES]), strategy)


def best_overall(metrics: DataFrame, k: int = 10) -> DataFrame:
    """Strategy with the highest recall; equal recall in strategy order."""
    order = [F.desc(f"recall_{k}"), _place(F.col("strategy"))]
    return metrics.orderBy(*order).limit(1).select("strategy", F.col(f"recall_{k}").alias("recall"))


def metrics_reference(metrics: DataFrame) -> DataFrame:
    """Flat metrics rounded for display."""
    flat = {c: rounded(c, 4) for c in ("recall_1", "recall_5", "recall_10", "mrr", "ndcg_10")}
    return metrics.select(
        "strategy", *[v.alias(c) for c, v in flat.items()],
        rounded("avg_latency_ms", 1).alias("avg_latency_ms"),
    )


# Overlap ---------------------------------------------------------------------------------

def membership(hits: DataFrame, strategies=STRATEGIES) -> DataFrame:
    """(query_id, woid) with one boolean per strategy that found it."""
    return hits.groupBy("query_id", "woid").agg(*[
        F.bool_or(F.col("strategy") == s).alias(s) for s in strategies
    ])


def _mask(strategies) -> Column:
    bits = [F.when(F.col(s), F.lit(1 << i)).otherwise(0) for i, s in enumerate(strategies)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def overlap_summary(hits: DataFrame, strategies=STRATEGIES) -> DataFrame:
    """Union size, rows common to all strategies that found anything, and overlap in %.

    Rows are counted per combination of strategies first; a query has at most fifteen.
    """
    masks = membership(hits, strategies).groupBy("query_id", _mask(strategies).alias("mask")).agg(
        F.count("*").alias("n")
    )
    per_query = masks.groupBy("query_id").agg(
        F.sum("n").alias("n_union"), F.bit_or("mask").alias("active"),
        F.collect_list(F.struct("mask", "n")).alias("parts"),
    )
    shared = F.filter("parts", lambda p: p["mask"] == F.col("active"))
    common = F.aggregate(shared, F.lit(0).cast("bigint"), lambda s, p: s + p["n"])
    return per_query.select("query_id", "n_union", common.alias("n_common")).withColumn(
        "overlap_pct", F.bround(F.col("n_common") / F.col("n_union") * 100, 0).cast("int")
    )


def unique_hits(hits: DataFrame, strategies=STRATEGIES) -> DataFrame:
    """Rows only one strategy found."""
    one = hits.groupBy("query_id", "woid").agg(
        F.count_distinct("strategy").alias("n"), F.min("strategy").alias("strategy")
    )
    return one.filter("n = 1").select("query_id", "strategy", "woid")


def set_differences(hits: DataFrame, left: str = "A", right: str = "C") -> DataFrame:
    """Per query: rows only ``left`` found and rows only ``right`` found."""
    both = membership(hits, (left, right))
    return both.groupBy("query_id").agg(
        F.count(F.when(F.col(left) & ~F.col(right), 1)).alias("only_left"),
        F.count(F.when(~F.col(left) & F.col(right), 1)).alias("only_right"),
    )


def observations(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Result counts against A, divergence class and effect of the metadata filter."""
    counts = hits.groupBy("query_id").agg(*[
        F.count(F.when(F.col("strategy") == s, 1)).alias(f"n_{s}") for s in ("A", "B", "B_prime")
    ])
    filters = [F.coalesce(c, F.lit("")) != "" for c in ("building_id", "building_type", "equipment")]
    asked = queries.select("query_id", (filters[0] | filters[1] | filters[2]).alias("has_metadata"))
    delta = F.col("n_B_prime") - F.col("n_A")
    return (
        # A query without hits has no overlap and diverges most.
        asked.join(counts, "query_id", "left").join(overlap_summary(hits), "query_id", "left")
        .na.fill(0, ["n_A", "n_B", "n_B_prime", "overlap_pct"])
        .withColumns({
            "delta_b": F.col("n_B") - F.col("n_A"),
            "delta_b_prime": delta,
            "divergence": F.when(F.col("overlap_pct") >= 80, "similar")
            .when(F.col("overlap_pct") >= 40, "moderate").otherwise("high"),
            "metadata_effect": F.when(~F.col("has_metadata"), "no_metadata")
            .when(delta < 0, "fewer").when(delta > 0, "more").otherwise("unchanged"),
        })
        .select(
            "query_id", "n_A", "n_B", "n_B_prime", "delta_b", "delta_b_prime", "overlap_pct",
            "divergence", "metadata_effect",
        )
    )


# Latency and chart inputs ----------------------------------------------------------------

def latency_race(log: DataFrame) -> DataFrame:
    """Fastest and slowest strategies of every query."""
    query = Window.partitionBy("query_id")
    latency = F.col("latency_ms")
    badge = F.when(latency == F.min(latency).over(query), "fastest").when(
        latency == F.max(latency).over(query), "slowest"
    )
    return log.select("query_id", "strategy", "latency_ms", badge.alias("badge"))


def recall_series(metrics: DataFrame, ks=EVAL_KS) -> DataFrame:
    """(strategy, k, recall) points."""
    points = [
        F.struct(F.lit(k).alias("k"), F.col(f"recall_{k}").alias("recall")) for k in ks
    ]
    return metrics.select("strategy", F.inline(F.array(*points)).alias("k", "recall"))


def metric_bars(
    metrics: DataFrame, names=("recall_10", "mrr", "ndcg_10"), strategies=("A", "C")
) -> DataFrame:
    """(strategy, metric, value) bars, by default A against C."""
    chosen = metrics.filter(F.col("strategy").isin(*strategies)).select("strategy", *names)
    return chosen.unpivot("strategy", list(names), "metric", "value")
