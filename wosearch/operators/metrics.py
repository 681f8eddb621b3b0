"""Ranking metrics over hits and relevance judgements."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wosearch.config import EVAL_KS, STRATEGIES

_CASE = (
    "query_id", "query_text", "query_type", "group_equipment", "group_type", "description",
    "n_relevant",
)


def rounded(c, digits: int) -> Column:
    """Rounded mean. The first rounding removes what the order of summation left behind, so
    that the result does not depend on the partitioning.
    """
    return F.round(F.round(c, 12), digits)


def judge(hits: DataFrame, relevant: DataFrame) -> DataFrame:
    """Mark every hit as relevant or not.

    The judgements can be as long as the corpus and the hits are few, so the judgements
    are first cut down to rows that were hit.
    """
    found = relevant.join(hits.select("query_id", "woid"), ["query_id", "woid"], "left_semi")
    marks = found.distinct().withColumn("relevant", F.lit(True))
    return hits.join(marks, ["query_id", "woid"], "left").withColumn(
        "relevant", F.coalesce("relevant", F.lit(False))
    )


def _gain(rank) -> Column:
    return F.lit(1.0) / F.log2(rank + 1)


def _ideal(n_relevant, k: int) -> Column:
    """Best possible discounted gain for min(n_relevant, k) relevant rows."""
    terms = [F.when(n_relevant >= r, _gain(F.lit(r))).otherwise(0.0) for r in range(1, k + 1)]
    return reduce(lambda total, term: total + term, terms)


def per_query_metrics(
    judged: DataFrame, cases: DataFrame, ks=EVAL_KS, strategies=STRATEGIES
) -> DataFrame:
    """One row per query and strategy: n_hits, first_hit_rank, mrr, recall_k, ndcg_k.

    A strategy without any hit for a query still has its row, with zeros.
    """
    hit = F.col("relevant")
    measures = [
        F.count("*").alias("n_hits"),
        F.min(F.when(hit, F.col("rank"))).alias("first_hit_rank"),
    ]
    for k in ks:
        within = hit & (F.col("rank") <= k)
        measures.append(F.count(F.when(within, 1)).alias(f"found_{k}"))
        measures.append(F.sum(F.when(within, _gain(F.col("rank")))).alias(f"dcg_{k}"))
    measured = judged.groupBy("query_id", "strategy").agg(*measures)
    grid = cases.select(
        *_CASE, F.explode(F.array(*[F.lit(s) for s in strategies])).alias("strategy")
    )
    rows = grid.join(measured, ["query_id", "strategy"], "left")
    n = F.col("n_relevant")
    columns = {"mrr": F.coalesce(F.lit(1.0) / F.col("first_hit_rank"), F.lit(0.0))}
    for k in ks:
        found, gained = (F.coalesce(f"{m}_{k}", F.lit(0)) for m in ("found", "dcg"))
        columns[f"recall_{k}"] = F.coalesce(F.try_divide(found, n), F.lit(0.0))
        columns[f"ndcg_{k}"] = F.coalesce(F.try_divide(gained, _ideal(n, k)), F.lit(0.0))
    return rows.withColumns(columns).select(
        *_CASE, "strategy", F.coalesce("n_hits", F.lit(0)).alias("n_hits"),
        "first_hit_rank", *columns,
    )


def at_k(per_query: DataFrame, metric: str, ks=EVAL_KS) -> DataFrame:
    """A per-k metric as (query_id, strategy, k, metric) rows."""
    pairs = [
        F.struct(F.lit(k).alias("k"), F.col(f"{metric}_{k}").alias(metric)) for k in ks
    ]
    return per_query.select(
        "query_id", "strategy", F.inline(F.array(*pairs)).alias("k", metric)
    )


def _means(ks, prefix: str = "", condition=None) -> list[Column]:
    def mean(c):
        value = F.col(c) if condition is None else F.when(condition, F.col(c))
        return F.coalesce(F.avg(value), F.lit(0.0)).alias(prefix + c)

    return [mean(f"{m}_{k}") for k in ks for m in ("recall", "ndcg")]


def strategy_metrics(per_query: DataFrame, ks=EVAL_KS) -> DataFrame:
    """Means per strategy over all queries."""
    return per_query.groupBy("strategy").agg(
        F.count("*").alias("n_queries"), F.avg("mrr").alias("mrr"), *_means(ks)
    )


def metrics_by_type(per_query: DataFrame, ks=EVAL_KS) -> DataFrame:
    """The same means over all queries (query_type ``all``) and per query type, in one pass."""
    grouped = per_query.groupingSets(
        [["strategy"], ["strategy", "query_type"]], "strategy", "query_type"
    )
    return grouped.agg(
        F.grouping("query_type").alias("_all"), F.count("*").alias("n_queries"), *_means(ks)
    ).withColumn(
        "query_type", F.when(F.col("_all") == 1, "all").otherwise(F.col("query_type"))
    ).drop("_all")


def exact_percentile(
    df: DataFrame, key: str, value: str, share: float, out: str, stretches: int = 4096
) -> DataFrame:
    """Linearly interpolated percentile per key.

    Equal values are counted first. Counts per equal-width stretch of values tell which
    stretches hold the two neighbours of the percentile; only these are put in order.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("c"))
    limits = counts.groupBy(key).agg(
        F.min(value).alias("low"), F.max(value).alias("high"), F.sum("c").alias("n")
    )
    width = F.try_divide(F.col(value) - F.col("low"), F.col("high") - F.col("low"))
    placed = counts.join(limits, key).withColumns({
        "stretch": F.least(F.floor(F.coalesce(width, F.lit(0.0)) * stretches), F.lit(stretches - 1)),
        "place": F.lit(share) * (F.col("n") - 1),
    })
    upto = Window.partitionBy(key).orderBy("stretch")
    sums = placed.groupBy(key, "stretch", "place").agg(F.sum("c").alias("s")).withColumn(
        "before", F.sum("s").over(upto) - F.col("s")
    )
    near = sums.filter(
        (F.col("before") <= F.ceil("place")) & (F.col("before") + F.col("s") > F.floor("place"))
    ).select(key, "stretch", "before")
    inside = Window.partitionBy(key, "stretch").orderBy(value)
    ranked = placed.join(near, [key, "stretch"]).withColumn(
        "last", F.col("before") + F.sum("c").over(inside) - 1
    )

    def at(place):
        holds = (F.col("last") >= place) & (F.col("last") - F.col("c") < place)
        return F.max(F.when(holds, F.col(value)))

    return ranked.groupBy(key, "place").agg(
        at(F.floor("place")).alias("lower"), at(F.ceil("place")).alias("upper")
    ).select(
        key, (F.col("lower") + (F.col("upper") - F.col("lower"))
              * (F.col("place") - F.floor("place"))).alias(out),
    )


def latency_stats(log: DataFrame) -> DataFrame:
    """Mean, population deviation and 95th percentile of measured latencies."""
    means = log.groupBy("strategy").agg(
        F.avg("latency_ms").alias("mean_ms"), F.stddev_pop("latency_ms").alias("std_ms")
    )
    return means.join(exact_percentile(log, "strategy", "latency_ms", 0.95, "p95_ms"), "strategy", "left")


def summary_table(per_query: DataFrame, log: DataFrame, ks=EVAL_KS) -> DataFrame:
    """One wide row per strategy. The query types are counted, not computed."""
    top = max(ks)
    kinds = {"semantic": F.col("query_type") == "semantic"}
    kinds["constrained"] = ~kinds["semantic"]
    quality = per_query.groupBy("strategy").agg(
        F.count("*").alias("n_queries"),
        *[F.count(F.when(c, 1)).alias(f"n_{kind}") for kind, c in kinds.items()],
        F.avg("mrr").alias("mrr"), *_means(ks),
        *[
            F.coalesce(F.avg(F.when(c, F.col(f"recall_{top}"))), F.lit(0.0)).alias(f"recall_{kind}")
            for kind, c in kinds.items()
        ],
    )
    return quality.join(latency_stats(log).drop("std_ms"), "strategy", "left")


def metrics_documents(per_query: DataFrame, log: DataFrame, ks=EVAL_KS) -> DataFrame:
    """Metrics as nested records: value maps keyed by k, six digits, latency three."""
    semantic = F.col("query_type") == "semantic"
    wide = per_query.groupBy("strategy").agg(
        F.count("*").alias("n_queries"), F.avg("mrr").alias("mrr"), *_means(ks),
        *_means(ks, "semantic_", semantic), *_means(ks, "constrained_", ~semantic),
    ).join(latency_stats(log), "strategy", "left")
    keys = F.array(*[F.lit(str(k)) for k in ks])

    def by_k(name, metric, prefix=""):
        values = [rounded(f"{prefix}{metric}_{k}", 6) for k in ks]
        return F.map_from_arrays(keys, F.array(*values)).alias(name)

    return wide.select(
        "strategy", "n_queries", rounded("mrr", 6).alias("mrr"),
        by_k("recall", "recall"), by_k("ndcg", "ndcg"),
        by_k("recall_semantic", "recall", "semantic_"),
        by_k("recall_constrained", "recall", "constrained_"),
        by_k("ndcg_semantic", "ndcg", "semantic_"),
        by_k("ndcg_constrained", "ndcg", "constrained_"),
        F.struct(*[
            F.coalesce(rounded(c, 3), F.lit(0.0)).alias(c) for c in ("mean_ms", "std_ms", "p95_ms")
        ]).alias("latency"),
    )
