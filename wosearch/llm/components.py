"""Connected components of links, as alternating star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wosearch.session import materialise


def _mirrored(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of the node and its neighbours."""
    both = _mirrored(links)
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("node"), F.least("a", "m").alias("m")
    )
    return (
        both.filter("b > a").join(least, F.col("a") == F.col("node"))
        .select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of these neighbours."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    tied = down.join(least.withColumnRenamed("a", "node"), F.col("a") == F.col("node")).select(
        F.col("b").alias("a"), F.col("m").alias("b")
    )
    return tied.unionByName(least.withColumnRenamed("m", "b")).filter("a <> b").distinct()


def _state(links: DataFrame) -> tuple:
    row = links.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"),
    ).first()
    return row["n"], row["h"]


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that links (a, b) of longs lead to; roots included.

    Alternates large-star and small-star steps, each written to the shared folder, until the
    links no longer change; then every node is tied to its root. The number of steps grows
    with the logarithm of the longest chain. Without links the result is empty.
    """
    now = materialise(links.select("a", "b").filter("a <> b").distinct(), "links")
    state = _state(now)
    while state[0]:
        now = materialise(_small_star(_large_star(now)), "links")
        previous, state = state, _state(now)
        if state == previous:
            break
    tied = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return tied.unionByName(roots)
