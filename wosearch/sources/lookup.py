"""Work orders laid out for lookups by their id.

Rows are sorted by the trimmed id in ranges, in small row groups that carry a Bloom filter of it. A
lookup is an equality the scan can use: row groups whose range or Bloom filter leaves the id out are
skipped, in files that were appended later, too. An id that owns a large share of the rows spreads
over several ranges, because the position counts as a second key.
"""

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wosearch.functions.text import strip
from wosearch.schema import SEQ

KEY = "woid_key"
ROW_GROUP_BYTES = 8 << 20
# Distinct ids a row group's filter is made for, and its rate of false positives.
DISTINCT_IDS = 100_000
FALSE_POSITIVES = 0.01


def write_lookup(
    df: DataFrame, path: str, mode: str = "errorifexists", sort: bool = True,
    row_group_bytes: int = ROW_GROUP_BYTES, distinct_ids: int = DISTINCT_IDS,
) -> None:
    """Write (or append) rows with their key; ``sort=False`` leaves the order to the filters."""
    keyed = df.withColumn(KEY, strip(F.col("WOID")))
    if sort:
        keyed = keyed.repartitionByRange(KEY, SEQ).sortWithinPartitions(KEY, SEQ)
    (
        keyed.write.mode(mode)
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.block.size.row.check.min", 100)
        .option("parquet.page.size.row.check.min", 100)
        .option(f"parquet.bloom.filter.enabled#{KEY}", True)
        .option(f"parquet.bloom.filter.expected.ndv#{KEY}", distinct_ids)
        .option(f"parquet.bloom.filter.fpp#{KEY}", FALSE_POSITIVES)
        .parquet(path)
    )


def open_lookup(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def find(table: DataFrame, woid: str) -> DataFrame:
    """The first stored row of a WOID, or no row."""
    return table.filter(F.col(KEY) == F.lit(woid.strip())).orderBy(SEQ).limit(1).drop(KEY)


def find_all(table: DataFrame, woids: Iterable[str]) -> DataFrame:
    """The first stored row of each of a few WOIDs; the list travels with the scan's filter."""
    wanted = sorted({w.strip() for w in woids})
    rows = table.filter(F.col(KEY).isin(wanted))
    first = rows.groupBy(KEY).agg(F.min(SEQ).alias("_first"))
    return rows.join(
        first.withColumnRenamed(KEY, "_key"), (F.col(KEY) == F.col("_key")) & (F.col(SEQ) == F.col("_first"))
    ).dropDuplicates([KEY]).drop("_key", "_first")
