"""Data-quality report."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wosearch.config import MIN_DESCRIPTION, READY_DESCRIPTION
from wosearch.schema import CLEAN_COLUMNS


def _share(part, total):
    return F.coalesce(F.try_divide(part, total), F.lit(0.0))


def schema_report(df: DataFrame) -> DataFrame:
    """One row per expected column: is it there?"""
    present = set(df.columns)
    return df.sparkSession.createDataFrame(
        [(c, c in present) for c in CLEAN_COLUMNS], "column string, present boolean"
    )


def missing_values(df: DataFrame) -> DataFrame:
    """Empty values and their share per column, in one pass over the table."""
    totals = df.agg(
        F.count("*").alias("total"),
        *[F.count(F.when(F.col(c) == "", 1)).alias(c) for c in CLEAN_COLUMNS],
    )
    return totals.unpivot("total", list(CLEAN_COLUMNS), "column", "missing").select(
        "column", "missing", _share(F.col("missing"), F.col("total")).alias("share")
    )


def placeholder_buildings(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.when(F.col("BuildingID").startswith("UNK"), 1)).alias("invalid"),
        F.count("*").alias("total"),
    ).select("invalid", _share(F.col("invalid"), F.col("total")).alias("share"))


def text_quality(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.when(F.col("WODescription") == "", 1)).alias("empty_text"),
        F.count(F.when(F.length("WODescription") < MIN_DESCRIPTION, 1)).alias("short_text"),
    )


def _row_digest(columns):
    """256-bit digest of a whole row; lengths keep neighbouring fields apart."""
    pieces = []
    for c in columns:
        value = F.col(c).cast("string")
        pieces += [
            F.coalesce(F.length(value).cast("string"), F.lit("null")), F.lit(":"),
            F.coalesce(value, F.lit("")),
        ]
    return F.sha2(F.concat(*pieces), 256)


def duplicates(df: DataFrame, columns=CLEAN_COLUMNS) -> DataFrame:
    """Rows beyond the first per WOID, and beyond the first per identical row.

    The whole-row check shuffles a digest, not the text.
    """
    by_woid = df.groupBy("WOID").count().agg(
        F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("value")
    )
    by_row = df.groupBy(_row_digest(columns).alias("digest")).count().agg(
        F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("value")
    )
    return by_woid.select(F.lit("duplicate_woid").alias("check"), "value").unionByName(
        by_row.select(F.lit("duplicate_row").alias("check"), "value")
    )


def cardinality(df: DataFrame, columns=("BuildingID", "Type"), approximate: bool = False):
    """Distinct values per column; ``approximate`` trades exactness for no shuffle of values."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(*[count(F.col(c)).alias(c) for c in columns]).unpivot(
        [], list(columns), "column", "n_distinct"
    )


def readiness_condition():
    return (
        (F.length("WODescription") > READY_DESCRIPTION)
        & (F.col("BuildingID") != "") & (F.col("Type") != "")
    )


def readiness(df: DataFrame) -> DataFrame:
    """Share of rows good enough to embed, with a verdict."""
    good = readiness_condition()
    counted = df.agg(F.count(F.when(good, 1)).alias("good_rows"), F.count("*").alias("total"))
    scored = counted.withColumn("score", _share(F.col("good_rows"), F.col("total")))
    return scored.withColumn(
        "verdict",
        F.when(F.col("score") > 0.85, "READY").when(F.col("score") > 0.6, "USABLE")
        .otherwise("NOT_READY"),
    )


def full_report(df: DataFrame) -> DataFrame:
    """All checks as (check, column, value) rows. Everything that is not a distinct count
    comes from one pass over the table.
    """
    good = readiness_condition()
    counters = {
        **{f"missing:{c}": F.col(c) == "" for c in CLEAN_COLUMNS},
        "placeholder_building:BuildingID": F.col("BuildingID").startswith("UNK"),
        "empty_text:WODescription": F.col("WODescription") == "",
        "short_text:WODescription": F.length("WODescription") < MIN_DESCRIPTION,
        "ready_rows:": good,
    }
    counted = df.agg(
        F.count("*").cast("double").alias("rows:"),
        *[F.count(F.when(c, 1)).cast("double").alias(n) for n, c in counters.items()],
    )
    shares = {n.replace(":", "_share:"): _share(F.col(f"`{n}`"), F.col("`rows:`"))
              for n in counters if not n.startswith(("empty", "short"))}
    wide = counted.withColumns(shares)
    simple = wide.unpivot([], list(wide.columns), "name", "value").select(
        F.split_part("name", F.lit(":"), F.lit(1)).alias("check"),
        F.split_part("name", F.lit(":"), F.lit(2)).alias("column"),
        "value",
    )
    present = schema_report(df).select(
        F.lit("present").alias("check"), "column", F.col("present").cast("double").alias("value")
    )
    double = duplicates(df).select("check", F.lit("").alias("column"), F.col("value").cast("double"))
    distinct = cardinality(df).select(
        F.lit("n_distinct").alias("check"), "column", F.col("n_distinct").cast("double").alias("value")
    )
    return simple.unionByName(present).unionByName(double).unionByName(distinct)


def corpus_headline(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_distinct("BuildingID").alias("n_buildings"),
        F.count_distinct("Type").alias("n_types"),
        F.count_distinct("equipment").alias("n_equipment"),
    )


def top_values(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """Most frequent values; equal counts in ascending value order."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n_rows"))
    return counts.orderBy(F.desc("n_rows"), "value").limit(n)


def facet_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).alias("value")).distinct().orderBy("value")
