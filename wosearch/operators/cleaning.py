"""From raw work orders to the cleaned table."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wosearch.config import MIN_DESCRIPTION, PLACEHOLDER_BUCKETS
from wosearch.functions.text import na_to_empty, search_text, strip
from wosearch.operators.numbering import with_row_index
from wosearch.schema import CLEAN_COLUMNS, RAW_COLUMNS, SEQ
from wosearch.session import materialise


def preprocess(raw: DataFrame) -> DataFrame:
    """Normalise the text columns, cast the others to text, rename the system column.

    A missing value turns into ``'nan'`` in a cast column and into ``''`` in a text column;
    a column the export lacks counts as ``''``.
    """
    raw = raw.withColumns({c: F.lit("") for c in RAW_COLUMNS if c not in raw.columns})

    def as_text(c):
        return F.coalesce(F.col(c).cast("string"), F.lit("nan"))

    return raw.select(
        SEQ,
        as_text("BuildingID").alias("BuildingID"),
        search_text(F.col("BuildingName")).alias("BuildingName"),
        search_text(F.col("Type")).alias("Type"),
        as_text("WOID").alias("WOID"),
        search_text(F.col("WODescription")).alias("WODescription"),
        as_text("WOStartDate").alias("WOStartDate"),
        as_text("WOEndDate").alias("WOEndDate"),
        search_text(F.col("SystemDescription")).alias("equipment"),
    )


def fill_missing(df: DataFrame) -> DataFrame:
    """What a write to CSV and a read back do: missing-value strings become ``''``."""
    return df.withColumns({c: na_to_empty(F.col(c)) for c in CLEAN_COLUMNS if c in df.columns})


def standard_building_id(c) -> Column:
    c = strip(c)
    return F.when(c.isin("nan", "None"), F.lit("")).otherwise(c)


def has_woid() -> Column:
    return F.col("WOID") != ""


def long_enough(minimum: int = MIN_DESCRIPTION) -> Column:
    return F.length("WODescription") >= minimum


def lacks_building(c) -> Column:
    """Null, blank, or one of the words nan / none in any case."""
    return c.isNull() | (strip(c) == "") | F.lower(c).isin("nan", "none")


def first_per_woid(df: DataFrame) -> DataFrame:
    """The first row of every WOID in file order.

    The winner is found on two narrow columns with map-side aggregation, so a WOID that
    owns a large share of the rows still costs one row per map task.
    """
    winners = df.groupBy("WOID").agg(F.min(SEQ).alias(SEQ)).select(SEQ)
    return df.join(winners, SEQ, "left_semi")


def assign_placeholders(df: DataFrame, buckets: int = PLACEHOLDER_BUCKETS) -> DataFrame:
    """The i-th row without a building (file order) gets ``UNK_{i mod buckets}``."""
    missing = df.filter(lacks_building(F.col("BuildingID"))).select(SEQ)
    labels = with_row_index(missing, SEQ).select(
        SEQ, F.concat(F.lit("UNK_"), (F.col("row_index") % buckets).cast("string")).alias("_label")
    )
    return (
        df.join(labels, SEQ, "left")
        .withColumn("BuildingID", F.coalesce("_label", "BuildingID"))
        .drop("_label")
    )


def fill_defaults(df: DataFrame) -> DataFrame:
    # Fixed values.
    defaults = {
        "BuildingName": "UNKNOWN_BUILDING", "Type": "UNKNOWN_TYPE", "WOEndDate": "ONGOING",
    }
    return df.withColumns({
        c: F.when(F.col(c) == "", F.lit(v)).otherwise(F.col(c)) for c, v in defaults.items()
    })


def enforce_schema(df: DataFrame) -> DataFrame:
    """Exactly the eight clean columns (and the file position when there is one)."""
    df = df.withColumns({c: F.lit("") for c in CLEAN_COLUMNS if c not in df.columns})
    return df.select(*[c for c in (SEQ,) if c in df.columns], *CLEAN_COLUMNS)


def _survivors(df: DataFrame) -> DataFrame:
    """One narrow row per WOID: its first position, whether that row is kept, whether it
    lacks a building. Fixed-width aggregates, so Spark hashes instead of sorting.
    """
    return df.groupBy("WOID").agg(
        F.min(SEQ).alias(SEQ),
        F.min_by(long_enough(), F.col(SEQ)).alias("kept"),
        F.min_by(lacks_building(F.col("BuildingID")), F.col(SEQ)).alias("lacks"),
        F.count("*").alias("n_rows"),
    )


def clean(preprocessed: DataFrame, buckets: int = PLACEHOLDER_BUCKETS) -> DataFrame:
    """The cleaning job: drop rows without WOID, keep the first row of each WOID, drop
    short descriptions, spread missing buildings over placeholders, fill defaults.

    All decisions are taken on narrow rows and written out, a few bytes per work order; the
    full rows move once, to meet them. They meet in hash tables of the decisions, so that no
    task sorts whole texts.
    """
    df = fill_missing(preprocessed)
    df = df.withColumn("BuildingID", standard_building_id(F.col("BuildingID")))
    survivors = _survivors(df.filter(has_woid())).filter("kept").select(SEQ, "lacks")
    kept = materialise(survivors, "cleaning-decisions")
    numbered = with_row_index(kept.filter("lacks").select(SEQ), SEQ)
    label = F.concat(F.lit("UNK_"), (F.col("row_index") % buckets).cast("string"))
    decisions = kept.join(numbered, SEQ, "left").select(SEQ, label.alias("_label"))
    rows = df.join(decisions.hint("shuffle_hash"), SEQ).withColumn("BuildingID", F.coalesce("_label", "BuildingID"))
    return enforce_schema(fill_defaults(rows))


def cleaning_counts(preprocessed: DataFrame) -> DataFrame:
    """Rows read, rows each step removed and rows left, from one aggregation by WOID."""
    df = fill_missing(preprocessed)
    real = has_woid().cast("bigint")
    totals = _survivors(df).agg(
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("rows_read"),
        F.coalesce(F.sum(F.col("n_rows") * real), F.lit(0)).alias("with_woid"),
        F.coalesce(F.sum(real), F.lit(0)).alias("distinct_woid"),
        F.coalesce(F.sum(F.col("kept").cast("bigint") * real), F.lit(0)).alias("rows_kept"),
    )
    return totals.select(
        "rows_read",
        (F.col("rows_read") - F.col("with_woid")).alias("missing_woid"),
        (F.col("with_woid") - F.col("distinct_woid")).alias("duplicate_woid"),
        (F.col("distinct_woid") - F.col("rows_kept")).alias("short_description"),
        "rows_kept",
    )
