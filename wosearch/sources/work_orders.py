"""Work orders in CSV files."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wosearch.config import BROADCAST_FILES
from wosearch.functions.text import na_to_empty, na_to_null
from wosearch.schema import CLEAN_COLUMNS, RAW_COLUMNS, SEQ, string_schema

# A field may hold line breaks and doubled quotes.
_DIALECT = {"header": True, "quote": '"', "escape": '"'}


def _headers(spark: SparkSession, path) -> dict[str, list[str]]:
    """Files by the text of their first line.

    One scan of the lines finds the header of every file; the result has a row per file.
    """
    lines = spark.read.text(path).select(
        "value", F.monotonically_increasing_id().alias("at"),
        F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_path").alias("file"),
    )
    firsts = lines.filter("start = 0").groupBy("file").agg(F.min_by("value", "at").alias("header"))
    groups: dict[str, list[str]] = {}
    for row in firsts.orderBy("file").collect():
        groups.setdefault(row["header"], []).append(row["file"])
    return groups


def _with_file_order(df: DataFrame, files: list[str]) -> DataFrame:
    """Add the position in file order as a bigint.

    ``files`` is the whole scan's list. Files rank by path. Inside a file the number is the byte offset of the split plus the
    row position in the task: unique and ascending, because a row takes at least one byte
    and only the last split of a file shares a task with other files.
    """
    ranks = df.sparkSession.createDataFrame(
        list(enumerate(files)), "file_rank bigint, file string"
    )
    # The list of files came from the driver. Beyond the bound Spark picks the join.
    ranks = F.broadcast(ranks) if len(files) <= BROADCAST_FILES else ranks
    position = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = df.select(
        "*",
        F.input_file_name().alias("file"),
        (F.input_file_block_start() + position).alias("offset"),
    )
    return (
        placed.join(ranks, "file")
        .withColumn(SEQ, F.shiftleft("file_rank", 40) + F.col("offset"))
        .drop("file", "file_rank", "offset")
    )


def _read_strings(spark: SparkSession, path, columns, multi_line: bool, bad_rows: str):
    """All-string scan by header name, whatever the order of columns in a file. A short row is
    padded with nulls; a row with more fields than the header fails the job or is skipped; a
    trailing delimiter is no field. Columns the header lacks read as ``''``.
    """
    files = sorted(spark.read.text(path).inputFiles())
    groups = _headers(spark, path) if len(files) > 1 else {"": files}
    scans = [
        _read_group(spark, group, files, columns, multi_line, bad_rows)
        for group in groups.values()
    ]
    wanted = [SEQ, *columns]
    return reduce(DataFrame.unionByName, [scan.select(*wanted) for scan in scans])


def _read_group(spark, group, files, columns, multi_line: bool, bad_rows: str) -> DataFrame:
    """Files of one header."""
    options = {**_DIALECT, "multiLine": multi_line}
    header = spark.read.options(**options).csv(group[0]).columns
    df = (
        spark.read.schema(string_schema([*header, "_overflow"]))
        .options(**options, enforceSchema=True)
        .csv(group)
    )
    df = _with_file_order(df, files)
    if bad_rows == "skip":
        df = df.filter(F.col("_overflow").isNull())
    else:
        too_long = F.raise_error(F.lit("row has more fields than the header"))
        df = df.filter(F.when(F.col("_overflow").isNull(), True).otherwise(too_long))
    return df.withColumns({c: F.lit("") for c in columns if c not in header})


def _map_columns(df: DataFrame, columns, function) -> DataFrame:
    return df.select(SEQ, *[function(F.col(c)).alias(c) for c in columns])


def read_raw(spark: SparkSession, path, multi_line: bool = True) -> DataFrame:
    """Raw export. All columns stay text; the usual missing-value strings become null.

    Free text may hold line breaks, which makes a file one split: export many files.
    """
    df = _read_strings(spark, path, RAW_COLUMNS, multi_line, "error")
    return _map_columns(df, RAW_COLUMNS, na_to_null)


def read_preprocessed(spark: SparkSession, path, multi_line: bool = False) -> DataFrame:
    """Normalised export. Over-long rows are skipped, missing values become ``''``."""
    df = _read_strings(spark, path, CLEAN_COLUMNS, multi_line, "skip")
    return _map_columns(df, CLEAN_COLUMNS, na_to_empty)


def read_clean(spark: SparkSession, path, multi_line: bool = False) -> DataFrame:
    """Cleaned export, all text, missing values filled with ``''``."""
    df = _read_strings(spark, path, CLEAN_COLUMNS, multi_line, "error")
    return _map_columns(df, CLEAN_COLUMNS, na_to_empty)


def read_columns(spark: SparkSession, path, columns, multi_line: bool = True) -> DataFrame:
    """The named columns of any CSV files as text, with their position in file order."""
    return _read_strings(spark, path, columns, multi_line, "error")


def write_csv(df: DataFrame, path, quote_all: bool = False, mode: str = "errorifexists") -> None:
    """CSV with a header; only fields that need it are quoted unless ``quote_all``.

    ``mode="ignore"`` skips the job when its output exists.
    """
    (
        df.write.mode(mode).options(**_DIALECT)
        .options(
            quoteAll=quote_all,
            ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
        )
        .csv(path)
    )


def first_rows(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows in file order."""
    return df.orderBy(SEQ).limit(n)
