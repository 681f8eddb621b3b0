"""Lookups that skip row groups."""

import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from wosearch.operators import inspection
from wosearch.schema import SEQ
from wosearch.sources import lookup


def orders(spark, n, copies=0):
    """Ids with white space around some of them, one id repeated, null and blank ids."""
    woid = (F.when(F.col("id") % 97 == 5, F.concat(F.lit(" \t"), F.lit("W"), F.col("id"), F.lit("  ")))
            .when(F.col("id") % 101 == 7, F.lit(None).cast("string"))
            .when(F.col("id") % 103 == 9, F.lit("  "))
            .when(F.col("id") < copies, F.lit("W-same")).otherwise(F.concat(F.lit("W"), F.col("id"))))
    return spark.range(n).select(
        F.col("id").alias(SEQ), woid.alias("WOID"), F.concat(F.lit("text "), F.sha2(F.col("id").cast("string"), 256)).alias("WODescription"))


def scanned_rows(df):
    """Rows the Parquet scan of a finished query handed on."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    if "Adaptive" in plan.getClass().getSimpleName():
        plan = plan.executedPlan()
    while plan.children().size():
        plan = plan.children().apply(0)
        if "QueryStage" in plan.getClass().getSimpleName():
            plan = plan.plan()
    return plan.metrics().apply("numOutputRows").value()


@pytest.mark.parametrize("sort", [True, False])
def test_row_groups_are_skipped(spark, tmp_path, sort):
    """By the range of their ids in the sorted layout, by Bloom filters alone in the other."""
    path = str(tmp_path / "t")
    rows = orders(spark, 20000)
    shuffled = rows.repartition(3, F.xxhash64(SEQ))
    lookup.write_lookup(shuffled, path, sort=sort, row_group_bytes=40_000, distinct_ids=2000)
    groups = [pq.ParquetFile(f).metadata for f in glob.glob(f"{path}/*.parquet")]
    largest = max(m.row_group(i).num_rows for m in groups for i in range(m.num_row_groups))
    assert sum(m.num_row_groups for m in groups) > 20
    table = lookup.open_lookup(spark, path)
    for wanted in ("W12345", "W1", "W19999"):
        found = lookup.find(table, wanted)
        assert found.collect() == inspection.lookup(rows, wanted).collect() and found.count() == 1
        assert scanned_rows(lookup.find(table, wanted)) <= 2 * largest
    assert "PushedFilters: [IsNotNull(woid_key), EqualTo(woid_key,W1)]" in \
        lookup.find(table, "W1")._jdf.queryExecution().executedPlan().toString().replace("..., ", "")
    # In between of stored ids: only a Bloom filter can tell.
    assert lookup.find(table, "W1234x").collect() == []
    if sort:
        assert scanned_rows(lookup.find(table, "W1234x")) <= largest


@pytest.mark.parametrize("wanted", ["W102", " W102 ", "W-same", "", "   ", "w102", "no such id", "W%", " W5\t"])
def test_same_row_as_the_scan(spark, tmp_path, wanted):
    rows = orders(spark, 3000, copies=1000)
    lookup.write_lookup(rows, str(tmp_path / "t"), row_group_bytes=20_000)
    table = lookup.open_lookup(spark, str(tmp_path / "t"))
    assert lookup.find(table, wanted).select(*rows.columns).collect() == inspection.lookup(rows, wanted).collect()


def test_several_ids_and_appends(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = orders(spark, 2000, copies=700)
    lookup.write_lookup(rows.filter(F.col(SEQ) >= 900), path)
    lookup.write_lookup(rows.filter(F.col(SEQ) < 900), path, mode="append")
    table = lookup.open_lookup(spark, path)
    wanted = ["W-same", "W1500", " W102", "none", "W1500"]
    got = sorted(r[SEQ] for r in lookup.find_all(table, wanted).collect())
    assert got == sorted(inspection.lookup(rows, w).first()[SEQ] for w in wanted[:3])
    assert lookup.find(table, "W-same").first()[SEQ] == inspection.lookup(rows, "W-same").first()[SEQ]


def test_empty_table(spark, tmp_path):
    lookup.write_lookup(orders(spark, 0), str(tmp_path / "t"))
    assert lookup.find(lookup.open_lookup(spark, str(tmp_path / "t")), "W1").collect() == []
