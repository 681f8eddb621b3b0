import random

import pytest
from pyspark.sql import functions as F

from wosearch.operators import cleaning, quality
from wosearch.operators.numbering import chunk_sizes, with_row_index
from wosearch.schema import CLEAN_COLUMNS, CLEAN_SCHEMA
from wosearch.sources import work_orders

LONG = "a description that is long enough"


def frame(spark, rows):
    """Rows of (seq, building, woid, description)."""
    full = [(i, b, "name", "type", w, d, "2024", "2025", "hvac") for i, b, w, d in rows]
    return spark.createDataFrame(full, CLEAN_SCHEMA)


def python_clean(rows, buckets=20):
    seen, out, missing = set(), {}, 0
    for i, b, w, d in sorted(rows):
        b = "" if (b or "").strip() in ("nan", "None") else (b or "").strip()
        if not w or w in seen:
            continue
        seen.add(w)
        if len(d) < 20:
            continue
        if b == "" or b.lower() in ("nan", "none"):
            b, missing = f"UNK_{missing % buckets}", missing + 1
        out[i] = (b, w)
    return out


def test_short_first_duplicate_removes_both(spark):
    rows = [(0, "B1", "W1", "short"), (1, "B1", "W1", LONG), (2, "B2", "W2", LONG)]
    assert [r.WOID for r in cleaning.clean(frame(spark, rows)).collect()] == ["W2"]


def test_placeholders_in_file_order(spark):
    rows = [(i, "" if i % 2 else "nan", f"W{i}", LONG) for i in range(45)]
    random.Random(1).shuffle(rows)
    got = cleaning.clean(frame(spark, rows)).orderBy("ingest_seq").collect()
    assert [r.BuildingID for r in got] == [f"UNK_{i % 20}" for i in range(45)]


def test_clean_matches_python_with_a_hot_id(spark):
    """A third of the rows share one id, another tenth has none."""
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        woid = "HOT" if i % 3 == 0 else "" if i % 10 == 1 else f"W{rng.randrange(1500)}"
        rows.append((i * 1_000_003, rng.choice(["B1", "", " nan ", "None", "none"]), woid,
                     rng.choice([LONG, "short"])))
    want = python_clean(rows)
    got = {r.ingest_seq: (r.BuildingID, r.WOID) for r in cleaning.clean(frame(spark, rows)).collect()}
    assert got == want
    counts = cleaning.cleaning_counts(frame(spark, rows)).first()
    assert counts.rows_read == 3000 and counts.rows_kept == len(want)
    assert counts.missing_woid == sum(1 for r in rows if not r[2])
    distinct = len({r[2] for r in rows if r[2]})
    assert counts.duplicate_woid == 3000 - counts.missing_woid - distinct
    assert counts.short_description == distinct - len(want)


@pytest.mark.parametrize("bucket", [1, 7, 100, 1 << 20])
def test_row_index(spark, bucket):
    numbers = random.Random(bucket).sample(range(10**15), 500)
    df = spark.createDataFrame([(n,) for n in numbers], "n bigint").repartition(5)
    got = {r.n: r.i for r in with_row_index(df, "n", "i", bucket).collect()}
    assert got == {n: i for i, n in enumerate(sorted(numbers))}


def test_chunk_sizes(spark):
    got = chunk_sizes(spark.range(25).withColumnRenamed("id", "n"), "n", 10).collect()
    assert sorted(map(tuple, got)) == [(0, 10), (1, 10), (2, 5)]


def test_enforce_schema_adds_columns(spark):
    df = spark.createDataFrame([("W1", 1)], "WOID string, extra int")
    assert cleaning.enforce_schema(df).columns == list(CLEAN_COLUMNS)


def test_preprocess_missing_values(spark):
    raw = spark.createDataFrame([(1, None, "A/B", None)], "ingest_seq bigint, BuildingID string, BuildingName string, WODescription string")
    row = cleaning.preprocess(raw).first()
    assert (row.BuildingID, row.BuildingName, row.WODescription, row.WOID) == ("nan", "a b", "", "")


def test_empty_table(spark):
    empty = frame(spark, [])
    assert cleaning.clean(empty).count() == 0
    assert cleaning.cleaning_counts(empty).first().rows_read == 0
    assert quality.readiness(empty).first().verdict == "NOT_READY"
    assert quality.full_report(empty).count() > 0


def test_quality_against_python(spark):
    rows = [(i, "UNK_1" if i % 4 == 0 else "B1", f"W{i % 7}", LONG if i % 3 else "") for i in range(40)]
    df = frame(spark, rows)
    report = {(r["check"], r.column): r.value for r in quality.full_report(df).collect()}
    assert report["placeholder_building", "BuildingID"] == 10
    assert report["empty_text", "WODescription"] == 14
    assert report["duplicate_woid", ""] == 33
    distinct = len({r[1:] for r in rows})
    assert report["duplicate_row", ""] == 40 - distinct
    assert report["n_distinct", "BuildingID"] == 2
    missing = quality.schema_report(df.drop("Type")).filter("NOT present").collect()
    assert [r.column for r in missing] == ["Type"]
    approx = quality.cardinality(df, ("WOID",), approximate=True).first()
    assert approx.n_distinct == 7


def test_csv_file_order_and_dialect(spark, tmp_path):
    header = "WOID,Other,WODescription,BuildingID,BuildingName,Type,WOStartDate,WOEndDate,SystemDescription\n"
    for name, numbers in (("b.csv", range(3, 6)), ("a.csv", range(3))):
        lines = [f'W{i},x,"say ""hi"",\nplease",NA,,null,2024,,HVAC\n' for i in numbers]
        (tmp_path / name).write_text(header + "".join(lines))
    rows = work_orders.read_raw(spark, str(tmp_path)).orderBy("ingest_seq").collect()
    assert [r.WOID for r in rows] == [f"W{i}" for i in range(6)]
    assert rows[0].WODescription == 'say "hi",\nplease'
    assert rows[0].BuildingID is None and rows[0].Type is None and rows[0].WOEndDate is None


def test_csv_bad_rows(spark, tmp_path):
    header = ",".join(CLEAN_COLUMNS) + "\n"
    body = "B1,n,t,W1,d,s,e,q\nB2,n,t,W2,d,s,e,q,extra\nB3,n,t,W3\nB4,n,t,W4,d,s,e,q,\n"
    path = tmp_path / "p.csv"
    path.write_text(header + body)
    rows = work_orders.read_preprocessed(spark, str(path)).orderBy("ingest_seq").collect()
    assert [(r.WOID, r.equipment) for r in rows] == [("W1", "q"), ("W3", ""), ("W4", "q")]
    with pytest.raises(Exception, match="more fields"):
        work_orders.read_clean(spark, str(path)).collect()


def test_csv_splits_keep_file_order(spark, tmp_path):
    path = tmp_path / "big.csv"
    path.write_text(",".join(CLEAN_COLUMNS) + "\n" + "".join(
        f"B,n,t,W{i},some text {i},s,e,q\n" for i in range(20000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 50_000)
    spark.conf.set("spark.sql.files.openCostInBytes", 1000)
    try:
        df = work_orders.read_clean(spark, str(path))
        assert df.rdd.getNumPartitions() > 1
        got = [r.WOID for r in df.orderBy("ingest_seq").select("WOID").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == [f"W{i}" for i in range(20000)]
    assert df.select("ingest_seq").distinct().count() == 20000


def test_stage_runs_once(spark, tmp_path):
    path = str(tmp_path / "out")
    work_orders.write_csv(spark.range(3).select(F.col("id").cast("string")), path, mode="ignore")
    work_orders.write_csv(spark.range(9).select(F.col("id").cast("string")), path, mode="ignore")
    assert spark.read.option("header", True).csv(path).count() == 3


def test_no_task_sorts_whole_texts(spark):
    from wosearch.sources import testdata

    kept = cleaning.clean(testdata.work_orders(spark, "/root/testdata/sf0.001").drop("stored_vec").transform(
        cleaning.preprocess))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ShuffledHashJoin") == 2
    assert "SortMergeJoin" not in plan and "RoundRobinPartitioning" not in "".join(
        line for line in plan.splitlines() if "text#" in line)
