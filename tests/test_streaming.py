import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from wosearch.operators.encoding import HashEncoder
from wosearch.operators.router import classify, find_term, override_filters, query_class
from wosearch.operators import inspection
from wosearch.plans.build import build_tables, build_vectors
from wosearch.schema import CLEAN_SCHEMA
from wosearch.sources.vector_table import open_vectors, table_stats
from wosearch.streaming.ingest import ingest_progress, ingest_totals, start_ingest
from wosearch.streaming.routing import start_routing
from wosearch.config import EQUIPMENT_TERMS


class Fragile(HashEncoder):
    """Fails on one work order as long as a flag file exists."""

    def __init__(self, dim, flag):
        super().__init__(dim)
        self.flag = flag

    def __getstate__(self):
        return {**super().__getstate__(), "flag": self.flag}

    def encode(self, texts):
        if os.path.exists(self.flag) and any("poison" in t for t in texts):
            raise RuntimeError("encoder died")
        return super().encode(texts)


def ship_tests():
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])


def write_chunk(spark, path, numbers, poison=None):
    rows = [(i, "B1", "hall", "research", f"W{i}", "poison" if i == poison else f"text {i}",
             "s", "e", "hvac") for i in numbers]
    spark.createDataFrame(rows, CLEAN_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_restart_after_a_failed_batch(spark, tmp_path):
    ship_tests()
    source, table, checkpoint = (str(tmp_path / n) for n in ("source", "table", "checkpoint"))
    flag = tmp_path / "flag"
    flag.touch()
    encoder = Fragile(32, str(flag))
    for chunk in range(4):
        write_chunk(spark, source, range(chunk * 10, chunk * 10 + 10), poison=25)

    def run():
        start_ingest(spark, source, table, checkpoint, encoder).awaitTermination()

    with pytest.raises(Exception, match="encoder died"):
        run()
    flag.unlink()
    run()
    run()
    stored = spark.read.parquet(table)
    assert sorted(r.WOID for r in stored.collect()) == sorted(f"W{i}" for i in range(40))
    totals = ingest_totals(ingest_progress(spark.read.parquet(source), stored)).first()
    assert tuple(totals) == (4, 40, True)
    # A new chunk adds only its own rows.
    write_chunk(spark, source, range(40, 45))
    pending = ingest_totals(ingest_progress(spark.read.parquet(source), stored)).first()
    assert tuple(pending) == (4, 40, False)
    run()
    assert spark.read.parquet(table).count() == 45


def test_open_missing_table(spark, tmp_path):
    path = str(tmp_path / "nothing")
    assert tuple(table_stats(open_vectors(spark, path)).first()) == (0, 0, 0)
    with pytest.raises(Exception):
        open_vectors(spark, path, required=True)


def test_build_in_stages_equals_one_plan(spark, tmp_path):
    raw = spark.createDataFrame(
        [(i, "", f"Hall {i}", "Research", f"W{i // 2}", f"Pump; leak, number {i} in the cellar",
          "2024", None, "HVAC") for i in range(30)],
        "ingest_seq bigint, BuildingID string, BuildingName string, Type string, WOID string, "
        "WODescription string, WOStartDate string, WOEndDate string, SystemDescription string")
    encoder = HashEncoder(32)
    staged = build_tables(raw, str(tmp_path / "t"), encoder).orderBy("ingest_seq").collect()
    assert staged == build_vectors(raw, encoder).orderBy("ingest_seq").collect()
    assert len(staged) == 15 and staged[0].WOEndDate == "ONGOING"
    # The stages exist: other input changes nothing.
    again = build_tables(raw.limit(1), str(tmp_path / "t"), encoder)
    assert again.count() == 15


QUERY_TEXTS = {
    "a": "plumbing elevator failure", "b": "leak in A050", "c": "leak in a050",
    "d": "HVAC in mixed teaching research area of C201", "e": "nothing here", "f": "",
    "g": "websites and others", "h": "research A1234 B12", "i": "fire  protection", "j": "fire protection.",
}


def test_router(spark):
    df = spark.createDataFrame(list(QUERY_TEXTS.items()), "query_id string, query_text string")
    rows = {r.query_id: r for r in query_class(classify(df)).collect()}
    assert rows["a"].equipment == "elevator" and rows["a"].strategy == "B_prime"
    assert (rows["b"].building_id, rows["b"].signal, rows["b"].strategy) == ("A050", "building_id", "B")
    assert (rows["c"].building_id, rows["c"].strategy) == (None, "A")
    assert (rows["d"].signal, rows["d"].building_type, rows["d"].building_id) == (
        "mixed", "mixed teaching research", "C201")
    assert rows["e"].query_class == "semantic" and rows["e"].n_tokens == 2
    assert rows["f"].n_tokens == 0
    assert rows["g"].signal == "none"
    assert (rows["h"].signal, rows["h"].building_id) == ("type", "A1234")
    assert rows["i"].equipment is None and rows["j"].equipment == "fire protection"


def test_override(spark):
    df = spark.createDataFrame(
        [("q", "A050", None, "hvac", "", "other", "site")],
        "query_id string, building_id string, building_type string, equipment string, "
        "manual_building_id string, manual_building_type string, manual_equipment string")
    row = override_filters(df).first()
    assert (row.building_id, row.building_type, row.equipment) == ("A050", "other", "site")


def test_vocabulary_order(spark):
    df = spark.createDataFrame([("site hvac interior finishes",)], "t string")
    assert df.select(find_term(F.col("t"), EQUIPMENT_TERMS)).first()[0] == "interior finishes"


def test_routing_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame(list(QUERY_TEXTS.items()), "query_id string, query_text string")
    df.write.parquet(str(tmp_path / "in"))
    start_routing(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    streamed = spark.read.parquet(str(tmp_path / "out")).orderBy("query_id").collect()
    assert streamed == query_class(classify(df)).orderBy("query_id").collect()


# Inspection ------------------------------------------------------------------------------

def vectors(spark, n=60, dim=8):
    m = np.random.default_rng(11).normal(size=(n, dim)).astype("float32")
    rows = [(i, "" if i % 5 == 0 else f"l{i % 3}", [float(x) for x in m[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "id bigint, label string, v array<float>").repartition(3), m.astype("float64")


def test_projection_equals_numpy(spark):
    df, m = vectors(spark)
    points, variance = inspection.project_2d(df, "id", "v", "label")
    centred = m - m.mean(axis=0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    signs = np.sign(vt[[0, 1], np.abs(vt[:2]).argmax(axis=1)])
    want = centred @ vt[:2].T * signs
    rows = points.orderBy("id").collect()
    assert np.allclose([[r.x, r.y] for r in rows], want)
    assert rows[0].label == "unknown" and rows[1].label == "l1"
    shares = [r.variance_share for r in variance.orderBy("component").collect()]
    assert np.allclose(shares, (s ** 2 / (s ** 2).sum())[:2])


@pytest.mark.parametrize("n", [None, 20])
def test_average_similarity_equals_numpy(spark, n):
    df, m = vectors(spark)
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    unit = unit if n is None else unit[:n]
    row = inspection.average_similarity(df, "id", "v", 8, n).first()
    assert row.n_rows == len(unit)
    assert row.average_similarity == pytest.approx((unit @ unit.T).mean())


def test_sanity_flags(spark):
    df = spark.createDataFrame(
        [(1, [3.0, 4.0]), (2, [float("nan"), 0.0]), (3, [float("inf"), 1.0])], "id bigint, v array<float>")
    bad = inspection.sanity(df, "v").first()
    assert bad.has_nan and bad.has_inf
    good = inspection.sanity(df.filter("id = 1"), "v").first()
    assert (good.n_rows, good.dim, good.element_type, good.mean_norm, good.std_norm) == (1, 2, "float", 5.0, 0.0)
    assert not good.has_nan and not good.has_inf


def test_grid_and_sample(spark):
    df, _ = vectors(spark)
    cells = inspection.vector_grid(df, "id", "v", 3).filter("id = 0").orderBy("dimension").collect()
    assert [(r.grid_row, r.grid_column) for r in cells] == [(i // 3, i % 3) for i in range(6)]
    table = df.withColumn("WOID", F.concat(F.lit("W"), "id"))
    once, twice = (sorted(r.id for r in inspection.sample(table, 10).collect()) for _ in range(2))
    assert once == twice and len(set(once)) == 10


def test_rows_of_one_chunk_are_dealt_over_the_cores(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "out")
    write_chunk(spark, source, range(400))
    start_ingest(spark, source, table, str(tmp_path / "c"), HashEncoder(8)).awaitTermination()
    stored = spark.read.parquet(table)
    assert stored.count() == 400 and len(stored.inputFiles()) > 1
    assert stored.select("chunk").distinct().count() == 1
