import numpy as np
import pytest
from pyspark.sql import functions as F

from wosearch.operators.encoding import HashEncoder, embed_queries, encode, split_by_validity
from wosearch.operators.search import neighbours, search
from wosearch.operators import strategies
from wosearch.functions.vectors import checked_dim

DIM = 16
CORPUS = "ingest_seq bigint, WOID string, v array<float>"


def random_rows(n, seed=0, copies=0):
    """n rows; the last ``copies`` repeat one vector, so scores tie."""
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, DIM)).astype("float32")
    if copies:
        m[-copies:] = m[0]
    return [(i, f"W{i % 97:03d}", [float(x) for x in m[i]]) for i in range(n)]


def brute(rows, probes, k):
    out = {}
    for q, vector in probes:
        q64 = np.array(vector, dtype="float64")
        scored = [(-np.float32(np.dot(q64, np.array(v, dtype="float64"))), w, i) for i, w, v in rows]
        out[q] = [i for _, _, i in sorted(scored)[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "pool_rank").collect():
        out.setdefault(r.query_id, []).append(r.ingest_seq)
    return out


@pytest.mark.parametrize("k", [1, 10, 200, 5000])
@pytest.mark.parametrize("options", [
    {}, {"salts": 3}, {"probe_block": 2},
])
def test_exact_against_brute_force(spark, k, options):
    """A third of the corpus is one vector; k may exceed the table."""
    rows = random_rows(1200, copies=400)
    probes = [(q, v) for q, _, v in random_rows(7, seed=1)[:6]] + [(99, rows[0][2])]
    corpus = spark.createDataFrame(rows, CORPUS).repartition(6)
    asked = spark.createDataFrame(probes, "query_id bigint, v array<float>")
    assert found(search(corpus, asked, k, "v", DIM, **options)) == brute(rows, probes, k)


def test_small_arrow_batches(spark):
    rows = random_rows(500, copies=200)
    probes = [(1, rows[0][2]), (2, rows[7][2])]
    corpus = spark.createDataFrame(rows, CORPUS).repartition(2)
    asked = spark.createDataFrame(probes, "query_id bigint, v array<float>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        got = found(search(corpus, asked, 25, "v", DIM))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute(rows, probes, 25)


def test_bad_vectors_never_match_and_are_reported(spark):
    good = [1.0] + [0.0] * (DIM - 1)
    rows = [(0, "ok", good), (1, "nan", [float("nan")] * DIM), (2, "short", [1.0]), (3, "none", None)]
    corpus = spark.createDataFrame(rows, CORPUS)
    asked = spark.createDataFrame([(1, good)], "query_id bigint, v array<float>")
    assert found(search(corpus, asked, 10, "v", DIM, invalid="skip")) == {1: [0]}
    with pytest.raises(Exception, match="vector size|not finite"):
        search(corpus, asked, 10, "v", DIM).collect()
    with pytest.raises(Exception, match="not finite"):
        search(corpus.filter("WOID = 'nan'"), asked, 10, "v", DIM).collect()
    bad = asked.unionByName(spark.createDataFrame([(2, [float("nan")] * DIM)], asked.schema))
    assert found(search(corpus, bad, 10, "v", DIM, invalid="skip")) == {1: [0]}
    with pytest.raises(Exception, match="not finite"):
        search(corpus.filter("WOID = 'ok'"), bad, 10, "v", DIM)
    kept, rejected = split_by_validity(corpus, "v", DIM)
    assert [r.WOID for r in kept.collect()] == ["ok"]
    assert {r.WOID for r in rejected.collect()} == {"nan", "short", "none"}
    with pytest.raises(Exception, match="vector size"):
        corpus.select(checked_dim(F.col("v"), DIM)).collect()


def test_blocks_of_queries_with_another_key(spark):
    """More queries than a block holds, on a table without a position column."""
    rows = random_rows(300, copies=100)
    corpus = spark.createDataFrame([(i, v) for i, _, v in rows], "id bigint, v array<float>")
    probes = [(q, v) for q, _, v in random_rows(9, seed=4)]
    asked = spark.createDataFrame(probes, "query_id bigint, v array<float>")
    got = search(corpus, asked, 5, "v", DIM, ("id",), probe_block=2).withColumnRenamed("id", "ingest_seq")
    assert found(got) == brute([(i, "", v) for i, _, v in rows], probes, 5)


def test_no_queries_and_no_rows(spark):
    corpus = spark.createDataFrame(random_rows(10), CORPUS)
    none = spark.createDataFrame([], "query_id bigint, v array<float>")
    assert search(corpus, none, 3, "v", DIM).count() == 0
    asked = spark.createDataFrame([(1, [1.0] * DIM)], "query_id bigint, v array<float>")
    assert search(corpus.filter("false"), asked, 3, "v", DIM).count() == 0


def test_neighbours_include_the_row(spark):
    rows = [(i, [float(x) for x in np.random.default_rng(i).normal(size=DIM)]) for i in range(50)]
    df = spark.createDataFrame(rows, "id bigint, v array<float>")
    got = neighbours(df, "id", "v", 7, 5, DIM).orderBy("pool_rank").collect()
    assert len(got) == 6 and got[0].id == 7


def test_encoder_is_deterministic_and_unit_length(spark):
    encoder = HashEncoder(64)
    texts = ["pump leak pump", "", "Pump LEAK pump", "été 42"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select("i", encode(F.col("t"), encoder).alias("v")).orderBy("i").collect()
    matrix = np.array([r.v for r in rows], dtype="float32")
    assert np.array_equal(matrix, HashEncoder(64).encode(texts))
    assert np.array_equal(matrix[0], matrix[2]) and not matrix[1].any()
    assert np.allclose(np.linalg.norm(matrix[[0, 3]], axis=1), 1)


class WordLength:
    """Another encoder, to show that the interface is open."""

    dim = 2

    def encode(self, texts):
        return np.array([[len(t), 1.0] for t in texts], dtype="float32")


def test_own_encoder(spark):
    from pyspark import cloudpickle
    import sys

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    df = spark.createDataFrame([(1, "abc")], "query_id bigint, query_text string")
    row = embed_queries(df, WordLength()).first()
    assert row.text_vec[0] == 60 and row.mice_vec[0] == 60 + len("work order description: ") - 0


# Strategies ------------------------------------------------------------------------------

TABLE = ("ingest_seq bigint, BuildingID string, BuildingName string, Type string, WOID string, "
         "WODescription string, equipment string, text_vec array<float>, mice_vec array<float>")
QUERIES = "query_id bigint, query_text string, building_id string, building_type string, equipment string"


@pytest.fixture(scope="module")
def table(spark):
    encoder = HashEncoder(64)
    words = ["pump", "leak", "roof", "fan", "door", "light", "heat", "cold"]
    rng = np.random.default_rng(3)
    rows = []
    for i in range(600):
        text = " ".join(rng.choice(words, 6))
        vector = [float(x) for x in encoder.encode([text])[0]]
        rows.append((i, "B1", "hall", "research" if i % 2 else "other", f"W{i % 400}", text,
                     "hvac" if i % 3 else "site", vector, vector))
    return spark.createDataFrame(rows, TABLE).repartition(4), rows, encoder


def python_strategies(rows, encoder, query, k):
    """All four strategies the plain way, for one query tuple."""
    _, text, b, t, e = query

    def ranked(prefix, n, column):
        q = encoder.encode([prefix + text])[0].astype("float64")
        scored = [(-np.float32(np.dot(q, np.array(r[column], dtype="float64"))), r[4], r[0], r)
                  for r in rows]
        seen, out = set(), []
        for _, woid, _, row in sorted(scored, key=lambda x: x[:3])[:n]:
            if woid not in seen:
                seen.add(woid)
                out.append(row)
        return out

    from wosearch.config import CONTEXT_QUERY_PREFIX, QUERY_PREFIX

    pool = ranked(QUERY_PREFIX, 20 * k, 7)
    kept = [r for r in pool if (not b or r[1] == b) and (not t or r[3] == t) and (not e or r[6] == e)]
    filtered = [r[4] for r in kept[:k]]
    return {
        "A": [r[4] for r in ranked(QUERY_PREFIX, k, 7)], "B": filtered, "B_prime": filtered,
        "C": [r[4] for r in ranked(QUERY_PREFIX + CONTEXT_QUERY_PREFIX, k, 8)],
    }


def test_strategies_against_python(spark, table):
    corpus, rows, encoder = table
    asked = [
        (1, "pump leak", None, "research", "hvac"), (2, "roof fan", "", "", ""),
        (3, "door light", "B1", None, "HVAC"), (4, "heat", None, "other", None),
    ]
    hits = strategies.retrieve_all(corpus, spark.createDataFrame(asked, QUERIES), encoder, 7)
    got = {}
    for r in hits.orderBy("query_id", "strategy", "rank").collect():
        got.setdefault((r.query_id, r.strategy), []).append(r.woid)
    for query in asked:
        for name, woids in python_strategies(rows, encoder, query, 7).items():
            assert got.get((query[0], name), []) == woids, (query, name)
    # Case matters to the filter: nothing is 'HVAC'.
    assert (3, "B") not in got


def test_single_strategies_equal_all(spark, table):
    corpus, _, encoder = table
    asked = spark.createDataFrame([(1, "pump", None, "research", None)], QUERIES)
    everything = strategies.retrieve_all(corpus, asked, encoder, 5)
    for name, one in (("A", strategies.strategy_a), ("B", strategies.strategy_b),
                      ("B_prime", strategies.strategy_b_prime), ("C", strategies.strategy_c)):
        want = everything.filter(F.col("strategy") == name).orderBy("rank").collect()
        assert one(corpus, asked, encoder, 5).orderBy("rank").collect() == want


def test_unknown_strategy_fails(spark, table):
    corpus, _, encoder = table
    asked = spark.createDataFrame([(1, "pump", None, None, None)], QUERIES).withColumn("strategy", F.lit("D"))
    with pytest.raises(Exception, match="unknown strategy"):
        strategies.retrieve_named(corpus, asked, encoder).collect()


def test_forced_strategy_keeps_the_filter(spark, table):
    from wosearch.operators.router import route_and_retrieve

    corpus, _, encoder = table
    asked = spark.createDataFrame([(1, "hvac pump"), (2, "leak")], "query_id bigint, query_text string")
    hits, routed = route_and_retrieve(corpus, asked, encoder, 4)
    assert {(r.query_id, r.strategy) for r in hits.collect()} == {(1, "B_prime"), (2, "A")}
    assert {r.equipment for r in hits.filter("query_id = 1").collect()} == {"hvac"}
    assert [r.signal for r in routed.orderBy("query_id").collect()] == ["equipment", "none"]
    forced, _ = route_and_retrieve(corpus, asked, encoder, 4, force="C")
    assert {r.strategy for r in forced.collect()} == {"C"}


def test_two_scans_keep_their_texts(spark, table, tmp_path):
    """Positions repeat between scans; every hit still gets its own text."""
    from wosearch.sources.vector_table import append_vectors, open_vectors

    corpus, _, encoder = table
    path = str(tmp_path / "vectors")
    for scan in ("first", "second"):
        part = corpus.withColumns({
            "WOID": F.concat(F.lit(scan + "-"), "WOID"),
            "WODescription": F.concat(F.lit(scan + ": "), "WODescription"),
            **{c: F.lit("") for c in ("WOStartDate", "WOEndDate", "text_repr", "mice_repr")},
        })
        append_vectors(part, path)
    asked = spark.createDataFrame([(1, "pump leak", None, None, None)], QUERIES)
    hits = strategies.strategy_a(open_vectors(spark, path), asked, encoder, 30).collect()
    scans = {r.woid.split("-")[0] for r in hits}
    assert scans == {"first", "second"}
    assert all(r.wo_description.startswith(r.woid.split("-")[0] + ": ") for r in hits)


def test_appended_twice_gives_one_hit_per_id(spark, table):
    corpus, rows, encoder = table
    asked = spark.createDataFrame([(1, "pump leak roof", None, None, None)], QUERIES)
    double = corpus.unionByName(corpus)
    hits = strategies.strategy_a(double, asked, encoder, 8).orderBy("rank").collect()
    want = python_strategies(rows + rows, encoder, (1, "pump leak roof", None, None, None), 8)["A"]
    assert [r.woid for r in hits] == want and len(want) < 8


def test_vectors_are_encoded_once(spark):
    rows = spark.range(50).select("id", F.concat(F.lit("pump "), "id").alias("t"))
    cells = rows.select("id", encode(F.col("t"), HashEncoder(8)).alias("v")).select("id", F.posexplode("v"))
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_encoder_remembers_a_bounded_number_of_tokens(monkeypatch):
    monkeypatch.setattr("wosearch.operators.encoding.KNOWN_TOKENS", 100)
    texts = [" ".join(f"t{i + j}" for j in range(40)) for i in range(0, 4000, 7)]
    encoder = HashEncoder(64)
    found = encoder.encode(texts)
    assert len(encoder._slots) <= 100
    assert np.array_equal(found, np.concatenate([HashEncoder(64).encode([t]) for t in texts]))


def test_a_task_holds_few_rows_in_double_precision():
    from wosearch.config import SCORE_ROWS
    from wosearch.operators.search import _BestRows

    assert _BestRows(np.ones((1, 4)), 3).rows_at_once == SCORE_ROWS
