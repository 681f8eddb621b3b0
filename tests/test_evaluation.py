import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wosearch.operators import analysis, evalset, insights, metrics
from wosearch.operators.encoding import HashEncoder, embed_documents
from wosearch.functions.representation import with_representations
from wosearch.plans.evaluation import full_analysis, run_evaluation
from wosearch.schema import CLEAN_SCHEMA
from wosearch.sources import results

CASES = ("query_id string, query_text string, query_type string, group_equipment string, "
         "group_type string, description string, n_relevant bigint")


def cleaned(spark, rows):
    """Rows of (seq, type, woid, description, equipment)."""
    full = [(i, "B1", "hall", t, w, d, "s", "e", q) for i, t, w, d, q in rows]
    return spark.createDataFrame(full, CLEAN_SCHEMA)


def digest(*parts):
    return hashlib.md5("|".join(("42", *parts)).encode()).hexdigest()


def python_cases(rows, n):
    """The sequential rule, one group after the other."""
    groups = {}
    for i, t, w, d, q in rows:
        if q not in ("", "UNKNOWN_TYPE") and t not in ("", "UNKNOWN_TYPE"):
            groups.setdefault((q, t), []).append((int(digest(w)[:15], 16), w, d))
    out, n_constrained = [], int(n * 0.6)
    for q, t in sorted((g for g, m in groups.items() if len(m) >= 5), key=lambda g: digest(*g)):
        if len(out) >= n:
            break
        _, woid, text = min(groups[q, t])
        constrained = len(out) < n_constrained
        query = f"{q} {t}: {text}" if constrained else text
        if len(query) >= 10:
            out.append((digest(q, t), query, "constrained" if constrained else "semantic",
                        woid, len(groups[q, t]) - 1))
    return out


def case_rows():
    """40 groups, one with a third of all rows; some seeds have texts too short to use."""
    rows, i = [], 0
    for g in range(40):
        size = 400 if g == 7 else 3 + g % 9
        for _ in range(size):
            text = "ab" if g % 5 == 1 else f"broken part number y{'x' * (i % 4)}"
            rows.append((i, f"t{g % 4}", f"W{i}", text, f"e{g // 4}"))
            i += 1
    rows += [(i + j, "UNKNOWN_TYPE", f"V{j}", "some long text", "e1") for j in range(9)]
    return rows


@pytest.mark.parametrize("n", [0, 1, 10, 20, 30, 500])
def test_cases_follow_the_sequential_rule(spark, n):
    rows = case_rows()
    got = evalset.build_cases(cleaned(spark, rows), n).orderBy("query_id").collect()
    assert [(r.query_id, r.query_text, r.query_type, r.seed_woid, r.n_relevant) for r in got] == \
        sorted(python_cases(rows, n))


def test_relevant_rows_skip_the_seed(spark):
    df = cleaned(spark, case_rows())
    cases = evalset.build_cases(df, 500)
    counted = evalset.relevant_rows(df, cases).groupBy("query_id").count()
    joined = cases.join(counted, "query_id")
    assert joined.count() == cases.count()
    assert joined.filter("count <> n_relevant").count() == 0


def test_no_group_is_an_error(spark):
    with pytest.raises(ValueError):
        evalset.build_cases(cleaned(spark, [(1, "t", "W1", "text", "e")]))


HITS = "query_id string, strategy string, rank int, woid string, score float, wo_description string"


def small_world(spark):
    cases = [("q1", "pump", "semantic", "e", "t", "one", 3), ("q2", "fan", "constrained", "e", "t", "two", 12),
             ("q3", "door", "constrained", "e", "t", "three", 0)]
    hits = (
        [("q1", "A", r, f"w{r}", 1.0 / r, "x") for r in range(1, 11)]
        + [("q1", "B", 1, "w3", 0.5, "x")]
        + [("q2", "A", r, f"v{r}", 1.0 / r, "x") for r in range(1, 11)]
        + [("q2", "C", r, f"u{r}", 1.0 / r, "x") for r in range(1, 11)]
    )
    relevant = ([("q1", w) for w in ("w3", "w5", "w99")] + [("q2", f"v{r}") for r in range(1, 13)]
                + [("q2", "u10")])
    return (spark.createDataFrame(cases, CASES), spark.createDataFrame(hits, HITS),
            spark.createDataFrame(relevant, "query_id string, woid string"), cases, hits, relevant)


def python_metrics(hits, relevant, n_relevant, k):
    rel = {w for q, w in relevant if q == hits[0][0]} if hits else set()
    ranked = [h[3] for h in sorted(hits, key=lambda h: h[2])]
    first = next((i for i, w in enumerate(ranked, 1) if w in rel), None)
    recall = len(set(ranked[:k]) & rel) / n_relevant if n_relevant else 0.0
    dcg = sum(1 / math.log2(i + 1) for i, w in enumerate(ranked[:k], 1) if w in rel)
    ideal = sum(1 / math.log2(i + 1) for i in range(1, min(n_relevant, k) + 1))
    return recall, dcg / ideal if ideal else 0.0, 1 / first if first else 0.0, first


def test_metrics_against_python(spark):
    cases_df, hits_df, rel_df, cases, hits, relevant = small_world(spark)
    judged = metrics.judge(hits_df, rel_df)
    rows = {(r.query_id, r.strategy): r for r in metrics.per_query_metrics(judged, cases_df).collect()}
    assert len(rows) == 12
    for case in cases:
        for s in ("A", "B", "B_prime", "C"):
            mine = [h for h in hits if h[:2] == (case[0], s)]
            for k in (1, 5, 10):
                recall, ndcg, mrr, first = python_metrics(mine, relevant, case[6], k)
                row = rows[case[0], s]
                assert row[f"recall_{k}"] == pytest.approx(recall)
                assert row[f"ndcg_{k}"] == pytest.approx(ndcg)
                assert row.mrr == pytest.approx(mrr) and row.first_hit_rank == first


def test_means_and_comparison(spark):
    cases_df, hits_df, rel_df, *_ = small_world(spark)
    per_query = metrics.per_query_metrics(metrics.judge(hits_df, rel_df), cases_df)
    by_type = {(r.strategy, r.query_type): r for r in metrics.metrics_by_type(per_query).collect()}
    assert by_type["A", "all"].n_queries == 3 and by_type["A", "constrained"].n_queries == 2
    assert by_type["A", "semantic"].recall_10 == pytest.approx(2 / 3)
    compared = analysis.compare(per_query)
    rows = {r.query_id: r for r in compared.collect()}
    assert rows["q1"].metadata_gain == pytest.approx(1 / 3 - 2 / 3)
    assert (rows["q1"].best_strategy, rows["q1"].worst_strategy) == ("A", "B_prime")
    assert (rows["q3"].best_strategy, rows["q3"].worst_strategy) == ("A", "A")
    assert [r.query_id for r in analysis.hurt(compared).collect()] == ["q2", "q1"]
    assert analysis.helped(compared).count() == 0
    impact = analysis.impact_summary(compared).first()
    assert (impact.n_helped, impact.n_hurt, impact.n_neutral) == (0, 2, 1)
    assert impact.largest_gain_query is None and impact.largest_loss_query == "two"
    pairs = {(r.s1, r.s2): (r.wins, r.losses, r.ties) for r in analysis.win_matrix(compared).collect()}
    assert len(pairs) == 6 and pairs["A", "B"] == (2, 0, 1) and pairs["B", "B_prime"] == (1, 0, 2)
    # Nothing gains 0.2, so the first queries serve as examples.
    assert [r.query_id for r in analysis.example_queries(compared, 2).collect()] == ["q1", "q2"]


def test_overlap_ignores_empty_strategies(spark):
    _, hits_df, *_ = small_world(spark)
    rows = {r.query_id: r for r in insights.overlap_summary(hits_df).collect()}
    # q1: only A and B found something and share w3; q2: A and C share nothing.
    assert (rows["q1"].n_union, rows["q1"].n_common, rows["q1"].overlap_pct) == (10, 1, 10)
    assert (rows["q2"].n_union, rows["q2"].n_common) == (20, 0)
    assert insights.unique_hits(hits_df).filter("query_id = 'q1'").count() == 9


def test_histogram_against_numpy(spark):
    values = np.random.default_rng(5).normal(size=400)
    df = spark.createDataFrame([("a" if i % 3 else "b", float(v)) for i, v in enumerate(values)],
                               "g string, v double")
    counts, edges = np.histogram(values, 12)
    rows = {r.bin: r for r in insights.histogram(df, "v", 12).collect()}
    assert [rows[i].n_values if i in rows else 0 for i in range(12)] == counts.tolist()
    assert rows[0].lower == pytest.approx(edges[0])
    assert insights.histogram(df, "v", 12, "g").agg(F.sum("n_values")).first()[0] == 400
    same = spark.createDataFrame([(1.0,), (1.0,)], "v double")
    assert [tuple(r) for r in insights.histogram(same, "v", 5).collect()] == [(0, 1.0, 2)]


def test_latency_percentile_equals_numpy(spark):
    values = np.random.default_rng(6).exponential(size=97) * 100
    log = spark.createDataFrame([("q", "A", float(v)) for v in values], "query_id string, strategy string, latency_ms double")
    row = metrics.latency_stats(log).first()
    assert row.mean_ms == pytest.approx(values.mean())
    assert row.std_ms == pytest.approx(values.std())
    assert row.p95_ms == pytest.approx(np.percentile(values, 95))


@pytest.mark.parametrize("text,single", [
    ('[{"strategy": "A", "mrr": 0.5, "recall": {"10": 0.25}}, {"strategy": "C"}]', True),
    ('{"A": {"mrr": 0.5, "recall": {"10": 0.25}}, "C": {}}', True),
    ('{"results": {"A": {"mrr": 0.5, "recall_at_10": 0.25}, "C": {"ndcg": {}}}}', True),
    ('{"strategy": "A", "mrr": 0.5, "recall": {"10": 0.25}}\n{"strategy": "C"}\n', False),
])
def test_metric_file_shapes(spark, tmp_path, text, single):
    path = tmp_path / "metrics.json"
    path.write_text(text)
    rows = {r.strategy: r for r in results.read_metrics(spark, str(path), single).collect()}
    assert set(rows) == {"A", "C"}
    assert (rows["A"].mrr, rows["A"].recall_10, rows["A"].ndcg_10) == (0.5, 0.25, 0.0)
    assert (rows["C"].mrr, rows["C"].avg_latency_ms) == (0.0, 0.0)


def test_whole_evaluation_repeats(spark):
    encoder = HashEncoder(64)
    corpus = embed_documents(with_representations(cleaned(spark, case_rows())), encoder)
    runs = [run_evaluation(corpus, encoder, n_queries=20) for _ in range(2)]
    first, second = (
        [tuple(r) for r in e.per_query.orderBy("query_id", "strategy").collect()] for e in runs
    )
    assert first == second and len(first) == 80
    parts = full_analysis(runs[0])
    assert parts["win_matrix"].count() == 6 and parts["export"].count() == 80
    # With the filter equal to the relevance rule, B only misses on the seed itself.
    bad = runs[0].hits.join(runs[0].cases, "query_id").filter(
        "strategy = 'B' AND query_type = 'constrained' AND NOT relevant AND woid <> seed_woid")
    assert bad.count() == 0
