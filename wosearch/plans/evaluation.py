"""Evaluation and analysis of the four strategies."""

from dataclasses import dataclass

from pyspark.sql import DataFrame

from wosearch.config import EVAL_KS, EVAL_QUERIES, EVAL_SEED
from wosearch.operators.analysis import (
    compare, comparison_rows, example_queries, impact_summary, query_cards, win_matrix,
)
from wosearch.operators.encoding import Encoder
from wosearch.operators.evalset import build_cases, relevant_rows
from wosearch.operators.metrics import judge, metrics_by_type, per_query_metrics, strategy_metrics
from wosearch.operators.strategies import retrieve_all
from wosearch.session import materialise


@dataclass
class Evaluation:
    """Everything retrieved and judged once; metrics and analysis only read it."""

    cases: DataFrame
    hits: DataFrame
    per_query: DataFrame

    @property
    def metrics(self) -> DataFrame:
        return strategy_metrics(self.per_query)

    @property
    def metrics_by_type(self) -> DataFrame:
        return metrics_by_type(self.per_query)

    @property
    def comparisons(self) -> DataFrame:
        return compare(self.per_query)


def run_evaluation(
    vectors: DataFrame, encoder: Encoder, cases: DataFrame | None = None, ks=EVAL_KS,
    n_queries: int | None = EVAL_QUERIES, seed: int = EVAL_SEED,
) -> Evaluation:
    """Retrieve all strategies for the query set and judge the hits.

    Hits are few (queries x strategies x k) and written out, so that the two scans of the
    vector table happen once and later joins see real sizes.
    """
    if cases is None:
        cases = build_cases(vectors, n_queries, seed)
    hits = materialise(retrieve_all(vectors, cases, encoder, max(ks)), "hits-with-text")
    judged = materialise(judge(hits, relevant_rows(vectors, cases)), "judged-hits")
    per_query = materialise(per_query_metrics(judged, cases, ks), "per-query")
    return Evaluation(cases, judged, per_query)


def full_analysis(evaluation: Evaluation, n_examples: int = 5) -> dict[str, DataFrame]:
    """Win matrix, impact summary, export rows and cards of the example queries."""
    comparisons = evaluation.comparisons
    examples = example_queries(comparisons, n_examples).select("query_id")
    shown = comparisons.join(examples, "query_id", "left_semi")
    return {
        "comparisons": comparisons,
        "win_matrix": win_matrix(comparisons),
        "impact": impact_summary(comparisons),
        "export": comparison_rows(evaluation.per_query, comparisons),
        "examples": query_cards(shown, evaluation.hits),
    }
