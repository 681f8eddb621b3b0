"""Times the headline jobs at $BENCH_SF_DIR and prints one JSON line."""

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from wosearch.config import STRATEGIES
from wosearch.operators import cleaning, quality, strategies
from wosearch.operators.encoding import HashEncoder, embed_documents
from wosearch.operators.evalset import build_cases
from wosearch.operators.router import classify
from wosearch.operators.search import search
from wosearch.functions.representation import with_representations
from wosearch.plans.catalog import Stages
from wosearch.plans.evaluation import full_analysis, run_evaluation
from wosearch.session import spread

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(job) -> float:
    """Median of warm runs."""
    job()
    seconds = []
    for _ in range(RUNS):
        start = time.perf_counter()
        job()
        seconds.append(time.perf_counter() - start)
    return round(statistics.median(seconds), 3)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    s = Stages(spark, FOLDER)
    encoder: HashEncoder = s.encoder
    corpus, cases = s.vectors, s.cases
    n_queries, n_rows = cases.count(), corpus.count()

    single = {
        "A": strategies.strategy_a, "B": strategies.strategy_b,
        "B_prime": strategies.strategy_b_prime, "C": strategies.strategy_c,
    }

    def one_strategy(name):
        return lambda: run(single[name](corpus, cases, encoder))

    def analyse():
        for part in full_analysis(s.evaluation).values():
            run(part)

    jobs = {
        "preprocess": lambda: run(cleaning.preprocess(s.raw_text)),
        "clean": lambda: run(cleaning.clean(s.preprocessed)),
        "quality_report": lambda: run(quality.full_report(s.filled)),
        "represent_and_embed": lambda: run(
            embed_documents(with_representations(spread(s.cleaned)), encoder)
        ),
        "stored_vector_search": lambda: run(
            search(s.table("embeddings"), s.label_probes, 10, "embedding", 64, ("vec_id",))
        ),
        **{f"strategy_{name}": one_strategy(name) for name in STRATEGIES},
        "all_strategies": lambda: run(strategies.retrieve_all(corpus, cases, encoder)),
        "route_queries": lambda: run(classify(s.router_queries)),
        "build_cases": lambda: run(build_cases(s.cleaned)),
        "evaluation": lambda: run(run_evaluation(corpus, encoder, cases).metrics),
        "analysis": analyse,
    }
    queries = {name: timed(job) for name, job in jobs.items()}
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(queries.values()), 3), "unit": "sec",
        "queries": queries, "sf": FOLDER.rsplit("sf", 1)[-1],
        "corpus_rows": n_rows, "evaluation_queries": n_queries, "dimensions": encoder.dim,
        "ms_per_query": {
            name: round(1000 * queries[f"strategy_{name}"] / n_queries, 2) for name in STRATEGIES
        },
    }))


if __name__ == "__main__":
    main()
