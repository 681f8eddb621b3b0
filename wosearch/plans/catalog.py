"""Named queries over the driver's tables, one per operator."""

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wosearch.config import EQUIPMENT_TERMS, POOL_FACTOR, STRATEGIES, TOP_K, TYPE_TERMS
from wosearch.functions.representation import (
    mice_repr, preview_text, text_repr, with_representations,
)
from wosearch.functions.text import search_text, strict_text, strip_identifiers
from wosearch.functions.vectors import checked_dim
from wosearch.operators import analysis, cleaning, insights, inspection, metrics, quality
from wosearch.operators import evalset, router, sketches, strategies
from wosearch.operators.clustered import ClusteredTable
from wosearch.operators.encoding import HashEncoder, embed_documents, embed_queries, encode
from wosearch.operators.numbering import chunk_sizes, with_row_index
from wosearch.operators.search import TIE_BREAK, neighbours, search
from wosearch.operators.trigrams import BrowseIndex
from wosearch.operators.vocabulary import longest_terms
from wosearch.plans.build import build_tables
from wosearch.plans.evaluation import Evaluation, full_analysis, run_evaluation
from wosearch.schema import CLEAN_COLUMNS, RAW_COLUMNS, SEQ, TRACKS
from wosearch.session import materialise, new_path, spread
from wosearch.sources import lookup, npy, results, testdata, vector_table, work_orders
from wosearch.streaming.ingest import ingest_progress, ingest_totals, start_ingest
from wosearch.streaming.retrieval import hits_log, start_retrieval
from wosearch.streaming.routing import start_routing

BROWSE_PATTERN = "worthless|thouin(or|ed)|[st]ionan.*thth(an|ing)"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_STAGES: dict[tuple[str, str], "Stages"] = {}


class Stages:
    """Tables the queries share, each derived from the driver's tables when first needed.

    What a deployment keeps on disk (cleaned table, vector table, hits) is written to the
    shared folder once per session.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.encoder = spark, folder, HashEncoder()

    def table(self, name: str) -> DataFrame:
        return testdata.table(self.spark, self.folder, name)

    def path(self, label: str) -> str:
        return new_path(self.spark, label)

    @cached_property
    def raw(self) -> DataFrame:
        return testdata.work_orders(self.spark, self.folder)

    @cached_property
    def raw_text(self) -> DataFrame:
        return self.raw.drop("stored_vec")

    @cached_property
    def preprocessed(self) -> DataFrame:
        return materialise(cleaning.preprocess(self.raw_text), "preprocessed")

    @cached_property
    def filled(self) -> DataFrame:
        return cleaning.fill_missing(self.preprocessed)

    @cached_property
    def cleaned(self) -> DataFrame:
        return materialise(cleaning.clean(self.preprocessed), "cleaned")

    @cached_property
    def vectors(self) -> DataFrame:
        return materialise(
            embed_documents(with_representations(spread(self.cleaned)), self.encoder), "vectors"
        )

    @cached_property
    def cases(self) -> DataFrame:
        return evalset.build_cases(self.cleaned, n_queries=None)

    @cached_property
    def evaluation(self) -> Evaluation:
        return run_evaluation(self.vectors, self.encoder, self.cases)

    @cached_property
    def metrics(self) -> DataFrame:
        """Means per strategy with the average latency."""
        latency = metrics.latency_stats(self.latencies)
        return self.evaluation.metrics.join(
            latency.select("strategy", F.col("mean_ms").alias("avg_latency_ms")), "strategy"
        )

    @cached_property
    def export(self) -> DataFrame:
        return analysis.comparison_rows(self.evaluation.per_query, self.evaluation.comparisons)

    @cached_property
    def router_queries(self) -> DataFrame:
        return testdata.router_queries(self.raw_text)

    @cached_property
    def latencies(self) -> DataFrame:
        return testdata.latency_log(self.raw_text)

    @cached_property
    def benchmark_queries(self) -> DataFrame:
        return self.table("benchmark").select(
            F.col("item_id").alias("query_id"), F.col("text").alias("query_text")
        )

    @cached_property
    def label_probes(self) -> DataFrame:
        """The first stored vector of every label, as query vectors."""
        e = self.table("embeddings")
        first = e.groupBy("label").agg(F.min("vec_id").alias("vec_id"))
        return e.join(first.select("vec_id"), "vec_id", "left_semi").select(
            F.col("vec_id").alias("query_id"), "embedding"
        )


def query(function: Callable[[Stages], DataFrame]):
    """Register a query under the name of its function."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, folder)
        if key not in _STAGES:
            _STAGES[key] = Stages(spark, folder)
        return function(_STAGES[key])

    QUERIES[function.__name__] = run
    return function


def _score(hits: DataFrame) -> DataFrame:
    return hits.withColumn("score", F.round(F.col("score").cast("double"), 6))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _short(hits: DataFrame) -> DataFrame:
    return _score(hits).select("query_id", "strategy", "rank", "woid", "score")


# Sources and sinks -----------------------------------------------------------------------

def _numbered(df: DataFrame) -> DataFrame:
    return with_row_index(df, SEQ, "position").drop(SEQ)


@query
def csv_raw_scan(s):
    path = s.path("raw-csv")
    work_orders.write_csv(s.raw_text.orderBy(SEQ).select(*RAW_COLUMNS), path, quote_all=True)
    return _numbered(work_orders.read_raw(s.spark, path))


@query
def csv_preprocessed_scan(s):
    path = s.path("preprocessed-csv")
    work_orders.write_csv(s.preprocessed.orderBy(SEQ).select(*CLEAN_COLUMNS), path)
    return _numbered(work_orders.read_preprocessed(s.spark, path))


@query
def csv_clean_scan(s):
    path = s.path("clean-csv")
    work_orders.write_csv(s.cleaned.orderBy(SEQ).select(*CLEAN_COLUMNS), path, quote_all=True)
    return _numbered(work_orders.read_clean(s.spark, path))


@query
def chunked_scan(s):
    return chunk_sizes(s.cleaned, SEQ, 100)


@query
def first_rows_scan(s):
    return work_orders.first_rows(s.cleaned, 50)


def _stored(table: DataFrame) -> DataFrame:
    """All cells of both tracks that are not zero."""
    tracks = F.array(*[F.struct(F.lit(t).alias("track"), F.col(c).alias("v")) for t, c in TRACKS.items()])
    return (
        table.select(SEQ, "WOID", F.explode(tracks).alias("t"))
        .select(SEQ, "WOID", "t.track", F.posexplode("t.v").alias("dimension", "value"))
        .filter("value <> 0").withColumn("value", F.round(F.col("value").cast("double"), 6))
    )


@query
def vector_table_append(s):
    path = s.path("appended")
    vector_table.append_vectors(s.vectors.filter("Type = 'research'"), path)
    vector_table.append_vectors(s.vectors.filter("Type <> 'research'"), path)
    return _stored(vector_table.open_vectors(s.spark, path))


@query
def vector_table_open(s):
    path = s.path("opened")
    before = vector_table.open_vectors(s.spark, path).agg(F.count("*").alias("n_rows"))
    vector_table.append_vectors(s.vectors, path)
    after = vector_table.open_vectors(s.spark, path, required=True).agg(
        F.count("*").alias("n_rows")
    )
    return before.withColumn("state", F.lit("absent")).unionByName(
        after.withColumn("state", F.lit("stored"))
    )


def _ingested(s) -> tuple[DataFrame, DataFrame]:
    source, table = s.path("stream-source"), s.path("stream-table")
    s.cleaned.repartitionByRange(4, SEQ).write.parquet(source)
    checkpoint = s.path("stream-checkpoint")
    start_ingest(s.spark, source, table, checkpoint, s.encoder, 2).awaitTermination()
    # A second run finds nothing left to do.
    start_ingest(s.spark, source, table, checkpoint, s.encoder, 2).awaitTermination()
    return s.spark.read.parquet(source), s.spark.read.parquet(table)


@query
def stream_ingest(s):
    return _stored(_ingested(s)[1])


@query
def stream_ingest_progress(s):
    return ingest_totals(ingest_progress(*_ingested(s)))


@query
def stage_skip(s):
    path = s.path("stage")
    vector_table.write_stage(s.cleaned, path)
    # The output exists, so the second job is not run.
    return vector_table.write_stage(s.cleaned.unionByName(s.cleaned), path)


def _batches(s) -> list[tuple[str, DataFrame]]:
    return [(t, s.vectors.filter(F.col("Type") == t)) for t in ("research", "teaching")] + [
        ("rest", s.vectors.filter("Type NOT IN ('research', 'teaching')"))]


def _appended(s) -> vector_table.CommitLog:
    """Three batches, one of them twice, and the files of an append that died."""
    path = s.path("batches")
    for name, rows in _batches(s):
        vector_table.append_batch(rows, path, name)
    vector_table.append_batch(_batches(s)[0][1], path, "research")
    s.vectors.write.parquet(f"{path}/data/unfinished")
    return vector_table.vector_log(s.spark, path)


@query
def vector_table_replay(s):
    return _stored(_appended(s).read())


@query
def vector_table_history(s):
    return _appended(s).history().select("version", "batch", "n_rows")


@query
def vector_table_snapshot(s):
    """The table as it was after its second batch."""
    return _appended(s).read(1).select(SEQ, "WOID", "Type", "batch_id")


@query
def table_stats(s):
    return vector_table.table_stats(s.vectors)


@query
def metrics_json_sink(s):
    path = s.path("metrics-json")
    documents = metrics.metrics_documents(s.evaluation.per_query, s.latencies)
    results.write_metrics(documents, path)
    stored = s.spark.read.schema(documents.schema).json(path)
    maps = ("recall", "ndcg", "recall_semantic", "recall_constrained", "ndcg_semantic",
            "ndcg_constrained")
    return stored.select(
        "strategy", "n_queries", "mrr",
        *[F.col(m)[k].alias(f"{m}_{k}") for m in maps for k in ("1", "5", "10")],
        "latency.mean_ms", "latency.std_ms", "latency.p95_ms",
    )


@query
def metrics_json_scan(s):
    path = s.path("metrics-json")
    results.write_metrics(metrics.metrics_documents(s.evaluation.per_query, s.latencies), path)
    return results.read_metrics(s.spark, path)


@query
def comparison_csv_sink(s):
    """The written file read back as plain text fields."""
    path = s.path("comparisons-csv")
    results.write_comparisons(s.export, path)
    text = s.spark.read.options(header=True, quote='"', escape='"', multiLine=True, nullValue="").csv(path)
    return text.select(*[
        F.coalesce(F.col(f.name), F.lit("")).alias(f.name) if f.dataType.simpleString() == "string"
        else F.col(f.name).cast(f.dataType).alias(f.name) for f in s.export.schema
    ])


@query
def comparison_csv_scan(s):
    path = s.path("comparisons-csv")
    results.write_comparisons(s.export, path)
    return results.read_comparisons(s.spark, path)


@query
def vector_text_pairs(s):
    pairs = s.table("embeddings").join(s.table("documents"), F.col("vec_id") == F.col("doc_id"))
    return pairs.select("vec_id", "text", F.size("embedding").alias("dim"))


@query
def npy_vector_scan(s):
    """Vectors written as several .npy shards and read back by position."""
    path = s.path("npy")
    npy.write_vectors(s.table("embeddings"), "embedding", path, "vec_id", shard_bytes=1 << 16)
    cells = inspection.heat_map(npy.read_vectors(s.spark, path), "position", "embedding", None)
    return cells.withColumn("value", F.round(F.col("value").cast("double"), 6))


@query
def npy_text_pairs(s):
    """A vector file and a text file whose rows belong together."""
    vectors, texts = s.path("pairs-npy"), s.path("pairs-csv")
    rows = s.table("embeddings").join(s.table("documents"), F.col("vec_id") == F.col("doc_id"))
    npy.write_vectors(rows, "embedding", vectors, "vec_id", shard_bytes=1 << 16)
    npy.write_texts(rows, "text", texts, "vec_id")
    pairs = npy.read_pairs(s.spark, vectors, texts)
    total = F.aggregate("embedding", F.lit(0.0), lambda t, x: t + x.cast("double"))
    return pairs.select(
        "position", "text", F.size("embedding").alias("dim"), F.round(total, 6).alias("total")
    )


# Projections and cleaning ----------------------------------------------------------------

@query
def search_text_form(s):
    return s.table("documents").select("doc_id", search_text(F.col("text")).alias("search_text"))


@query
def strict_text_form(s):
    return s.table("documents").select("doc_id", strict_text(F.col("text")).alias("strict_text"))


@query
def preprocess_rows(s):
    return cleaning.preprocess(s.raw_text)


@query
def standard_building_ids(s):
    return s.raw_text.select(
        SEQ, cleaning.standard_building_id(F.col("BuildingID")).alias("BuildingID")
    )


@query
def rows_with_woid(s):
    return s.filled.filter(cleaning.has_woid()).select(SEQ, "WOID")


@query
def first_row_per_woid(s):
    kept = cleaning.first_per_woid(s.filled.filter(cleaning.has_woid()))
    return kept.select(SEQ, "WOID", "WODescription")


@query
def long_descriptions(s):
    firsts = cleaning.first_per_woid(s.filled.filter(cleaning.has_woid()))
    return firsts.filter(cleaning.long_enough()).select(SEQ, "WOID")


@query
def missing_building_mask(s):
    return s.raw_text.select(SEQ, cleaning.lacks_building(F.col("BuildingID")).alias("missing"))


@query
def placeholder_buckets(s):
    return cleaning.assign_placeholders(s.raw_text).select(SEQ, "BuildingID")


@query
def default_values(s):
    return cleaning.fill_defaults(s.filled).select(SEQ, "BuildingName", "Type", "WOEndDate")


@query
def enforced_schema(s):
    return cleaning.enforce_schema(s.raw_text.drop("WOEndDate"))


@query
def clean_work_orders(s):
    return cleaning.clean(s.preprocessed)


@query
def cleaning_counts(s):
    return cleaning.cleaning_counts(s.preprocessed)


@query
def text_representation(s):
    return s.cleaned.select("WOID", text_repr().alias("text_repr"))


@query
def mice_representation(s):
    return s.cleaned.select("WOID", mice_repr().alias("mice_repr"))


@query
def mice_display_form(s):
    return s.cleaned.select("WOID", mice_repr("\n").alias("mice_repr"))


@query
def representations(s):
    return with_representations(s.filled)


@query
def metadata_filter(s):
    row = {"building_id": F.col("BuildingID"), "wo_type": F.col("Type"), "equipment": F.col("equipment")}
    keep = strategies.matches_filter(
        F.lit(None).cast("string"), F.lit("research"), F.lit(""), row
    )
    return s.cleaned.filter(keep).select("WOID", "Type", "equipment")


@query
def filter_is_empty(s):
    routed = router.classify(s.router_queries)
    return routed.select("query_id", strategies.filter_is_empty().alias("is_empty"))


@query
def hit_projection(s):
    return strategies.present(s.evaluation.hits)


@query
def browse_filter(s):
    return inspection.browse(s.cleaned, kind="research", pattern="ing|ed")


@query
def indexed_browse(s):
    """Rows of a pattern by the trigram index, in a table that was appended to."""
    index = BrowseIndex(s.spark, s.path("browse"))
    for rest in (0, 1):
        index.append(s.cleaned.filter(F.col(SEQ) % 2 == rest))
    return index.browse(kind="research", pattern=BROWSE_PATTERN)


@query
def point_lookup(s):
    return inspection.lookup(s.raw_text, " W8 ").select(SEQ, *RAW_COLUMNS)


@query
def indexed_point_lookup(s):
    """point_lookup by the layout that skips row groups."""
    path = s.path("lookup")
    lookup.write_lookup(s.raw_text, path)
    found = lookup.find(lookup.open_lookup(s.spark, path), " W8 ")
    return found.select(SEQ, *RAW_COLUMNS)


@query
def indexed_lookups(s):
    """Several ids in a table that was appended to."""
    path = s.path("lookups")
    lookup.write_lookup(s.raw_text.filter(F.col(SEQ) % 2 == 0), path)
    lookup.write_lookup(s.raw_text.filter(F.col(SEQ) % 2 == 1), path, mode="append", sort=False)
    table = lookup.open_lookup(s.spark, path)
    return lookup.find_all(table, ("W8", " W100", "W101", "W102", "none")).select(SEQ, *RAW_COLUMNS)


@query
def vector_lookup(s):
    cells = inspection.heat_map(inspection.lookup(s.vectors, "W8"), "WOID", "text_vec", None)
    return cells.withColumn("value", F.round(F.col("value").cast("double"), 6))


@query
def preview_texts(s):
    return s.cleaned.select("WOID", preview_text().alias("preview"))


# Quality ---------------------------------------------------------------------------------

@query
def schema_check(s):
    """Which expected columns a written export has, and how many values they hold."""
    path = s.path("export")
    work_orders.write_csv(s.raw_text.select(*RAW_COLUMNS), path, quote_all=True)
    export = s.spark.read.options(header=True, quote='"', escape='"', multiLine=True).csv(path)
    held = export.agg(*[
        (F.count(F.nullif(F.col(c), F.lit(""))) if c in export.columns else F.lit(0).cast("long")).alias(c)
        for c in CLEAN_COLUMNS
    ]).unpivot([], list(CLEAN_COLUMNS), "column", "n_values")
    return quality.schema_report(export).join(held, "column")


@query
def missing_values(s):
    return _rounded(quality.missing_values(s.filled), "share")


@query
def placeholder_buildings(s):
    return _rounded(quality.placeholder_buildings(s.cleaned), "share")


@query
def text_quality(s):
    return quality.text_quality(s.filled)


@query
def duplicate_rows(s):
    return quality.duplicates(s.filled)


@query
def cardinality(s):
    return quality.cardinality(s.filled)


@query
def distinct_sketches(s):
    """Merged sketches of batches against exact counts: whether they are within their bound."""
    log = sketches.distinct_log(s.spark, s.path("distinct"))
    columns = ("BuildingID", "Type", "equipment", "WOID")
    for name, rows in _batches(s):
        sketches.add_distinct(log, rows, columns, name)
    exact = quality.cardinality(s.cleaned, columns).withColumnRenamed("n_distinct", "n_exact")
    off = F.abs(F.col("n_distinct") - F.col("n_exact"))
    return sketches.distinct_counts(log).join(exact, "column").select(
        "column", "n_values", "n_exact",
        (off <= sketches.distinct_bound() * F.col("n_exact")).alias("within_bound"),
    )


@query
def embedding_readiness(s):
    return _rounded(quality.readiness(s.filled), "score")


@query
def quality_report(s):
    return _rounded(quality.full_report(s.filled), "value")


@query
def corpus_headline(s):
    return quality.corpus_headline(s.cleaned)


@query
def top_types(s):
    return quality.top_values(s.cleaned, "Type")


@query
def top_equipment(s):
    return quality.top_values(s.cleaned, "equipment")


@query
def facet_values(s):
    return quality.facet_values(s.cleaned, "Type")


@query
def facet_equipment(s):
    return quality.facet_values(s.cleaned, "equipment")


# Vectors ---------------------------------------------------------------------------------

def _cells(df: DataFrame, key: str, vector: str) -> DataFrame:
    cells = inspection.heat_map(df, key, vector, None)
    return cells.filter("value <> 0").withColumn("value", F.round(F.col("value").cast("double"), 6))


@query
def document_vectors(s):
    represented = with_representations(s.cleaned)
    return _cells(embed_documents(represented, s.encoder), "WOID", "mice_vec")


@query
def query_vectors(s):
    return _cells(embed_queries(s.benchmark_queries, s.encoder), "query_id", "text_vec")


@query
def dimension_check(s):
    return s.table("embeddings").select(
        "vec_id", F.size(checked_dim(F.col("embedding"), 64)).alias("dim")
    )


@query
def search_stored_vectors(s):
    found = search(s.table("embeddings"), s.label_probes, TOP_K, "embedding", 64, ("vec_id",))
    return _score(found.withColumnRenamed("pool_rank", "rank"))


def _track(s, vector: str) -> DataFrame:
    probes = embed_queries(s.benchmark_queries, s.encoder)
    found = search(s.vectors.select(SEQ, "WOID", vector), probes, TOP_K, vector, s.encoder.dim)
    return _score(found.select("query_id", F.col("pool_rank").alias("rank"), "WOID", "score"))


@query
def search_text_track(s):
    return _track(s, "text_vec")


@query
def search_mice_track(s):
    return _track(s, "mice_vec")


@query
def search_short_table(s):
    items = s.table("benchmark").select(
        "item_id", encode(F.col("text"), s.encoder).alias("text_vec")
    )
    probes = embed_queries(s.cases, s.encoder)
    found = search(
        items, probes, TOP_K * POOL_FACTOR, "text_vec", s.encoder.dim, ("item_id",)
    )
    return _score(found.withColumnRenamed("pool_rank", "rank"))


@query
def clustered_search_vectors(s):
    """Exact top-k of a clustered table, like search_stored_vectors."""
    stored = ClusteredTable(s.spark, s.path("clustered"), "embedding", 64)
    stored.create(s.table("embeddings"))
    found = stored.search(s.label_probes, TOP_K, ("vec_id",))
    return _score(found.withColumnRenamed("pool_rank", "rank"))


@query
def clustered_search_text_track(s):
    """Both halves appended one after the other, then searched like search_text_track."""
    stored = ClusteredTable(s.spark, s.path("clustered"), "text_vec", s.encoder.dim)
    rows = s.vectors.select(SEQ, "WOID", "text_vec")
    stored.create(rows.filter(F.col(SEQ) % 2 == 0))
    stored.append(rows.filter(F.col(SEQ) % 2 == 1))
    probes = embed_queries(s.benchmark_queries, s.encoder)
    found = stored.search(probes, TOP_K, TIE_BREAK)
    return _score(found.select("query_id", F.col("pool_rank").alias("rank"), "WOID", "score"))


@query
def vector_sanity(s):
    return _rounded(inspection.sanity(s.table("embeddings"), "embedding"), "mean_norm", "std_norm")


@query
def nearest_to_row(s):
    found = neighbours(s.table("embeddings"), "vec_id", "embedding", 100, 5, 64)
    return _score(found.select("query_id", F.col("pool_rank").alias("rank"), "vec_id", "score"))


@query
def average_similarity(s):
    return _rounded(
        inspection.average_similarity(s.table("embeddings"), "vec_id", "embedding", 64, None),
        "average_similarity",
    )


@query
def vector_sample(s):
    return inspection.sample(s.vectors, 100).select("WOID", "Type", "equipment")


@query
def principal_components(s):
    placed = inspection.project_2d(s.table("embeddings"), "vec_id", "embedding", "label")[0]
    return _rounded(placed, "x", "y")


@query
def principal_component_variance(s):
    shares = inspection.project_2d(s.table("embeddings"), "vec_id", "embedding", "label")[1]
    return _rounded(shares, "variance_share")


@query
def vector_heat_map(s):
    cells = inspection.heat_map(s.table("embeddings"), "vec_id", "embedding")
    return cells.withColumn("value", F.round(F.col("value").cast("double"), 6))


@query
def vector_grid(s):
    cells = inspection.vector_grid(s.table("embeddings"), "vec_id", "embedding")
    return cells.withColumn("value", F.round(F.col("value").cast("double"), 6))


@query
def ad_hoc_search(s):
    asked = s.spark.createDataFrame(
        [(1, "pump in the research hall leaks again")], "query_id bigint, query_text string"
    )
    return _short(strategies.strategy_a(s.vectors, asked, s.encoder, 3))


# Strategies and routing ------------------------------------------------------------------

@query
def hits_one_per_woid(s):
    corpus = s.raw.filter("stored_vec IS NOT NULL").select(SEQ, "WOID", F.col("stored_vec").alias("embedding"))
    found = search(corpus, s.label_probes, TOP_K * POOL_FACTOR, "embedding", 64)
    hits = found.withColumnRenamed("WOID", "woid")
    one = strategies.drop_repeated_woids(hits, "query_id", order=["pool_rank"])
    return _score(one.drop("pool_rank"))


@query
def strategy_a(s):
    return _short(strategies.strategy_a(s.vectors, s.cases, s.encoder))


@query
def strategy_b(s):
    return _short(strategies.strategy_b(s.vectors, s.cases, s.encoder))


@query
def strategy_b_prime(s):
    return _short(strategies.strategy_b_prime(s.vectors, s.cases, s.encoder))


@query
def strategy_c(s):
    return _short(strategies.strategy_c(s.vectors, s.cases, s.encoder))


@query
def retrieve_named(s):
    names = F.array(*[F.lit(n) for n in STRATEGIES])
    wanted = s.cases.withColumn(
        "strategy", F.get(names, F.pmod(F.length("query_text"), F.lit(len(STRATEGIES))))
    )
    return _short(strategies.retrieve_named(s.vectors, wanted, s.encoder))


@query
def route_and_retrieve(s):
    asked = s.cases.select("query_id", "query_text")
    return _short(router.route_and_retrieve(s.vectors, asked, s.encoder)[0])


@query
def retrieve_all(s):
    return _short(strategies.retrieve_all(s.vectors, s.cases, s.encoder))


@query
def building_codes(s):
    return s.router_queries.select(
        "query_id", router.building_code(F.col("query_text")).alias("building_id")
    )


@query
def vocabulary_terms(s):
    text = F.lower("query_text")
    return s.router_queries.select(
        "query_id",
        router.find_term(text, EQUIPMENT_TERMS).alias("equipment"),
        router.find_term(text, TYPE_TERMS).alias("building_type"),
    )


@query
def classify_queries(s):
    return router.classify(s.router_queries)


@query
def vocabulary_join(s):
    """vocabulary_terms by joins with vocabulary tables."""
    texts = s.router_queries.withColumn("query_text", F.lower("query_text"))

    def found(terms, name):
        table = s.spark.createDataFrame([(t,) for t in terms], "term string")
        return longest_terms(texts, "query_id", "query_text", table, name)

    return found(EQUIPMENT_TERMS, "equipment").join(found(TYPE_TERMS, "building_type"), "query_id")


@query
def vocabulary_of_sources(s):
    """The longest name of a building, as the raw rows have them, in each reported text."""
    names = s.raw_text.select(F.lower("BuildingName").alias("term")).filter("term <> ''")
    texts = s.raw_text.select(SEQ, F.concat(
        F.lit("leak in "), F.lower("BuildingName"), F.lit(" near "), F.lower("SystemDescription")
    ).alias("report"))
    both = names.union(s.raw_text.select(F.lower("SystemDescription")))
    return longest_terms(texts, SEQ, "report", both)


@query
def explain_routing(s):
    return router.explain_routing(s.router_queries)


@query
def override_filters(s):
    manual = s.raw_text.select(
        F.col(SEQ).alias("query_id"), F.col("BuildingID").alias("manual_building_id"),
        F.col("Type").alias("manual_building_type"), F.lit("").alias("manual_equipment"),
    )
    routed = router.classify(s.router_queries).join(manual, "query_id")
    return router.override_filters(routed).select("query_id", *strategies.FILTERS)


@query
def query_classes(s):
    return router.query_class(router.classify(s.router_queries)).select(
        "query_id", "query_class", "n_tokens"
    )


@query
def stream_routing(s):
    source, table = s.path("query-stream"), s.path("routed")
    s.router_queries.withColumn("query_id", F.col("query_id").cast("string")).write.parquet(source)
    start_routing(s.spark, source, table, s.path("routing-checkpoint")).awaitTermination()
    return s.spark.read.parquet(table)


@query
def stream_retrieval(s):
    """retrieve_all for queries that arrive in four files, the stream started twice."""
    source, hits, checkpoint = s.path("asked"), s.path("stream-hits"), s.path("stream-hits-checkpoint")
    asked = s.cases.select("query_id", "query_text")
    asked.repartition(4, "query_id").write.parquet(source)
    for _ in range(2):
        start_retrieval(
            s.spark, source, lambda: s.vectors, hits, checkpoint, s.encoder, STRATEGIES,
            files_per_batch=2,
        ).awaitTermination()
    return _short(hits_log(s.spark, hits).read())


# Evaluation ------------------------------------------------------------------------------

@query
def relevance_groups(s):
    return evalset.relevance_groups(s.cleaned)


@query
def seed_documents(s):
    return evalset.seed_rows(s.cleaned, evalset.relevance_groups(s.cleaned))


@query
def relevant_rows(s):
    return evalset.relevant_rows(s.cleaned, s.cases)


@query
def stripped_identifiers(s):
    return s.cleaned.select(
        "WOID",
        strip_identifiers(F.col("WODescription"), F.col("BuildingName")).alias("stripped"),
    )


@query
def semantic_queries(s):
    return s.cleaned.select(
        "WOID",
        evalset.semantic_query(F.col("WODescription"), F.col("BuildingName")).alias("query_text"),
    )


@query
def constrained_queries(s):
    text = evalset.constrained_query(
        F.col("WODescription"), F.col("BuildingName"), F.col("equipment"), F.col("Type")
    )
    return s.cleaned.select("WOID", text.alias("query_text"))


@query
def case_types(s):
    return s.cases.groupBy("query_type").agg(F.count("*").alias("n_cases"))


@query
def evaluation_cases(s):
    return s.cases


@query
def evaluation_cases_default(s):
    return evalset.build_cases(s.cleaned)


@query
def recall_at_k(s):
    return _rounded(metrics.at_k(s.evaluation.per_query, "recall"), "recall")


@query
def reciprocal_rank(s):
    return _rounded(s.evaluation.per_query.select("query_id", "strategy", "mrr"), "mrr")


@query
def ndcg_at_k(s):
    return _rounded(metrics.at_k(s.evaluation.per_query, "ndcg"), "ndcg")


@query
def first_hit_rank(s):
    return s.evaluation.per_query.select("query_id", "strategy", "first_hit_rank")


_MEANS = ("mrr", *[f"{m}_{k}" for k in (1, 5, 10) for m in ("recall", "ndcg")])


@query
def strategy_metrics(s):
    return _rounded(s.evaluation.metrics, *_MEANS)


@query
def work_order_pipeline(s):
    """Raw CSV export to metrics, every stage written to the folder of the run."""
    folder = s.path("work-orders")
    export = s.raw_text.orderBy(SEQ).select(*RAW_COLUMNS)
    work_orders.write_csv(export, f"{folder}/raw", quote_all=True)
    stored = build_tables(work_orders.read_raw(s.spark, f"{folder}/raw"), folder, s.encoder)
    return _rounded(run_evaluation(stored, s.encoder, n_queries=None).metrics, *_MEANS)


@query
def metrics_by_type(s):
    return _rounded(s.evaluation.metrics_by_type, *_MEANS[1:])


@query
def latency_stats(s):
    return _rounded(metrics.latency_stats(s.latencies), "mean_ms", "std_ms", "p95_ms")


@query
def latency_sketches(s):
    """Figures merged from sketches of batches; the rank of the quantile is within its bound."""
    log = sketches.quantile_log(s.spark, s.path("latencies"))
    for n in range(3):
        sketches.add_latencies(log, s.latencies.filter(F.col("query_id") % 3 == n), f"part-{n}")
    figures, bound = sketches.latency_figures(log), sketches.rank_bound()
    below, upto = (
        F.avg(F.when(op, 1.0).otherwise(0.0))
        for op in (F.col("latency_ms") < F.col("p95_ms"), F.col("latency_ms") <= F.col("p95_ms"))
    )
    ranks = s.latencies.join(figures, "strategy").groupBy("strategy").agg(
        ((below <= 0.95 + bound) & (upto >= 0.95 - bound)).alias("within_bound")
    )
    return _rounded(
        figures.join(ranks, "strategy").select("strategy", "n_values", "mean_ms", "std_ms", "within_bound"),
        "mean_ms", "std_ms",
    )


@query
def evaluate_strategies(s):
    measured = run_evaluation(s.vectors, s.encoder, s.cases)
    return _rounded(
        measured.per_query.drop("query_text", "group_equipment", "group_type"), *_MEANS
    )


@query
def summary_table(s):
    table = metrics.summary_table(s.evaluation.per_query, s.latencies)
    return _rounded(table, *_MEANS, "recall_semantic", "recall_constrained", "mean_ms", "p95_ms")


# Analysis --------------------------------------------------------------------------------

_COMPARED = tuple(f"{s}_{m}" for s in STRATEGIES for m in ("recall", "mrr", "ndcg"))


@query
def compare_strategies(s):
    wide = s.evaluation.comparisons.drop(
        "query_text", "metadata_gain", "best_strategy", "worst_strategy"
    )
    return _rounded(wide, *_COMPARED)


@query
def metadata_gain(s):
    return _rounded(s.evaluation.comparisons.select("query_id", "metadata_gain"), "metadata_gain")


@query
def best_and_worst(s):
    return s.evaluation.comparisons.select("query_id", "best_strategy", "worst_strategy")


@query
def helped_queries(s):
    found = analysis.helped(s.evaluation.comparisons)
    return _rounded(found.select("query_id", "description", "metadata_gain"), "metadata_gain")


@query
def hurt_queries(s):
    # A threshold of zero: queries that no metadata strategy improves.
    found = analysis.hurt(s.evaluation.comparisons, 0.0)
    return _rounded(found.select("query_id", "description", "metadata_gain"), "metadata_gain")


@query
def win_matrix(s):
    return analysis.win_matrix(s.evaluation.comparisons)


@query
def impact_summary(s):
    return _rounded(
        analysis.impact_summary(s.evaluation.comparisons),
        "largest_gain", "largest_loss", "helped_share", "hurt_share", "neutral_share",
    )


@query
def query_cards(s):
    cards = analysis.query_cards(s.evaluation.comparisons, s.evaluation.hits)
    return _rounded(cards, "metadata_gain", "score")


@query
def analysis_examples(s):
    return _rounded(full_analysis(s.evaluation)["examples"], "metadata_gain", "score")


@query
def gain_classes(s):
    return insights.gain_classes(s.export)


@query
def gain_histogram(s):
    gains = s.export.filter("strategy = 'A'")
    return _rounded(insights.histogram(gains, "metadata_gain", 40), "lower")


@query
def score_histogram(s):
    hits = strategies.present(s.evaluation.hits)
    return _rounded(insights.histogram(hits, "score", 30, "strategy"), "lower")


@query
def gain_extremes(s):
    return insights.gain_extremes(s.export)


@query
def best_overall(s):
    return _rounded(insights.best_overall(s.metrics), "recall")


@query
def metrics_reference(s):
    return insights.metrics_reference(s.metrics)


@query
def overlap_summary(s):
    return insights.overlap_summary(s.evaluation.hits)


@query
def unique_hits(s):
    return insights.unique_hits(s.evaluation.hits)


@query
def membership_table(s):
    return insights.membership(s.evaluation.hits)


@query
def set_differences(s):
    return insights.set_differences(s.evaluation.hits)


@query
def observations(s):
    return insights.observations(s.evaluation.hits, s.cases)


@query
def latency_race(s):
    return _rounded(insights.latency_race(s.latencies), "latency_ms")


@query
def recall_series(s):
    return _rounded(insights.recall_series(s.metrics), "recall")


@query
def metric_bars(s):
    return _rounded(insights.metric_bars(s.metrics), "value")
