"""The four retrieval strategies over a batch of queries.

A queries table has query_id, query_text and the three filter fields building_id,
building_type and equipment; null or ``''`` leaves a field unconstrained.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wosearch.config import POOL_FACTOR, STRATEGIES, TOP_K
from wosearch.operators.encoding import Encoder, embed_queries
from wosearch.operators.search import TIE_BREAK, search
from wosearch.schema import BATCH, SEQ
from wosearch.session import materialise

FILTERS = ("building_id", "building_type", "equipment")
HIT_COLUMNS = (
    "query_id", "strategy", "rank", "score", "woid", "building_id", "building_name",
    "wo_type", "equipment", "wo_description",
)
# What ranking and filtering need; long text joins the final hits only.
_KEYS = (BATCH, SEQ, "WOID", "BuildingID", "Type", "equipment")
_RANKED = (
    "query_id", "strategy", "rank", "score", BATCH, SEQ, "woid", "building_id", "wo_type",
    "equipment",
)


def _keyed(corpus: DataFrame) -> DataFrame:
    """The corpus with a batch id on every row; a table of one scan may lack it."""
    batch = F.coalesce(BATCH, F.lit("")) if BATCH in corpus.columns else F.lit("")
    return corpus.withColumn(BATCH, batch)


def matches_filter(building_id, building_type, equipment, row: dict) -> Column:
    """Equality on every filter field that is set; case counts."""

    def ok(wanted, actual):
        wanted = F.coalesce(wanted, F.lit(""))
        return (wanted == "") | (wanted == actual)

    return (
        ok(building_id, row["building_id"]) & ok(building_type, row["wo_type"])
        & ok(equipment, row["equipment"])
    )


def filter_is_empty() -> Column:
    """True when no field is set; an empty string counts as set."""
    return F.coalesce(*FILTERS).isNull()


def drop_repeated_woids(hits: DataFrame, *keys: str, order=None) -> DataFrame:
    """Best hit per WOID inside ``keys``, ranked again. ``order`` breaks equal scores."""
    order = order or [F.desc("score"), "woid"]
    per_woid = Window.partitionBy(*keys, "woid").orderBy(*order)
    per_key = Window.partitionBy(*keys).orderBy(*order)
    return (
        hits.withColumn("_copy", F.row_number().over(per_woid))
        .filter("_copy = 1").drop("_copy")
        .withColumn("rank", F.row_number().over(per_key))
    )


def _pool(corpus: DataFrame, queries: DataFrame, k: int, vector: str, dim: int) -> DataFrame:
    """Top-k hits per query, one per WOID, still carrying their rank in the table."""
    found = search(
        _keyed(corpus).select(*_KEYS, vector), queries, k, vector, dim, (*TIE_BREAK, BATCH)
    )
    hits = found.select(
        "query_id", "score", "pool_rank", BATCH, SEQ, F.col("WOID").alias("woid"),
        F.col("BuildingID").alias("building_id"), F.col("Type").alias("wo_type"), "equipment",
    )
    return drop_repeated_woids(hits, "query_id", order=["pool_rank"])


def _with_text(corpus: DataFrame, ranked: DataFrame) -> DataFrame:
    """Add the stored text to ranked hits.

    The hits are written first: they are few, and with their real size known Spark sends
    them to the corpus scan instead of shuffling the corpus.
    """
    ranked = materialise(ranked.select(*_RANKED), "ranked")
    texts = (
        _keyed(corpus).select(
            BATCH, SEQ, F.col("BuildingName").alias("building_name"),
            F.col("WODescription").alias("wo_description"),
        )
        .join(ranked.select(BATCH, SEQ), [BATCH, SEQ], "left_semi").dropDuplicates([BATCH, SEQ])
    )
    return ranked.join(texts, [BATCH, SEQ]).select(*HIT_COLUMNS)


def _text_hits(pool: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """A, B and B_prime out of one pool: A is its head, the other two filter it first."""
    wanted = queries.select("query_id", "strategies", *[F.col(c).alias(f"f_{c}") for c in FILTERS])
    row = {c: F.col(c) for c in ("building_id", "wo_type", "equipment")}
    fits = matches_filter(*[F.col(f"f_{c}") for c in FILTERS], row)
    running = Window.partitionBy("query_id").orderBy("rank")
    judged = (
        pool.join(wanted, "query_id")
        .withColumn("_fits", fits)
        .withColumn("_fit_rank", F.sum(F.col("_fits").cast("int")).over(running))
    )
    head = F.col("pool_rank") <= k
    kept = F.col("_fits") & (F.col("_fit_rank") <= k)
    placed = F.array(
        F.struct(F.lit("A").alias("name"), F.col("rank").alias("place"), head.alias("ok")),
        *[
            F.struct(
                F.lit(s).alias("name"), F.col("_fit_rank").cast("int").alias("place"),
                kept.alias("ok"),
            )
            for s in ("B", "B_prime")
        ],
    )
    return (
        judged.filter(head | kept)
        .withColumn("_s", F.explode(placed))
        .filter(F.col("_s.ok") & F.array_contains("strategies", F.col("_s.name")))
        .withColumn("strategy", F.col("_s.name"))
        .withColumn("rank", F.col("_s.place"))
        .select(*_RANKED)
    )


def retrieve(
    corpus: DataFrame, queries: DataFrame, encoder: Encoder, k: int = TOP_K, possible=STRATEGIES
) -> DataFrame:
    """Hits of every strategy named in a query's ``strategies`` array.

    One scan of the text vectors serves A, B and B_prime; one scan of the metadata vectors
    serves C. A query only takes part in the scans its strategies need, and a scan that no
    ``possible`` strategy needs is left out.
    """
    unknown = F.filter("strategies", lambda s: ~s.isin(*possible))
    checked = F.when(F.size(unknown) == 0, F.col("strategies")).otherwise(
        F.raise_error(F.concat(F.lit("unknown strategy: "), F.concat_ws(", ", unknown)))
    )
    queries = queries.withColumn("strategies", checked)
    on_text = [s for s in ("A", "B", "B_prime") if s in possible]
    parts = []
    if on_text:
        wanted = F.arrays_overlap("strategies", F.array(*[F.lit(s) for s in on_text]))
        asked = embed_queries(queries.filter(wanted), encoder)
        pool = _pool(corpus, asked, k * POOL_FACTOR, "text_vec", encoder.dim)
        parts.append(_text_hits(pool, queries, k))
    if "C" in possible:
        wanted = F.array_contains("strategies", "C")
        asked = embed_queries(queries.filter(wanted), encoder)
        context = _pool(corpus, asked, k, "mice_vec", encoder.dim)
        parts.append(context.withColumn("strategy", F.lit("C")).select(*_RANKED))
    ranked = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return _with_text(corpus, ranked)


def with_strategies(queries: DataFrame, *names: str) -> DataFrame:
    return queries.withColumn("strategies", F.array(*[F.lit(n) for n in names]))


def strategy_a(corpus, queries, encoder, k: int = TOP_K) -> DataFrame:
    """Plain dense retrieval: top-k of the table, then one hit per WOID."""
    pool = _pool(corpus, embed_queries(queries, encoder), k, "text_vec", encoder.dim)
    return _with_text(corpus, pool.withColumn("strategy", F.lit("A")))


def strategy_b(corpus, queries, encoder, k: int = TOP_K) -> DataFrame:
    """Pool of 20 k, then the metadata filter, then the first k. May return fewer."""
    return retrieve(corpus, with_strategies(queries, "B"), encoder, k, ("B",))


def strategy_b_prime(corpus, queries, encoder, k: int = TOP_K) -> DataFrame:
    """Computes what B computes under its own name."""
    return retrieve(corpus, with_strategies(queries, "B_prime"), encoder, k, ("B_prime",))


def strategy_c(corpus, queries, encoder, k: int = TOP_K) -> DataFrame:
    """Dense retrieval on the vectors that have the metadata in their text."""
    pool = _pool(corpus, embed_queries(queries, encoder), k, "mice_vec", encoder.dim)
    return _with_text(corpus, pool.withColumn("strategy", F.lit("C")))


def retrieve_named(corpus, queries, encoder, k: int = TOP_K) -> DataFrame:
    """Dispatch on the ``strategy`` column of the queries; an unknown name fails the job."""
    return retrieve(corpus, queries.withColumn("strategies", F.array("strategy")), encoder, k)


def retrieve_all(corpus, queries, encoder, k: int = TOP_K) -> DataFrame:
    return retrieve(corpus, with_strategies(queries, *STRATEGIES), encoder, k)


def present(hits: DataFrame) -> DataFrame:
    """Hits as shown to a user: short names, score to six digits."""
    return hits.select(
        "query_id", "woid", "building_id", "building_name", F.col("wo_type").alias("type"),
        "equipment", "wo_description",
        F.round(F.col("score").cast("double"), 6).alias("score"), "strategy",
    )
