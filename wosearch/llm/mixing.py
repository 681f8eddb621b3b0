"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

1. Sizes are words. The sources, by code point (null last), weigh 5, 2, 1, repeating, and
   share ``share`` times all words; no target exceeds ``limit`` times its source's words, and
   what a source can't take goes to the others by weight. That is one water level, found in
   closed form from running sums over the sources.
2. Each source's documents, in the order of md5(seed|doc_id), form a stream that may be read
   twice, cut into blocks of ``block`` words.
3. Slot k of the schedule is the point k * golden ratio mod 1 in fixed-point numbers; the
   source whose share of the cumulative targets holds the point owns the slot. Slots are
   ranked per source, and the slot of rank r takes the source's block r. Where the points
   leave a source some blocks short, closing slots follow.
4. Documents meet the slots through the blocks they overlap; the last block of a source is
   cut at its target, so the words taken equal the target, rounded to a word.

A source may hold any share of the rows: positions and ranks are running sums inside 4096
buckets per source plus the buckets' offsets, and blocks spread over all tasks.

Defined results
* a null text has no words; documents without words take part with nothing taken;
* null is a source of its own, after all others;
* equal order keys (repeated ids) go by size, so repeated rows are read one after another;
* no words at all, or an empty table: every target is 0;
* only the id, the source and the text are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wosearch.session import materialise

WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2.0
BLOCK = 512
SEED = "mix-1"
BUCKETS = 4096
# Fixed point of the schedule: 31 bits, and the odd number next to 2^31 / golden ratio.
UNIT = 1 << 31
GOLDEN = 1327217885
# The unit interval in cells, so that points find their source by an equi-join.
CELL_BITS = 21

WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, order key."""
    return docs.select(
        F.col("doc_id"), F.col("source"),
        F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
        .alias("size"),
        F.xxhash64("text").alias("text_hash"),
        F.md5(F.concat(F.lit(SEED + "|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
              .cast("binary")).alias("order"),
    )


def targets(
    sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, limit: float = LIMIT
) -> DataFrame:
    """One row per source: rank, source, source_size, target.

    A source is at its limit if a water level at its own limit per weight needs no more than
    all there is to share; the rest share what is left by weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy("level", "rank")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    # As exact as doubles are for whole numbers: sums of words and weights, below 2^53.
    per_source = (
        sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("rank", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(
            F.array(*(F.lit(float(w)) for w in weights)),
            F.pmod(F.col("rank") - 1, F.lit(len(weights))).cast("int") + 1,
        ))
        .withColumn("most", F.col("source_size") * F.lit(limit))
        .withColumn("level", F.col("most") / F.col("weight"))
    )
    levelled = per_source.withColumns({
        "budget": F.sum("source_size").over(everything) * F.lit(share),
        "settled": F.coalesce(F.sum("most").over(before), F.lit(0.0)),
        "open_weight": F.sum("weight").over(after),
    }).withColumn(
        "is_full", F.col("settled") + F.col("level") * F.col("open_weight") <= F.col("budget")
    )
    left = F.col("budget") - F.coalesce(
        F.sum(F.when(F.col("is_full"), F.col("most"))).over(everything), F.lit(0.0)
    )
    open_weight = F.sum(F.when(~F.col("is_full"), F.col("weight"))).over(everything)
    return levelled.select(
        "rank", "source", F.col("source_size").cast("long"),
        F.when(F.col("is_full"), F.col("most"))
        .otherwise(left * F.col("weight") / open_weight).alias("target"),
    )


def schedule(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """Slots: rank (of the source), block, slot (null for closing slots)."""
    spark = sources.sparkSession
    total = sources.agg(F.sum("words")).first()[0] or 0
    n_slots = -(-total // block)
    upto = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = F.sum("words").over(upto)
    fixed = (F.lit(UNIT) / F.lit(float(max(total, 1))))
    parts = (
        sources.select(
            "rank", "words",
            F.floor((running - F.col("words")) * fixed).alias("low"),
            F.floor(running * fixed).alias("high"),
        )
        .filter("high > low")
        .withColumn("cell", F.explode(F.sequence(
            F.shiftright("low", CELL_BITS), F.shiftright(F.col("high") - 1, CELL_BITS)
        )))
    )
    points = (
        spark.range(n_slots).select(
            F.col("id").alias("slot"),
            F.pmod(F.pmod(F.col("id"), F.lit(UNIT)) * GOLDEN, F.lit(UNIT)).alias("point"),
            F.floor(F.col("id") * BUCKETS / F.lit(max(n_slots, 1))).alias("part"),
        )
        .withColumn("cell", F.shiftright("point", CELL_BITS))
    )
    owned = (
        points.join(parts, "cell")
        .filter("point >= low AND point < high").select("rank", "part", "slot", "words")
    )
    ranked = owned.withColumn(
        "place", F.row_number().over(Window.partitionBy("rank", "part").orderBy("slot")) - 1
    )
    counts = owned.groupBy("rank", "part").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("rank", "part", (
        F.sum("n").over(Window.partitionBy("rank").orderBy("part")) - F.col("n")
    ).alias("offset"))
    slots = (
        ranked.join(offsets, ["rank", "part"])
        .select("rank", (F.col("offset") + F.col("place")).alias("block"), "slot", "words")
        .filter(F.col("block") * block < F.col("words")).drop("words")
    )
    held = counts.groupBy("rank").agg(F.sum("n").alias("held"))
    needed = F.ceil(F.col("words") / F.lit(block)).cast("long")
    closing = (
        sources.join(held, "rank", "left")
        .withColumn("held", F.coalesce("held", F.lit(0).cast("long")))
        .filter(F.col("held") < needed)
        .select(
            "rank", F.explode(F.sequence("held", needed - 1)).alias("block"),
            F.lit(None).cast("long").alias("slot"),
        )
    )
    return slots.unionByName(closing)


def mix(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, and

    taken_first, taken_second (words of the first and second reading), first_slot, text_hash.
    """
    sized = materialise(sizes(docs), "mix-sizes")
    sources = materialise(
        targets(sized).withColumn("words", F.round("target").cast("long")), "mix-sources"
    )
    slots = schedule(sources, block)

    known = sized.alias("d").join(
        sources.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name"))
    ).drop("name").withColumn("bucket", F.substring("order", 1, 3))
    inside = Window.partitionBy("rank", "bucket").orderBy("order", "size", "text_hash")
    placed = known.withColumns({
        "place": F.row_number().over(inside),
        "upto": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)),
    })
    sums = known.groupBy("rank", "bucket").agg(F.sum("size").alias("n"))
    offsets = sums.select("rank", "bucket", (
        F.sum("n").over(Window.partitionBy("rank").orderBy("bucket")) - F.col("n")
    ).alias("offset"))
    start = F.col("offset") + F.col("upto") - F.col("size")
    ranges = placed.join(offsets, ["rank", "bucket"]).withColumn("readings", F.filter(
        F.transform(F.array(F.lit(0), F.lit(1)), lambda p: F.struct(
            p.alias("reading"),
            (p * F.col("source_size") + start).alias("low"),
            F.least(p * F.col("source_size") + start + F.col("size"), "words").alias("high"),
        )),
        lambda r: r["low"] < r["high"],
    ))
    key = ["rank", "bucket", "place", "doc_id", "source", "size", "source_size", "target",
           "text_hash"]
    pieces = (
        ranges.select(*key, F.explode_outer("readings").alias("r"))
        .select(*key, "r.*")
        .withColumn("block", F.explode_outer(F.sequence(
            F.floor(F.col("low") / F.lit(block)), F.floor((F.col("high") - 1) / F.lit(block))
        )))
    )
    words = (
        F.least("high", (F.col("block") + 1) * block) - F.greatest("low", F.col("block") * block)
    )
    met = pieces.join(slots.withColumn("met", F.lit(True)), ["rank", "block"], "left")
    taken = F.when(F.col("met"), words)
    zero = F.lit(0).cast("long")
    return met.groupBy(*key).agg(
        F.coalesce(F.sum(taken), zero).alias("taken"),
        F.coalesce(F.sum(F.when(F.col("reading") == 0, taken)), zero).alias("taken_first"),
        F.coalesce(F.sum(F.when(F.col("reading") == 1, taken)), zero).alias("taken_second"),
        F.min("slot").alias("first_slot"),
    ).drop("rank", "bucket", "place")


def take(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix itself: the documents' rows, one for each reading that takes words of them.

    A reading that takes a part takes the first words. Repeated rows are alike, so each
    distinct row's text meets all decisions about it.
    """
    decided = mix(docs, block).filter("taken > 0").select(
        "doc_id", "text_hash", F.col("source").alias("mix_source"), F.col("size").alias("mix_size"),
        F.explode(F.array("taken_first", "taken_second")).alias("mix_taken"),
    ).filter("mix_taken > 0").withColumnRenamed("doc_id", "mix_id")
    texts = docs.withColumn("text_hash", F.xxhash64("text")).dropDuplicates(
        ["doc_id", "source", "text_hash"]
    )
    joined = texts.join(
        decided.withColumnRenamed("text_hash", "mix_hash"),
        F.col("doc_id").eqNullSafe(F.col("mix_id")) & (F.col("text_hash") == F.col("mix_hash"))
        & F.col("source").eqNullSafe(F.col("mix_source")),
    )
    gap = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++"
    first_words = F.call_function(
        "regexp_extract", F.col("text"),
        F.concat(F.lit(f"^(?:{gap}){{"), F.col("mix_taken").cast("string"), F.lit("}+")),
        F.lit(0),
    )
    text = F.when(F.col("mix_taken") < F.col("mix_size"), first_words).otherwise(F.col("text"))
    changed = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed.select(*docs.columns)
