"""SpotSigs: signatures of content words that follow common words.

A text's words are its runs of letters in lower case. An anchor is a common word; a signature
is the anchor and the ``CHAIN`` content words that follow it, common words passed over. Where
``GAP`` content words have gone by without an anchor, each further content word serves as one,
so texts without common words have signatures too. The fingerprint is the sorted set of
signature hashes; likeness is the Jaccard similarity of two sets. Sets whose sizes differ too
much can't be alike: their similarity is at most the ratio of the sizes. ``near_pairs`` uses that
to partition the sets by size, so that sets meet only within a partition and with the next one.

Defined results
* a null text is an empty one; an empty text has an empty fingerprint;
* a text without signatures has one: all of its words, or the text itself if it has none;
* two empty fingerprints are alike (1), an empty and another one are not (0);
* the next document is the one with the next smaller id, the first one after the last; equal ids
  go by the hash of their text, and a null id comes last; a lone document follows itself;
* repeated rows stay apart; an empty table gives an empty result; texts of any length are
  read whole;
* only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import re
from collections import OrderedDict
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wosearch.session import materialise

CHAIN = 3
GAP = 8
HASH_BYTES = 4
ROWS_PER_BUCKET = 2000
MOST_BUCKETS = 20_000
SIMILARITY = 0.8

# Common words of English, German, French and Spanish.
COMMON = frozenset(
    "a an and are as at be been but by for from had has have he her his i in is it its not of "
    "on or she that the their there they this to was we were which who will with would you "
    "aber als am an auch auf aus bei bin bis das dass dem den der des die ein eine einem einen "
    "einer eines er es für hat ich ihr im in ist kein mit nach nicht noch nur oder sich sie "
    "sind so über um und uns von vor war wenn werden wie wir zu zum zur "
    "à au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur lui "
    "mais ne nous on ou où par pas plus pour qu que qui sa se ses son sont sur un une vous "
    "al como con de del el ella en entre es esta este fue ha la las lo los más me mi muy no o "
    "para pero por que se ser si sin sobre su sus también un una uno y ya".split()
)

_words = re.compile(r"[^\W\d_]+").findall

RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)


def _hash(signature: str) -> bytes:
    return xxhash.xxh32_digest(signature.encode())


def signatures(text: str) -> frozenset[bytes]:
    """Hashes of the text's signatures."""
    words = _words(text.lower())
    content: list[str] = []
    starts: list[tuple[str, int]] = []  # anchor, number of content words before its chain
    last = 0  # content words before the last anchor's chain
    for word in words:
        if word in COMMON:
            last = len(content)
            starts.append((word, last))
        else:
            content.append(word)
            if len(content) - last > GAP:
                starts.append((word, len(content)))
    most = len(content) - CHAIN
    found = frozenset(
        _hash(f"{anchor} {' '.join(content[at:at + CHAIN])}") for anchor, at in starts if at <= most
    )
    if found or not text:
        return found
    return frozenset((_hash(" ".join(words) or text),))


def as_text(found: frozenset[bytes]) -> str:
    """Sorted hashes, as hexadecimal digits one after another."""
    return b"".join(sorted(found)).hex()


def likeness(a: frozenset, b: frozenset, least: float = 0.0) -> float:
    """Jaccard similarity; 0 where the sizes alone show that it is below ``least``."""
    if not a or not b:
        return float(len(a) == len(b))
    small, large = sorted((a, b), key=len)
    if len(small) < least * len(large):
        return 0.0
    common = len(small & large)
    return common / (len(small) + len(large) - common)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and the next document's text, in stretches of consecutive ids.

    Ids are dealt to buckets by quantiles of the ids; each bucket also gets the first document
    of the bucket that follows. So no stretch exceeds a bucket, and texts are shuffled once.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    place = F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf")))
    n = docs.count()
    wanted = max(1, min(MOST_BUCKETS, n // ROWS_PER_BUCKET))
    inner = rows.filter("doc_id is not null").agg(F.percentile_approx(
        F.col("doc_id").cast("double"), [i / wanted for i in range(1, wanted)] or [0.5], 10 * wanted
    )).first()[0] or []
    splits = [float("-inf"), *(sorted(set(inner)) or [0.0]), float("inf")]
    dealt = Bucketizer(splits=splits, inputCol="place", outputCol="bucket").transform(
        rows.withColumn("place", place).withColumn("tie", F.xxhash64("text"))
    )
    order = F.struct(F.coalesce(F.col("doc_id").isNotNull(), F.lit(False)), "doc_id", "tie")
    heads = [
        (r["bucket"], r["h"]["doc_id"], r["h"]["tie"])
        for r in dealt.groupBy("bucket").agg(F.max(order).alias("h"))
        .select("bucket", F.struct(F.col("h.doc_id"), F.col("h.tie")).alias("h"))
        .orderBy(F.desc("bucket")).collect()
    ]
    # The head of each bucket is a guest of the one before; the first head, of the last.
    guests = docs.sparkSession.createDataFrame(
        [(head[1], head[2], heads[i - 1][0]) for i, head in enumerate(heads)],
        "guest_id long, guest_tie long, guest_of double",
    )
    # One row per bucket, so ``MOST_BUCKETS`` rows at most.
    marked = dealt.join(
        F.broadcast(guests),
        F.col("doc_id").eqNullSafe(F.col("guest_id")) & (F.col("tie") == F.col("guest_tie")), "left",
    )
    seats = marked.select(
        "doc_id", "text", "tie",
        F.explode(F.filter(F.array(
            F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("guest")),
            F.struct(F.col("guest_of").alias("bucket"), F.lit(True).alias("guest")),
        ), lambda s: s["bucket"].isNotNull())).alias("seat"),
    ).select("doc_id", "text", "tie", "seat.*")
    row = Window.partitionBy("bucket").orderBy(
        "guest", F.col("doc_id").desc_nulls_last(), F.col("tie").desc()
    )
    following = F.lead("text").over(row)
    return seats.withColumn("next_text", following).filter("not guest").select(
        "doc_id", "text", "next_text"
    )


class Recent:
    """Signatures of the last texts: a next text is soon a text itself."""

    def __init__(self, most: int = 4):
        self.most, self.known = most, OrderedDict()

    def __call__(self, text: str) -> frozenset[bytes]:
        if text not in self.known:
            self.known[text] = signatures(text)
            if len(self.known) > self.most:
                self.known.popitem(last=False)
        return self.known[text]


def _compare_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    recent = Recent()
    for batch in batches:
        rows = []
        for doc_id, text, following in zip(*(column for column in batch.columns)):
            text, following = text.as_py(), following.as_py()
            cut = len(text) // 2
            edited = text[:len(text) - cut] + following[:cut]
            own, changed = recent(text), signatures(edited)
            rows.append((
                doc_id.as_py(), len(text), hashlib.sha256(edited.encode()).hexdigest(),
                as_text(own), as_text(changed), likeness(own, changed),
                likeness(own, recent(following)),
            ))
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(),
                 pa.float64())
        columns = list(zip(*rows)) or [[] for _ in types]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, type=t) for c, t in zip(columns, types)],
            names=[part.split()[0] for part in RESULT.split(", ")],
        )


def compare_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other."""
    return with_next(docs).mapInArrow(_compare_task, RESULT)


def _sign_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [sorted(signatures(t.as_py() or "")) for t in batch.column(1)]
        numbers = [[int.from_bytes(h, "big") for h in s] for s in found]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(numbers, type=pa.list_(pa.int64()))],
            names=["doc_id", "sigs"],
        )


def near_pairs(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(a, b, likeness): pairs of different fingerprints with a Jaccard similarity of ``least``.

    a and b are the smallest ids of their fingerprints, a the smaller one; a fingerprint that occurs
    only without an id has a null one and comes second. Copies share a fingerprint and make no
    pairs; two texts under one id are two fingerprints. Texts without signatures pair with none.
    Sets are partitioned by size into stretches of ratio ``least``. A set's rarest signatures,
    so many that two alike sets must share one, are its entries in an inverted index; entries
    meet within a partition and with the next, and what the sizes rule out is left out. Sets go by
    a hash of their signatures, so ids play no part in the search.
    """
    signed = docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(
        _sign_task, "doc_id long, sigs array<long>"
    )
    sets = materialise(
        signed.filter("size(sigs) > 0").groupBy("sigs").agg(F.min("doc_id").alias("id"))
        .withColumn("key", F.xxhash64("sigs")), "spotsigs-sets",
    )
    counts = sets.select(F.explode("sigs").alias("sig")).groupBy("sig").count()
    size = F.size("sigs")
    ranked = (
        sets.select("key", size.alias("n"), F.explode("sigs").alias("sig")).join(counts, "sig")
        .withColumn("rank", F.row_number().over(
            Window.partitionBy("key").orderBy("count", "sig")))
        .filter(F.col("rank") <= F.col("n") - F.ceil(F.lit(least) * F.col("n")) + 1)
        .withColumn("part", F.floor(F.log("n") / F.lit(-1.0) / F.log(F.lit(least))))
    )
    left = ranked.select(
        F.col("key").alias("x"), F.col("n").alias("n_x"), "sig",
        F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"),
        F.col("part").alias("home"),
    )
    right = ranked.select(F.col("key").alias("y"), F.col("n").alias("n_y"), "sig", "part")
    pairs = left.join(right, ["sig", "part"]).filter(
        "(home < part or x < y) and x <> y"
    ).filter(F.least("n_x", "n_y") >= F.lit(least) * F.greatest("n_x", "n_y")).select(
        F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")
    ).distinct()

    def side(name: str) -> DataFrame:
        return sets.select(
            F.col("key").alias(name), F.col("sigs").alias(f"sigs_{name}"), F.col("id").alias(f"id_{name}")
        )

    common = F.size(F.array_intersect("sigs_x", "sigs_y"))
    alike = pairs.join(side("x"), "x").join(side("y"), "y").withColumn(
        "likeness", common / (F.size("sigs_x") + F.size("sigs_y") - common)
    ).filter(F.col("likeness") >= least)
    both_known = F.col("id_x").isNotNull() & F.col("id_y").isNotNull()
    return alike.select(
        F.least("id_x", "id_y").alias("a"),
        F.when(both_known, F.greatest("id_x", "id_y")).alias("b"), "likeness",
    )
