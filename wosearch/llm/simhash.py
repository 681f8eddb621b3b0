"""SimHash fingerprints and near-duplicates by pivot distance tables.

A fingerprint has 64 bits: bit i is set if it is set in over half of the XXH64 values of the
text's word shingles. Texts link if their fingerprints differ in ``RADIUS`` bits or fewer.

Search for links. Exact copies share a fingerprint and form one class from the start.
Fingerprints that differ in 3 bits agree in at least two of five bands, so each class goes to
ten groups, one for each pair of bands. Inside a group the pivot table works: the distances of
every fingerprint to ``PIVOTS`` reference fingerprints are computed once; by the triangle
inequality no distance can differ by more than the radius within a link. Members are sorted by
their distance to the first pivot, so only a short stretch is looked at; pairs whose largest
difference over all pivots exceeds the radius are discarded; the rest is verified.

Hot groups. The members of a group agree in some bits. In a group with more than ``GROUP``
members the other bits are cut into four parts; fingerprints within 3 bits agree in one part at
least, so each member goes to four smaller groups, and groups that are still too large are cut
again. With ``REST_BITS`` bits left a group can't have more members than that, so this comes to an
end: no pair within the radius is lost and no task holds a larger group, whatever the fingerprints.

Pairs never leave a task: links inside one group are merged as they are found, and only those
that join two parts go on, fewer than the group has members.

Defined results
* no words (null, empty or white space only): fingerprint zero, linked like any other;
* fewer words than a shingle has: one shingle of all words;
* repeated rows are members of one class; an empty table gives an empty result;
* a component's id is its smallest doc_id; null ids don't count unless there are no others;
* only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wosearch.llm.common import parts
from wosearch.llm.components import components
from wosearch.session import materialise

SHINGLE = 3
SEED = 42
RADIUS = 3
BANDS = (13, 13, 13, 13, 12)
PIVOTS = 32
GROUP = 2048
REST_BITS = 11
BATCH_BYTES = 8 << 20
SLICE = 1 << 16


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text.

    bytes.lower() changes A-Z alone and bytes.split() splits at just x20 and x09 to x0D.
    """
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = min(shingle, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[s:e], SEED)
         for s, e in zip(starts[:len(words) - n].tolist(), ends[n:].tolist())),
        np.uint64, len(words) - n,
    )
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), SLICE):
        some = hashes[at:at + SLICE].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int.from_bytes(bits.tobytes(), "little")


def _fingerprint_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for doc_ids, hashes, texts in parts(batches, BATCH_BYTES, text=2):
        prints = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays(
            [doc_ids, hashes, pa.array(prints.view(np.int64))],
            names=["doc_id", "text_hash", "print"],
        )


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, print (the fingerprint's bits as a long)."""
    narrow = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text"), F.col("text"))
    return narrow.mapInArrow(_fingerprint_task, "doc_id long, text_hash long, print long")


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints, a fixed sequence of pseudo-random bits."""
    return np.array([xxhash.xxh64_intdigest(f"pivot {i}") for i in range(n)], dtype=np.uint64)


def _as_long(bits: int) -> int:
    return bits - (1 << 64) if bits >= 1 << 63 else bits


def _band_masks() -> list[int]:
    edges = np.cumsum((0, *BANDS)).tolist()
    bands = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [_as_long(x | y) for x, y in combinations(bands, len(BANDS) - RADIUS)]


def _parts(rest: Column, n: int = RADIUS + 1) -> Column:
    """The set bits of a long in ``n`` masks; empty ones are left out."""
    bits = F.filter(
        F.sequence(F.lit(0), F.lit(63)), lambda b: F.call_function("getbit", rest, b) == 1
    )

    def mask(i: Column) -> Column:
        first = F.floor(F.size(bits) * i / n).cast("int")
        last = F.floor(F.size(bits) * (i + 1) / n).cast("int")
        return F.aggregate(
            F.slice(bits, first + 1, last - first), F.lit(0).cast("long"),
            lambda m, b: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b)),
        )

    return F.filter(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), mask), lambda m: m != 0)


def _dealt(members: DataFrame, masks: Column) -> DataFrame:
    """Members (print, group, rest) to smaller groups, one for each mask of bits they now agree in."""
    return members.select("print", "group", "rest", F.explode(masks).alias("mask")).select(
        "print", F.xxhash64("group", "mask", F.col("print").bitwiseAND(F.col("mask"))).alias("group"),
        F.col("rest").bitwiseAND(F.bitwise_not("mask")).alias("rest"),
    )


def link_groups(
    key: np.ndarray, prints: np.ndarray, radius: int = RADIUS
) -> list[tuple[int, int]]:
    """Links that join parts inside groups of equal keys, as row pairs."""
    refs = pivots()
    coords = np.stack([np.bitwise_count(prints ^ p) for p in refs], axis=1).astype(np.int8)
    order = np.lexsort((prints, coords[:, 0], key))
    key, prints, coords = key[order], prints[order], coords[order]
    n = len(prints)
    group = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
    part = np.arange(n)
    links = []
    active, step = np.arange(n), 0
    while len(active):
        step += 1
        active = active[active + step < n]
        other = active + step
        near = (group[active] == group[other]) & (
            coords[other, 0] - coords[active, 0] <= radius
        )
        active = active[near]
        apart = active[part[active] != part[active + step]]
        if not len(apart):
            continue
        gap = np.abs(coords[apart] - coords[apart + step]).max(axis=1)
        apart = apart[gap <= radius]
        apart = apart[np.bitwise_count(prints[apart] ^ prints[apart + step]) <= radius]
        if not len(apart):
            continue
        merged = {}

        def find(x: int) -> int:
            while x in merged:
                x = merged[x]
            return x

        for i in apart.tolist():
            a, b = find(int(part[i])), find(int(part[i + step]))
            if a != b:
                merged[max(a, b)] = min(a, b)
                links.append((i, i + step))
        if merged:
            old = np.fromiter(merged, np.int64, len(merged))
            to = np.arange(n)
            to[old] = [find(x) for x in old.tolist()]
            part = to[part]
    return [(int(order[i]), int(order[j])) for i, j in links]


def _link_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches come sorted by group; the last group of a batch waits for the next batch."""
    held: list[np.ndarray] | None = None
    for batch in _with_end(batches):
        if batch is not None:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = columns if held is None else [np.concatenate(p) for p in zip(held, columns)]
            if not len(held[0]):
                continue
            cut = int(np.argmax(held[0] == held[0][-1]))
        elif held is None or not len(held[0]):
            return
        else:
            cut = len(held[0])
        if not cut:
            continue
        key, prints = (c[:cut] for c in held)
        held = [c[cut:] for c in held]
        links = link_groups(key, prints.view(np.uint64))
        if links:
            a, b = (prints[list(side)] for side in zip(*links))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _with_end(batches: Iterable) -> Iterator:
    yield from batches
    yield None


def link_prints(prints: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column print), enough to connect them."""
    # ``rest``: the bits that can still tell the members of a group apart.
    single = prints.select("print", F.lit(0).alias("group"), F.lit(-1).cast("long").alias("rest"))
    members = _dealt(single, F.array(*(F.lit(mask) for mask in _band_masks())))
    done = []
    while True:
        hot = materialise(
            members.filter(F.bit_count("rest") > REST_BITS).groupBy("group").count()
            .filter(F.col("count") > GROUP).select("group"), "simhash-hot",
        )
        if hot.isEmpty():
            done.append(members)
            break
        done.append(members.join(hot, "group", "left_anti"))
        members = materialise(
            _dealt(members.join(hot, "group", "left_semi"), _parts(F.col("rest"))), "simhash-members"
        )
    whole = reduce(DataFrame.unionByName, done).select("group", "print")
    return whole.repartition("group").sortWithinPartitions("group").mapInArrow(
        _link_task, "a long, b long"
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, print, component_id for every row of docs (doc_id, text)."""
    rows = materialise(fingerprints(docs), "simhash")
    classes = materialise(rows.groupBy("print").agg(F.min("doc_id").alias("least")), "classes")
    tied = components(link_prints(classes.select("print")))
    rooted = classes.join(tied, F.col("print") == F.col("node"), "left").select(
        "print", "least", F.coalesce("root", "print").alias("root")
    )
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("print", "root").join(ids, "root").select("print", "component_id")
    return rows.join(named, "print").select("doc_id", "text_hash", "print", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs with one document of each component: the one with its id.

    Among repeated rows and rows that share this id, one remains.
    """
    found = near_duplicates(docs)
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_hash"))
    kept = found.groupBy("component_id").agg(F.min(order).alias("k")).filter(
        "component_id is not null"
    ).select(F.col("k.doc_id").alias("kept_id"), F.col("k.text_hash").alias("kept_hash"))
    lone = found.filter("component_id is null").groupBy("print").agg(
        F.min("text_hash").alias("kept_hash")
    ).select(F.lit(None).cast("long").alias("kept_id"), "kept_hash")
    marked = docs.withColumn("text_hash", F.xxhash64("text"))
    return marked.join(
        kept.unionByName(lone),
        F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("text_hash") == F.col("kept_hash")),
    ).drop("kept_id", "kept_hash").dropDuplicates(["doc_id", "text_hash"]).select(*docs.columns)
