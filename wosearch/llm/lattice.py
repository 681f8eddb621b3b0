"""Near-duplicate vectors by lattice hashing.

Vectors of one label are compared by cosine. Equal vectors form one class from the start. In
each of ``TABLES`` tables a class's unit vector is projected at random to eight dimensions and
decoded to the nearest point of the lattice E8, its cell; a search also probes the ``PROBES``
neighbouring points nearest to it (of the 240 at the least distance). Two classes are candidates
if one's probes meet the other's cell in some table; the cosine is then verified in double
precision. By simulation a pair at the threshold itself is found with probability 0.997.

Hot cells. The members of a cell with ``HOT`` or more classes define a hub, their mean
direction. Classes whose angle to a hub is at most half the threshold's angle make up its ball:
any two of them link, by the triangle inequality, so a ball's links are counted, not listed. In
the candidate search a ball is one item with a few cells; the angle between hub and another item
tells whether any member can link with it, and only then members are compared one by one.

Defined results
* a vector that is null, empty, zero, or holds nulls or non-finite numbers, and a vector without
  a label, links with nothing and is its own component; so does one of another length with
  those of this length;
* equal vectors link with each other, repeated rows included: a row that occurs twice counts as
  two vectors; a component's id is its smallest vec_id, null ids don't count;
* an empty table gives an empty result;
* only the id, the vector and the label are read, so other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wosearch.llm.components import components
from wosearch.session import materialise

THRESHOLD = 0.93
TABLES = 6
PROBES = 8
SCALE = 7.0
HOT = 64
SLICE = 4096
# Less than the rounding of a cosine can turn.
MARGIN = 1e-6


def shortest() -> np.ndarray:
    """The 240 shortest vectors of E8, from their two rules."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def _nearest_even(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum."""
    point = np.rint(x)
    odd = np.flatnonzero(point.sum(axis=1) % 2)
    gap = x[odd] - point[odd]
    worst = np.abs(gap).argmax(axis=1)
    side = np.where(gap[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
    point[odd, worst] += side
    return point


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8: integer points of even sum, or those moved by one half."""
    whole, half = _nearest_even(x), _nearest_even(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(closer[:, None], whole, half)


def projections(dim: int) -> list[np.ndarray]:
    """One matrix (dim x 8) per table, the same in every task."""
    out = []
    for t in range(TABLES):
        random = np.random.default_rng((t, dim)).standard_normal((max(dim, 8), 8))
        out.append(np.linalg.qr(random)[0][:dim] * SCALE)
    return out


def _cell_keys(points: np.ndarray, table: int, dim: int) -> np.ndarray:
    """A 64-bit number for each lattice point of a table, for vectors of one length."""
    steps = np.rint(2 * points).astype(np.int64).view(np.uint64)
    h = np.full(steps.shape[:-1], table + 1, dtype=np.uint64)
    for i in range(8):
        h = (h ^ steps[..., i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h ^= np.uint64(dim * 0xD6E8FEB86659FD93 % (1 << 64))  # lengths don't meet
    return h.view(np.int64)


def cells(units: np.ndarray) -> np.ndarray:
    """Cells of unit vectors: n x TABLES x (1 + PROBES), the own one first."""
    around = shortest()
    out = np.empty((len(units), TABLES, 1 + PROBES), dtype=np.int64)
    for t, matrix in enumerate(projections(units.shape[1])):
        x = units @ matrix
        home = decode(x)
        closest = np.argsort(-((x - home) @ around.T), axis=1, kind="stable")[:, :PROBES]
        out[:, t, 0] = _cell_keys(home, t, units.shape[1])
        out[:, t, 1:] = _cell_keys(home[:, None, :] + around[closest], t, units.shape[1])
    return out


_CELLS = "class_id long, label int, unit array<double>, cells array<array<long>>"


def _cell_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = batch.column(2)
        sizes = np.diff(vectors.offsets.to_numpy())
        flat = vectors.flatten().to_numpy().astype(np.float64)
        starts = np.cumsum(sizes) - sizes
        for dim in np.unique(sizes).tolist():  # a table holds one length as a rule
            for rows in np.array_split(own := np.flatnonzero(sizes == dim), len(own) // SLICE + 1):
                x = flat[starts[rows][:, None] + np.arange(dim)]
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                keys = cells(x)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)),
                     pa.array(list(x), pa.list_(pa.float64())),
                     pa.array([k.tolist() for k in keys], pa.list_(pa.list_(pa.int64())))],
                    names=["class_id", "label", "unit", "cells"],
                )


def _cosine_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cosines of the unit vectors in columns u and v of each row; they leave, cosine comes."""
    for batch in batches:
        value = np.array([
            float(np.dot(u, v)) for u, v in zip(
                batch.column("u").to_numpy(zero_copy_only=False),
                batch.column("v").to_numpy(zero_copy_only=False),
            )
        ])
        kept = [n for n in batch.schema.names if n not in ("u", "v")]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in kept), pa.array(value, pa.float64())], names=[*kept, "cosine"]
        )


def with_cosine(df: DataFrame) -> DataFrame:
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in ("u", "v")]
    return df.mapInArrow(_cosine_task, ", ".join([*kept, "cosine double"]))


def is_sound(vector: Column) -> Column:
    """Neither null nor zero, all components finite."""
    def bad(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    return F.coalesce(
        ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False)
    )


def _balls(classes: DataFrame, keys: DataFrame, half_angle: float) -> DataFrame:
    """class_id, ball, angle (to the hub): classes that belong to a ball."""
    hot = materialise(
        keys.filter("own").groupBy("label", "cell").agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= HOT), "lattice-hot",
    )
    own = keys.filter("own").join(hot, ["label", "cell"]).select("label", "cell", "n", "class_id")
    means = own.join(classes.select("class_id", "unit"), "class_id").select(
        "label", "cell", "n", F.posexplode("unit").alias("at", "x")
    ).groupBy("label", "cell", "n", "at").agg(F.avg("x").alias("x"))
    hubs = means.groupBy("label", "cell", "n").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("m")
    ).withColumn("norm", F.sqrt(F.aggregate("m", F.lit(0.0), lambda a, x: a + x * x))).filter(
        "norm > 0"
    ).select("label", "cell", "n", F.transform("m", lambda x: x / F.col("norm")).alias("v"))
    # A cell may be hot in several labels: each has a ball of its own.
    seen = keys.join(hubs, ["label", "cell"]).select(
        "class_id", "n", "cell", F.xxhash64("label", "cell").alias("ball"), "v"
    )
    near = with_cosine(
        seen.join(classes.select("class_id", F.col("unit").alias("u")), "class_id")
    ).filter(F.col("cosine") >= math.cos(half_angle - MARGIN))
    return near.groupBy("class_id").agg(
        F.max(F.struct("n", "cell", "cosine", "ball")).alias("best")
    ).select("class_id", F.col("best.ball").alias("ball"), F.acos(
        F.least(F.col("best.cosine"), F.lit(1.0))).alias("angle"))


def link(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding, label)."""
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"),
        F.col("embedding").cast("array<double>").alias("vector"),
    )
    sound = is_sound(F.col("vector")) & F.col("label").isNotNull()
    grouped = rows.filter(sound).groupBy("label", "vector").agg(
        F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies")
    )
    # The hash tells classes apart where ids are missing or repeated.
    classes = materialise(
        grouped.withColumn("class_id", F.xxhash64("label", "vector")), "lattice-classes"
    )
    hashed = materialise(
        classes.select("class_id", "label", "vector").mapInArrow(_cell_task, _CELLS),
        "lattice-cells",
    )
    keys = materialise(
        hashed.select("class_id", "label", F.explode("cells").alias("c")).select(
            "class_id", "label", F.posexplode("c").alias("at", "cell")
        ).select("class_id", "label", "cell", (F.col("at") == 0).alias("own")), "lattice-keys",
    )
    angle = math.acos(threshold)
    balls = materialise(_balls(hashed, keys, angle / 2), "lattice-balls")

    # Items: balls (by their hub's cell) and the classes that belong to none.
    def item(df: DataFrame) -> DataFrame:
        return df.join(balls, "class_id", "left").withColumns({
            "item": F.coalesce("ball", "class_id"), "is_ball": F.col("ball").isNotNull(),
        })

    items = item(keys).groupBy("label", "cell", "item", "is_ball").agg(F.max("own").alias("own"))
    homes = items.filter("own").select(
        "label", "cell", F.col("item").alias("b"), F.col("is_ball").alias("b_ball")
    )
    probes = items.select(
        "label", "cell", F.col("item").alias("a"), F.col("is_ball").alias("a_ball")
    )
    met = probes.join(homes, ["label", "cell"]).filter("a <> b or a_ball <> b_ball").select(
        F.when(F.col("a") < F.col("b"), F.struct("a", "a_ball", "b", "b_ball")).otherwise(F.struct(
            F.col("b").alias("a"), F.col("b_ball").alias("a_ball"),
            F.col("a").alias("b"), F.col("a_ball").alias("b_ball"),
        )).alias("p"), "label",
    ).select("label", "p.*").distinct()

    # The hub of a ball stands for it: a member nearest to it, ties by id, and its reach.
    members = item(hashed.select("class_id", "label", "unit")).select(
        "label", "item", "is_ball", "class_id", "unit", F.coalesce("angle", F.lit(0.0)).alias("angle")
    )
    centre = members.groupBy("label", "item", "is_ball").agg(
        F.min_by("unit", F.struct("angle", "class_id")).alias("unit"),
        (F.max("angle") + F.min("angle")).alias("reach"),
    )

    def side(name: str, vector: str) -> DataFrame:
        return centre.select(
            "label", F.col("item").alias(name), F.col("is_ball").alias(f"{name}_ball"),
            F.col("unit").alias(vector), F.col("reach").alias(f"{name}_reach"),
        )

    weighed = with_cosine(
        met.join(side("a", "u"), ["label", "a", "a_ball"])
        .join(side("b", "v"), ["label", "b", "b_ball"])
    )
    between = F.acos(F.greatest(F.least(F.col("cosine"), F.lit(1.0)), F.lit(-1.0)))
    close = weighed.filter(between <= angle + F.col("a_reach") + F.col("b_reach") + MARGIN)
    plain = close.filter("not a_ball and not b_ball").filter(F.col("cosine") >= threshold).select("a", "b")
    mixed = close.filter("a_ball or b_ball").select("label", "a", "a_ball", "b", "b_ball")

    def opened(name: str, vector: str) -> DataFrame:
        return members.select(
            "label", F.col("item").alias(name), F.col("is_ball").alias(f"{name}_ball"),
            F.col("class_id").alias(f"{name}_class"), F.col("unit").alias(vector),
        )

    verified = with_cosine(
        mixed.join(opened("a", "u"), ["label", "a", "a_ball"])
        .join(opened("b", "v"), ["label", "b", "b_ball"])
        .select(F.col("a_class").alias("a"), F.col("b_class").alias("b"), "u", "v")
    ).filter(F.col("cosine") >= threshold).select("a", "b")
    links = materialise(plain.unionByName(verified).distinct(), "lattice-links")

    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    copies = classes.select(F.col("class_id").alias("b"), "copies")
    outside = both.join(copies, "b").groupBy("a").agg(F.sum("copies").alias("outside"))
    in_ball = balls.join(classes.select("class_id", "copies"), "class_id")
    sizes = in_ball.groupBy("ball").agg(F.sum("copies").alias("size"))
    firsts = balls.groupBy("ball").agg(F.min("class_id").alias("first"))
    chain = balls.join(firsts, "ball").select(F.col("class_id").alias("a"), F.col("first").alias("b"))
    tied = components(links.unionByName(chain))
    rooted = classes.select("class_id", "least", "copies").join(
        tied, F.col("class_id") == F.col("node"), "left"
    ).withColumn("root", F.coalesce("root", "class_id"))
    roots = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    per_class = (
        rooted.join(roots, "root")
        .join(outside, F.col("class_id") == F.col("a"), "left")
        .join(balls.select("class_id", "ball"), "class_id", "left").join(sizes, "ball", "left")
        .select(
            "class_id", "component_id",
            (F.coalesce("outside", F.lit(0)) + F.coalesce("size", F.col("copies")) - 1).alias("n_links"),
        )
    )
    keyed = rows.select("vec_id", F.when(sound, F.xxhash64("label", "vector")).alias("key"))
    found = keyed.join(per_class, F.col("key") == F.col("class_id"), "left")
    return found.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(
            F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.col("component_id").isNull()
        ).alias("kept"),
    )
