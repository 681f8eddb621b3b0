"""Merkle manifest of a dataset: hash trees per group whose parents keep SHA midstates.

1. A leaf is the SHA-256 of a row's fields, each written as its length and value.
2. Per group, leaves in ascending order of their id are nodes; every ``arity`` consecutive nodes
   become the SHA-256 of their concatenated hex digests, until one node is left, the subroot.
   The subroots, ordered by group, become the root in the same way.
3. A parent absorbs its children one after another and keeps a copy of its hash state before
   each slot. To fold a replaced child, the state of its slot is resumed: only the replacement
   and the siblings to its right are hashed, nothing to the left.

Nodes are numbered by one range partitioning and running counts of its partitions, so a group may
hold any share of the rows. ``arity ** LEVELS`` consecutive nodes form a block, which one task
builds; blocks' roots are the nodes of the next tier. A block gets its path to the root, whose
parents' states are resumed for each of its leaves, so no tier gathers the leaves' digests.

Defined results
* a null field is written as ``-``, an empty one as ``0:``; null groups form a group of their own,
  before all others;
* null ids come first; equal ids go by leaf digest, so repeated rows are leaves side by side;
* a lone leaf is its group's subroot, a lone subroot is the root; without siblings the proof is the
  hash of nothing;
* tampering leaves a null count and a row with a null id as they are, so these verify; adding to
  the largest long makes the count null;
* an empty table has no rows and no root;
* only the named fields are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wosearch.session import materialise

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 2
# Levels of the tree that one block holds: 256 nodes of two children each.
LEVELS = 8
# Row numbers of monotonically_increasing_id: the partition above, the row below.
ROW_BITS = 33
TAMPER_MOD = 7

_NODE = "tree string, n long, idx long, digest string"
_STEPS = "array<struct<before:string,after:string>>"
_STEPS_ARROW = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


def field_text(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")
    )


def row_digest(fields: Iterable[Column]) -> Column:
    return F.sha2(F.concat(*(field_text(f) for f in fields)).cast("binary"), 256)


def is_tampered(doc_id: Column) -> Column:
    picked = F.crc32(doc_id.cast("string").cast("binary")) % TAMPER_MOD == 0
    return F.coalesce(picked, F.lit(False))


def leaves(docs: DataFrame, group: str = "lang") -> DataFrame:
    """tree, doc_id, digest, and the digest after tampering where that changes the row."""
    whole = [F.col(f) for f in FIELDS]
    changed = [F.try_add(F.col(f), F.lit(1)) if f == "n_chars" else F.col(f) for f in FIELDS]
    alters = is_tampered(F.col("doc_id")) & F.col("n_chars").isNotNull()
    return docs.select(
        # "-" sorts before "=", so null is the first group.
        F.coalesce(F.concat(F.lit("="), F.col(group)), F.lit("-")).alias("tree"),
        F.col("doc_id"), row_digest(whole).alias("digest"),
        F.when(alters, row_digest(changed)).alias("replaced"),
    )


def numbered(nodes: DataFrame, order: list[str], label: str) -> DataFrame:
    """Add idx, the position of a node in its tree, and n, the nodes of the tree."""
    row = F.monotonically_increasing_id()
    placed = materialise(
        nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
        .withColumn("row", row).withColumn("part", F.shiftright("row", ROW_BITS)),
        f"{label}-ordered",
    )
    by_part = Window.partitionBy("tree").orderBy("part")
    runs = (
        placed.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("rows"), F.min("row").alias("first"))
        .select(
            "tree", "part",
            (F.sum("rows").over(by_part) - F.col("rows") - F.col("first")).alias("shift"),
            F.sum("rows").over(Window.partitionBy("tree")).alias("n"),
        )
    )
    return (
        placed.join(materialise(runs, f"{label}-runs"), ["tree", "part"])
        .withColumn("idx", F.col("row") + F.col("shift")).drop("row", "part", "shift")
    )


class Parent:
    """A node over up to ``arity`` children, with its hash state before each of them."""

    def __init__(self, children: list[str]):
        self.children, self.states = children, []
        state = sha256()
        for child in children:
            self.states.append(state.copy())
            state.update(child.encode())
        self.digest = state.hexdigest()

    def fold(self, slot: int, replacement: str) -> str:
        state = self.states[slot].copy()
        state.update(replacement.encode())
        state.update("".join(self.children[slot + 1:]).encode())
        return state.hexdigest()


def grow(digests: list[str], arity: int, levels: int | None) -> list[list[Parent]]:
    """Levels of parents over the nodes of a block: ``levels`` of them, or up to one node."""
    out: list[list[Parent]] = []
    while len(out) < levels if levels is not None else len(digests) > 1:
        row = [Parent(digests[i:i + arity]) for i in range(0, len(digests), arity)]
        out.append(row)
        digests = [p.digest for p in row]
    return out


def _block_levels(n: int, arity: int, levels: int) -> int | None:
    """A tree within one block ends at one node, other trees' blocks have full height."""
    return levels if n > arity ** levels else None


def _ordered(table: pa.Table) -> pa.Table:
    return table.sort_by("idx")


def _block_root(key, table: pa.Table, arity: int, levels: int) -> pa.Table:
    table = _ordered(table)
    n = table["n"][0].as_py()
    digests = table["digest"].to_pylist()
    rows = grow(digests, arity, _block_levels(n, arity, levels))
    root = rows[-1][0].digest if rows else digests[0]
    return pa.table({
        "tree": [key[0].as_py()], "n": pa.array([-(-n // arity ** levels)], pa.int64()),
        "idx": pa.array([key[1].as_py()], pa.int64()), "digest": [root],
    })


def _way(rows: list[list[Parent]], i: int, arity: int) -> list[dict]:
    """Siblings before and after node ``i`` on each level of its block."""
    out = []
    for row in rows:
        i, slot = divmod(i, arity)
        children = row[i].children
        out.append({"before": "".join(children[:slot]), "after": "".join(children[slot + 1:])})
    return out


def _block_steps(table: pa.Table, arity: int, levels: int) -> pa.Table:
    table = _ordered(table)
    n = table["n"][0].as_py()
    rows = grow(table["digest"].to_pylist(), arity, _block_levels(n, arity, levels))
    steps = [_way(rows, i, arity) for i in range(table.num_rows)]
    return pa.table({
        "tree": table["tree"], "idx": table["idx"], "steps": pa.array(steps, _STEPS_ARROW),
    })


def _blocks(nodes: DataFrame, width: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"idx div {width}"))


@dataclass
class Tree:
    """Tiers of a forest: nodes (tree, n, idx, digest), the last one with one node per tree."""

    tiers: list[DataFrame]
    arity: int
    levels: int

    @property
    def width(self) -> int:
        return self.arity ** self.levels

    def steps(self, nodes: DataFrame) -> DataFrame:
        """tree, idx, steps: the siblings of each node up to the top of its block."""
        arity, levels = self.arity, self.levels
        return _blocks(nodes.select("tree", "n", "idx", "digest"), self.width).groupBy(
            "tree", "block"
        ).applyInArrow(
            lambda key, table: _block_steps(table, arity, levels),
            f"tree string, idx long, steps {_STEPS}",
        )

    def paths(self, tops: DataFrame) -> list[DataFrame]:
        """For each tier above the first: (tree, idx, up, and what ``tops`` has more), where
        ``up`` lists the siblings from the node to the root; ``tops`` gives the trees' own.
        """
        extra = [c for c in tops.columns if c not in ("tree", "up")]
        below = tops.withColumn("idx", F.lit(0).cast("long"))
        out = [below]
        for nodes in reversed(self.tiers[1:-1]):
            steps = self.steps(nodes)
            below = materialise(
                _blocks(steps, self.width)
                .join(below.withColumnRenamed("idx", "block"), ["tree", "block"])
                .select("tree", "idx", F.concat("steps", "up").alias("up"), *extra),
                "merkle-paths",
            )
            out.append(below)
        return out[::-1]


def build(nodes: DataFrame, arity: int = ARITY, levels: int = LEVELS) -> Tree:
    """Trees over the numbered ``nodes`` (tree, n, idx, digest)."""
    tiers = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        blocks = _blocks(tiers[-1].select("tree", "n", "idx", "digest"), arity ** levels)
        tiers.append(materialise(
            blocks.groupBy("tree", "block").applyInArrow(
                lambda key, table: _block_root(key, table, arity, levels), _NODE
            ),
            "merkle-tier",
        ))
        most = -(-most // arity ** levels)
        if most <= 1:
            return Tree(tiers, arity, levels)


@dataclass
class Manifest:
    """Numbered leaves, the trees over them and the tree over the trees' subroots."""

    leaves: DataFrame
    trees: Tree
    forest: Tree

    @property
    def subroots(self) -> DataFrame:
        return self.trees.tiers[-1].select("tree", F.col("digest").alias("subroot"))

    @property
    def root(self) -> str | None:
        row = self.forest.tiers[-1].select("digest").first()
        return row["digest"] if row else None


def manifest(
    docs: DataFrame, group: str = "lang", arity: int = ARITY, levels: int = LEVELS
) -> Manifest:
    """Hash every row and build the trees; writes one narrow row per document and the tiers."""
    own = materialise(numbered(leaves(docs, group), ["doc_id", "digest"], "merkle"), "merkle-leaves")
    trees = build(own, arity, levels)
    tops = trees.tiers[-1].select(F.col("tree").alias("name"), "digest")
    # One tree over all subroots, in the order of their groups.
    ordered = numbered(tops.withColumn("tree", F.lit("")), ["name"], "merkle-forest")
    return Manifest(own, trees, build(materialise(ordered, "merkle-subroots"), arity, levels))


def _group_paths(m: Manifest) -> DataFrame:
    """tree, subroot, up: the siblings from a group's subroot to the root."""
    names = m.forest.tiers[0]
    none = F.array().cast(_STEPS)
    above = m.forest.paths(
        m.forest.tiers[-1].select("tree", none.alias("up"))
    )[0].select(F.col("idx").alias("block"), "up")
    full = _blocks(m.forest.steps(names), m.forest.width).join(above, "block").select(
        "idx", F.concat("steps", "up").alias("up")
    )
    return materialise(
        names.select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), "idx")
        .join(full, "idx").drop("idx"), "merkle-tops",
    )


_FOLDED = (
    "doc_id long, leaf string, subroot string, root string, proof_sha256 string, "
    "folded_root string, verified boolean"
)


def _fold_block(
    nodes: pa.Table, path: pa.Table, root: str, arity: int, levels: int
) -> pa.Table:
    nodes = _ordered(nodes)
    digests = nodes["digest"].to_pylist()
    rows = grow(digests, arity, _block_levels(nodes["n"][0].as_py(), arity, levels))
    # Parents on the block's way to the root: their states before its slot, once for all leaves.
    up = path["up"][0].as_py()
    upper = [(sha256(step["before"].encode()), step["after"].encode()) for step in up]
    tail = "".join(step["before"] + step["after"] for step in up)
    proofs, folded = [], []
    for i, new in enumerate(nodes["replaced"].to_pylist()):
        way = _way(rows, i, arity)
        siblings = "".join(step["before"] + step["after"] for step in way) + tail
        proofs.append(sha256(siblings.encode()).hexdigest())
        value, at = new or digests[i], i
        for row in rows:
            at, slot = divmod(at, arity)
            value = row[at].fold(slot, value)
        for before, after in upper:
            state = before.copy()
            state.update(value.encode())
            state.update(after)
            value = state.hexdigest()
        folded.append(value)
    n = len(digests)
    return pa.table({
        "doc_id": nodes["doc_id"].cast(pa.int64()), "leaf": digests,
        "subroot": [path["subroot"][0].as_py()] * n, "root": [root] * n,
        "proof_sha256": proofs, "folded_root": folded,
        "verified": [value == root for value in folded],
    })


def fold(m: Manifest) -> DataFrame:
    """One row per leaf: its proof, and the root folded from its replacement or itself."""
    tops = _group_paths(m)
    paths = m.trees.paths(tops)[0].withColumnRenamed("idx", "block")
    blocks = _blocks(m.leaves, m.trees.width)
    root, arity, levels = m.root, m.trees.arity, m.trees.levels
    return blocks.groupBy("tree", "block").cogroup(paths.groupBy("tree", "block")).applyInArrow(
        lambda key, nodes, path: _fold_block(nodes, path, root, arity, levels), _FOLDED
    )
