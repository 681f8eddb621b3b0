"""The Merkle manifest against a plain recursive tree."""

import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from wosearch.llm import merkle


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def digest(row, n_chars):
    return h(*map(field, (row.doc_id, row.source, row.lang, n_chars, row.text)))


def grown(nodes, arity):
    """All levels of a tree, the nodes first."""
    levels = [nodes]
    while len(nodes) > 1:
        nodes = [h(*nodes[i:i + arity]) for i in range(0, len(nodes), arity)]
        levels.append(nodes)
    return levels


def way(levels, i, arity):
    """Runs from a node to the top, with the node's place in them."""
    out = []
    for level in levels[:-1]:
        start = i // arity * arity
        out.append((level[start:start + arity], i - start))
        i //= arity
    return out


def expected(rows, arity=2):
    groups = defaultdict(list)
    for row in rows:
        groups[row.lang].append((digest(row, row.n_chars), row))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda p: (p[1].doc_id is not None, p[1].doc_id or 0, p[0]))
        trees[g] = grown([leaf for leaf, _ in groups[g]], arity)
    forest = grown([trees[g][-1][0] for g in order], arity)
    root, out = forest[-1][0], []
    for at, g in enumerate(order):
        for i, (leaf, row) in enumerate(groups[g]):
            steps = way(trees[g], i, arity) + way(forest, at, arity)
            proof = h(*(n for run, slot in steps for k, n in enumerate(run) if k != slot))
            value = leaf
            if row.doc_id is not None and zlib.crc32(str(row.doc_id).encode()) % 7 == 0 \
                    and row.n_chars is not None:
                value = digest(row, row.n_chars + 1)
            for run, slot in steps:
                value = h(*run[:slot], value, *run[slot + 1:])
            out.append((row.doc_id, leaf, trees[g][-1][0], root, proof, value, value == root))
    return sorted(out, key=repr)


def got(docs, **how):
    return sorted((tuple(r) for r in merkle.fold(merkle.manifest(docs, **how)).collect()), key=repr)


# Blocks of 9, 4 and 256 nodes: trees of several tiers, and of one.
@pytest.mark.parametrize("arity,levels", [(3, 2), (2, 2), (2, 8)])
def test_documents(spark, arity, levels):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = expected(docs.collect(), arity)
    rows = got(docs, arity=arity, levels=levels)
    assert rows == want
    assert 0 < sum(not r[-1] for r in rows) < len(rows)


def test_many_groups(spark):
    """More subroots than a block holds; the forest has tiers of its own."""
    docs = spark.range(400).select(
        F.col("id").alias("doc_id"), F.lit("s").alias("source"),
        F.concat(F.lit("l"), F.col("id") % 150).alias("lang"),
        F.when(F.col("id") % 5 > 0, F.col("id")).alias("n_chars"), F.lit("é😀").alias("text"),
    )
    assert got(docs, levels=2) == expected(docs.collect())


def test_odd_documents(spark):
    docs = brute.odd_documents(spark).withColumns({"tree": F.lit(1), "idx": F.lit(2), "digest": F.lit("x")})
    rows = docs.collect()
    assert got(docs, levels=1) == expected(rows)
    assert got(docs.filter("doc_id = 3")) == expected([r for r in rows if r.doc_id == 3])
    assert got(docs.limit(0)) == []


def test_parents_keep_their_states():
    children = [h(str(i)) for i in range(5)]
    parent = merkle.Parent(children)
    assert parent.digest == h(*children) and len(parent.states) == 5
    for slot in range(5):
        assert parent.fold(slot, "new") == h(*children[:slot], "new", *children[slot + 1:])
    assert parent.fold(0, children[0]) == parent.digest
