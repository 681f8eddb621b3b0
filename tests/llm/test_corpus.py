"""Fingerprints, near-duplicates, model scores, toxicity, mixing and packing."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyarrow import parquet
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from wosearch.llm import (
    components, lattice, mixing, ngram_model, packing, simhash, spotsigs, toxicity,
)
from wosearch.session import materialise

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


# Fingerprints ----------------------------------------------------------------------------

def edits(rows):
    """The rows of documents in descending order with the next one's text."""
    return [(a, rows[(i + 1) % len(rows)]) for i, a in enumerate(rows)]


def test_spotsigs_edits(spark, docs):
    rows = sorted(((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), reverse=True)
    got = {r.doc_id: r for r in spotsigs.compare_edits(docs).collect()}
    assert len(got) == len(rows)
    for (doc_id, text), (_, following) in edits(rows):
        cut = len(text) // 2
        edited = text[:len(text) - cut] + following[:cut]
        row = got[doc_id]
        assert row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        own, other, after = map(spotsigs.signatures, (text, edited, following))
        assert row.fingerprint == spotsigs.as_text(own)
        assert row.near_edited == len(own & other) / max(1, len(own | other))
        assert row.near_next == len(own & after) / max(1, len(own | after))


def plain_signatures(text):
    """Chains of three content words after a common word, or after a content word that comes more
    than eight content words after the last common one; looked up anew for every word."""
    words = re.findall(r"[^\W\d_]+", text.lower())
    found = set()
    for i, word in enumerate(words):
        if word not in spotsigs.COMMON:
            commons = [j for j in range(i) if words[j] in spotsigs.COMMON]
            since = words[commons[-1] + 1 if commons else 0:i + 1]
            if len(since) <= 8:
                continue
        chain = [w for w in words[i + 1:] if w not in spotsigs.COMMON][:3]
        if len(chain) == 3:
            found.add(xxhash.xxh32_digest(" ".join([word, *chain]).encode()))
    if not found and text:
        found.add(xxhash.xxh32_digest((" ".join(words) or text).encode()))
    return found


def test_spotsigs_signatures(docs):
    texts = [r.text for r in docs.filter("length(text) < 3000").limit(150).collect()]
    texts += [t for t in brute.ODD_TEXTS if t is not None and len(t) < 20000]
    texts += ["the x", "a b c d", "one two three four five six seven eight nine ten eleven twelve thirteen", "THE Old OLD old old"]
    for text in texts:
        assert spotsigs.signatures(text) == plain_signatures(text)


def test_spotsigs_pairs_without_ids(spark, docs):
    """A set without an id pairs like any other, and so do two texts under one id."""
    text = docs.filter("length(text) between 2000 and 4000").first().text
    words = text.split(" ")
    other, third = " ".join(words[:-20]), " ".join(words[:40] + words[60:])
    rows = spark.createDataFrame([(None, text), (5, other), (5, third), (None, ""), (7, None)], "doc_id long, text string")
    sets = [spotsigs.signatures(t) for t in (text, other, third)]
    want = sorted(
        (str((None, 5) if x and y is None else (5, 5) if x and y else (5, None)), round(spotsigs.likeness(a, b), 9))
        for (x, a), (y, b) in itertools.combinations(zip((None, 5, 5), sets), 2) if spotsigs.likeness(a, b) >= 0.8
    )
    assert len(want) >= 2 and len(set(sets)) == 3
    got = spotsigs.near_pairs(rows, 0.8).collect()
    assert sorted((str((r.a, r.b)), round(r.likeness, 9)) for r in got) == want
    assert spotsigs.near_pairs(rows.limit(0)).count() == 0


def test_spotsigs_odd(spark):
    docs = brute.odd_documents(spark)
    rows = spotsigs.compare_edits(docs).collect()
    assert len(rows) == docs.count()
    by_text = defaultdict(set)
    for r in rows:
        by_text[r.doc_id].add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values()) and by_text[12] == by_text[13]
    assert spotsigs.compare_edits(docs.limit(0)).count() == 0
    assert spotsigs.compare_edits(docs.filter("doc_id = 12")).first().near_next == 1.0


def test_spotsigs_pairs(spark, docs):
    some = docs.filter("doc_id < 300")
    sets = defaultdict(list)
    for r in some.collect():
        if found := spotsigs.signatures(r.text):
            sets[found].append(r.doc_id)
    keys = list(sets)
    want = {
        tuple(sorted((min(sets[a]), min(sets[b]))))
        for i, a in enumerate(keys) for b in keys[i + 1:] if spotsigs.likeness(a, b) >= 0.5
    }
    assert {(r.a, r.b) for r in spotsigs.near_pairs(some, 0.5).collect()} == want


def simhash_of(text):
    words = brute.words(text)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(prints: dict) -> dict:
    groups, ids = brute.Groups(), list(prints)
    values = np.array([prints[i] for i in ids], dtype=np.uint64)
    for i, doc_id in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(values[i:] ^ values[i]) <= 3) + i:
            groups.tie(doc_id, ids[j])
    return {i: groups.root(i) for i in ids}


@pytest.mark.parametrize("odd", [True, False])
def test_simhash(spark, docs, odd):
    data = brute.odd_documents(spark) if odd else docs
    found = simhash.near_duplicates(data).collect()
    assert len(found) == data.count()
    prints = {r.doc_id: simhash_of(r.text) for r in data.collect() if r.doc_id is not None}
    want = linked(prints)
    for r in found:
        if r.doc_id is not None:
            assert r.print & (1 << 64) - 1 == prints[r.doc_id] and r.component_id == want[r.doc_id]
    kept = simhash.keep_one(data)
    assert kept.columns == data.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(want.values()))
    assert ids.count(None) == odd
    assert simhash.near_duplicates(data.limit(0)).count() == 0


def test_simhash_hot_groups(spark, monkeypatch):
    """Groups beyond the bound go through the cells and keep every link."""
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 1 << 62, 3)
    prints = {int(c) ^ (1 << int(a)) ^ (1 << int(b)) for c in centre for a, b in rng.integers(0, 62, (120, 2))}
    prints |= {int(x) for x in rng.integers(0, 1 << 62, 200)}
    monkeypatch.setattr(simhash, "GROUP", 10)
    links = simhash.link_prints(spark.createDataFrame([(p,) for p in prints], "print long")).collect()
    groups = brute.Groups()
    for a, b in links:
        assert (a ^ b).bit_count() <= 3
        groups.tie(a, b)
    want = linked({p: p for p in sorted(prints)})
    assert {p: groups.root(p) for p in prints} == want


def test_simhash_one_band_pair(spark):
    """Many members that agree in two bands: cut until groups are bounded, no link lost."""
    rng = np.random.default_rng(3)
    prints = [int(x) << 26 | 12345 for x in rng.integers(0, 1 << 37, 60_000)]
    near = {p ^ sum(1 << int(b) for b in rng.choice(np.arange(26, 63), rng.integers(1, 4), replace=False)): p for p in prints[:200]}

    def links_of(some):
        rows = spark.createDataFrame([(p,) for p in set(some)], "print long").repartition(8)
        return [(r.a, r.b) for r in simhash.link_prints(rows).collect()]

    groups = brute.Groups()
    for a, b in links_of([*prints, *near]):
        assert (a ^ b).bit_count() <= 3
        groups.tie(a, b)
    assert all(groups.root(a) == groups.root(b) for a, b in near.items())
    # All links of a smaller copy that is still beyond the bound.
    few, groups = sorted({*prints[:4000], *near}), brute.Groups()
    for a, b in links_of(few):
        groups.tie(a, b)
    assert {p: groups.root(p) for p in few} == linked({p: p for p in few})


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 101), (7, 7), (100, 103)]
    got = dict(components.components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# Vectors ---------------------------------------------------------------------------------

def link_vectors(rows):
    groups, n = brute.Groups(), Counter()
    for i, (a, va, la) in enumerate(rows):
        groups.root(a)
        for b, vb, lb in rows[i + 1:]:
            if la == lb and np.dot(va, vb) / np.linalg.norm(va) / np.linalg.norm(vb) >= 0.93:
                groups.tie(a, b)
                n[a] += 1
                n[b] += 1
    return {a: (n[a], groups.root(a)) for a, _, _ in rows}


@pytest.mark.parametrize("hot", [8, 64])
def test_lattice(spark, monkeypatch, hot):
    monkeypatch.setattr(lattice, "HOT", hot)
    rng = np.random.default_rng(3)
    rows = []
    for c in rng.standard_normal((6, 32)):
        rows += [(c + 0.12 * rng.standard_normal(32), 1) for _ in range(40)]
    rows += [(v, int(i % 3)) for i, v in enumerate(rng.standard_normal((60, 32)))] + [rows[0]] * 3
    rows = [(i, np.float32(v).astype(float), label) for i, (v, label) in enumerate(rows)]
    table = spark.createDataFrame(
        [(i, v.tolist(), label) for i, v, label in rows], "vec_id long, embedding array<float>, label int")
    want = link_vectors(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in lattice.link(table).collect()}
    assert sum(n for n, _ in got.values()) >= 0.99 * sum(n for n, _ in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)
    assert {i: c for i, (_, c) in got.items()} == {i: c for i, (_, c) in want.items()}


def test_lattice_hot_cell_in_labels(spark, monkeypatch):
    """A dense group dealt over three labels: a cell hot in each is a ball in each."""
    monkeypatch.setattr(lattice, "HOT", 8)
    rng = np.random.default_rng(6)
    centre = rng.standard_normal(32)
    rows = [(i, np.float32(centre + 0.02 * rng.standard_normal(32)).astype(float), i % 3) for i in range(90)]
    table = spark.createDataFrame(
        [(i, v.tolist(), label) for i, v, label in rows], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in lattice.link(table).collect()}
    assert got == link_vectors(rows) == {i: (29, i % 3) for i in range(90)}


def test_lattice_lengths(spark):
    """Vectors of two lengths under one label don't meet."""
    rng = np.random.default_rng(7)
    rows = []
    for dim in (64, 65):
        some = rng.standard_normal((250, dim))
        rows.append([(1000 * dim + i, v, 1) for i, v in enumerate(np.concatenate((some, some[:20] * 2 + 0.01)))])
    table = spark.createDataFrame(
        [(i, v.tolist(), label) for own in rows for i, v, label in own],
        "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in lattice.link(table).collect()}
    assert got == link_vectors(rows[0]) | link_vectors(rows[1])


def test_lattice_odd(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, None, 1), (4, [0.0, 0.0], 1),
            (5, [1.0, None], 1), (6, [nan, 1.0], 1), (7, [1.0, 0.0], None), (8, [1.0, 0.0, 0.0], 1), (9, [], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("cell", F.lit(1))
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in lattice.link(table).collect())
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)] + [(i, 0, i, True) for i in range(3, 10)]
    assert lattice.link(table.limit(0)).count() == 0


def test_e8_decoding():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((50, 8)) * 2
    points = lattice.decode(x)
    twice = np.rint(2 * points)
    assert (twice == 2 * points).all() and ((twice % 2).sum(axis=1) % 8 == 0).all()
    assert (points.sum(axis=1) % 2 == 0).all()
    around = lattice.shortest()
    assert len(around) == 240
    nearer = ((x[:, None] - points[:, None] - around) ** 2).sum(axis=2) < ((x - points) ** 2).sum(axis=1)[:, None] - 1e-9
    assert not nearer.any()


# Model scores ----------------------------------------------------------------------------

@pytest.mark.parametrize("odd", [True, False])
def test_base_scores(spark, docs, odd):
    data = brute.odd_documents(spark) if odd else docs
    rows = [(r.doc_id, brute.words(r.text) + [None]) for r in data.collect()]
    counts = Counter(t for i, ts in rows if not brute.held_out(i, 10) for t in ts)
    n, v = sum(counts.values()), len(counts)
    want = sorted((repr(i), len(ts), sum(counts[t] > 0 for t in ts),
                   round(sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts), 4))
                  for i, ts in rows)
    found = ngram_model.score(data, filter_bytes=1 << 22).collect()
    assert sorted((repr(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 4)) for r in found) == want
    assert {r.train_tokens for r in found} == {n}
    assert all(r.held_out == brute.held_out(r.doc_id, 10) for r in found)
    if not odd:
        held = [r for r in found if r.held_out]
        assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert ngram_model.score(data.limit(0)).count() == 0


def test_filter_counts():
    rng = np.random.default_rng(2)
    words = np.unique(rng.integers(0, 1 << 63, 3000).astype(np.uint64) * np.uint64(2))
    counts = rng.integers(1, 100000, len(words))
    table = ngram_model.segment(words, counts, words[:0], counts[:0], 1 << 20)
    known = ngram_model.Filter([table])
    ratio = known.counts(words) / counts
    assert ratio.min() > 0.6 and ratio.max() < 1.6
    assert (known.counts(np.unique(rng.integers(0, 1 << 63, 3000).astype(np.uint64) | np.uint64(1))) > 0).mean() < 0.01


def test_filter_keeps_every_pair():
    """A filter that starts too small grows; nothing is left out."""
    rng = np.random.default_rng(4)
    words, pairs = (np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (2000, 9000))
    of_word, of_pair = rng.integers(1, 1000, len(words)), rng.geometric(0.6, len(pairs))
    known = ngram_model.Filter([ngram_model.segment(words, of_word, pairs, of_pair, 30_000)])
    assert (known.counts(words) / of_word).min() > 0.6
    assert (known.counts(pairs) / of_pair).min() > 0.6


@pytest.mark.parametrize("odd", [True, False])
def test_scores_by_range(spark, docs, odd):
    """Too small a filter scores as a large one does, and segments that stay put as sent ones."""
    data = brute.odd_documents(spark) if odd else docs
    by_size = {
        (size, sent): sorted((repr(r.doc_id), r.score) for r in ngram_model.score(
            data, filter_bytes=size, broadcast_bytes=sent).collect())
        for size, sent in ((1 << 22, 1 << 24), (1 << 12, 1 << 24), (1 << 12, 0))
    }
    large, small, stored = by_size.values()
    assert small == stored and len(small) == data.count()
    if not odd:
        assert sum(x for _, x in small) == pytest.approx(sum(x for _, x in large), rel=0.02)


@pytest.mark.parametrize("odd", [True, False])
def test_base_scores_by_range(spark, docs, odd):
    """Counts that come back with the answers give what shares of the ranges give."""
    data = brute.odd_documents(spark) if odd else docs
    sent, stored = (
        sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))
               for r in ngram_model.score(data, filter_bytes=1 << 12, broadcast_bytes=size).collect())
        for size in (1 << 24, 0)
    )
    assert stored == sent
    assert ngram_model.score(data.limit(0), broadcast_bytes=0).count() == 0


def test_range_is_probed_once(monkeypatch):
    """Probes grow with the distinct n-grams of a range, not with the parts that ask."""
    rng, calls, rows, want = np.random.default_rng(6), [], [], {}
    pool = [np.unique(rng.integers(0, 1 << 63, 500).astype(np.uint64)) & ~np.uint64(0xFFFF) for _ in range(2)]
    real, total = ngram_model.probe, [Counter(), Counter()]
    monkeypatch.setattr(ngram_model, "probe", lambda h, t: calls.append(len(h)) or real(h, t))
    for part in range(400):
        words, pairs = (np.sort(rng.choice(p, 30, replace=False)) for p in pool)
        counts = [rng.integers(0, 4, 30).astype(np.uint32) for _ in pool]
        for known, grams, count in zip(total, (words, pairs), counts):
            known.update(dict(zip(grams.tolist(), count.tolist())))
        rows.append((0, part, words.tobytes(), counts[0].tobytes(), ngram_model.short_bytes(pairs),
                     counts[1].tobytes()))
        want[part] = words, pairs
    names = ["number", "part", "words", "of_word", "pairs", "of_pair"]
    sent = pa.table([pa.array(c) for c in zip(*rows)], names=names)
    got = ngram_model._answer_task((pa.scalar(0),), sent, 1 << 16).to_pylist()
    assert len(calls) == 2 and sum(calls) == len(total[0]) + len(total[1])
    assert (got[0]["part"], got[0]["n"]) == (-1, sum(total[0].values()))
    assert [r["part"] for r in got[1:]] == list(range(400))
    for row in got[1:]:
        words, pairs = want[row["part"]]
        exact = np.frombuffer(row["counts"], np.int64)
        assert exact.tolist() == [total[0][w] for w in words.tolist()]
        for levels, counts in ((row["words"], exact), (row["pairs"], np.array([total[1][x] for x in pairs.tolist()]))):
            levels = np.frombuffer(levels, np.uint8)
            assert (levels[counts > 0] >= ngram_model.levels(counts[counts > 0])).all()


def test_packed_parts_are_read_few_at_once(spark):
    """A reader takes a whole row group, and parts are large rows."""
    noise = spark.range(0, 24, 1, 1).selectExpr(
        "id AS part", "unhex(array_join(transform(sequence(1, 32768), x -> sha2(concat(id, '-', x), 256)), '')) AS packed")
    written = materialise(noise, "packed", **ngram_model.PACKED)
    file, = written.inputFiles()
    groups = parquet.ParquetFile(file.removeprefix("file://")).metadata
    assert groups.num_rows == 24
    assert max(groups.row_group(i).num_rows for i in range(groups.num_row_groups)) <= 6


# Toxicity --------------------------------------------------------------------------------

def test_toxicity_held_out(spark, docs):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = toxicity.train(docs, labels)
    joined = toxicity.score(docs, model).join(labels, "doc_id").collect()
    assert all(0 <= r.score <= 1 for r in joined)
    right = [(r.score >= 0.5) == bool(r.toxic) for r in joined if brute.held_out(r.doc_id, 5)]
    assert np.mean(right) > 0.9
    kept = toxicity.keep_clean(docs, model)
    scored = toxicity.score(docs, model)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(
        r.doc_id for r in scored.filter("score < 0.5").collect())


def test_toxicity_odd(spark):
    docs = brute.odd_documents(spark)
    labels = spark.createDataFrame(
        [(i, i % 2 if i != 4 else None, 0) for i in range(14)] + [(None, 1, 0), (3, 0, 0)],
        "doc_id long, toxic int, quality int")
    model = toxicity.train(docs, labels)
    assert toxicity.score(docs, model).count() == docs.count()
    assert toxicity.keep_clean(docs, model).columns == docs.columns
    assert {r.score for r in toxicity.score(docs, toxicity.train(docs, labels.limit(0))).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).count() == 0


# Mixing ----------------------------------------------------------------------------------

def water_level(sizes: dict) -> dict:
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] >= 2 * sizes[s]}
        if not full:
            return target | share
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    return target


@pytest.mark.parametrize("odd", [True, False])
def test_mixing(spark, docs, odd):
    data = brute.odd_documents(spark) if odd else docs
    size_of = Counter()
    for r in data.collect():
        size_of[r.source] += len(brute.words(r.text))
    want = water_level(dict(size_of))
    found = mixing.mix(data).collect()
    taken = Counter()
    for r in found:
        assert r.source_size == size_of[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert len(found) == data.count()
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    mixed = Counter()
    rows = mixing.take(data).collect()
    for r in rows:
        mixed[r.source] += len(brute.words(r.text))
    assert {s: n for s, n in mixed.items() if n} == {s: n for s, n in taken.items() if n}
    again = mixing.mix(data.repartition(7)).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, again))
    assert mixing.mix(data.limit(0)).count() == 0


# Packing ---------------------------------------------------------------------------------

@pytest.mark.parametrize("odd", [True, False])
def test_packing_round_trip(spark, docs, odd):
    from tokenizers import Tokenizer

    data = (brute.odd_documents(spark) if odd else docs.filter("doc_id < 300")).repartition(2)
    reference = Tokenizer.from_file(packing.tokenizer_files()[0])
    pieces = packing.pack(data).collect()
    whole, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        whole[p.doc_id].append((p.start, p.length, p.ids_crc32, p.doc_tokens))
        sequences[p.sequence_id].append((p.offset, p.length))
    want = defaultdict(list)
    for r in data.collect():
        want[r.doc_id].append(reference.encode(r.text or "", add_special_tokens=False).ids + [0])
    assert set(whole) == set(want)
    for doc_id, copies in want.items():
        ids = np.array(copies[0], dtype="<u4")
        assert sum(n for _, n, _, _ in whole[doc_id]) == len(ids) * len(copies)
        for start, n, crc, total in whole[doc_id]:
            assert total == len(ids) and zlib.crc32(ids[start:start + n].tobytes()) == crc
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == 1024 or at & (at - 1) == 0  # no padding at all
    assert packing.pack(data.limit(0)).count() == 0


def test_closest_fill():
    for counts, room in (({700: 2, 300: 1, 20: 3}, 1000), ({5: 3, 3: 2}, 14), ({9: 1}, 4), ({600: 5}, 1024)):
        taken = packing.closest_fill(counts, room)
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1)}
        assert all(k <= counts[n] for n, k in taken.items())
        assert sum(n * k for n, k in taken.items()) == max(s for s in sums if s <= room)


# Pipeline --------------------------------------------------------------------------------

def test_pipeline_stages(spark, docs):
    data = docs
    for name, stage in corpus_pipeline.STAGES:
        before = data
        data = stage(spark, before, FOLDER)
        data.cache()
        if name != "packing":
            assert data.columns == docs.columns
        if name == "simhash":
            kept = [simhash_of(r.text) for r in data.collect()]
            assert len(set(linked(dict(enumerate(kept))).values())) == len(kept)
        if name == "pii":
            assert not any(brute.spans({"email": brute.PII["email"]}, r.text) for r in data.collect())
    # How many pieces there are depends on the splits; the tokens don't.
    tokens = [x.agg(F.sum("length")).first()[0] for x in (data, corpus_pipeline.run(spark, FOLDER))]
    assert tokens[0] == tokens[1] > 0
    odd = brute.odd_documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        for rows in (odd, odd.limit(0)):
            out = stage(spark, rows, FOLDER)
            assert name == "packing" or out.columns == odd.columns
            out.count()
