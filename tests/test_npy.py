"""Vector files and the text files that belong to them."""

import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from wosearch.sources import npy


def rows_of(df):
    return sorted((r.position, r.embedding) for r in df.collect())


def as_rows(*blocks):
    return list(enumerate(np.concatenate(blocks).astype(np.float32).tolist()))


@pytest.mark.parametrize("dtype", ["<f4", ">f4", "<f8", "<f2", "<i4", "|u1"])
@pytest.mark.parametrize("version", [(1, 0), (2, 0), (3, 0)])
def test_types_and_versions(spark, tmp_path, dtype, version):
    block = np.arange(60).reshape(12, 5).astype(dtype)
    with open(tmp_path / "a.npy", "wb") as f:
        np.lib.format.write_array(f, block, version=version)
    # 7 rows of the widest type do not fill a split: ranges end inside the file.
    found = npy.read_vectors(spark, str(tmp_path / "a.npy"), split_bytes=100)
    assert found.rdd.getNumPartitions() == -(-12 // max(1, 100 // block[0].nbytes))
    assert rows_of(found) == as_rows(block)


def test_shards_in_order_of_names(spark, tmp_path):
    rng = np.random.default_rng(1)
    blocks = [rng.normal(size=(n, 3)).astype("<f4") for n in (4, 0, 9, 1)]
    for name, block in zip(("a", "b", "b-1/x", "c"), blocks):
        os.makedirs(os.path.dirname(tmp_path / f"{name}.npy"), exist_ok=True)
        np.save(tmp_path / f"{name}.npy", block)
    os.makedirs(tmp_path / "_writing-1")
    np.save(tmp_path / "_writing-1/z.npy", blocks[0])
    (tmp_path / "notes.txt").write_text("no vectors")
    order = sorted(("a.npy", "b.npy", "b-1/x.npy", "c.npy"))
    named = dict(zip(("a.npy", "b.npy", "b-1/x.npy", "c.npy"), blocks))
    found = npy.read_vectors(spark, f"file://{tmp_path}", split_bytes=24)
    assert rows_of(found) == as_rows(*(named[n] for n in order))


def test_large_batches(spark, tmp_path, monkeypatch):
    block = np.arange(3000, dtype="<f4").reshape(1000, 3)
    np.save(tmp_path / "a.npy", block)
    monkeypatch.setattr(npy, "BATCH_BYTES", 100)
    assert rows_of(npy.read_vectors(spark, str(tmp_path))) == as_rows(block)


@pytest.mark.parametrize("damage", ["magic", "short", "flat", "columns", "text", "widths", "absent"])
def test_unusable_files_fail(spark, tmp_path, damage):
    block = np.arange(12, dtype="<f4").reshape(4, 3)
    file = tmp_path / "a.npy"
    np.save(file, {"flat": block.ravel(), "columns": np.asfortranarray(block),
                   "text": np.array([["a", "b"]])}.get(damage, block))
    if damage == "magic":
        file.write_bytes(b"PK" + file.read_bytes()[2:])
    if damage == "short":
        file.write_bytes(file.read_bytes()[:-1])
    if damage == "widths":
        np.save(tmp_path / "b.npy", block[:, :2])
    path = str(tmp_path / "none") if damage == "absent" else str(tmp_path)
    with pytest.raises(Exception):
        npy.read_vectors(spark, path).collect()


def test_empty_folder_and_no_rows(spark, tmp_path):
    assert npy.read_vectors(spark, str(tmp_path)).count() == 0
    np.save(tmp_path / "a.npy", np.zeros((0, 4), "<f4"))
    assert npy.read_vectors(spark, str(tmp_path)).count() == 0


def vectors(spark, n, dim=6):
    cells = F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: (F.col("id") * 10 + i).cast("float"))
    return spark.range(n).select("id", cells.alias("v"), F.concat(F.lit('a "quoted"\ntext, '), "id").alias("t"))


def test_written_shards(spark, tmp_path):
    path = str(tmp_path / "out")
    npy.write_vectors(vectors(spark, 500).repartition(7), "v", path, "id", shard_bytes=300)
    files = sorted(glob.glob(f"{path}/**", recursive=True))
    assert len(files) > 20 and all(f.endswith(".npy") for f in files[1:])
    # NumPy reads the shards, in the order of their names.
    whole = np.concatenate([np.load(f) for f in files[1:]])
    assert whole[:, 0].tolist() == [10 * i + 1 for i in range(500)] and whole.shape == (500, 6)
    assert rows_of(npy.read_vectors(spark, path)) == as_rows(whole)
    with pytest.raises(Exception):
        npy.write_vectors(vectors(spark, 5), "v", path, "id")


def test_failed_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "bad")
    uneven = vectors(spark, 50).withColumn("v", F.when(F.col("id") == 33, F.array(F.lit(1.0))).otherwise(F.col("v")))
    with pytest.raises(Exception):
        npy.write_vectors(uneven, "v", path, "id")
    assert glob.glob(f"{path}/*") == []


def test_pairs_by_position(spark, tmp_path):
    rows = vectors(spark, 300)
    npy.write_vectors(rows.repartition(5), "v", str(tmp_path / "v"), "id", shard_bytes=1000)
    npy.write_texts(rows.repartition(3), "t", str(tmp_path / "t"), "id")
    got = npy.read_pairs(spark, str(tmp_path / "v"), str(tmp_path / "t")).orderBy("position").collect()
    want = rows.orderBy("id").collect()
    assert [(r.position, r.text, r.embedding) for r in got] == [(w.id, w.t, w.v) for w in want]


@pytest.mark.parametrize("n_texts", [299, 301])
def test_pairs_of_different_length_fail(spark, tmp_path, n_texts):
    npy.write_vectors(vectors(spark, 300), "v", str(tmp_path / "v"), "id")
    npy.write_texts(vectors(spark, n_texts), "t", str(tmp_path / "t"), "id")
    with pytest.raises(Exception, match="differ in number"):
        npy.read_pairs(spark, str(tmp_path / "v"), str(tmp_path / "t")).collect()
