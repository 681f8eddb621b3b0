"""The content-addressed archive against plain dictionaries and a plain WARC parser."""

import base64
import glob
import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from wosearch.llm import warc
from wosearch.session import new_path


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def expected(rows, least=0):
    """page_id, bytes, digest, type, refers_to of every row."""
    groups = defaultdict(list)
    for r in rows:
        groups[(r.html or "").encode()].append(r.page_id)
    out = Counter()
    for payload, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i or 0))
        shared = len(payload) >= least
        for k, i in enumerate(ids):
            kind, to = ("revisit", ids[0]) if shared and k else ("response", None)
            out[i, len(payload), digest(payload), kind, to] += 1
    return out


def parse(data):
    """Records of a WARC file: header fields in order and block."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split("\r\n")
        assert first == "WARC/1.1"
        fields = dict(line.split(": ", 1) for line in lines)
        start, size = end + 4, int(fields["Content-Length"])
        assert data[start + size:start + size + 4] == b"\r\n\r\n"
        yield fields, data[start:start + size]
        at = start + size + 4


ODD = [
    (1, "u", None), (2, None, ""), (3, "u\r\nX-Page-Id: 9", "<p>é😀\r\n\r\nWARC/1.1\r\n"), (None, "u", "one"),
    (3, "u", "two"), (3, "u", "two"), (9, "v", "two"), (-4, "w", "one"), (None, "u", "no id"), (None, "u", "no id"),
    (10, "x", "long " * 200000), (11, "y", "long " * 200000),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame(ODD, "page_id long, url string, html string")
    return rows.withColumns({"payload": F.lit(1), "row": F.lit("x"), "header": F.lit(None)})


def tuples(df):
    return Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect())


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    # Copies under other ids, some smaller than the originals.
    copies = pages.filter("page_id % 3 = 0").withColumn("page_id", F.col("page_id") * 7 - 40)
    both = pages.unionByName(copies)
    assert tuples(warc.archive(both)) == expected(both.collect())


@pytest.mark.parametrize("least", [0, 3, 10**7])
def test_odd_pages(spark, odd, least):
    path = new_path(spark, "odd-warc")
    warc.write(odd, path, least)
    assert tuples(warc.digests(spark, path)) == expected(odd.collect(), least)
    assert warc.payloads(spark, path).count() == len({r.html or "" for r in odd.collect()})


def test_records_come_back(spark, odd):
    path = new_path(spark, "whole-warc")
    warc.write(odd, path)
    got = Counter((r.page_id, bytes(r.payload)) for r in warc.records(spark, path).collect())
    assert got == Counter((r.page_id, (r.html or "").encode()) for r in odd.collect())


def test_exported_files(spark, odd):
    path, out = new_path(spark, "export-warc"), new_path(spark, "files-warc")
    warc.write(odd, path)
    warc.export(spark, path, out)
    found = [r for f in glob.glob(f"{out}/part-*") for r in parse(open(f, "rb").read())]
    by_id = {f["WARC-Record-ID"]: (f, block) for f, block in found}
    assert len(by_id) == len(found) == len(ODD)
    whole = Counter()
    for fields, block in found:
        if fields["WARC-Type"] == "revisit":
            assert block == b"" and fields["WARC-Profile"] == warc.PROFILE
            response, block = by_id[fields["WARC-Refers-To"]]
            assert response["WARC-Type"] == "response"
            assert response["WARC-Payload-Digest"] == fields["WARC-Payload-Digest"]
        assert fields["WARC-Payload-Digest"] == "sha1:" + digest(block)
        page = fields.get("X-Page-Id")
        whole[page and int(page), block] += 1
    assert whole == Counter((i, (html or "").encode()) for i, _, html in ODD)


def test_damaged_payload_fails(spark, odd):
    path = new_path(spark, "damaged-warc")
    warc.write(odd, path)
    good = spark.read.parquet(f"{path}/payloads")
    bad = good.withColumn("payload", F.concat("payload", F.lit(b"!")))
    bad.write.parquet(f"{path}-bad/payloads")
    warc.headers(spark, path).write.parquet(f"{path}-bad/headers")
    with pytest.raises(Exception, match="doesn't match its digest"):
        warc.digests(spark, f"{path}-bad").collect()


def test_empty_table(spark, odd):
    assert warc.archive(odd.limit(0)).count() == 0
