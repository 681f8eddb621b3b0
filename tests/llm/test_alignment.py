"""Token alignment against a plain merge of token ends."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import brute
from wosearch.llm import alignment


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return a, b


def byte_letters():
    """Letters of the byte-level alphabet and their bytes."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in own]
    return {**{chr(x): x for x in own}, **{chr(256 + i): x for i, x in enumerate(rest)}}


LETTERS = byte_letters()


def tokens(tokenizers, text):
    """(id, bytes) of both tokenizers, none where one doesn't give the text back."""
    a, b = tokenizers
    if not text:
        return [], []
    left = [(i, bytes(LETTERS[c] for c in a.id_to_token(i)))
            for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i)
              else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    want = (" " + text).encode()
    if b"".join(t for _, t in left) != want or b"".join(t for _, t in right) != want:
        return [], []
    return left, right


def ends(found):
    return np.cumsum([len(t) for _, t in found]).tolist()

def groups_of(left, right):
    """Groups between shared ends, by one merge."""
    a, b = ends(left), ends(right)
    out, i, j, n, m = [], 0, 0, 0, 0
    while n < len(a):
        if a[n] == b[m]:
            out.append(([t for t, _ in left[i:n + 1]], [t for t, _ in right[j:m + 1]]))
            n, m = n + 1, m + 1
            i, j = n, m
        elif a[n] < b[m]:
            n += 1
        else:
            m += 1
    return out

def expected(tokenizers, rows):
    docs = []
    for r in rows:
        left, right = tokens(tokenizers, r.text)
        docs.append((r.doc_id, len(left), len(right), groups_of(left, right)))
    linked = [Counter((x, y) for a, b in groups for x in a for y in b) for *_, groups in docs]
    held = Counter(pair for pairs in linked for pair in pairs)
    highest = defaultdict(int)
    for (x, _), n in held.items():
        highest[x] = max(highest[x], n)
    out = []
    for (doc_id, n_a, n_b, groups), pairs in zip(docs, linked):
        line = ";".join("|".join(",".join(map(str, side)) for side in group) for group in groups)
        out.append((
            doc_id, n_a, n_b, len(groups), sum(pairs.values()),
            sum(n for p, n in pairs.items() if held[p] == highest[p[0]]),
            sum(n * held[p] for p, n in pairs.items()),
            hashlib.sha256(line.encode()).hexdigest() if groups else "",
        ))
    return sorted(out, key=repr)

def got(docs):
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return sorted((tuple(r) for r in alignment.align(docs).select(*columns).collect()), key=repr)

def test_documents(spark, tokenizers):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert got(docs) == expected(tokenizers, docs.collect())

def test_small_parts(spark, tokenizers, monkeypatch):
    """Counts are those of the corpus, however documents are dealt to parts and tasks."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = expected(tokenizers, docs.collect())
    assert got(docs.repartition(7)) == want
    # Some rows come twice; each is a document.
    twice = docs.unionByName(docs.filter("doc_id % 5 = 0"))
    assert got(twice.repartition(3)) == expected(tokenizers, twice.collect())

TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a\tb\n\nc", "\n", "▁", "x ▁y", "<|endoftext|> <s></s> <0x41>",
    "東京特許許可局 は 東京", "é é ﬁ 😀😀 👩‍👩", "1234567 89 $%^", "x" * 5000, " " * 3000, "ab cd 　e f g",
    "naïve café — “quoted”", "\x00\x01 \x7f", "ɐ" * 700 + " word", "tab\t\t\tx \r\n y", "same text", "same text",
]

def test_odd_texts(spark, tokenizers):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, "repeated id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({
        "pair": F.lit(1), "part": F.lit("x"), "times": F.lit(None).cast("int"),
    })
    assert got(docs) == expected(tokenizers, docs.collect())
    assert got(docs.limit(0)) == []
    odd = brute.odd_documents(spark)
    assert got(odd) == expected(tokenizers, odd.collect())

def test_large_groups_give_each_pair_once(spark, tokenizers, monkeypatch):
    import pyarrow as pa

    a, b = alignment.encoders(*alignment.tokenizer_files())
    texts = pa.array([t or "" for t in TEXTS], pa.large_string())

    def summed():
        doc, pair, times = alignment.Aligned(texts, a, b).links()
        out = Counter()
        for d, p, n in zip(doc.tolist(), pair.tolist(), times.tolist()):
            out[d, p] += n
        return out

    want = summed()
    monkeypatch.setattr(alignment, "MOST_LINKS", 1)
    assert summed() == want

@pytest.mark.parametrize("seed", range(30))
def test_divide_finds_all_common_ends(seed):
    """Random ends of several texts, with long stretches without a common one."""
    rng = np.random.default_rng(seed)
    a, b, borders, at = [], [], [0], 0
    for _ in range(rng.integers(1, 6)):
        size = int(rng.integers(1, 400))
        for ends_, share in ((a, rng.random()), (b, rng.random() ** 3)):
            inner = at + 1 + np.flatnonzero(rng.random(size - 1) < share)
            ends_.extend(inner.tolist() + [at + size])
        at += size
        borders.append(len(a))
        if rng.random() < 0.3:
            borders.append(len(a))  # a text without tokens
    a, b = np.array(a), np.array(b)
    found = alignment.divide(a, b, np.array(borders))
    assert a[found].tolist() == sorted(set(a.tolist()) & set(b.tolist()))
