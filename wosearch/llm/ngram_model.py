"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

Counting. Tasks turn parts of the documents into 64-bit hashes of words and word pairs and send
them on by hash range with their counts in the part's training documents. A range's task adds
these up, so it knows the exact count of its words, and fills a segment of the filter. No word
or document is ever gathered in one place, however frequent.

Filter. An n-gram with count c enters as (n-gram, 1) to (n-gram, q), where q grows with the
logarithm of c. Probing 1, 2, ... until one is missing gives back q, and so the order of
magnitude of c. Every word and pair enters: a segment grows with what it holds.

Up to ``BROADCAST_TEXT`` of text and ``BROADCAST_BYTES`` of filter, the segments travel to all
tasks, and a range returns each document's share of the base score. Beyond that a segment never
leaves its task: it is probed once for each distinct n-gram of the range, and the parts get the
levels of what they sent and the exact counts of their words. The parts, compressed, are written
once; they are all that is shuffled of the texts, and they meet the answers by their number. Both
ways fill and probe the same segments.

Score. P(w | v) = WEIGHT * c(v w) / c(v) + (1 - WEIGHT) * (c(w) + 0.1) / (N + 0.1 (V + 1)), with
all counts but N and V from the filter. Sentences are whole texts between a start and an end.

Defined results
* a null or empty text is one token, the end;
* without training documents no token is known: the base probability is 1 (N = V = 0), and so is
  the model's unigram part;
* a null id is never held out; repeated rows count as often as they occur;
* texts of any length are read whole; an empty table gives an empty result;
* only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wosearch.llm.common import is_held_out, parts, text_volume
from wosearch.session import materialise

FOLDS = 10
PRIOR = 0.1
WEIGHT = 0.2
FILTER_BYTES = 64 << 20  # least size of the filter
BROADCAST_BYTES = 80 << 20  # largest filter that travels to all tasks
BROADCAST_TEXT = 64 << 20  # most text for which that is tried
PROBES = 4
BITS_EACH = 6  # least bits per entry of a segment
BASE = 1.5  # ratio of two levels of counts
BATCH_BYTES = 3 << 20  # of text counted at once
SCORE_BYTES = 3 << 20  # of text scored at once
RANGE_BYTES = 8 << 20
LEAST_BITS = 6  # 64 ranges at least, so that no segment is large

END = np.uint64(0x5851F42D4C957F2D)
START = np.uint64(0x14057B7EF767814F)
_A, _B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True

COUNTED = "kind int, part long, number int, a binary, b binary, c binary, d binary"
_SENT = pa.schema([
    ("kind", pa.int32()), ("range", pa.int32()), ("part", pa.int64()), ("a", pa.binary()),
    ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary()),
])
SENT = "kind int, range int, part long, a binary, b binary, c binary, d binary"
# Kinds of rows.
DOCS, WORDS, PAIRS, SHARES, SEGMENT, TOTALS = range(6)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(33)) * _A
    x = (x ^ x >> np.uint64(33)) * _B
    return x ^ x >> np.uint64(33)


def tokenize(texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, one after another, each text's end included, and their text.

    bytes.lower() changes A-Z alone.
    """
    raw = [t.encode() for t in texts]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    buffer = np.frombuffer(b" ".join(raw).lower() + b" " * 9, dtype=np.uint8)
    space = _SPACE[buffer]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edges = np.concatenate(([0], edges))
    starts, ends = edges[::2], edges[1::2]
    lengths = ends - starts
    window = np.ndarray((len(buffer) - 7,), dtype="<u8", buffer=buffer, strides=(1,))
    hashes = mix(lengths.astype(np.uint64) + _B)
    left, at = np.arange(len(starts)), 0
    while len(left):  # eight bytes of each word at a time
        rest = lengths[left] - at
        piece = window[starts[left] + at] & _MASKS[np.minimum(rest, 8)]
        hashes[left] = mix(hashes[left] * _A ^ piece)
        left, at = left[rest > 8], at + 8
    texts_start = np.concatenate(([0], np.cumsum(sizes + 1)))[:len(raw)]
    owner = np.searchsorted(texts_start, starts, side="right") - 1
    all_owners = np.concatenate((owner, np.arange(len(raw))))
    order = np.argsort(all_owners, kind="stable")
    return np.concatenate((hashes, np.full(len(raw), END)))[order], all_owners[order]


def pairs_of(tokens: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """History of each token, and the hash of history and token: 48 bits, the last 16 are 0."""
    history = np.concatenate(([START], tokens[:-1]))[:len(tokens)]
    history[np.flatnonzero(np.diff(owner, prepend=-1))] = START
    return history, mix(history * _B ^ tokens) & ~np.uint64(0xFFFF)


def short_bytes(pairs: np.ndarray) -> bytes:
    """Six bytes for each hash of a pair."""
    return pairs.astype("<u8").view("<u2").reshape(-1, 4)[:, 1:].tobytes()


def from_short(data: bytes) -> np.ndarray:
    parts_ = np.frombuffer(data, "<u2").reshape(-1, 3)
    out = np.zeros((len(parts_), 4), dtype="<u2")
    out[:, 1:] = parts_
    return out.reshape(-1).view("<u8")


def _ranges(sorted_hashes: np.ndarray, bits: int) -> np.ndarray:
    """Borders of the hash ranges in sorted hashes."""
    tops = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else []
    return np.concatenate(([0], np.searchsorted(sorted_hashes, tops), [len(sorted_hashes)]))


def _send_task(batches: Iterable[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId() << 32
    for doc_ids, texts, held, text_hashes in parts(batches, BATCH_BYTES):
        held_out = held.to_numpy(zero_copy_only=False)
        tokens, owner = tokenize(texts.to_pylist())
        n_tokens = np.bincount(owner, minlength=len(held_out))
        rows = [(
            DOCS, part % (1 << bits), part,
            pc.fill_null(doc_ids, -1).to_numpy().tobytes(), text_hashes.to_numpy().tobytes(),
            n_tokens.astype(np.int64).tobytes(),
            pc.is_null(doc_ids).to_numpy(zero_copy_only=False).tobytes(),
        )]
        # Words: distinct (word, document), sorted by word; counts of held-out ones negative.
        order = np.argsort(tokens, kind="stable")
        word, doc = tokens[order], owner[order]
        new = np.flatnonzero(np.concatenate(([True], (word[1:] != word[:-1]) | (doc[1:] != doc[:-1]))))
        count = np.diff(np.append(new, len(word))).astype(np.int32)
        word, doc = word[new], doc[new].astype(np.uint16)
        count[held_out[doc]] *= -1
        own = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        distinct, per = word[own], np.diff(np.append(own, len(word))).astype(np.uint16)
        cuts = _ranges(distinct, bits)
        inner = np.append(own, len(word))[cuts]
        rows += [
            (WORDS, r, part, distinct[s:e].tobytes(), per[s:e].tobytes(), doc[a:b].tobytes(),
             count[a:b].tobytes())
            for r, (s, e, a, b) in enumerate(zip(cuts, cuts[1:], inner, inner[1:])) if e > s
        ]
        _, pair = pairs_of(tokens, owner)
        pair = np.sort(pair[~held_out[owner]])
        new = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1]))[:len(pair)])
        count = np.diff(np.append(new, len(pair))).astype(np.uint32)
        pair = pair[new]
        cuts = _ranges(pair, bits)
        rows += [
            (PAIRS, r, part, short_bytes(pair[s:e]), count[s:e].tobytes(), b"", b"")
            for r, (s, e) in enumerate(zip(cuts, cuts[1:])) if e > s
        ]
        part += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, type=f.type) for c, f in zip(zip(*rows), _SENT)], schema=_SENT
        )


def _summed(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes and the sums of their counts."""
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    distinct, place = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, place, np.concatenate(counts).astype(np.int64))
    return distinct, total


def levels(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / math.log(BASE) + 1e-9).astype(np.int64)


def _positions(hashes: np.ndarray, level: np.ndarray | int, segment_bits: int) -> Iterator:
    h = mix(hashes + np.asarray(level).astype(np.uint64) * END)
    step = (h >> np.uint64(32)) | np.uint64(1)
    for i in range(PROBES):
        yield (h + np.uint64(i) * step) % np.uint64(segment_bits)


def segment(words, word_counts, pairs, pair_counts, least_bytes: int) -> np.ndarray:
    """A segment of the filter with all words and pairs, as large as BITS_EACH asks for."""
    seen = word_counts > 0
    hashes = np.append(words[seen], pairs)
    level = np.append(levels(word_counts[seen]), levels(pair_counts))
    out = np.zeros(max(least_bytes, math.ceil(int(level.sum()) * BITS_EACH / 8)), dtype=np.uint8)
    step = 1
    while len(hashes):
        for at in _positions(hashes, step, 8 * len(out)):
            np.bitwise_or.at(out, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        step += 1
        more = level >= step
        hashes, level = hashes[more], level[more]
    return out


def _payloads(table: pa.Table) -> Iterator[tuple]:
    """kind, part and the four payloads of each row, not copied."""
    for batch in table.to_batches():
        kinds, owners = batch.column("kind").to_pylist(), batch.column("part").to_pylist()
        columns = [batch.column(name) for name in "abcd"]
        for i, (kind, part) in enumerate(zip(kinds, owners)):
            yield kind, part, *(column[i].as_buffer() for column in columns)


def _range_task(key: tuple, table: pa.Table, segment_bytes: int) -> pa.Table:
    """Adds up one range of hashes; passes on the rows about documents."""
    number = key[0].as_py()
    words, pairs, pair_counts, out = [], [], [], []
    for kind, part, a, b, c, d in _payloads(table):
        if kind == DOCS:
            out.append((DOCS, part, number, *(x.to_pybytes() for x in (a, b, c, d))))
        elif kind == WORDS:
            words.append((
                part, np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint16),
                np.frombuffer(c, np.uint16), np.frombuffer(d, np.int32),
            ))
        else:
            pairs.append(from_short(a))
            pair_counts.append(np.frombuffer(b, np.uint32))
    learned = [
        np.add.reduceat(np.maximum(count, 0).astype(np.int64), np.cumsum(per.astype(np.int64)) - per)
        for _, _, per, _, count in words
    ]
    distinct, total = _summed([w for _, w, _, _, _ in words], learned)
    for part, word, per, doc, count in words:
        c = np.repeat(total[np.searchsorted(distinct, word)], per)
        n = np.abs(count)
        most = int(doc.max()) + 1
        share = np.bincount(doc, n * np.log10(c + PRIOR), most)
        known = np.bincount(doc, n * (c > 0), most).astype(np.int64)
        present = np.unique(doc)
        out.append((SHARES, part, number, present.tobytes(), share[present].tobytes(),
                    known[present].tobytes(), b""))
    bits = segment(distinct, total, *_summed(pairs, pair_counts), segment_bytes)
    out.append((TOTALS, -1, number, np.array(
        [total.sum(), (total > 0).sum(), len(bits)], np.int64).tobytes(), b"", b"", b""))
    out.append((SEGMENT, -1, number, bits.tobytes(), b"", b"", b""))
    types = (pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4)
    names = ["kind", "part", "number", "a", "b", "c", "d"]
    pa.default_memory_pool().release_unused()
    return pa.Table.from_arrays(
        [pa.array(c, type=t) for c, t in zip(zip(*out), types)], names=names
    )


def _share_task(table: pa.Table) -> pa.Table:
    """Adds up the documents' shares of one part."""
    rows = table.to_pylist()
    docs = next(row for row in rows if row["kind"] == DOCS)
    n_tokens = np.frombuffer(docs["c"], np.int64)
    base, known = np.zeros(len(n_tokens)), np.zeros(len(n_tokens), np.int64)
    for row in sorted((r for r in rows if r["kind"] == SHARES), key=lambda r: r["number"]):
        doc = np.frombuffer(row["a"], np.uint16)
        base[doc] += np.frombuffer(row["b"], np.float64)
        known[doc] += np.frombuffer(row["c"], np.int64)
    null = np.frombuffer(docs["d"], bool)
    return pa.Table.from_arrays([
        pa.array(np.frombuffer(docs["a"], np.int64), mask=null),
        pa.array(np.frombuffer(docs["b"], np.int64)),
        pa.array(n_tokens), pa.array(known), pa.array(base),
    ], names=["doc_id", "text_hash", "n_tokens", "n_known", "share"])


def probe(hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Levels of hashes in a segment, 0 for what isn't there."""
    out = np.zeros(len(hashes), dtype=np.uint8)
    left, level = np.arange(len(hashes)), 1
    while len(left) and level < 256:
        there = np.arange(len(left))
        for at in _positions(hashes[left], level, 8 * len(table)):
            at = at[there]
            bit = table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1
            there = there[bit == 1]
        left = left[there]
        out[left] = level
        level += 1
    return out


# Estimated count of each level.
_COUNT_OF = np.array([0.0, 1.0, *(BASE ** (level - 0.5) for level in range(2, 256))])


class Filter:
    """Counts by repeated probes; the top bits of a hash tell the segment."""

    def __init__(self, segments: list[np.ndarray]):
        self.segments = segments
        self.bits = len(segments).bit_length() - 1

    def counts(self, hashes: np.ndarray) -> np.ndarray:
        """Estimated counts of sorted hashes, 0 for what isn't there."""
        out = np.zeros(len(hashes))
        cuts = _ranges(hashes, self.bits)
        for table, start, end in zip(self.segments, cuts, cuts[1:]):
            if end > start:
                out[start:end] = _COUNT_OF[probe(hashes[start:end], table)]
        return out


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Distinct words and pairs, sorted, and of each token its text, places and whether it is first."""
    tokens, owner = tokenize(texts)
    history, pair = pairs_of(tokens, owner)
    words, word_at = np.unique(tokens, return_inverse=True)
    pairs, pair_at = np.unique(pair, return_inverse=True)
    return words, pairs, (owner, history == START, word_at, pair_at)


def _log_scores(
    places: tuple, of_word: np.ndarray, of_pair: np.ndarray, n_texts: int, total: tuple, weight: float
) -> np.ndarray:
    n, v, n_docs = total
    owner, first, word_at, pair_at = places
    of_pair = of_pair[pair_at]
    before = np.concatenate(([0], word_at[:-1]))[:len(owner)]
    of_history = np.where(first, float(n_docs), of_word[before])
    continued = np.divide(
        np.minimum(of_pair, of_history), of_history,
        out=np.zeros(len(owner)), where=of_history > 0,
    )
    alone = (of_word[word_at] + PRIOR) / (n + PRIOR * (v + 1))
    logs = np.log10(weight * continued + (1 - weight) * alone)
    return np.bincount(owner, logs, n_texts)


SCORED = "doc_id long, text_hash long, score double"


def _score_task(
    batches: Iterable[pa.RecordBatch], shared: Broadcast, total: tuple, weight: float
) -> Iterator[pa.RecordBatch]:
    known = Filter(shared.value)
    for doc_ids, texts, _, text_hashes in parts(batches, SCORE_BYTES):
        words, pairs, places = _grams(texts.to_pylist())
        score = _log_scores(
            places, known.counts(words), known.counts(pairs), len(texts), total, weight
        )
        yield pa.RecordBatch.from_arrays(
            [doc_ids, text_hashes, pa.array(score)], names=["doc_id", "text_hash", "score"]
        )


# Large inputs: parts are packed and written, send their n-grams to the ranges, and meet the answers.
PARTS = "part long, packed binary"
GRAMS = "number int, part long, words binary, of_word binary, pairs binary, of_pair binary"
ANSWERS = "part long, number int, n long, v long, counts binary, words binary, pairs binary"
FOUND = "doc_id long, held_out boolean, n_tokens long, n_known long, share double, score double"
# A reader's batch is a whole row group of these large rows, so row groups are small.
PACKED = {"parquet.block.size": 4 << 20, "parquet.page.size.row.check.min": 1}
PROBED = 1 << 18  # hashes that are probed at once


def _pack_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of the documents, each one compressed value."""
    part = TaskContext.get().partitionId() << 32
    for doc_ids, texts, held, _ in parts(batches, BATCH_BYTES):
        whole = pa.RecordBatch.from_arrays([doc_ids, texts, held], names=["doc_id", "text", "held_out"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(
            sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")
        ) as out:
            out.write_batch(whole)
        yield pa.RecordBatch.from_arrays(
            [pa.array([part]), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
            names=["part", "packed"],
        )
        part += 1


def _unpacked(packed: pa.Scalar) -> tuple[pa.Array, list[str], np.ndarray]:
    whole = pa.ipc.open_stream(packed.as_buffer()).read_next_batch()
    held_out = whole.column(2).to_numpy(zero_copy_only=False)
    return whole.column(0), whole.column(1).to_pylist(), held_out


def _grams_task(batches: Iterable[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Of each part and range the distinct words and pairs, with their counts in training documents."""
    for batch in batches:
        for part, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
            _, texts, held_out = _unpacked(packed)
            tokens, owner = tokenize(texts)
            learned = ~held_out[owner]
            _, pair = pairs_of(tokens, owner)
            del texts
            sent = []
            for hashes in (tokens, pair):
                order = np.argsort(hashes)
                hashes = hashes[order]
                new = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
                count = np.add.reduceat(learned[order].astype(np.uint32), new, dtype=np.uint32)
                sent += [hashes[new], count]
            words, of_word, pairs, of_pair = sent
            at, also = _ranges(words, bits), _ranges(pairs, bits)
            rows = [
                (r, part, words[s:e].tobytes(), of_word[s:e].tobytes(), short_bytes(pairs[a:b]),
                 of_pair[a:b].tobytes())
                for r, (s, e, a, b) in enumerate(zip(at, at[1:], also, also[1:])) if e > s or b > a
            ]
            yield pa.RecordBatch.from_arrays([
                pa.array(c, type=t)
                for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), *[pa.binary()] * 4))
            ], names=["number", "part", "words", "of_word", "pairs", "of_pair"])
    pa.default_memory_pool().release_unused()


def _added(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, the sums of their counts, and the place of every hash among them."""
    every = np.concatenate(hashes)
    order = np.argsort(every)
    every = every[order]
    new = np.concatenate(([True], every[1:] != every[:-1]))[:len(every)]
    place = np.empty(len(every), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    distinct = every[new]
    # Sums of integers below 2^53 are exact.
    total = np.bincount(place, np.concatenate(counts), len(distinct)).astype(np.int64)
    return distinct, total, place


def _probed(hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
    out = np.empty(len(hashes), dtype=np.uint8)
    for at in range(0, len(hashes), PROBED):
        out[at:at + PROBED] = probe(hashes[at:at + PROBED], table)
    return out


def _answer_task(key: tuple, table: pa.Table, segment_bytes: int) -> pa.Table:
    """Adds up one range, fills its segment and probes it once for each of the range's n-grams.

    Every part gets, of what it sent, the exact counts of its words and the levels of words and pairs.
    """
    number, owners = key[0].as_py(), table.column("part").to_pylist()

    def column(name: str, read) -> list[np.ndarray]:
        return [read(x.as_buffer()) for x in table.column(name)]

    def of(kind) -> Callable:
        return lambda data: np.frombuffer(data, kind)

    words, of_word = column("words", of(np.uint64)), column("of_word", of(np.uint32))
    pairs, of_pair = column("pairs", from_short), column("of_pair", of(np.uint32))
    word_ends, pair_ends = (np.cumsum([0, *map(len, x)]) for x in (words, pairs))
    words, of_word, word_at = _added(words, of_word)
    pairs, of_pair, pair_at = _added(pairs, of_pair)
    seen = of_pair > 0
    bits = segment(words, of_word, pairs[seen], of_pair[seen], segment_bytes)
    word_level, pair_level = _probed(words, bits), _probed(pairs, bits)
    rows = [(-1, number, int(of_word.sum()), int((of_word > 0).sum()), b"", b"", b"")]
    for part, s, e, a, b in zip(owners, word_ends, word_ends[1:], pair_ends, pair_ends[1:]):
        mine = word_at[s:e]
        rows.append((part, number, 0, 0, of_word[mine].tobytes(), word_level[mine].tobytes(),
                     pair_level[pair_at[a:b]].tobytes()))
    pa.default_memory_pool().release_unused()
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 3)
    names = ["part", "number", "n", "v", "counts", "words", "pairs"]
    return pa.Table.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names=names)


def _answered_task(written: pa.Table, answers: pa.Table, total: tuple, weight: float) -> pa.Table:
    """Results of the documents of one part."""
    answers = answers.sort_by("number")
    counts, of_word, of_pair = (
        np.frombuffer(b"".join(answers.column(name).to_pylist()), kind)
        for name, kind in (("counts", np.int64), ("words", np.uint8), ("pairs", np.uint8))
    )
    doc_ids, texts, held_out = _unpacked(written.column("packed")[0])
    _, _, places = _grams(texts)
    owner, _, word_at, _ = places
    score = _log_scores(places, _COUNT_OF[of_word], _COUNT_OF[of_pair], len(texts), total, weight)
    n_known = np.bincount(owner, (counts > 0)[word_at], len(texts)).astype(np.int64)
    share = np.bincount(owner, np.log10(counts + PRIOR)[word_at], len(texts))
    return pa.Table.from_arrays(
        [doc_ids, pa.array(held_out), pa.array(np.bincount(owner, minlength=len(texts))),
         pa.array(n_known), pa.array(share), pa.array(score)],
        names=["doc_id", "held_out", "n_tokens", "n_known", "share", "score"],
    )


def _score_by_range(
    rows: DataFrame, bits: int, segment_bytes: int, n_docs: int, weight: float
) -> DataFrame:
    """What ``score`` returns, with segments that stay in the tasks that fill them."""
    written = materialise(rows.mapInArrow(_pack_task, PARTS), "ngram-parts", **PACKED)
    answers = materialise(
        written.mapInArrow(lambda b: _grams_task(b, bits), GRAMS).groupBy("number").applyInArrow(
            lambda key, b: _answer_task(key, b, segment_bytes), ANSWERS
        ), "ngram-answers",
    )
    n, v = (x or 0 for x in answers.agg(F.sum("n"), F.sum("v")).first())
    found = written.groupBy("part").cogroup(answers.filter("part >= 0").groupBy("part")).applyInArrow(
        lambda left, right: _answered_task(left, right, (n, v, n_docs), weight), FOUND
    )
    return _presented(found, n, v)


def _presented(found: DataFrame, n: int, v: int) -> DataFrame:
    norm = math.log10(n + PRIOR * (v + 1))
    return found.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
        (F.col("share") - F.col("n_tokens") * norm).alias("base_score"), "score",
    )


def score(
    docs: DataFrame, weight: float = WEIGHT, filter_bytes: int = FILTER_BYTES,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text"),
        is_held_out(F.col("doc_id"), FOLDS).alias("held_out"),
        F.xxhash64("text").alias("text_hash"),
    )
    _, volume = text_volume(rows, "text")
    bits = max(LEAST_BITS, math.ceil(math.log2(max(volume, 1) / RANGE_BYTES)))
    segment_bytes = max(1, filter_bytes >> bits)
    n_docs = docs.select(is_held_out(F.col("doc_id"), FOLDS).alias("h")).filter("not h").count()
    if volume > BROADCAST_TEXT or filter_bytes > broadcast_bytes:
        return _score_by_range(rows, bits, segment_bytes, n_docs, weight)
    sent = rows.mapInArrow(lambda b: _send_task(b, bits), SENT)
    counted = materialise(
        sent.groupBy("range").applyInArrow(
            lambda key, b: _range_task(key, b, segment_bytes), COUNTED
        ), "ngram-counts",
    )
    totals = [np.frombuffer(r["a"], np.int64) for r in counted.filter(f"kind = {TOTALS}").collect()]
    n, v, stored = (int(x) for x in np.sum(totals, axis=0)) if totals else (0, 0, 0)
    if stored > broadcast_bytes:
        return _score_by_range(rows, bits, segment_bytes, n_docs, weight)

    total = (n, v, n_docs)
    tables = [np.zeros(1, dtype=np.uint8)] * (1 << bits)
    for row in counted.filter(f"kind = {SEGMENT}").select("number", "a").toLocalIterator():
        tables[row["number"]] = np.frombuffer(row["a"], np.uint8)
    shared = spark.sparkContext.broadcast(tables)
    scores = rows.mapInArrow(lambda b: _score_task(b, shared, total, weight), SCORED)

    # Repeated rows have the same results, so one of their shares stands for all.
    shares = counted.filter(f"kind in ({DOCS}, {SHARES})").groupBy("part").applyInArrow(
        _share_task, "doc_id long, text_hash long, n_tokens long, n_known long, share double"
    ).groupBy("doc_id", "text_hash").agg(
        F.first("n_tokens").alias("n_tokens"), F.first("n_known").alias("n_known"),
        F.first("share").alias("share"),
    ).withColumnsRenamed({"doc_id": "share_id", "text_hash": "share_hash"})
    joined = scores.join(
        shares,
        F.col("doc_id").eqNullSafe(F.col("share_id")) & (F.col("text_hash") == F.col("share_hash")),
    ).withColumn("held_out", is_held_out(F.col("doc_id"), FOLDS))
    return _presented(joined, n, v)
