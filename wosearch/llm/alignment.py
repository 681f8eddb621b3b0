"""Token alignment of two tokenizers: divide and conquer at shared cuts.

Both tokenizers split the same bytes. A byte offset where a token of each ends is a shared cut;
the shared cuts divide a text into groups of tokens that cover the same bytes.

1. Each task tokenizes its documents in parts of bounded size. Tokenizer A is a byte-level BPE
   over space + text, tokenizer B a sentence-piece BPE that adds the space itself.
2. An interval of tokens is divided at a common end near its middle: the end of A next to the
   middle is looked up by bisection among the ends of B, then ends further out are tried. Both
   halves are intervals again; one without a common end inside is a leaf, a group. The intervals
   of all documents of a part are divided in the same rounds.
3. All pairs of tokens of a group are links. A part's distinct id pairs, each with the number of
   its documents that hold it, are added up over the corpus; each part gets the sums of its own
   pairs back, and the highest sum of their A ids, and scores its documents with them.

A pair of ids that every document holds is one row of each part, so no sum is hot, and a part is
bounded by ``BATCH_BYTES`` of text (a longer text is a part of its own).

Defined results
* null and empty texts, and texts that a tokenizer doesn't give back byte by byte (with U+2581,
  say), have no tokens: counts of zero and an empty digest;
* strings of special tokens inside texts are plain text;
* repeated rows count as documents each; null ids are carried along; an empty table gives no rows;
* equal highest counts of an A id are all best;
* only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wosearch.llm.common import parts
from wosearch.session import materialise

BATCH_BYTES = 2 << 20
# Ends tried one by one in each round before an interval's rest is looked through at once.
PROBES = 6
# Part numbers: the task's partition above, a running number below.
TASK_BITS = 40
# Ids of B below this; a pair of ids is one number.
PAIR_BITS = 20
# Links of a group that are listed one by one.
MOST_LINKS = 1 << 12
# White space after a space would belong to the word's first token in some tokenizers.
_PLAIN_WORD = r"^[^\s\pZ\x1c-\x1f\x{85}\x{2581}]"


class Encoder:
    """Ids and token lengths of texts; lengths are in bytes of the text the ids stand for.

    ``whole`` encodes one text. Words after a space that don't begin with white space are encoded
    alone, once for all texts of a batch: neither vocabulary has a token that goes on over a
    space, so the ids of a text are those of its words, one after another.
    """

    def __init__(self, token_bytes: list[bytes]):
        self.bytes = pa.array(token_bytes, pa.large_binary())
        self.width = np.array([len(t) for t in token_bytes], dtype=np.int64)
        self.text = pa.array([str(i) for i in range(len(token_bytes))], pa.large_string())

    def whole(self, text: str) -> np.ndarray:
        raise NotImplementedError

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of space + word, one word after another, and how many each has."""
        raise NotImplementedError


class ByteLevel(Encoder):
    """The byte-level BPE, by its ranks: the bytes of an id are its entry, decoded."""

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding(
            "byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
        )
        table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        super().__init__(table)

    def whole(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(" " + text).astype(np.int64)

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self.encoding.encode_to_numpy(" " + " ".join(words)).astype(np.int64)
        ends = np.cumsum(self.width[ids])
        word_ends = np.cumsum(np.fromiter((len(w.encode()) + 1 for w in words), np.int64, len(words)))
        after = np.searchsorted(ends, word_ends) + 1
        return ids, np.diff(after, prepend=0)


class Pieces(Encoder):
    """The sentence-piece model; it puts a space before a text by itself."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)

        def token(i: int) -> bytes:
            if self.model.is_byte(i):
                return bytes([int(self.model.id_to_piece(i)[3:-1], 16)])
            return self.model.id_to_piece(i).replace("▁", " ").encode()

        super().__init__([token(i) for i in range(self.model.vocab_size())])

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text), dtype=np.int64)

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = self.model.encode(words, num_threads=1)
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = (i for one in lists for i in one)
        return np.fromiter(flat, np.int64, int(sizes.sum())), sizes


@lru_cache(maxsize=2)
def encoders(ranks_path: str, pattern: str, model_path: str) -> tuple[Encoder, Encoder]:
    return ByteLevel(ranks_path, pattern), Pieces(model_path)


class Words:
    """The texts of a batch as words after spaces; ``plain`` texts are put together from them."""

    def __init__(self, texts: pa.Array):
        lists = pc.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()
        self.codes, distinct = coded.indices.to_numpy(), coded.dictionary
        self.borders = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        good = pc.match_substring_regex(distinct, _PLAIN_WORD).to_numpy(zero_copy_only=False)
        self.distinct, self.good = distinct, good
        odd = np.concatenate([[0], np.cumsum(~good[self.codes])])
        self.plain = odd[self.borders[1:]] == odd[self.borders[:-1]]
        self.texts = texts

    def encode(self, encoder: Encoder) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after another, and how many each text has."""
        n_words = len(self.distinct)
        sizes, first = np.zeros(n_words, np.int64), np.zeros(n_words, np.int64)
        ids = np.zeros(0, np.int64)
        if self.good.any():
            ids, sizes[self.good] = encoder.words(self.distinct.filter(pa.array(self.good)).to_pylist())
            first[self.good] = np.cumsum(sizes[self.good]) - sizes[self.good]
        own = slice(self.borders[0], self.borders[-1])
        doc = np.repeat(np.arange(len(self.plain)), np.diff(self.borders))
        n = np.where(self.plain[doc], sizes[self.codes[own]], 0)
        shift = first[self.codes[own]] - (np.cumsum(n) - n)
        flat = ids[np.repeat(shift, n) + np.arange(n.sum())]
        counts = np.bincount(doc, n, len(self.plain)).astype(np.int64)
        odd = np.flatnonzero(~self.plain)
        whole = {i: encoder.whole(text) for i in odd.tolist() if (text := self.texts[i].as_py())}
        if not whole:
            return flat, counts
        for i, found in whole.items():
            counts[i] = len(found)
        out = np.zeros(counts.sum(), np.int64)
        out[np.repeat(self.plain, counts)] = flat
        ends = np.cumsum(counts)
        for i, found in whole.items():
            out[ends[i] - len(found):ends[i]] = found
        return out, counts


def divide(ends_a: np.ndarray, ends_b: np.ndarray, a_cuts: np.ndarray) -> np.ndarray:
    """Tokens of A that end at a cut, found by dividing intervals at common ends.

    ``ends_a`` and ``ends_b`` are ascending byte offsets. ``a_cuts`` are the borders of the first
    intervals as token numbers of A, ascending, the first 0 and the last the number of tokens.
    """
    is_cut = np.zeros(len(ends_a), dtype=bool)
    low, high = a_cuts[:-1], a_cuts[1:]
    is_cut[high[high > low] - 1] = True
    while True:
        # An interval of one token of A has no end inside.
        inner = high - low > 1
        low, high = low[inner], high[inner]
        if not len(low):
            return is_cut
        start = np.where(low > 0, ends_a[low - 1], 0)
        middle = np.searchsorted(ends_a, (start + ends_a[high - 1]) // 2)
        middle = np.clip(middle, low, high - 2)
        cut = np.full(len(low), -1, dtype=np.int64)
        open_ = np.arange(len(low))
        for probe in range(PROBES):
            away = (probe + 1) // 2 * (1 if probe % 2 else -1)
            at = middle[open_] + away
            inside = (at >= low[open_]) & (at <= high[open_] - 2)
            wanted = ends_a[np.where(inside, at, 0)]
            found = np.searchsorted(ends_b, wanted)
            hit = inside & (found < len(ends_b)) & (ends_b[np.minimum(found, len(ends_b) - 1)] == wanted)
            cut[open_[hit]] = at[hit]
            open_ = open_[~hit]
            if not len(open_):
                break
        # Ends on both sides, further out each time; short intervals have none left.
        long = open_[np.maximum(middle[open_] - low[open_], high[open_] - 2 - middle[open_]) > PROBES // 2 - 1]
        for i in long.tolist():
            cut[i] = _common_end(ends_a, ends_b, int(low[i]), int(high[i]) - 1, int(middle[i]))
        some = cut >= 0
        low, high, cut = low[some], high[some], cut[some]
        is_cut[cut] = True
        low, high = np.concatenate([low, cut + 1]), np.concatenate([cut + 1, high])


def _common_end(ends_a: np.ndarray, ends_b: np.ndarray, low: int, stop: int, middle: int) -> int:
    """The common end among ``low`` to ``stop`` (exclusive) next to ``middle``, -1 if none is.

    The stretch looked through doubles, so the work is in proportion to the distance.
    """
    reach = PROBES
    while True:
        a, b = max(low, middle - reach), min(stop, middle + reach + 1)
        block = ends_a[a:b]
        found = np.searchsorted(ends_b, block)
        hits = np.flatnonzero(ends_b[np.minimum(found, len(ends_b) - 1)] == block)
        if len(hits):
            return int(a + hits[np.abs(a + hits - middle).argmin()])
        if a == low and b == stop:
            return -1
        reach *= 2


class Aligned:
    """The groups of a batch of texts: per text, ranges of tokens of A and B."""

    def __init__(self, texts: pa.Array, a: Encoder, b: Encoder):
        words = Words(texts)
        ids_a, n_a = words.encode(a)
        ids_b, n_b = words.encode(b)
        ids_a, n_a, ids_b, n_b = _faithful(texts, a, b, ids_a, n_a, ids_b, n_b)
        self.a, self.b, self.n_a, self.n_b = ids_a, ids_b, n_a, n_b
        # All texts' bytes in one row: a text's last end is a common end.
        ends_a, ends_b = np.cumsum(a.width[ids_a]), np.cumsum(b.width[ids_b])
        is_cut = divide(ends_a, ends_b, np.concatenate([[0], np.cumsum(n_a)]))
        last_a = np.flatnonzero(is_cut)
        last_b = np.searchsorted(ends_b, ends_a[last_a])
        self.stop_a, self.stop_b = last_a + 1, last_b + 1
        self.size_a, self.size_b = np.diff(self.stop_a, prepend=0), np.diff(self.stop_b, prepend=0)
        doc_of_a = np.repeat(np.arange(len(n_a)), n_a)
        self.group_doc = doc_of_a[last_a]
        self.n_groups = np.bincount(self.group_doc, minlength=len(n_a))

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, id pair (as one number) and how often they are linked.

        A group with many links gives each of its pairs once, others give every link.
        """
        per_group = self.size_a * self.size_b
        large = per_group > MOST_LINKS
        per_group = np.where(large, 0, per_group)
        group = np.repeat(np.arange(len(per_group)), per_group)
        k = np.arange(len(group)) - np.repeat(np.cumsum(per_group) - per_group, per_group)
        row, column = np.divmod(k, self.size_b[group])
        a = self.a[(self.stop_a - self.size_a)[group] + row]
        b = self.b[(self.stop_b - self.size_b)[group] + column]
        docs, pairs, times = [self.group_doc[group]], [a << PAIR_BITS | b], [np.ones(len(a), np.int64)]
        for g in np.flatnonzero(large).tolist():
            a, n_a = np.unique(self.a[self.stop_a[g] - self.size_a[g]:self.stop_a[g]], return_counts=True)
            b, n_b = np.unique(self.b[self.stop_b[g] - self.size_b[g]:self.stop_b[g]], return_counts=True)
            pairs.append((a[:, None] << PAIR_BITS | b).ravel())
            times.append((n_a[:, None] * n_b).ravel())
            docs.append(np.full(len(a) * len(b), self.group_doc[g]))
        return np.concatenate(docs), np.concatenate(pairs), np.concatenate(times)

    def digests(self, a: Encoder, b: Encoder) -> list[str]:
        """SHA-256 of ``a1,a2|b1;a3|b2`` for each text, empty without tokens."""
        n_docs = len(self.n_a)
        # Groups in order, the tokens of A before those of B; a comma, bar or semicolon follows.
        shift = np.repeat(self.stop_b - self.size_b, self.size_a)
        place_a = np.arange(len(self.a)) + shift
        place_b = np.arange(len(self.b)) + np.repeat(self.stop_a, self.size_b)
        total = len(self.a) + len(self.b)
        ends = np.zeros(total, np.int64)
        ends[place_a[self.stop_a - 1]] = 1
        ends[place_b[self.stop_b - 1]] = 2
        codes = np.zeros(total, np.int64)
        codes[place_a], codes[place_b] = self.a, self.b + len(a.text)
        both = pa.concat_arrays([a.text, b.text])
        signs = pa.array([",", "|", ";"], pa.large_string())
        line = pc.binary_join_element_wise(
            both.take(pa.array(codes)), signs.take(pa.array(ends)), pa.scalar("", pa.large_string())
        )
        data, offsets = _bytes(line)
        stops = offsets[np.cumsum(self.n_a + self.n_b)].tolist()
        out, start = [], 0
        for i in range(n_docs):
            stop = stops[i]
            out.append(hashlib.sha256(data[start:stop - 1]).hexdigest() if stop > start else "")
            start = stop
        return out


def _faithful(texts, a, b, ids_a, n_a, ids_b, n_b):
    """Drop the tokens of texts that one of the tokenizers doesn't give back byte by byte."""
    space = pa.scalar(" ", pa.large_string())
    wanted = pc.binary_join_element_wise(space, texts, pa.scalar("", pa.large_string()))
    want, want_ends = _bytes(wanted)
    good = np.diff(want_ends) > 1
    for encoder, ids, n in ((a, ids_a, n_a), (b, ids_b, n_b)):
        have, token_ends = _bytes(encoder.bytes.take(pa.array(ids)))
        ends = token_ends[np.concatenate([[0], np.cumsum(n)])]
        good &= np.diff(ends) == np.diff(want_ends)
        for i in np.flatnonzero(good).tolist():
            good[i] = have[ends[i]:ends[i + 1]] == want[want_ends[i]:want_ends[i + 1]]
    return (
        ids_a[np.repeat(good, n_a)], n_a * good, ids_b[np.repeat(good, n_b)], n_b * good,
    )


def _bytes(values: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The values' bytes in one row, and where they begin and the last one ends."""
    _, offsets, data = values.buffers()
    ends = np.frombuffer(offsets, np.int64, len(values) + 1) if len(values) else np.zeros(1, np.int64)
    return memoryview(data or b""), ends


_DOCUMENT = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "pairs binary, times binary"
)
# A part's documents, and one row with its distinct pairs.
ALIGNED = f"part long, {_DOCUMENT}, distinct_pairs array<long>, holders array<int>"


def _summed(keys: np.ndarray, amounts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of each one's amounts."""
    if not len(keys):
        return keys, amounts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
    return keys[first], np.add.reduceat(amounts[order], first)


def _align_task(batches: Iterable[pa.RecordBatch], files: tuple) -> Iterator[pa.RecordBatch]:
    a, b = encoders(*files)
    part = TaskContext.get().partitionId() << TASK_BITS
    for doc_ids, texts in parts(batches, BATCH_BYTES):
        found = Aligned(texts, a, b)
        doc, pair, times = found.links()
        distinct, code = np.unique(pair, return_inverse=True)
        held, times = _summed(doc << 32 | code, times)
        holder, code = held >> 32, (held & 0xFFFFFFFF).astype("<u4")
        n = len(doc_ids)
        borders = np.searchsorted(holder, np.arange(n + 1))
        slices = [slice(x, y) for x, y in zip(borders[:-1].tolist(), borders[1:].tolist())]
        per_doc = [int(times[s].sum()) for s in slices]
        none = pa.nulls(1, pa.int64())
        lists = pa.nulls(n, pa.list_(pa.int64()))
        counts = pa.nulls(n, pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([
            pa.array([part] * (n + 1), pa.int64()),
            pa.concat_arrays([doc_ids.cast(pa.int64()), none]),
            *(pa.array(np.append(x, 0), pa.int64()) for x in (found.n_a, found.n_b, found.n_groups, per_doc)),
            pa.array(found.digests(a, b) + [None], pa.string()),
            pa.array([code[s].tobytes() for s in slices] + [None], pa.binary()),
            pa.array([times[s].astype("<u8").tobytes() for s in slices] + [None], pa.binary()),
            pa.concat_arrays([lists, pa.array([distinct], pa.list_(pa.int64()))]),
            pa.concat_arrays([counts, pa.array(
                [np.bincount(code, minlength=len(distinct)).astype(np.int32)], pa.list_(pa.int32())
            )]),
        ], names=[f.split()[0] for f in ALIGNED.split(", ")])
        part += 1


def tokenizer_files() -> tuple[str, str, str]:
    import public_tokenizers

    return (
        public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
        public_tokenizers.path("piece_bpe_32k.model"),
    )


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n_docs (documents that hold the pair linked), is_best (highest of its A id)."""
    counts = materialise(
        aligned.filter("distinct_pairs IS NOT NULL")
        .select(F.explode(F.arrays_zip("distinct_pairs", "holders")).alias("p"))
        .groupBy(F.col("p.distinct_pairs").alias("pair"))
        .agg(F.sum("p.holders").alias("n_docs")),
        "alignment-counts",
    ).withColumn("a", F.shiftright("pair", PAIR_BITS))
    highest = counts.groupBy("a").agg(F.max("n_docs").alias("most"))
    return counts.join(highest, "a").select(
        "pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("is_best")
    )


_SCORED = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
    "groups_sha256 string"
)


def _score_part(docs: pa.Table, sums: pa.Table) -> pa.Table:
    """Documents of a part with the corpus-wide counts of its pairs, in order of the pairs."""
    order = np.argsort(sums["pair"].to_numpy())
    n_docs = sums["n_docs"].to_numpy()[order].astype(np.int64)
    best = sums["is_best"].to_numpy(zero_copy_only=False)[order].astype(np.int64)
    n_best, count_sum = [], []
    for pairs, times in zip(docs["pairs"], docs["times"]):
        code = np.frombuffer(pairs.as_buffer(), "<u4")
        times = np.frombuffer(times.as_buffer(), "<u8").astype(np.int64)
        n_best.append(int((best[code] * times).sum()))
        count_sum.append(int((n_docs[code] * times).sum()))
    kept = {c: docs[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
    return pa.table({
        **kept, "n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64()),
        "groups_sha256": docs["groups_sha256"],
    })


def align(
    docs: DataFrame, files: tuple[str, str, str] | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document; see the module's text for the columns' meaning.

    ``files``: A's vocabulary as ranks, its pre-token pattern, and B's model.
    """
    narrow = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    task = partial(_align_task, files=files or tokenizer_files())
    aligned = materialise(narrow.mapInArrow(task, ALIGNED), "alignment")
    own = aligned.filter("distinct_pairs IS NOT NULL").select(
        F.col("part").alias("pairs_part"), F.explode("distinct_pairs").alias("pair")
    )
    sums = own.join(pair_counts(aligned), "pair").select("pairs_part", "pair", "n_docs", "is_best")
    rows = aligned.filter("distinct_pairs IS NULL").drop("distinct_pairs", "holders")
    return rows.groupBy("part").cogroup(sums.groupBy("pairs_part")).applyInArrow(
        lambda key, left, right: _score_part(left, right), _SCORED
    )
