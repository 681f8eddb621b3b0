"""Packing token sequences into fixed windows by minimum bin slack.

Each task tokenizes its documents, cuts off the full windows and keeps the rests in a buffer.
From the buffer it fills window after window: the longest rest comes first, and a bitset
subset-sum dynamic programme over the multiset of remaining lengths picks what brings the
window closest to its capacity; backtracking through the bitsets gives the count of each
length. No shuffle is needed, and the buffer is bounded whatever the input is.

Defined results
* a null text is an empty one: only the end id; an empty table gives no pieces;
* repeated rows are packed as often as they occur; a null id is carried along;
* a long text is cut at window borders; other pieces are cut only to close a task's last
  windows, which then hold a power of two of tokens, so that they need no padding;
* equal lengths go in the order they were read, so reruns over the same splits agree;
* only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict, deque
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wosearch.llm.common import parts

WINDOW = 1024
END_ID = 0
# Rests held while looking for a good fit, and rests left for the next fill.
BUFFER = 4096
CARRY = 512
# Bytes of text tokenized at once; a longer text comes alone.
BATCH_BYTES = 4 << 20
# Sequence numbers: the task's partition above, a running number below.
TASK_BITS = 40

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long"
)
_ARROW = pa.schema([(name.split()[0], pa.int64()) for name in PIECES.split(", ")])


class Tokens:
    """Ids of texts as the tokenizers library gives them with add_special_tokens=False.

    A space before a character that is no white space always opens a new pre-token of the
    byte-level pattern, so the ids of a text are those of its first word and of " " + each
    further word, one after another. So a batch's distinct words are encoded once, by the
    faster encoder of the same vocabulary, and its texts are put together from them. Texts
    with white space after a space are encoded whole; texts that hold a special token's own
    string are left to the tokenizers library.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding(
            "byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
        )
        self.width = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.width[rank] = len(token)
        self.reference = Tokenizer.from_file(json_path)
        added = self.reference.get_added_tokens_decoder().values()
        self.special = [token.content for token in added]

    def whole(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            ids = self.reference.encode(text, add_special_tokens=False).ids
            return np.array(ids, dtype=np.uint32)
        return self.encoding.encode_to_numpy(text)

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; none is null."""
        lists = pc.split_pattern(texts, " ")
        words = lists.flatten().dictionary_encode()
        codes, distinct = words.indices.to_numpy(), words.dictionary
        regular = pc.match_substring_regex(distinct, r"^[^\s\pZ\x1c-\x1f\x{85}]")
        sound = regular.to_numpy(zero_copy_only=False)
        for s in self.special:
            sound &= ~pc.match_substring(distinct, s).to_numpy(zero_copy_only=False)

        known = distinct.filter(pa.array(sound))
        sizes = np.zeros(len(distinct), dtype=np.int64)
        first = np.zeros(len(distinct), dtype=np.int64)
        ids = np.zeros(0, dtype=np.uint32)
        if len(known):
            lines = pa.LargeListArray.from_arrays(pa.array([0, len(known)], pa.int64()), known)
            ids = self.encoding.encode_to_numpy(" " + pc.binary_join(lines, pa.scalar(" ", pa.large_string()))[0].as_py())
            ends = np.cumsum(self.width[ids])
            word_ends = np.cumsum(pc.binary_length(known).to_numpy().astype(np.int64) + 1)
            after = np.searchsorted(ends, word_ends) + 1
            sizes[sound] = np.diff(after, prepend=0)
            first[sound] = after - sizes[sound]

        borders = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        out = []
        for i, text in enumerate(texts):
            own = codes[borders[i] + 1:borders[i + 1]]
            if not sound[own].all() or any(s in text.as_py() for s in self.special):
                out.append(self.whole(text.as_py()))
                continue
            head = self.encoding.encode_to_numpy(distinct[codes[borders[i]].item()].as_py())
            n = sizes[own]
            shift = first[own] - (np.cumsum(n) - n)
            rest = ids[np.repeat(shift, n) + np.arange(n.sum())]
            out.append(np.concatenate([head, rest]))
        return out


@lru_cache(maxsize=2)
def tokens(json_path: str, ranks_path: str, pattern: str) -> Tokens:
    return Tokens(json_path, ranks_path, pattern)


def closest_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length bring the sum closest to ``capacity`` from below.

    Bit s of ``reach`` says that a sum of s can be made. A length that occurs c times enters
    as 1, 2, 4, ... copies up to c, so each copy count can be made. The bitset before each
    step is kept and the chosen sum is traced back through them.
    """
    mask = (1 << capacity + 1) - 1
    reach, steps, full = 1, [], 1 << capacity
    for length in sorted((n for n in counts if n <= capacity), reverse=True):
        left, copies = min(counts[length], capacity // length), 1
        while left > 0 and not reach & full:
            copies = min(copies, left)
            steps.append((length, copies, reach))
            reach |= reach << length * copies & mask
            left -= copies
            copies *= 2
        if reach & full:
            break
    target = reach.bit_length() - 1
    taken: dict[int, int] = defaultdict(int)
    for length, copies, before in reversed(steps):
        if not before >> target & 1:
            taken[length] += copies
            target -= length * copies
    return taken


class Packer:
    """Fills windows from rests: (doc_id, start, ids, doc_tokens)."""

    def __init__(self, window: int, first_sequence: int):
        self.window, self.sequence = window, first_sequence
        self.by_length: dict[int, deque] = defaultdict(deque)
        self.held = 0
        self.columns: list[list] = [[] for _ in _ARROW]

    def put(self, sequence: list[tuple]) -> None:
        """One sequence of pieces, laid one after another."""
        offset = 0
        for doc_id, start, ids, doc_tokens in sequence:
            n = len(ids)
            row = (doc_id, start, n, zlib.crc32(ids.tobytes()), doc_tokens, self.sequence, offset)
            for column, value in zip(self.columns, row):
                column.append(value)
            offset += n
        self.sequence += 1

    def add(self, doc_id, ids: np.ndarray) -> None:
        n = len(ids)
        for start in range(0, n - self.window + 1, self.window):
            self.put([(doc_id, start, ids[start:start + self.window], n)])
        if rest := n % self.window:
            self.hold((doc_id, n - rest, ids[n - rest:].copy(), n))

    def hold(self, piece: tuple) -> None:
        self.by_length[len(piece[2])].append(piece)
        self.held += 1

    def draw(self, length: int) -> tuple:
        pieces = self.by_length[length]
        piece = pieces.popleft()
        if not pieces:
            del self.by_length[length]
        self.held -= 1
        return piece

    def fill(self) -> tuple[list[tuple], int]:
        """Pieces of the next window and its slack."""
        longest = max(self.by_length)
        sequence = [self.draw(longest)]
        room = self.window - longest
        if room and self.held:
            counts = {n: len(pieces) for n, pieces in self.by_length.items()}
            for length, copies in closest_fill(counts, room).items():
                for _ in range(copies):
                    sequence.append(self.draw(length))
                room -= length * copies
        return sequence, room

    def reduce(self, keep: int) -> None:
        """Fill windows until ``keep`` rests are left."""
        while self.held > keep:
            sequence, room = self.fill()
            if room and self.held:
                doc_id, start, ids, n = self.draw(max(self.by_length))
                sequence.append((doc_id, start, ids[:room], n))
                self.hold((doc_id, start + room, ids[room:], n))
                room = 0
            if room:
                self.close(sequence)
            else:
                self.put(sequence)

    def close(self, sequence: list[tuple]) -> None:
        """Cut the last, short window into sequences that need no padding."""
        total = sum(len(piece[2]) for piece in sequence)
        pieces = deque(sequence)
        for bit in reversed(range(total.bit_length())):
            room, part = total & 1 << bit, []
            while room:
                doc_id, start, ids, n = pieces.popleft()
                part.append((doc_id, start, ids[:room], n))
                if len(ids) > room:
                    pieces.appendleft((doc_id, start + room, ids[room:], n))
                room -= min(room, len(ids))
            if part:
                self.put(part)

    def batch(self) -> pa.RecordBatch:
        columns, self.columns = self.columns, [[] for _ in _ARROW]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, type=pa.int64()) for c in columns], schema=_ARROW
        )


def _pack_task(batches: Iterable[pa.RecordBatch], window: int, files: tuple) -> Iterator:
    encode = tokens(*files).batch
    packer = Packer(window, TaskContext.get().partitionId() << TASK_BITS)
    for doc_ids, texts in parts(batches, BATCH_BYTES):
        for doc_id, ids in zip(doc_ids.to_pylist(), encode(texts)):
            packer.add(doc_id, np.append(ids, np.uint32(END_ID)))
            if packer.held >= BUFFER:
                packer.reduce(CARRY)
        yield packer.batch()
    packer.reduce(0)
    yield packer.batch()


def tokenizer_files() -> tuple[str, str, str]:
    import public_tokenizers

    return (
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )


def pack(
    docs: DataFrame, window: int = WINDOW, files: tuple[str, str, str] | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece; see the module's text for the layout and the defined results.

    ``files``: the tokenizer's JSON, the same vocabulary as ranks, and its pre-token pattern.
    """
    narrow = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    task = partial(_pack_task, window=window, files=files or tokenizer_files())
    return narrow.mapInArrow(task, PIECES)
