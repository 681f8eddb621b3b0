"""Secret scan: a keyword automaton finds where to look, anchored patterns read the secret,

checksums inside the secret confirm or refuse it.

Each task scans whole texts: one pass of an Aho-Corasick automaton over all keywords of all
kinds, patterns only at its hits. Long hex strings have no keyword; a single linear pass over
the letters finds their runs.

Kinds by rank: assign, access and hex as the base, then github and npm tokens (their last six
signs are the CRC-32 of the rest in base 62), signed web tokens (the header must decode to
JSON that names an algorithm), stripe, slack and google keys, and private key blocks.

Defined results
* a null or empty text has no spans; the digest is that of an empty string;
* keywords of assign match in either case, of ASCII letters only; positions are code points;
* spans that begin together are ordered by rank; a base match that fails its length test is
  dropped and still hides what it overlaps, as matches of one kind never overlap;
* repeated rows give repeated results, an empty table an empty one;
* only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wosearch.llm.common import parts

BATCH_BYTES = 8 << 20
SPANS = "doc_id long, spans array<struct<start:int,end:int,kind:string,rank:int>>"

_BASE_62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def has_crc(token: str) -> bool:
    """The last six signs are the CRC-32 of what follows the prefix, in base 62."""
    body, check = token[token.index("_") + 1:-6], token[-6:]
    value, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        out = _BASE_62[digit] + out
    return out == check


def has_header(token: str) -> bool:
    """The first part decodes to a JSON object that names an algorithm."""
    head = token.split(".", 1)[0]
    try:
        header = json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (binascii.Error, ValueError):
        return False
    return isinstance(header, dict) and "alg" in header


@dataclass(frozen=True)
class Kind:
    name: str
    keywords: tuple[str, ...]
    pattern: re.Pattern
    holds: Callable[[re.Match], bool]
    base: bool = False
    # Signs of a run inside which a match that failed once fails from every later start as well.
    run: re.Pattern | None = None


def _any(match: re.Match) -> bool:
    return True


# Keywords, formats and lengths of the kinds.
KINDS = (
    Kind(
        "assign", ("password", "passwd", "secret", "token", "apikey", "api_key"),
        re.compile(
            r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
            r"([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII,
        ),
        lambda m: len(m[1]) >= 12, True,
    ),
    Kind("access", ("akia",), re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18, True),
    Kind("hex", (), re.compile(r"[0-9a-f]{16,}"), _any, True),
    Kind("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
         re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), lambda m: has_crc(m[0])),
    Kind("npm", ("npm_",),
         re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), lambda m: has_crc(m[0])),
    Kind("jwt", ("eyj",),
         re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
         lambda m: has_header(m[0]), run=re.compile(r"[A-Za-z0-9_-]+")),
    Kind("stripe", ("sk_live_", "rk_live_"), re.compile(r"[sr]k_live_[A-Za-z0-9]{24,}"), _any),
    Kind("slack", ("xoxb-", "xoxp-", "xoxa-", "xoxr-", "xoxs-"),
         re.compile(r"xox[bpars]-[0-9]{8,}-[A-Za-z0-9-]{10,}"), _any),
    Kind("google", ("aiza",), re.compile(r"AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])"), _any),
    Kind("pem", ("-----begin ",),
         re.compile(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"), _any),
)
BASE = tuple(kind.name for kind in KINDS if kind.base)
HEX_RANK = BASE.index("hex")


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    words = ahocorasick.Automaton()
    for rank, kind in enumerate(KINDS):
        for keyword in kind.keywords:
            words.add_word(keyword, (rank, len(keyword)))
    words.make_automaton()
    return words


def ascii_lower(text: str) -> str:
    """A-Z in lower case; every other letter and all positions stay."""
    return text.lower() if text.isascii() else text.encode().lower().decode()


def scan(text: str) -> list[tuple[int, int, int]]:
    """Spans (start, rank, end) in order."""
    found = [(m.start(), HEX_RANK, m.end()) for m in KINDS[HEX_RANK].pattern.finditer(text)]
    hits = sorted(
        (end + 1 - length, rank) for end, (rank, length) in automaton().iter(ascii_lower(text))
    )
    free = [0] * len(KINDS)  # where the next match of a kind may begin
    for start, rank in hits:
        if start < free[rank]:
            continue
        kind = KINDS[rank]
        if m := kind.pattern.match(text, start):
            free[rank] = m.end()
            if kind.holds(m):
                found.append((start, rank, m.end()))
        elif kind.run and (run := kind.run.match(text, start)):
            free[rank] = run.end()
    return sorted(found)


def _scan_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([
        ("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("rank", pa.int32())
    ]))
    for doc_ids, texts in parts(batches, BATCH_BYTES):
        spans = [
            [{"start": s, "end": e, "kind": KINDS[r].name, "rank": r} for s, r, e in scan(t.as_py())]
            for t in texts
        ]
        yield pa.RecordBatch.from_arrays(
            [doc_ids, pa.array(spans, type=kind)], names=["doc_id", "spans"]
        )


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the spans of every kind, by start, then rank."""
    narrow = df.select(F.col(id_col).cast("long"), F.col(text_col))
    return narrow.mapInArrow(_scan_task, SPANS)


def digest(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    ), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
