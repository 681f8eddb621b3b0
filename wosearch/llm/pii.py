"""Personal data: patterns propose spans, checksums confirm them, context adjusts the score.

Everything runs as built-in column functions. A pattern's matches and the text between them
come from two scans; running lengths give the positions, in code points.

Kinds, in the order of their rank: email, ip, card (Luhn) and phone as the base, then iban
(mod-97), ssn (allotted numbers), tel and pan. The last two are phone and card numbers inside runs of
digits that are no phone or card as a whole, such as a phone number with a card number after it. A
confirmed proposal starts with the score of its kind; words of the kind within the 40 code points
before it add to the score. Base spans are always kept; the others need ``THRESHOLD``. So an ssn is
kept only next to a word that speaks of one.

Defined results
* a null or empty text has no spans; the digest is that of an empty string;
* a text of any length is searched whole; no pattern walks back over what it has passed, running
  lengths are taken in stretches and pieces of text are cut from short blocks, so the work is in
  proportion to the text, however many spans it has;
* spans that begin together are ordered by the rank of their kind;
* repeated rows give repeated results, an empty table an empty one;
* columns of the result that the input has already are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT_CHARS = 40
CONTEXT_BONUS = 0.3
THRESHOLD = 0.7
# Members of a stretch of a running sum, and code points of a block of text.
STRETCH = 256
BLOCK = 1024


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str  # what it proposes, leftmost and non-overlapping
    needs: str  # a quick test: a text without it has no match
    score: float
    context: str  # words that speak of the kind
    base: bool


# Patterns and limits of the kinds. A match of email or ip starts where a run
# of its first class starts or where the last match has ended; elsewhere it would fail too.
# Only a maximal run of digits can be a card, so its length is part of the pattern.
KINDS = (
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        r"@", 0.9, r"e-?mail|contact|write", True,
    ),
    Kind(
        "ip",
        r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        r"[0-9]\.[0-9]", 0.5, r"\bip\b|address|host|server", True,
    ),
    Kind(
        "card",
        r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
        r"[0-9][\x20-]?[0-9]", 0.8, r"card|visa|master|credit|payment", True,
    ),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        r"\+[0-9]", 0.6, r"phone|call|tel|mobile|fax", True,
    ),
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?"
        r"(?![A-Za-z0-9])",
        r"[A-Z]{2}[0-9]{2}", 0.8, r"iban|account|bank|konto|cuenta|compte", False,
    ),
    Kind(
        "ssn",
        r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        r"[0-9]{3}-[0-9]{2}-", 0.4, r"ssn|social security|tax id", False,
    ),
    Kind(
        "tel",
        r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])",
        r"\+[0-9]", 0.7, r"phone|call|tel|mobile|fax", False,
    ),
    Kind(
        "pan",
        r"(?<![0-9])[3-6][0-9]{3}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])",
        r"[0-9][\x20-]?[0-9]", 0.7, r"card|visa|master|credit|payment", False,
    ),
)
# Where tel and pan are looked for: in what is proposed by these and not confirmed as the base kind.
RUNS = {
    "tel": ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    "pan": ("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,}+"),
}
RANK = {kind.name: i for i, kind in enumerate(KINDS)}

SPAN = "struct<start:int,rank:int,end:int,kind:string,score:double>"


def mod_97(account: Column) -> Column:
    """Remainder of an account number, letters as 10 to 35, its first four signs moved last."""
    turned = F.concat(F.substring(account, 5, 1000), F.substring(account, 1, 4))
    return F.aggregate(
        F.filter(F.split(turned, ""), lambda c: c != ""),
        F.lit(0),
        lambda rest, c: F.when(
            c.between("0", "9"), (rest * 10 + c.try_cast("int")) % 97
        ).otherwise((rest * 100 + F.ascii(c) - 55) % 97),
    )


def confirmed(kind: str, match: Column) -> Column:
    """The kind's check of a proposed match."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        # Parts without leading zeros have three digits at most.
        return F.forall(
            F.split(match, r"\."),
            lambda part: F.coalesce(
                F.regexp_replace(part, "^0+(?=[0-9])", "").try_cast("int") <= 255, F.lit(False)
            ),
        )
    if kind in ("card", "pan"):
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind in ("phone", "tel"):
        return F.length(digits).between(9, 15)
    if kind == "iban":
        account = F.replace(match, F.lit(" "), F.lit(""))
        return F.length(account).between(15, 34) & (mod_97(account) == 1)
    if kind == "ssn":
        area = F.substring(match, 1, 3)
        return ~(area.isin("000", "666") | (area >= "900") | match.rlike("-00-|-0000$"))
    return F.lit(True)


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, combine) -> Column:
    """Of an array of ints the combination (sum, maximum) of each member and all before it.

    Stretches are run through one by one, then their last members, so appending to arrays costs no
    more than the length of a stretch.
    """
    none = F.array().cast("array<int>")

    def last(numbers: Column) -> Column:
        return F.coalesce(F.try_element_at(numbers, F.lit(-1)), F.lit(0))

    def one_by_one(numbers: Column) -> Column:
        return F.aggregate(
            numbers, none, lambda done, x: F.concat(done, F.array(combine(last(done), x)))
        )

    def joined(stretches: Column) -> Column:
        return let(one_by_one(F.transform(stretches, last)), lambda sums: F.flatten(F.transform(
            stretches, lambda numbers, i: F.transform(
                numbers, lambda x: combine(x, F.coalesce(F.get(sums, i - 1), F.lit(0)))
            )
        )))

    starts = F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(STRETCH))
    return let(
        F.transform(starts, lambda at: one_by_one(F.slice(values, at, F.lit(STRETCH)))), joined
    )


def text_blocks(text: Column) -> Column:
    """The text in pieces of ``BLOCK`` code points."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0))


def cut(blocks: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` (exclusive) of the text, from the blocks that hold them."""
    first = F.floor(start / BLOCK).cast("int")
    n = F.floor((end - 1) / BLOCK).cast("int") - first + 1
    # Most pieces lie in one block or two; a slice of the array costs its length.
    held = F.when(n <= 2, F.concat(
        F.coalesce(F.get(blocks, first), F.lit("")),
        F.when(n == 2, F.coalesce(F.get(blocks, first + 1), F.lit(""))).otherwise(""),
    )).otherwise(F.array_join(F.slice(blocks, first + 1, F.greatest(n, F.lit(0))), ""))
    return F.when(end > start, F.substring(held, start - first * BLOCK + 1, end - start)).otherwise("")


PROPOSED = "array<struct<start:int,end:int,match:string>>"


def proposals(text: Column, pattern: str) -> Column:
    """Matches of a pattern with their positions: array<struct<start,end,match>>."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern)
    steps = F.filter(
        F.arrays_zip(between.alias("gap"), matches.alias("match")), lambda x: x["match"].isNotNull()
    )

    def placed(steps: Column) -> Column:
        lengths = F.transform(steps, lambda x: F.length(x["gap"]) + F.length(x["match"]))
        return let(running(lengths, lambda a, b: a + b), lambda ends: F.transform(
            steps, lambda x, i: F.struct(
                (F.get(ends, i) - F.length(x["match"])).alias("start"), F.get(ends, i).alias("end"),
                x["match"].alias("match"),
            ),
        ))

    return let(steps, placed)


def proposed(text: Column, kind: Kind) -> Column:
    """What a kind proposes; for tel and pan inside the runs that are nothing as a whole."""
    if kind.name not in RUNS:
        found = proposals(text, kind.pattern)
    else:
        base, pattern = RUNS[kind.name]
        runs = F.filter(proposals(text, pattern), lambda x: ~confirmed(base, x["match"]))
        found = F.flatten(F.transform(runs, lambda run: F.transform(
            proposals(run["match"], kind.pattern), lambda x: F.struct(
                (run["start"] + x["start"]).alias("start"), (run["start"] + x["end"]).alias("end"),
                x["match"].alias("match"),
            ),
        )))
    return F.when(text.rlike(kind.needs), found.cast(PROPOSED)).otherwise(F.array().cast(PROPOSED))


def in_any_case(words: str) -> str:
    """A pattern that finds what these lower-case words find in a text put in lower case.

    The first lower() or upper() of a JVM has ICU title-case all characters, gigabytes of garbage that
    leave a large heap. Besides A-Z only the Kelvin sign becomes one of a-z alone, and just two
    characters that are no letters to Java become letters, so that a word does not end there.
    """
    return "(?i)" + words.replace("k", "[k\u212a]").replace(
        r"\b", "(?<![\ua7cb\ua7dc])\\b(?![\ua7cb\ua7dc])"
    )


def scored(blocks: Column, kind: Kind, found: Column) -> Column:
    """Confirmed spans of a kind that reach the score they need."""
    def span(x: Column) -> Column:
        before = cut(blocks, F.greatest(x["start"] - CONTEXT_CHARS, F.lit(0)), x["start"])
        bonus = F.when(before.rlike(in_any_case(kind.context)), CONTEXT_BONUS).otherwise(0.0)
        return F.struct(
            x["start"].alias("start"), F.lit(RANK[kind.name]).alias("rank"),
            x["end"].alias("end"), F.lit(kind.name).alias("kind"),
            F.round(F.least(F.lit(1.0), bonus + kind.score), 3).alias("score"),
        )

    spans = F.transform(F.filter(found, lambda x: confirmed(kind.name, x["match"])), span)
    return spans if kind.base else F.filter(spans, lambda s: s["score"] >= THRESHOLD)


def find_spans(df: DataFrame, text_col: str = "text", out: str = "pii_spans") -> DataFrame:
    """Adds the spans of every kind, by start, then rank: array<struct<start,rank,end,...>>."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    names = {kind: f"__{out}_{kind.name}" for kind in KINDS}
    blocks = f"__{out}_blocks"
    found = df.withColumns({**{names[k]: proposed(text, k) for k in KINDS}, blocks: text_blocks(text)})
    spans = F.array_sort(F.concat(*(
        scored(F.col(blocks), kind, F.col(name)).cast(f"array<{SPAN}>") for kind, name in names.items()
    )))
    return found.withColumn(out, spans).drop(blocks, *names.values())


def digest(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    ), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Puts <KIND> in place of every span; overlapping spans go together, under the first one's kind.

    A column n_chars, where there is one, follows the new text.
    """
    found = find_spans(df, text_col, "__pii")
    text, spans = F.coalesce(F.col(text_col), F.lit("")), F.col("__pii")
    marks = F.array(*(F.lit(f"<{kind.name.upper()}>") for kind in KINDS))

    def masked_text(blocks: Column, reached: Column) -> Column:
        """``reached``: the furthest end of each span and those before it."""
        def piece(s: Column, i: Column) -> Column:
            at = F.coalesce(F.get(reached, i - 1), F.lit(0))
            return F.when(s["start"] < at, "").otherwise(F.concat(
                cut(blocks, at, s["start"]), F.get(marks, s["rank"])
            ))

        end = F.coalesce(F.try_element_at(reached, F.lit(-1)), F.lit(0))
        return F.concat(
            F.array_join(F.transform(spans, piece), ""), cut(blocks, end, F.length(text))
        )

    walked = let(text_blocks(text), lambda blocks: let(
        running(F.transform(spans, lambda s: s["end"]), F.greatest),
        lambda reached: masked_text(blocks, reached),
    ))
    clean = F.when(F.size(spans) == 0, F.col(text_col)).otherwise(walked)
    masked = found.withColumn(text_col, clean).drop("__pii")
    if "n_chars" in df.columns:
        n = F.coalesce(F.length(text_col), F.lit(0)).cast(df.schema["n_chars"].dataType)
        masked = masked.withColumn("n_chars", n)
    return masked.select(*df.columns)
