"""Browsing by regular expression with a trigram index.

The index lists, for every three ASCII characters that follow one another somewhere, the blocks of
rows whose descriptions hold them. From a pattern a condition is drawn that every matching text
meets: which trigrams must occur, joined by and / or. The condition is worked out on the postings,
and the regular expression itself is tried only on rows of the blocks that are left. So the rows
are those of a plain scan for any pattern; one from which no trigram follows (``a.b``, ``\\d+``) is a
plain scan.

Letters count without case, as in the scan: texts are folded like the regex engine folds them, with
the four letters beyond ASCII that it takes for ASCII ones. Parts of a pattern that are not plain
ASCII, or whose reading could differ between engines, add no condition.
"""

import re
import warnings
from collections.abc import Iterable
from functools import reduce
from re import _constants as sre
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wosearch.operators.inspection import BROWSE_COLUMNS, browse
from wosearch.schema import SEQ
from wosearch.session import materialise

ROWS_PER_BLOCK = 16
ROW_GROUP_BYTES = 4 << 20
# Strings a part of a pattern may stand for while it is followed letter by letter.
MOST_STRINGS = 16
# Trigrams of a condition. More of an "and" are left out, more of an "or" drop the condition.
MOST_GRAMS = 48
# Blocks that are named in the scan's filter; more of them are joined.
MOST_LISTED = 2000

# Letters beyond ASCII that a case-insensitive pattern takes for k, s, i, i.
_FOLDED = ("\u212a\u017f\u0130\u0131", "ksii")
# What other engines read differently: quoting, vertical space, octal digits, comments.
_OTHERWISE = re.compile(r"\\[QEv0-9]|\(\?[a-zA-Z]*[xdU]|\(\?#|&&")

# A condition: a trigram, ("and", conditions), ("or", conditions) or None for no condition.
Condition = str | tuple | None


def all_of(parts: Iterable[Condition]) -> Condition:
    found = list(dict.fromkeys(p for p in parts if p is not None))
    return None if not found else found[0] if len(found) == 1 else ("and", tuple(found))


def any_of(parts: Iterable[Condition]) -> Condition:
    found = list(dict.fromkeys(parts))
    if not found or None in found:
        return None
    return found[0] if len(found) == 1 else ("or", tuple(found))


def grams_of(text: str) -> Condition:
    return all_of(text[i:i + 3] for i in range(len(text) - 2))


class _Reader:
    """Follows a parsed pattern. ``run`` is what the letters read last may be, one after another."""

    def __init__(self):
        self.run: set[str] = {""}
        self.parts: list[Condition] = []
        self.whole = True  # ``run`` is all of the pattern so far

    def flush(self) -> None:
        self.parts.append(any_of(grams_of(s) for s in sorted(self.run)))
        self.run, self.whole = {""}, False

    def extend(self, strings: Iterable[str]) -> None:
        longer = {a + b for a in self.run for b in strings}
        if len(longer) > MOST_STRINGS:
            self.flush()
            longer = set(strings)
        if len(longer) > MOST_STRINGS:
            self.flush()
        else:
            self.run = longer

    def condition(self) -> Condition:
        return all_of([*self.parts, any_of(grams_of(s) for s in sorted(self.run))])

    def inner(self, pattern) -> "_Reader":
        reader = _Reader()
        reader.read(pattern)
        return reader

    def insert(self, reader: "_Reader") -> None:
        if reader.whole:
            self.extend(reader.run)
        else:
            self.flush()
            self.parts.append(reader.condition())

    def read(self, pattern) -> None:
        for op, value in pattern:
            if op is sre.LITERAL and value < 128:
                self.extend({chr(value).lower()})
            elif op is sre.IN and len(value) <= 4 and all(o is sre.LITERAL and v < 128 for o, v in value):
                self.extend({chr(v).lower() for _, v in value})
            elif op is sre.BRANCH:
                readers = [self.inner(p) for p in value[1]]
                if all(r.whole for r in readers):
                    self.extend(set().union(*(r.run for r in readers)))
                else:
                    self.flush()
                    self.parts.append(any_of(r.condition() for r in readers))
            elif op is sre.SUBPATTERN:
                self.insert(self.inner(value[3]))
            elif op is sre.ATOMIC_GROUP:
                self.insert(self.inner(value))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
                least, most, inside = value
                reader = self.inner(inside)
                if (least, most) == (0, 1) and reader.whole:
                    self.extend(reader.run | {""})
                    continue
                for _ in range(min(int(least), 3)):
                    self.insert(reader)
                if most != least or least > 3:
                    self.flush()
            elif op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
                continue  # takes no characters
            else:
                self.flush()


def _nested_class(pattern: str) -> bool:
    """A class inside a class, which engines read differently."""
    escaped, inside, first = False, False, False
    for c in pattern:
        if escaped:
            escaped, first = False, False
        elif c == "\\":
            escaped = True
        elif inside:
            if c == "[":
                return True
            if c == "]" and first:
                return True
            inside, first = c != "]", first and c == "^"
        elif c == "[":
            inside = first = True
    return False


def condition_of(pattern: str) -> Condition:
    """What trigrams a text must hold to match, letters in lower case; None: any text may match."""
    if _OTHERWISE.search(pattern) or _nested_class(pattern):
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            parsed = _parser.parse(pattern)
    except (re.error, Warning, OverflowError, RecursionError):
        return None
    reader = _Reader()
    reader.read(parsed)
    return _bounded(reader.condition())


def grams_in(condition: Condition) -> list[str]:
    if condition is None:
        return []
    if isinstance(condition, str):
        return [condition]
    return list(dict.fromkeys(g for part in condition[1] for g in grams_in(part)))


def _bounded(condition: Condition) -> Condition:
    if condition is None or len(grams_in(condition)) <= MOST_GRAMS:
        return condition
    if condition[0] == "or":
        return None
    kept: list[Condition] = []
    for part in condition[1]:
        if len(grams_in(all_of([*kept, part]))) <= MOST_GRAMS:
            kept.append(part)
    return all_of(kept)


def holds(condition: Condition, has) -> Column:
    """The condition as a column; ``has`` gives that of a trigram."""
    if isinstance(condition, str):
        return has(condition)
    joined = [holds(part, has) for part in condition[1]]
    return reduce(lambda a, b: a & b if condition[0] == "and" else a | b, joined)


def trigrams(text: Column) -> Column:
    """Distinct trigrams of ASCII characters of a text, in lower case."""
    folded = F.coalesce(text, F.lit(""))
    for letter, plain in zip(*_FOLDED):
        folded = F.replace(folded, F.lit(letter), F.lit(plain))
    # Looking ahead finds overlapping trigrams in one pass.
    found = F.regexp_extract_all(F.lower(folded), F.lit(r"(?=([\x00-\x7f]{3}))"), F.lit(1))
    return F.array_distinct(found)


class BrowseIndex:
    """Rows in blocks of consecutive positions, and postings of their descriptions' trigrams."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    @property
    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    def append(self, df: DataFrame, rows_per_block: int = ROWS_PER_BLOCK) -> "BrowseIndex":
        """Store and index rows; the first call creates the index.

        Both tables are sorted in ranges with small row groups, so that a scan that names trigrams
        or blocks skips the others. A trigram of a third of all blocks spreads over several ranges.
        """
        placed = df.withColumn("block", F.expr(f"{SEQ} div {rows_per_block}"))

        def write(table: DataFrame, order: tuple, name: str) -> None:
            table.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("append").option(
                "parquet.block.size", ROW_GROUP_BYTES
            ).option("parquet.block.size.row.check.min", 100).parquet(f"{self.path}/{name}")

        write(placed, ("block", SEQ), "rows")
        # A block's texts are read as one. No trigram runs over the character between two of them.
        texts = F.concat_ws("\u00b6", F.collect_list("WODescription"))
        found = materialise(placed.groupBy("block").agg(trigrams(texts).alias("grams")), "block-grams")
        write(found.select("block", F.explode("grams").alias("gram")), ("gram", "block"), "postings")
        return self

    def blocks(self, condition: Condition) -> DataFrame:
        """Blocks that meet the condition as a whole."""
        grams = grams_in(condition)
        names = {g: f"g{i}" for i, g in enumerate(grams)}
        return (
            self.postings.filter(F.col("gram").isin(grams)).groupBy("block")
            .agg(*[F.bool_or(F.col("gram") == g).alias(n) for g, n in names.items()])
            .filter(holds(condition, lambda g: F.col(names[g]))).select("block")
        )

    def candidates(self, pattern: str) -> DataFrame:
        """Rows that may match, all that do among them."""
        condition = condition_of(pattern) if pattern else None
        if condition is None:
            return self.rows.drop("block")
        found = self.blocks(condition)
        few = [r["block"] for r in found.limit(MOST_LISTED + 1).collect()]
        if len(few) <= MOST_LISTED:
            return self.rows.filter(F.col("block").isin(few)).drop("block")
        return self.rows.join(found, "block", "left_semi").drop("block")

    def browse(
        self, kind: str = "All", equipment: str = "All", pattern: str = "", limit: int = 200
    ) -> DataFrame:
        """The rows of ``inspection.browse`` over the stored rows."""
        rows = self.candidates(pattern).select(SEQ, *BROWSE_COLUMNS)
        return browse(rows, kind, equipment, pattern, limit)
