"""Text normalisation as Column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from wosearch.config import NA_TOKENS

# Unicode-aware character sets; Java's \w and \s cover ASCII only.
WORD = r"\p{L}\p{N}_"
SPACE = r"\s\x1c-\x1f\x{85}\p{Z}"
# All characters of SPACE: those of \s, \x1c-\x1f, \x85 and \p{Z}.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(
    map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
# Word boundary before / after a word character.
_START = f"(?<![{WORD}])"
_END = f"(?![{WORD}])"


def strip(c) -> Column:
    """Remove Unicode whitespace at both ends (``trim`` removes only spaces). Only the ends of a
    long text are looked at.
    """
    return F.btrim(c, F.lit(SPACES))


def collapse(c) -> Column:
    # A lone space already is what it should be and is not matched.
    return F.regexp_replace(c, f" [{SPACE}]+|[{SPACE}&&[^ ]][{SPACE}]*", " ")


def search_text(c) -> Column:
    """Search-text form of a free-text field; a null becomes the empty string.

    Symbols go last, so ``a & b`` keeps both spaces and an edge space can come back.
    """
    # The six separators become a space, the two quotes disappear.
    flat = F.coalesce(c, F.lit(""))
    for mark in "\n\r,;|/\"'":
        flat = F.replace(flat, F.lit(mark), F.lit("" if mark in "\"'" else " "))
    words = F.trim(collapse(F.lower(flat)))
    # ASCII first: the regex engine tests the parts of a class in order.
    return F.regexp_replace(words, f"[^a-z0-9 \\-.{WORD}{SPACE}]+", "")


def strict_text(c) -> Column:
    """ASCII form: lower-case letters, digits, dashes and single spaces."""
    lowered = F.lower(F.coalesce(c, F.lit("")))
    return F.trim(collapse(F.regexp_replace(lowered, f"[^a-z0-9{SPACE}\\-]+", " ")))


def na_to_null(c) -> Column:
    """Null for every string a CSV reader takes as missing."""
    return F.when(~c.isin(*NA_TOKENS), c)


def na_to_empty(c) -> Column:
    return F.coalesce(na_to_null(c), F.lit(""))


def strip_identifiers(description, building_name) -> Column:
    """Drop tokens that point at one building, so that a query generalises."""
    name = F.coalesce(building_name, F.lit(""))
    q = F.lower(description)
    q = F.when(
        ~name.isin("", "unknown_building"), F.replace(q, F.lower(name), F.lit(""))
    ).otherwise(q)
    # Building codes, zones, internal codes, dash codes.
    for pattern in (
        r"[a-z]\p{Nd}{3,4}",
        rf"zone[{SPACE}]*\p{{Nd}}+",
        r"(?:pm|cppainter|waycas|nspi|wo\p{Nd}+|elelct|csb)",
        rf"[{WORD}]{{2,}}-[{WORD}]{{2,}}-[{WORD}]{{2,}}",
    ):
        q = F.regexp_replace(q, _START + pattern + _END, " ")
    q = F.regexp_replace(q, f"[{SPACE}]{{2,}}", " ")
    return F.btrim(q, F.lit(" -|.,"))


def contains_term(c, term: str) -> Column:
    """Whole-word match of a literal lower-case term."""
    return c.rlike(_START + "\\Q" + term + "\\E" + _END)


def seeded_md5(seed: int, *parts) -> Column:
    """md5 over seed and parts: a shuffle order every engine can repeat."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def md5_number(digest) -> Column:
    """First 15 hex digits of a digest as a bigint (fits hash aggregation)."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
