"""Longest term of a vocabulary in each text, for vocabularies of any size.

``router.find_term`` tries one pattern per term, which suits some dozens. Here the vocabulary is a
table: every stretch of up to as many words as its longest term has is cut from the text and meets
the terms by an equality join, so the work grows with the text and not with the vocabulary.

A term is found as whole words: no word character stands before its first or after its last
character. Terms may hold any characters between and around their words (``c++``, ``24/7 on-call``);
the join is on the part from the first word to the last one, and what lies before and after it is
compared with the text. Long terms beat short ones, equal lengths go in alphabetical order.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wosearch.functions.text import WORD
from wosearch.session import materialise

_RUNS = f"[{WORD}]+|[^{WORD}]+"


def _runs(text) -> Column:
    """The text as alternating runs of word characters and others."""
    return F.regexp_extract_all(text, F.lit(f"({_RUNS})"), 1)


def _is_word(run: Column) -> Column:
    return run.rlike(f"^[{WORD}]")


def term_table(vocabulary: DataFrame, term: str = "term") -> DataFrame:
    """term, core (first word to last word), lead, tail, n_words. Distinct; null terms are no terms.

    A term without a word fails the job.
    """
    text = F.col(term)
    wordless = F.raise_error(F.concat(F.lit("a term has no word: "), text)).cast("boolean")
    return (
        vocabulary.select(text.alias("term")).distinct().filter("term IS NOT NULL")
        .filter(F.when(F.col("term").rlike(f"[{WORD}]"), True).otherwise(wordless))
        .withColumns({
            "lead": F.regexp_extract("term", f"^([^{WORD}]*)", 1),
            "tail": F.regexp_extract("term", f"([^{WORD}]*)$", 1),
        })
        .withColumn("core", F.substr(
            "term", F.length("lead") + 1, F.length("term") - F.length("lead") - F.length("tail")
        ))
        .withColumn("n_words", F.size(F.regexp_extract_all("core", F.lit(f"([{WORD}]+)"), 1)))
    )


def longest_terms(texts: DataFrame, key: str, text: str, vocabulary: DataFrame, out: str = "term") -> DataFrame:
    """key and the longest term found in the text, null if there is none; one row per key.

    ``vocabulary`` has a column ``term``. Keys are unique. Spark joins by its real size: a small
    vocabulary travels to the texts, a large one is shuffled with the stretches of words.
    """
    terms = materialise(term_table(vocabulary), "terms")
    longest = terms.agg(F.max("n_words")).first()[0] or 0
    cut = texts.select(F.col(key).alias("_key"), _runs(F.coalesce(F.col(text), F.lit(""))).alias("runs"))
    places = F.filter(
        F.sequence(F.lit(1), F.size("runs")), lambda i: _is_word(F.element_at("runs", i))
    )
    # An empty text has no runs; a sequence from 1 down to 0 would have two members.
    placed = cut.filter(F.size("runs") > 0).select("_key", "runs", F.explode(places).alias("at"))
    stretches = F.transform(
        F.sequence(F.lit(1), F.lit(max(1, longest))), lambda n: F.struct(
            n.alias("n"), F.array_join(F.slice("runs", F.col("at"), 2 * n - 1), "").alias("core")
        ),
    )
    last = F.col("at") + 2 * F.col("s.n") - 2
    grams = (
        placed.select("_key", "runs", "at", F.explode(stretches).alias("s")).filter(last <= F.size("runs"))
        .select(
            "_key", F.col("s.core").alias("core"),
            # What stands before and after; the very edge of the text is marked by a null.
            F.try_element_at("runs", F.nullif(F.col("at") - 1, F.lit(0))).alias("before"),
            (F.col("at") == 2).alias("before_opens"),
            F.get("runs", last).alias("after"), (last + 1 == F.size("runs")).alias("after_closes"),
        )
    )
    before, after = F.coalesce("before", F.lit("")), F.coalesce("after", F.lit(""))

    def stands(edge: str, neighbour: Column, fits: Column, at_border: str) -> Column:
        """The term's edge is there, and what is beyond it is no word character."""
        rest = (F.length(neighbour) > F.length(edge)) | F.coalesce(at_border, F.lit(False))
        return (F.col(edge) == "") | (fits & rest)

    found = grams.join(terms, "core").filter(
        stands("lead", before, F.endswith(before, F.col("lead")), "before_opens")
        & stands("tail", after, F.startswith(after, F.col("tail")), "after_closes")
    )
    best = found.groupBy("_key").agg(
        F.min(F.struct((-F.length("term")).alias("shorter"), "term")).alias("best")
    ).select(F.col("_key"), F.col("best.term").alias(out))
    return texts.select(key).join(best, F.col(key) == F.col("_key"), "left").drop("_key")
