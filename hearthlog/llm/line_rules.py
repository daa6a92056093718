"""Quality rules, line first: judge every line, drop the failing ones, then judge what is left.

A line that holds a word fails when it breaks one of three rules:

* navigation: at least two separators, and one for every four words or fewer (menus, link bars,
  breadcrumb trails);
* boilerplate: it holds one of the fixed phrases, in any case, and has at most
  ``max_boilerplate_words`` words, so that prose which merely mentions such a phrase stays;
* punctuation: no word of it ends with a sentence mark, closing quotes and brackets aside, or more than
  one character in ``symbol_share`` of its text is a markup symbol.

Lines without a word are neither judged nor kept. A document is rejected when its failing lines hold
more than ``max_lost`` of its word characters, or when it fails the base rules: fewer than fifty words,
or more than half of them inside three-word windows that the text repeats.

Everything is one projection over the scan: no exchange, no Python, and no state beyond one row.
Null and blank texts have no words and are rejected; rows with null or repeated ids are judged one by
one; extra columns are passed through ``clean`` untouched and ignored by ``judge``.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlog.llm.text import BLANKS, HAS_WORD, let, words

# Phrases of web furniture.
BOILERPLATE = (
    "accept cookies",
    "all rights reserved",
    "click here",
    "cookie policy",
    "enable javascript",
    "log in",
    "lorem ipsum",
    "powered by",
    "privacy policy",
    "read more",
    "sign in",
    "sign up",
    "subscribe to",
    "terms of service",
    "terms of use",
)
SYMBOLS = "[#*$%&|<>]"
SEPARATORS = "[|»›•·]"
MANY_SEPARATORS = "[|»›•·][^|»›•·]*[|»›•·]"
SENTENCE_END = "[.!?…][\"'”’»)\\]]*([\\x20\\x09-\\x0D]|$)"

MIN_WORDS = 50
MAX_BOILERPLATE_WORDS = 15
SYMBOL_SHARE = 10
MAX_LOST = 0.5


def _covered(windows: Column) -> Column:
    """Words inside windows that occur twice, from the windows' hashes in order."""
    tagged = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))

    def starts(s: Column) -> Column:
        same = lambda x, i: (x.h == F.get(s, i - 1).h) | (x.h == F.get(s, i + 1).h)
        return F.sort_array(F.transform(F.filter(s, same), lambda x: x["at"]))

    def add(acc: Column, at: Column) -> Column:
        return F.struct(
            at.cast("long").alias("last"),
            (acc["total"] + F.least(F.lit(3), at - acc["last"])).cast("long").alias("total"),
        )

    zero = F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("total"))
    return F.aggregate(let(tagged, starts), zero, add, lambda acc: acc["total"])


def repeat_words(tokens: Column) -> Column:
    """How many words lie in three-word windows that occur twice or more, first occurrence included."""

    def windows(w: Column) -> Column:
        at = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        return F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), at)).otherwise(
            F.array().cast("array<bigint>")
        )

    counted = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_covered(h))
    return let(let(tokens, windows), counted)


def _line_fails(line: Column, max_boilerplate_words: int, symbol_share: int) -> Column:
    # Cheap tests stand before those that split the line into words.
    n_words = F.size(words(line))
    lowered = F.lower(line)
    phrase = reduce(or_, [lowered.contains(p) for p in BOILERPLATE])
    return (
        ~line.rlike(SENTENCE_END)
        | (F.regexp_count(line, F.lit(SYMBOLS)) * symbol_share > F.length(line))
        | (line.rlike(MANY_SEPARATORS) & (F.regexp_count(line, F.lit(SEPARATORS)) * 4 >= n_words))
        | (phrase & (n_words <= max_boilerplate_words))
    )


def _word_chars(text: Column) -> Column:
    return F.length(F.array_join(words(text), "")).cast("long")


def _word_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(HAS_WORD))


def judge(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    min_words: int = MIN_WORDS,
    max_boilerplate_words: int = MAX_BOILERPLATE_WORDS,
    symbol_share: int = SYMBOL_SHARE,
    max_lost: float = MAX_LOST,
) -> DataFrame:
    """One row per input row: counts, the base verdict, what the line rules removed, and ``kept``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), text.alias("_text"))
    rows = rows.select(id_col, "_text", words(F.col("_text")).alias("_words"))
    measured = rows.select(
        id_col,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count(F.col("_text"), F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(
            _word_lines(F.col("_text")),
            lambda lines: F.struct(
                (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
                F.size(lines).cast("long").alias("n_lines"),
                let(
                    F.filter(lines, lambda line: _line_fails(line, max_boilerplate_words, symbol_share)),
                    lambda bad: F.struct(
                        F.size(bad).cast("long").alias("n_failed"),
                        _word_chars(F.array_join(bad, " ")).alias("failed_chars"),
                    ),
                ).alias("bad"),
            ),
        ).alias("_lines"),
        repeat_words(F.col("_words")).alias("n_repeat_words"),
    )
    base_failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    lost = F.col("_lines.bad.failed_chars")
    return measured.select(
        id_col,
        "n_words",
        "word_chars",
        "n_symbols",
        "_lines.n_dup_lines",
        "n_repeat_words",
        base_failed.alias("base_failed"),
        (~base_failed & (lost <= max_lost * F.col("word_chars"))).alias("kept"),
        "_lines.n_lines",
        F.col("_lines.bad.n_failed").alias("n_failed_lines"),
        lost.alias("failed_chars"),
    )


def clean(
    docs: DataFrame,
    text_col: str = "text",
    *,
    max_boilerplate_words: int = MAX_BOILERPLATE_WORDS,
    symbol_share: int = SYMBOL_SHARE,
) -> DataFrame:
    """The input rows with the failing lines taken out of the text; a null text stays null."""
    good = F.filter(
        F.split(F.col(text_col), "\n"),
        lambda line: line.rlike(HAS_WORD) & ~_line_fails(line, max_boilerplate_words, symbol_share),
    )
    return docs.withColumn(text_col, F.array_join(good, "\n"))


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits: float) -> DataFrame:
    """The input rows whose document passes; a filter inside the scan's stage, no join back by id."""
    whole = F.struct(*[F.col(c) for c in docs.columns])
    packed = docs.select(whole.alias("_row"), F.col(text_col).alias("_body"))
    verdict = judge(packed, "_row", "_body", **limits)
    return verdict.filter("kept").select("_row.*")
