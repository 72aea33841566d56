"""Line-first cleaning in SQL functions only.

Each line is judged by rules on punctuation, navigation, symbols, shouting and
boilerplate; lines that fail are removed, and a document that loses more than
``MAX_LOST`` of its characters is rejected. The base measures (words, symbols,
repeated lines and repeated eight-word windows) are taken over the whole text.

Everything is a narrow projection: no shuffle, no Python. Windows of eight words
are compared by 64-bit hashes; only texts with a repeated hash sort them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Share of the characters of all lines that a kept document may lose.
MAX_LOST = 0.5
#: Words from which a line needs no closing punctuation.
FREE_WORDS = 10
#: Share of symbols from which a line fails.
MAX_SYMBOLS = 0.08

# Phrases of lines that belong to the site, not to the text.
BOILERPLATE = [
    "all rights reserved", "cookie policy", "privacy policy", "terms of service", "terms of use", "use of cookies",
    "sign up", "log in", "subscribe to", "click here", "share this", "enable javascript", "lorem ipsum",
    "released under the", "licensed under", "this work is licensed",
]
BOILERPLATE_RULE = "(" + "|".join(BOILERPLATE) + ")"
NAVIGATION_RULE = "[ ][|»›•·>/][ ].*[ ][|»›•·>/]([ ]|$)"
CLOSED_RULE = "[.!?:;,…\"')\\]»”]$"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def without(text: Column, letters: str) -> Column:
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), letters, text)


def words_of(text: Column) -> Column:
    """Words as an array; none for a null or blank text."""
    return let(
        F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE)),
        lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, "[\\x20\\x09-\\x0D]+")),
    )


def repeated_words(words: Column, width: int = 8) -> Column:
    """Words that lie in a window of ``width`` words found twice or more."""

    def covered(windows: Column) -> Column:
        order = F.array_sort(F.transform(windows, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        places = let(order, lambda o: F.array_sort(F.transform(
            F.filter(o, lambda s, i: (F.get(o, i - 1)["x"] == s["x"]) | (F.coalesce(F.get(o, i + 1)["x"] == s["x"], F.lit(False)))),
            lambda s: s["i"])))
        steps = let(places, lambda p: F.aggregate(
            F.transform(p, lambda v, i: F.when(i == 0, F.lit(width)).otherwise(F.least(F.lit(width), v - F.get(p, i - 1)))),
            F.lit(0).cast("long"), lambda a, b: a + b))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(steps)

    def windows(hashes: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(hashes) - width)
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(width)]))

    few = F.size(words) <= width
    return F.when(few, F.lit(0).cast("long")).otherwise(
        let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(windows(h), covered))
    )


def line_passes(line: Column) -> Column:
    """The rules for one line that has a word."""
    letters = F.length(line)
    symbols = letters - F.length(without(line, SYMBOLS))
    shouted = (F.upper(line) == line) & (F.lower(line) != line) & line.rlike("[^ ]+ [^ ]+ [^ ]+")
    long_enough = line.rlike("^([^ ]+[ ]+){%d}" % (FREE_WORDS - 1))
    return (
        (symbols <= letters * MAX_SYMBOLS) & ~shouted & ~F.lower(line).rlike(BOILERPLATE_RULE)
        & ~line.rlike(NAVIGATION_RULE) & (line.rlike(CLOSED_RULE) | long_enough)
    )


def judge(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, clean_text, lost_share.

    Base measures fail a text under 20 words or with over 30 % repeated words;
    such a text is not kept. A null text counts as empty. All lines count, also
    in very long texts; a repeated row is judged like its twin. clean_text joins
    the lines that pass by one \\n (empty if none). A column of ``docs`` with one of
    these names is replaced.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    first = docs.withColumns({"_words": words_of(text), "_lines": lines})
    judged = F.transform("_lines", lambda x: let(F.btrim(x, F.lit(SPACE)), lambda t: F.struct(
        line_passes(t).alias("passes"), F.length(t).cast("long").alias("size"), x.alias("line"))))
    measured = first.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(without(text, SPACE)).cast("long"),
        "n_symbols": (F.length(text) - F.length(without(text, SYMBOLS))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": repeated_words(F.col("_words")),
        "_judged": judged,
    }).drop("_words", "_lines")

    def total(keep: Callable[[Column], Column]) -> Column:
        return F.aggregate(F.filter("_judged", keep), F.lit(0).cast("long"), lambda a, s: a + s["size"])

    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    everything = total(lambda s: F.lit(True))
    return measured.withColumns({
        "base_failed": failed,
        "lost_share": F.when(everything == 0, F.lit(1.0)).otherwise(total(lambda s: ~s["passes"]) / everything),
        "clean_text": F.array_join(F.transform(F.filter("_judged", lambda s: s["passes"]), lambda s: s["line"]), "\n"),
    }).withColumn("kept", ~F.col("base_failed") & (F.col("lost_share") <= MAX_LOST)).drop("_judged")
