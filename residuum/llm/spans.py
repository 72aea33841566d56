"""Places of regular-expression matches in whole texts, by SQL functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from residuum.llm.quality_rules import let

SPANS = "array<struct<start:int,end:int,value:string>>"


def spans(text: Column, pattern: str) -> Column:
    """Leftmost matches that do not overlap, as (start, end, value) in code points; end is exclusive.

    The text between matches and the matches give the places by adding lengths.
    Group 0 is taken; the pattern must not match the empty string.
    """

    def placed(hits: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        pairs = F.arrays_zip(F.transform(F.slice(gaps, 1, F.size(hits)), lambda g: F.length(g)).alias("gap"), hits.alias("value"))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

        def step(acc: Column, pair: Column) -> Column:
            begin = acc["at"] + pair["gap"]
            end = begin + F.length(pair["value"])
            found = F.struct(begin.alias("start"), end.alias("end"), pair["value"].alias("value"))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(found)).alias("out"))

        return F.when(F.size(hits) == 0, F.array().cast(SPANS)).otherwise(F.aggregate(pairs, start, step, lambda acc: acc["out"]))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the digits of ``number`` pass Luhn's check."""
    n = F.length(number)
    total = F.aggregate(
        F.sequence(F.lit(1), n), F.lit(0),
        lambda acc, i: acc + let(F.substring(number, i, F.lit(1)).cast("int"), lambda d: F.when(
            (n - i) % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))),
    )
    return F.when(n > 0, total % 10 == 0).otherwise(False)


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])
