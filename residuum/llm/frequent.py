"""The most frequent keys of a count table, without sorting it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def most_frequent(counts: DataFrame, count_col: str, size: int, split: bool = False) -> DataFrame:
    """The rows of ``counts`` from the lowest count at which they are at most ``size``.

    Counts under 1024 are told apart exactly, larger ones by 64 steps an octave: a
    few thousand cells decide, so neither a task nor the driver meets more than
    ``size`` rows. Rows of equal counts come together or not at all; with ``split``
    the rows of the step that no longer fits are taken by a hash of the row until there are ``size``, so
    that a table of equal counts gives ``size`` rows too.
    """
    n = F.col(count_col)
    step = F.when(n < 1024, n).otherwise(1024 + F.floor((F.log2(n) - 10) * 64)).cast("long")
    picked, last, left = _while_they_fit(counts, step, size, descending=True)
    if last is None or not split:
        return counts.where(picked)
    name = F.xxhash64(*counts.columns)
    inside = step == last
    for shift in (52, 40, 28, 16, 4):
        cell = F.shiftrightunsigned(name, shift).bitwiseAND(F.lit(4095))
        more, last, left = _while_they_fit(counts.where(inside), cell, left, descending=False)
        picked = picked | (inside & more)
        inside = inside & (cell == F.lit(last))
        if last is None or not left:
            break
    return counts.where(picked)


def _while_they_fit(rows: DataFrame, cell: Column, left: int, descending: bool) -> tuple[Column, int | None, int]:
    """Condition of the first cells that hold at most ``left`` rows, the next cell (None: all fit), and what is left."""
    found = sorted((r["cell"], r["rows"]) for r in rows.groupBy(cell.alias("cell")).agg(F.count("*").alias("rows")).collect())
    for value, n in reversed(found) if descending else found:
        if n > left:
            return (cell > value if descending else cell < value), value, left
        left -= n
    return F.lit(True), None, left
