"""Ordered aggregates without single-task windows.

A window over a whole group sorts that group in one task. Here every group is
first cut into cells that keep the order; cell totals are tiny and are summed
with a window, rows only ever meet the other rows of their own cell.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS_PER_OCTAVE = 4096


def magnitude_cell(value: Column, per_octave: int = CELLS_PER_OCTAVE) -> Column:
    """Order-keeping integer cell of a number: log-linear, 4096 cells per octave."""
    size = F.abs(value.cast("double"))
    octave = F.floor(F.log2(size))
    inside = F.floor((size / F.pow(F.lit(2.0), octave) - 1.0) * per_octave)
    cell = (octave + 1100) * per_octave + inside
    return (
        F.when(value.isNull(), None)
        .when(value == 0, F.lit(0))
        .when(value > 0, cell)
        .otherwise(-cell)
        .cast("bigint")
    )


def is_finite(value: Column) -> Column:
    """Whether a number is neither null nor NaN nor infinite."""
    number = value.cast("double")
    return F.coalesce(~F.isnan(number) & (F.abs(number) < float("inf")), F.lit(False))


def _before(keys: Sequence[str], order: Sequence[Column]):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def prefix_sums(
    rows: DataFrame,
    keys: Sequence[str],
    value: str,
    sums: dict[str, Column],
    descending: bool = True,
    following: bool = False,
) -> DataFrame:
    """One row per (keys, value) with sums, running sums (cum_*) and totals (total_*).

    Equal values are merged before any shuffle of the ordered data. ``following``
    adds the sums of the next value (next_*), null at the last one.
    """
    keys, names = list(keys), list(sums)
    distinct = (
        rows.groupBy(*keys, value)
        .agg(*[F.sum(c).alias(n) for n, c in sums.items()])
        .withColumn("_cell", magnitude_cell(F.col(value)))
    )
    turn = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    before, whole = _before(keys, [turn("_cell")]), Window.partitionBy(*keys)
    first = F.max_by if descending else F.min_by
    heads = [first(n, value).alias(f"_head_{n}") for n in names] if following else []
    cells = distinct.groupBy(*keys, "_cell").agg(*[F.sum(n).alias(f"_sum_{n}") for n in names], *heads)
    in_order = Window.partitionBy(*keys).orderBy(turn("_cell"))
    cells = cells.select(
        *keys,
        "_cell",
        *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_off_{n}") for n in names],
        *[F.sum(f"_sum_{n}").over(whole).alias(f"total_{n}") for n in names],
        *[F.lead(f"_head_{n}").over(in_order).alias(f"_head_{n}") for n in names if following],
    )
    neighbours = Window.partitionBy(*keys, "_cell").orderBy(turn(value))
    inside = (
        Window.partitionBy(*keys, "_cell")
        .orderBy(turn(value))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return distinct.join(cells, [*keys, "_cell"]).select(
        *keys,
        value,
        *names,
        *[(F.sum(n).over(inside) + F.col(f"_off_{n}")).alias(f"cum_{n}") for n in names],
        *[f"total_{n}" for n in names],
        *[F.coalesce(F.lead(n).over(neighbours), F.col(f"_head_{n}")).alias(f"next_{n}") for n in names if following],
    )


def number_rows(
    rows: DataFrame,
    keys: Sequence[str],
    cells: Sequence[str],
    order: Sequence[Column],
    cell_order: Sequence[Column] | None = None,
    out: str = "position",
) -> DataFrame:
    """1-based position inside ``keys`` when ``cells`` is a coarse form of ``order``.

    A few hundred cells per group are plenty: they bound both windows.
    """
    keys, cells = list(keys), list(cells)
    cell_order = list(cell_order or [F.col(c) for c in cells])
    sizes = rows.groupBy(*keys, *cells).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(
        *keys, *cells, F.coalesce(F.sum("_n").over(_before(keys, cell_order)), F.lit(0)).alias("_off")
    )
    inside = Window.partitionBy(*keys, *cells).orderBy(*order)
    return rows.join(offsets, [*keys, *cells]).withColumn(
        out, F.col("_off") + F.row_number().over(inside)
    ).drop("_off")


def kth_row(
    rows: DataFrame,
    keys: Sequence[str],
    value: str,
    tie: str,
    rank: Column,
) -> DataFrame:
    """The ``rank``-th row of each group by value descending, then tie ascending.

    ``rank`` may use ``group_n``, the group size. Returns keys, cut_value and
    cut_tie; groups with rank below one have no row. Three narrowing steps: the
    value cell, the value with a cell of the tie, the row.
    """
    keys = list(keys)
    named = rows.select(*keys, F.col(value).alias("_v"), F.col(tie).alias("_t")).withColumns(
        {"_c": magnitude_cell(F.col("_v")), "_tc": magnitude_cell(F.col("_t"))}
    )
    # 1: cell of the value
    cells = named.groupBy(*keys, "_c").agg(F.count(F.lit(1)).alias("_n"))
    cells = cells.withColumn("group_n", F.sum("_n").over(Window.partitionBy(*keys)))
    cells = cells.withColumn("_k", rank.cast("bigint")).withColumn(
        "_above", F.coalesce(F.sum("_n").over(_before(keys, [F.col("_c").desc()])), F.lit(0))
    )
    first = cells.where((F.col("_above") < F.col("_k")) & (F.col("_k") <= F.col("_above") + F.col("_n")))
    first = first.select(*keys, "_c", (F.col("_k") - F.col("_above")).alias("_k"))
    # 2: exact value and cell of the tie column
    # ``first`` and ``second`` have one row per group: no row of ``rows`` is moved to meet them
    near = named.join(F.broadcast(first), [*keys, "_c"])
    groups = near.groupBy(*keys, "_v", "_tc").agg(
        F.count(F.lit(1)).alias("_n"), F.max("_k").alias("_k")
    )
    groups = groups.withColumn(
        "_above",
        F.coalesce(F.sum("_n").over(_before(keys, [F.col("_v").desc(), F.col("_tc").asc()])), F.lit(0)),
    )
    second = groups.where((F.col("_above") < F.col("_k")) & (F.col("_k") <= F.col("_above") + F.col("_n")))
    second = second.select(*keys, "_v", "_tc", (F.col("_k") - F.col("_above")).alias("_k"))
    # 3: the row
    last = named.join(F.broadcast(second), [*keys, "_v", "_tc"]).withColumn(
        "_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_t").asc()))
    )
    return last.where(F.col("_r") == F.col("_k")).select(
        *keys, F.col("_v").alias("cut_value"), F.col("_t").alias("cut_tie")
    )


def medians(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Exact median per group (mean of the two middle values); null, NaN and infinite values are skipped."""
    keys = list(keys)
    steps = prefix_sums(
        rows.where(is_finite(F.col(value))), keys, value, {"n": F.lit(1)}, descending=False
    )
    low = F.floor((F.col("total_n") + 1) / 2)
    high = F.floor((F.col("total_n") + 2) / 2)
    holds = lambda k: (F.col("cum_n") - F.col("n") < k) & (k <= F.col("cum_n"))
    return steps.groupBy(*keys).agg(
        ((F.max(F.when(holds(low), F.col(value))) + F.max(F.when(holds(high), F.col(value)))) / 2.0).alias(
            "median"
        )
    )
