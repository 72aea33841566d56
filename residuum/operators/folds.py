"""Grouped, stratified folds for many tables at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residuum.operators.prefix import number_rows
from residuum.storage import cut


def group_value(df: DataFrame, axis: str) -> Column:
    """The value that must not be split between folds."""
    if axis == "target":
        return F.col("pr_id").cast("string")
    if axis == "drug":
        return F.col("dr_id").cast("string")
    if axis == "pair":
        return F.concat_ws("::", F.col("dr_id").cast("string"), F.col("pr_id").cast("string"))
    if axis == "none":
        return F.col("row_id").cast("string")
    raise ValueError(f"unknown group axis: {axis}")


def by_axes(df: DataFrame, axes: Sequence[str]) -> DataFrame:
    """Repeat rows per group axis with the matching ``group_id``."""
    sides = F.array(*[F.struct(F.lit(a).alias("group_axis"), group_value(df, a).alias("group_id")) for a in axes])
    return df.withColumn("_a", F.explode(sides)).select("*", "_a.*").drop("_a")


def make_folds(
    rows: DataFrame, keys: Sequence[str], label: str, folds: int = 3, seed: int = 2026
) -> DataFrame:
    """Fold number per (keys, group_id); tables that cannot be split have no rows.

    Groups are dealt in turns, forth and back, most positives first, so folds
    get equal shares of both classes and sizes.
    """
    return _deal(rows, list(keys), label, folds, seed)


def assign_folds(
    rows: DataFrame,
    keys: Sequence[str],
    label: str,
    folds: int = 3,
    seed: int = 2026,
    strict: bool = True,
    usable: Column | None = None,
) -> DataFrame:
    """Rows with ``fold`` and ``n_folds``, null where the row or its table has none.

    Without ``strict`` a table that cannot be split by group is split by row.
    """
    keys = list(keys)
    usable = F.lit(True) if usable is None else usable
    marked = rows.withColumn("_g", F.when(usable, F.col("group_id")))
    grouped = marked.where("_g is not null")
    table = _deal(grouped, keys, label, folds, seed)
    if not strict:
        alone = grouped.join(table.select(*keys).distinct(), keys, "left_anti")
        alone = alone.withColumn("group_id", F.col("row_id").cast("string"))
        marked = marked.withColumn("_r", F.when(usable, F.col("row_id").cast("string")))
        by_row = _deal(alone, keys, label, folds, seed).select(
            *keys, F.col("group_id").alias("_r"), F.col("fold").alias("_rf"), F.col("n_folds").alias("_rn")
        )
        marked = marked.join(by_row, [*keys, "_r"], "left")
    out = marked.join(table.withColumnRenamed("group_id", "_g"), [*keys, "_g"], "left").drop("_g")
    if strict:
        return out
    return out.withColumns(
        {"fold": F.coalesce("fold", "_rf"), "n_folds": F.coalesce("n_folds", "_rn")}
    ).drop("_r", "_rf", "_rn")


def _deal(rows: DataFrame, keys: list[str], label: str, folds: int, seed: int) -> DataFrame:
    groups = rows.groupBy(*keys, "group_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("pos")
    )
    return deal_groups(groups, keys, folds, seed)


def deal_groups(groups: DataFrame, keys: Sequence[str], folds: int = 3, seed: int = 2026) -> DataFrame:
    """``make_folds`` for groups that are already counted (columns n and pos)."""
    keys = list(keys)
    sizes = groups.groupBy(*keys).agg(
        F.sum("pos").alias("_pos"), (F.sum("n") - F.sum("pos")).alias("_neg"), F.count(F.lit(1)).alias("_groups")
    )
    sizes = sizes.withColumn("_k", F.least(F.lit(int(folds)), F.col("_pos"), F.col("_neg"), F.col("_groups")))
    # ``sizes`` and ``good`` have one row per table
    ready = groups.join(F.broadcast(sizes.where(F.col("_k") >= 2).select(*keys, "_k")), keys)
    shuffled = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("group_id")))
    ready = ready.withColumns({"_h": shuffled, "_hc": F.substring(shuffled, 1, 2)})
    order = [F.col("pos").desc(), F.col("n").desc()]
    dealt = number_rows(
        ready, keys, ["pos", "n", "_hc"], [F.col("_h"), F.col("group_id")],
        cell_order=[*order, F.col("_hc").asc()], out="_at",
    )
    turn = F.floor((F.col("_at") - 1) / F.col("_k"))
    place = F.pmod(F.col("_at") - 1, F.col("_k"))
    dealt = dealt.withColumn(
        "fold", F.when(turn % 2 == 0, place).otherwise(F.col("_k") - 1 - place).cast("int")
    )
    # the check and the result read the same deal: the groups are ordered once
    dealt = cut(dealt.select(*keys, "group_id", "fold", "_k", "pos", "n"), "dealt-groups")
    check = dealt.groupBy(*keys, "fold").agg(
        F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"), F.first("_k").alias("_k")
    )
    # every fold must hold both classes, and so must what is left without it
    good = check.groupBy(*keys).agg(
        F.min("p").alias("lp"), F.min("q").alias("lq"),
        F.max("p").alias("hp"), F.max("q").alias("hq"),
        F.sum("p").alias("tp"), F.sum("q").alias("tq"),
        F.count(F.lit(1)).alias("seen"), F.first("_k").alias("_k"),
    ).where("lp > 0 and lq > 0 and tp > hp and tq > hq and seen = _k")
    return dealt.join(F.broadcast(good.select(*keys)), keys, "left_semi").select(
        *keys, "group_id", "fold", F.col("_k").cast("int").alias("n_folds")
    )
