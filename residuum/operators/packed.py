"""Ranking metrics of many overlapping tables from one ordered pass.

A row that belongs to many tables (policies, group axes, folds) is not repeated
for each: its memberships are digits of one code. Rows are ordered by score
once per score column, in cells that keep the order, and the counts of all
tables run along beside each other.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from residuum.operators.prefix import is_finite, magnitude_cell
from residuum.storage import cut

CELLS_PER_OCTAVE = 32
BUFFER_ROWS = 200_000


def table_ids(rows: DataFrame, keys: Sequence[str], name: str = "_t") -> DataFrame:
    """A number for each distinct key, stored, so that every use of it agrees."""
    distinct = rows.select(*keys).distinct()
    return cut(distinct.withColumn(name, F.row_number().over(Window.orderBy(*keys))), "table-ids")


def _series(code: np.ndarray, parts: Sequence[int]) -> list[np.ndarray]:
    """One mask per (member, part), from the digits above the label bit."""
    rest, out = code >> 1, []
    for p in parts:
        digit = rest % (p + 1)
        rest = rest // (p + 1)
        out += [digit == i + 1 for i in range(p)]
    return out


def _counts(code: np.ndarray, starts: np.ndarray, parts: Sequence[int]) -> np.ndarray:
    """Rows and positives of every series in each run of rows: (runs, 2 x series)."""
    masks = _series(code, parts)
    wrong = (code & 1).astype(bool)
    columns = [np.add.reduceat(m, starts, dtype=np.int64) for m in masks]
    columns += [np.add.reduceat(m & wrong, starts, dtype=np.int64) for m in masks]
    return np.stack(columns, axis=1)


def _lists(table: np.ndarray) -> pa.Array:
    ends = np.arange(0, table.size + 1, table.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(table.ravel()))


def _cell_totals(parts: Sequence[int], scores: int):
    """Task side of the first pass: counts per table, score column and cell."""

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        table, code = rows["_t"].to_numpy(), rows["_code"].to_numpy()
        for i in range(scores):
            known = rows[f"_c{i}"].is_valid().to_numpy()
            t, c, cell = table[known], code[known], rows[f"_c{i}"].drop_null().to_numpy()
            if not len(t):
                continue
            order = np.lexsort((cell, t))
            t, c, cell = t[order], c[order], cell[order]
            starts = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (cell[1:] != cell[:-1])])
            yield pa.RecordBatch.from_arrays(
                [pa.array(t[starts]), pa.array(np.full(len(starts), i, np.int32)), pa.array(cell[starts]), _lists(_counts(c, starts, parts))],
                names=["_t", "_i", "_cell", "_sums"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= BUFFER_ROWS:
                yield from flush(held)
                held, n = [], 0
        if n:
            yield from flush(held)

    return run


def _ordered_terms(parts: Sequence[int], fractions: Sequence[float]):
    """Task side of the second pass: rows by cell and score, each cell led by its offsets."""
    width = sum(parts)

    def terms(counts: np.ndarray, before: np.ndarray, totals: np.ndarray) -> list[np.ndarray]:
        n, pos = counts[:, :width].astype(np.float64), counts[:, width:].astype(np.float64)
        above, found = before[:, :width], before[:, width:]
        all_n, all_pos = totals[:, :width], totals[:, width:]
        wins = pos * ((all_n - all_pos) - (above - found) - 0.5 * (n - pos))
        some = np.maximum(n, 1.0)
        precision = pos * (found + pos) / np.maximum(above + n, 1.0)
        out = [precision, wins]
        for f in fractions:
            size = np.where(all_n > 1, np.minimum(np.maximum(np.rint(all_n * f), 1.0), all_n - 1), all_n)
            out.append(pos * np.clip((size - above) / some, 0.0, 1.0))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list] = {}
        cell = None  # (table, score column), running counts, totals of the open cell
        last = None  # score and counts of the open score

        def add(key, counts, before, totals):
            sums = [x.sum(axis=0) for x in terms(counts, before, np.broadcast_to(totals, before.shape))]
            if key in found:
                found[key][0] += np.stack(sums)
            else:
                found[key] = [np.stack(sums), totals]

        def close():
            nonlocal last
            if last is not None:
                key, running, totals = cell
                add(key, last[1][None, :], running[None, :], totals)
                running += last[1]
                last = None

        for batch in batches:
            table, column = batch["_t"].to_numpy(), batch["_i"].to_numpy()
            heads = np.flatnonzero(batch["_score"].is_null().to_numpy(zero_copy_only=False))
            score, code = batch["_score"].to_numpy(zero_copy_only=False), batch["_code"].to_numpy(zero_copy_only=False)
            edges = np.unique(np.r_[0, heads, batch.num_rows])
            opens = set(heads.tolist())
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if a in opens:
                    close()
                    offsets = np.asarray(batch["_sums"][int(a)].as_py(), dtype=np.float64)
                    cell = ((int(table[a]), int(column[a])), offsets[: 2 * width].copy(), offsets[2 * width :])
                    a += 1
                    if a == b:
                        continue
                s, c = score[a:b], code[a:b].astype(np.int64)
                starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
                counts, values = _counts(c, starts, parts), s[starts]
                if last is not None and last[0] == values[0]:
                    counts[0] += last[1]
                    last = None
                close()
                key, running, totals = cell
                if len(counts) > 1:
                    done = counts[:-1]
                    upto = np.cumsum(done, axis=0)
                    add(key, done, running + upto - done, totals)
                    running += upto[-1]
                last = (values[-1], counts[-1])
        close()
        for (t, i), (sums, totals) in found.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([t] * width, pa.int32()), pa.array([i] * width, pa.int32()), pa.array(range(width), pa.int32()),
                 pa.array(totals[:width]), pa.array(totals[width:]), *[pa.array(x) for x in sums]],
                names=["_t", "_i", "_series", "_n", "_pos", "_ap", "_wins", *[f"_h{j}" for j in range(len(fractions))]],
            )

    return run


def packed_ranking(
    rows: DataFrame,
    keys: Sequence[str],
    scores: dict[str, Column],
    members: dict[str, int],
    label: str,
    review_fractions: Sequence[float] = (),
) -> DataFrame:
    """Ranking sums per key, score column, member column and part.

    ``members`` names integer columns and their number of parts: a row is in part
    0, 1, ... of a member, or null in none. The label is 0 or 1. Rows without a
    finite score or label are left out. Returns keys, profile, member, part,
    total_n, total_pos, auroc, auprc and ``hits``, an array with (review_fraction,
    _size, _hits).
    """
    keys, names, parts = list(keys), list(scores), list(members.values())
    ids = table_ids(rows, keys)
    code, place = F.col(label).cast("bigint"), 2
    for name, p in members.items():
        code = code + F.coalesce(F.col(name).cast("bigint") + 1, F.lit(0)) * place
        place *= p + 1
    if place > 2**62:
        raise ValueError("too many members for one code")
    same = [F.col(f"_k{i}").eqNullSafe(F.col(k)) for i, k in enumerate(keys)]
    named = ids.select("_t", *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    on = same[0]
    for c in same[1:]:
        on = on & c
    # one row per table
    wide = rows.where(is_finite(F.col(label))).join(F.broadcast(named), on).select(
        F.col("_t").cast("int").alias("_t"), code.alias("_code"),
        *[F.when(is_finite(s), s.cast("double") + 0.0).alias(f"_s{i}") for i, s in enumerate(scores.values())],
    )
    wide = cut(wide.where(F.col("_code") > 1), "packed-rows")
    celled = wide.select(
        "_t", "_code", *[magnitude_cell(F.col(f"_s{i}"), CELLS_PER_OCTAVE).alias(f"_c{i}") for i in range(len(names))]
    )
    width = 2 * sum(parts)
    cells = celled.mapInArrow(_cell_totals(parts, len(names)), "_t int, _i int, _cell bigint, _sums array<bigint>")
    each = lambda c: [F.sum(F.col(c)[j]).alias(f"n{j}") for j in range(width)]
    cells = cells.groupBy("_t", "_i", "_cell").agg(*each("_sums"))
    whole = Window.partitionBy("_t", "_i")
    before = whole.orderBy(F.col("_cell").desc()).rowsBetween(Window.unboundedPreceding, -1)
    heads = cells.select(
        "_t", "_i", "_cell", F.lit(None).cast("double").alias("_score"), F.lit(None).cast("bigint").alias("_code"),
        F.array(*[F.coalesce(F.sum(f"n{j}").over(before), F.lit(0)) for j in range(width)],
                *[F.sum(f"n{j}").over(whole) for j in range(width)]).alias("_sums"),
    )
    items = F.array(*[F.struct(F.lit(i).alias("_i"), F.col(f"_s{i}").alias("_score")) for i in range(len(names))])
    long = wide.select("_t", "_code", F.explode(items).alias("_x")).where("_x._score is not null")
    long = long.select(
        "_t", F.col("_x._i").alias("_i"), magnitude_cell(F.col("_x._score"), CELLS_PER_OCTAVE).alias("_cell"),
        F.col("_x._score").alias("_score"), "_code", F.lit(None).cast("array<bigint>").alias("_sums"),
    )
    ordered = long.unionByName(heads).repartition("_t", "_i", "_cell").sortWithinPartitions(
        "_t", "_i", "_cell", F.col("_score").desc_nulls_first()
    )
    hits = [f"_h{j}" for j in range(len(review_fractions))]
    found = ordered.mapInArrow(
        _ordered_terms(parts, list(review_fractions)),
        ", ".join(["_t int, _i int, _series int, _n double, _pos double, _ap double, _wins double", *[f"{h} double" for h in hits]]),
    )
    sums = found.groupBy("_t", "_i", "_series").agg(
        F.max("_n").cast("bigint").alias("total_n"), F.max("_pos").alias("total_pos"),
        *[F.sum(c).alias(c) for c in ("_ap", "_wins", *hits)],
    ).where("total_n > 0")
    n, pos = F.col("total_n"), F.col("total_pos")
    both = (pos > 0) & (pos < n)
    size = lambda f: F.when(n > 1, F.least(F.greatest(F.rint(n * f).cast("bigint"), F.lit(1)), n - 1)).otherwise(n)
    reviews = [
        F.struct(F.lit(float(f)).alias("review_fraction"), size(float(f)).alias("_size"), F.col(h).alias("_hits"))
        for f, h in zip(review_fractions, hits)
    ]
    places = [(m, i) for m, p in members.items() for i in range(p)]
    at = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("_series") + 1)
    out = sums.select(
        "_t", F.element_at(F.array(*[F.lit(x) for x in names]), F.col("_i") + 1).alias("profile"),
        at([m for m, _ in places]).alias("member"), at([i for _, i in places]).alias("part"), "total_n", "total_pos",
        F.when(both, F.try_divide(F.col("_wins"), pos * (n - pos))).alias("auroc"),
        F.when(both, F.try_divide(F.col("_ap"), pos)).alias("auprc"),
        *([F.array(*reviews).alias("hits")] if reviews else []),
    )
    return out.join(F.broadcast(ids), "_t").drop("_t")
