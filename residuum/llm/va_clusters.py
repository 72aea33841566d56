"""Centroid clustering over a vector approximation file.

Each component of a vector falls into one of ``2 ** bits`` cells of its dimension;
the approximation file holds only these few bits. For a centroid, a table gives
the least and the greatest value that each cell adds to the squared distance, and
their sums over the dimensions bound it. All distances are taken less the distance to one
reference point between the centroids: that term is the same for all, and without it the
intervals are narrow. A vector whose best interval lies below all others is assigned by its cells alone; full vectors are fetched only where
intervals overlap, or where a vector changes its cluster and its components must
move from one sum to the other. All arithmetic is in integers, so results do
not depend on partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residuum.storage import cut

#: Bits of a component in the approximation file: 1, 2, 4 or 8, so that a byte holds whole components.
BITS = 8
#: Integer steps of a component of size one; components beyond ``REACH`` steps have no exact 64-bit distance.
SCALE, REACH = 1024, 1 << 27
#: Vectors that choose the limits of the cells (about; drawn by a hash of the key). Any limits give exact results.
SAMPLE = 20_000
#: Vectors fetched by keys sent to the tasks; where more intervals overlap, cells and vectors are read side by side.
FETCHED = 500_000
#: Bound on table entries gathered at once.
BLOCK = 8192


@dataclass
class Store:
    """The written files: (key, id, cells) is the approximation, (key, vector) the rest; and the limits of the cells."""

    table: DataFrame
    limits: np.ndarray  # (dims, 2 ** bits - 1): a component's cell is the number of limits not above it
    low: np.ndarray
    high: np.ndarray
    bits: int = BITS

    @property
    def dims(self) -> int:
        return len(self.low)

    @property
    def width(self) -> int:
        """Bytes of an approximation."""
        return -(-self.dims * self.bits // 8)


def integers(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(mask, matrix): which rows are kept, and floor(SCALE * x) of their components."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), dims), False)
    flat = column.filter(fits).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null component comes as NaN
    x = np.floor(flat.reshape(-1, dims) * float(SCALE))
    good = (np.abs(x) <= REACH).all(axis=1)
    mask = fits.to_numpy(zero_copy_only=False).copy()
    mask[mask] = good
    return mask, x[good].astype(np.int64)


def vectors_of(column: pa.Array, dims: int) -> np.ndarray:
    """The matrix in a column of packed vectors."""
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(-1, dims).astype(np.int64)


def cells_of(x: np.ndarray, limits: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Packed cells of each row of ``x``, several to a byte."""
    cells = np.stack([np.searchsorted(limits[d], x[:, d], "right") for d in range(x.shape[1])], axis=1).astype(np.uint8)
    per = 8 // bits
    cells = np.pad(cells, ((0, 0), (0, -x.shape[1] % per)))
    out = np.zeros((len(x), cells.shape[1] // per), np.uint8)
    for j in range(per):
        out |= cells[:, j::per] << np.uint8(j * bits)
    return out


def bound_tables(centroids: np.ndarray, store: Store) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest): (bytes of an approximation, 256, centroids), what each byte's components add to the squared
    distance to a centroid less that to the reference point r. A component x adds (x - c)^2 - (x - r)^2, which is linear in x."""
    per = 8 // store.bits
    low = np.concatenate([store.low[:, None], store.limits], axis=1)
    high = np.concatenate([store.limits - 1, store.high[:, None]], axis=1)
    low, high = np.maximum(low, store.low[:, None]), np.minimum(high, store.high[:, None])
    r = (centroids.sum(axis=0) // len(centroids))[:, None, None]
    c = centroids.T[:, None, :]  # dims, 1, centroids
    one, other = ((r - c) * (2 * x[:, :, None] - c - r) for x in (low, high))
    byte = np.arange(256)
    out = []
    for ends in (np.minimum(one, other), np.maximum(one, other)):
        ends = np.pad(ends, ((0, store.width * per - store.dims), (0, 0), (0, 0)))
        out.append(sum(ends[j::per][:, (byte >> (j * store.bits)) & ((1 << store.bits) - 1)] for j in range(per)))
    return out[0], out[1]


def by_cells(cells: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Cluster of each approximation, -1 where intervals overlap. Of equal distances the smaller number wins."""
    found = np.empty(len(cells), np.int64)
    count = tables[0].shape[2]
    number = np.arange(count)
    for begin in range(0, len(cells), BLOCK):
        part = cells[begin : begin + BLOCK]
        least, greatest = np.zeros((len(part), count), np.int64), np.zeros((len(part), count), np.int64)
        for j in range(part.shape[1]):
            least += tables[0][j][part[:, j]]
            greatest += tables[1][j][part[:, j]]
        best = greatest.argmin(axis=1)
        most = greatest[np.arange(len(part)), best][:, None]
        clear = (least > most) | ((least == most) & (number > best[:, None])) | (number == best[:, None])
        found[begin : begin + BLOCK] = np.where(clear.all(axis=1), best, -1)
    return found


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of full vectors; ties go to the smaller number."""
    far = np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    best = far.argmin(axis=1)
    return best, far[np.arange(len(x)), best]


def build(vectors: DataFrame, dims: int, id_col: str = "vec_id", vector_col: str = "embedding", bits: int = BITS) -> Store:
    """Write the kept vectors with their cells, and return the files with their limits.

    Kept are vectors of exactly ``dims`` components, none null, not finite or beyond ``REACH`` steps.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask, x = integers(batch.column(1), dims)
            rows = [r.tobytes() for r in x.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(mask)), pa.array(rows, pa.binary())], ["id", "vector"])

    used = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    whole = cut(used.mapInArrow(pack, "id long, vector binary").withColumn("key", F.monotonically_increasing_id()), "va-vectors")

    def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        n, low, high = 0, np.full(dims, REACH), np.full(dims, -REACH)
        for batch in batches:
            if batch.num_rows:
                x = vectors_of(batch.column(0), dims)
                n, low, high = n + len(x), np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
        d = np.arange(dims)
        yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(np.full(dims, n)), pa.array(low), pa.array(high)], ["d", "n", "low", "high"])

    ends = whole.select("vector").mapInArrow(extremes, "d long, n long, low long, high long").groupBy("d").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect()
    ends = sorted(ends, key=lambda r: r["d"])
    n = ends[0]["n"] if ends else 0
    share = min(1.0, SAMPLE / max(n, 1))
    drawn = whole.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(share * (1 << 30))).select("vector") if n else whole.limit(0)
    some = np.frombuffer(b"".join(bytes(r["vector"]) for r in drawn.collect()), np.int32).reshape(-1, dims)
    steps = np.arange(1, 1 << bits) / (1 << bits)
    limits = np.quantile(some, steps, axis=0, method="higher").T.astype(np.int64) if len(some) else np.zeros((dims, len(steps)), np.int64)
    low = np.array([r["low"] for r in ends] or [0] * dims, np.int64)
    high = np.array([r["high"] for r in ends] or [0] * dims, np.int64)

    def approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = vectors_of(batch.column(2), dims)
            cells = [r.tobytes() for r in cells_of(x, limits, bits)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.binary())], ["key", "id", "vector", "cells"])

    table = cut(whole.select("key", "id", "vector").mapInArrow(approximate, "key long, id long, vector binary, cells binary"), "va-file")
    return Store(table, limits, low, high, bits)


def unclear(store: Store, before: np.ndarray | None, now: np.ndarray) -> DataFrame:
    """(key) of the vectors whose full components a round needs: cells that leave a cluster open, or that move."""
    tables = None if before is None else bound_tables(before, store)
    own = bound_tables(now, store)
    width = store.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, width)
            a, b = by_cells(cells, tables), by_cells(cells, own)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array((a < 0) | (b < 0) | (a != b)))], ["key"])

    return store.table.select("key").limit(0) if not len(now) else (
        store.table.select("key") if before is None else store.table.select("key", "cells").mapInArrow(run, "key long"))


def moved(store: Store, fetched: DataFrame, before: np.ndarray | None, now: np.ndarray) -> DataFrame:
    """(cluster, d, change): what the vectors that change their cluster add to the sums of both; d = dims counts them."""
    dims, count = store.dims, len(now)
    tables = None if before is None else (bound_tables(before, store), bound_tables(now, store))
    width = store.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = np.zeros((count, dims + 1), np.int64)
        seen = 0
        for batch in batches:
            rows = batch.column(0)
            if tables is not None:
                cells = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, width)
                a, b = (by_cells(cells, t) for t in tables)
                rows = rows.filter(pa.array((a < 0) | (b < 0) | (a != b)))
            if not len(rows):
                continue
            x = vectors_of(rows, dims)
            new = nearest(x, now)[0]
            old = np.full(len(x), -1) if before is None else nearest(x, before)[0]
            for j in range(count):
                for sign, where in ((1, (new == j) & (old != j)), (-1, (old == j) & (new != j))):
                    if where.any():
                        change[j, :dims] += sign * x[where].sum(axis=0)
                        change[j, dims] += sign * int(where.sum())
            seen += len(x)
            if seen > 1 << 30:  # sums of a task stay within 64 bits
                yield out(change)
                change[:], seen = 0, 0
        yield out(change)

    def out(change: np.ndarray) -> pa.RecordBatch:
        cluster, d = np.nonzero(change)
        return pa.RecordBatch.from_arrays([pa.array(cluster), pa.array(d), pa.array(change[cluster, d])], ["cluster", "d", "change"])

    parts = fetched.select("vector", "cells").mapInArrow(run, "cluster long, d long, change long")
    return parts.groupBy("cluster", "d").agg(F.sum(F.col("change").cast("decimal(38,0)")).alias("change"))


def round_of(store: Store, before: np.ndarray | None, now: np.ndarray, fetch: int = FETCHED) -> tuple[DataFrame, int]:
    """Changes of the sums from the assignment by ``before`` to that by ``now``, and how many vectors were fetched (-1: all read)."""
    keys = unclear(store, before, now)
    if before is None:
        return moved(store, store.table, before, now), -1
    keys = cut(keys, "va-keys")
    wanted = keys.count()
    if wanted > fetch:
        return moved(store, store.table, before, now), wanted
    return moved(store, store.table.join(F.broadcast(keys), "key", "left_semi"), before, now), wanted


def cluster(
    vectors: DataFrame, dims: int = 64, k: int = 8, rounds: int = 10, seed: str = "3", id_col: str = "vec_id", vector_col: str = "embedding",
    bits: int = BITS, fetch: int = FETCHED, report: list | None = None,
) -> tuple[DataFrame, np.ndarray]:
    """Assignments (id, cluster, distance) of the kept vectors after ``rounds`` rounds, and the centroids.

    Kept are vectors of exactly ``dims`` components, none null, not finite, or larger than 131,072 (whose squared
    distances have no exact 64-bit value); components count as floor(1024 * x). Centroids start as the ``k`` vectors with the smallest hexadecimal
    sha256 of ``seed:id`` (a null id counts as an empty text; of equal ids the smaller
    components), fewer if there are not so many. Each round assigns all vectors to the nearest centroid (ties: smaller
    number) and moves every non-empty centroid to the floor of its mean. Repeated rows count each for itself and keep their
    row; other columns are ignored; an empty table gives no row and no centroid. ``report`` gets the number of vectors fetched in each round.
    """
    store = build(vectors, dims, id_col, vector_col, bits)
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = store.table.select("vector", name.alias("name")).orderBy("name", "vector").limit(k).collect()
    now = np.array([np.frombuffer(bytes(r["vector"]), np.int32) for r in first], np.int64).reshape(-1, dims)
    before: np.ndarray | None = None
    sums = [[0] * (dims + 1) for _ in now]
    for _ in range(rounds if len(now) else 0):
        if before is not None and (before == now).all():
            break  # nothing moved: all further rounds repeat this one
        changes, fetched = round_of(store, before, now, fetch)
        if report is not None:
            report.append(fetched)
        for r in changes.collect():  # k * (dims + 1) rows at most
            sums[r["cluster"]][r["d"]] += int(r["change"])
        before = now
        now = np.array([[s // own[dims] for s in own[:dims]] if own[dims] else list(c) for own, c in zip(sums, now)], np.int64)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, far = nearest(vectors_of(batch.column(1), dims), now)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.int32()), pa.array(far)], ["id", "cluster", "distance"])

    kept = store.table.select("id", "vector")
    return (kept if len(now) else kept.limit(0)).mapInArrow(assign, "id long, cluster int, distance long"), now
