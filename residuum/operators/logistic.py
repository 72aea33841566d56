"""Logistic fits for many groups at once.

Groups below a row limit are solved where their rows meet, one task per group.
Larger groups never meet in one task: each pass sums gradients and Hessians
inside the tasks, merges them per group, and takes the next Newton step. Both
ways minimise 0.5*|w|^2 + C*sum(weight*loss) with a free intercept, to the same
optimum.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from residuum.functions.columns import sigmoid
from residuum.storage import cut

LOCAL_ROWS = 100_000
MAX_STEPS = 60
TOLERANCE = 1.0e-9
#: Largest ``gradient_norm`` of a fit that counts as converged.
CONVERGED = 1.0e-6
PLATT_C = 1.0e6


def curvature(x: np.ndarray, y: np.ndarray, w: np.ndarray, beta: np.ndarray, offset: np.ndarray | float = 0.0):
    """Loss, gradient and Hessian of the weighted log loss; the intercept comes last."""
    z = x @ beta[:-1] + beta[-1] + offset
    p = 1.0 / (1.0 + np.exp(-np.clip(z, -500.0, 500.0)))
    loss = float(np.sum(w * (np.logaddexp(0.0, z) - y * z)))
    residual, weight = w * (p - y), w * p * (1.0 - p)
    gradient = np.append(x.T @ residual, residual.sum())
    side = x.T @ weight
    hessian = np.empty((len(beta), len(beta)))
    hessian[:-1, :-1] = (x * weight[:, None]).T @ x
    hessian[-1, :-1] = hessian[:-1, -1] = side
    hessian[-1, -1] = weight.sum()
    return loss, gradient, hessian


class Newton:
    """Damped Newton state of one fit; fed with merged sums at ``point``."""

    def __init__(self, size: int, c: float):
        self.c, self.kept, self.best = c, np.zeros(size + 1), np.inf
        self.move, self.scale, self.done, self.steps = np.zeros(size + 1), 1.0, False, 0

    @property
    def point(self) -> np.ndarray:
        return self.kept + self.scale * self.move

    def feed(self, loss: float, gradient: np.ndarray, hessian: np.ndarray) -> None:
        here = self.point
        value = self.c * loss + 0.5 * float(here[:-1] @ here[:-1])
        self.steps += 1
        if value > self.best + 1e-10 * abs(self.best) and self.scale > 1e-6:
            self.scale /= 2.0
            self.done = self.steps >= MAX_STEPS
            return
        ridge = np.append(np.ones(len(here) - 1), 0.0)
        g = self.c * gradient + ridge * here
        h = self.c * hessian + np.diag(ridge + 1e-12 * self.c)
        self.kept, self.best, self.scale = here, min(value, self.best), 1.0
        try:
            self.move = -np.linalg.solve(h, g)
        except np.linalg.LinAlgError:
            self.move = -np.linalg.lstsq(h, g, rcond=None)[0]
        small = np.abs(self.move).max() < TOLERANCE * (1.0 + np.abs(here).max())
        if small:
            self.kept, self.move = here + self.move, np.zeros_like(here)
        self.done = small or self.steps >= MAX_STEPS


def solve(x: np.ndarray, y: np.ndarray, w: np.ndarray, c: float) -> np.ndarray:
    state = Newton(x.shape[1], c)
    while not state.done:
        state.feed(*curvature(x, y, w, state.point))
    return state.kept


def gradient_norm(gradient: np.ndarray, beta: np.ndarray, weight: float, c: float) -> float:
    """Largest entry of the objective's gradient, a unit of weight: the certificate of a fit."""
    full = c * gradient + np.append(beta[:-1], 0.0)
    return float(np.abs(full).max() / max(c * weight, 1e-300))


def solve_spread(
    rows: DataFrame, keys: Sequence[str], problems: dict[tuple, dict[str, list[int]]], c: float | dict[tuple, float],
    norms: dict | None = None,
) -> dict[tuple, dict[str, np.ndarray]]:
    """Newton fits over rows that stay where they are.

    ``rows``: keys, x array<double>, y, w, and o where a logit is added that no fit changes. ``problems`` names, per key,
    the fits and the positions of x each one uses; each must have rows. ``c`` may differ by key. Only coefficients reach the driver. One more pass puts
    each fit's ``gradient_norm`` at its coefficients into ``norms`` where given.
    """
    keys, fits_of = list(keys), list(problems)
    c_of = c if isinstance(c, dict) else dict.fromkeys(fits_of, c)
    states = [{name: Newton(len(idx), c_of[k]) for name, idx in problems[k].items()} for k in fits_of]
    columns = [list(problems[k].items()) for k in fits_of]
    # rows carry the number of their fit: tasks group numbers, not keys, and read x as one block
    number = rows.sparkSession.createDataFrame(
        [(*k, i) for i, k in enumerate(fits_of)], T.StructType([*[rows.schema[k] for k in keys], T.StructField("_fit", T.IntegerType())]))
    numbers = ["y", "w", *[k for k in rows.columns if k == "o"]]
    rows = rows.join(F.broadcast(number), keys).select("_fit", "x", *[F.col(k).cast("double").alias(k) for k in numbers])
    sums_type = "_fit int, _name string, loss double, gradient array<double>, hessian array<double>, weight double"
    next_type = "_fit int, _name string, best double, kept array<double>, move array<double>, scale double, done boolean"
    while True:
        open_points = {i: {n: s.point for n, s in fits.items() if not s.done} for i, fits in enumerate(states)}
        open_points = {i: v for i, v in open_points.items() if v}
        last = not open_points
        if last:
            solved = {k: {n: s.kept for n, s in fits.items()} for k, fits in zip(fits_of, states)}
            if norms is None or not any(solved.values()):
                return solved
            open_points = {i: solved[k] for i, k in enumerate(fits_of) if solved[k]}

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals: dict = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                fit, y, w, *more = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns) if i != 1)
                whole = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(fit), -1)
                order = np.argsort(fit, kind="stable")
                starts = np.flatnonzero(np.append(True, fit[order][1:] != fit[order][:-1]))
                for begin, end in zip(starts, [*starts[1:], len(fit)]):
                    at, i = order[begin:end], int(fit[order[begin]])
                    if i not in open_points:
                        continue
                    x, own_y, own_w = whole[at], y[at], w[at]
                    offset = more[0][at] if more else 0.0
                    for name, idx in columns[i]:
                        if name not in open_points[i]:
                            continue
                        got = (*curvature(x[:, idx], own_y, own_w, open_points[i][name], offset), float(own_w.sum()))
                        old = totals.get((i, name))
                        totals[(i, name)] = got if old is None else tuple(a + b for a, b in zip(old, got))
            if totals:
                loss, gradient, hessian, weight = zip(*totals.values())
                doubles = pa.list_(pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i for i, _ in totals], pa.int32()), pa.array([n for _, n in totals]), pa.array(loss, pa.float64()),
                     pa.array(list(gradient), doubles), pa.array([h.ravel() for h in hessian], doubles), pa.array(weight, pa.float64())],
                    ["_fit", "_name", "loss", "gradient", "hessian", "weight"])

        if last:
            entry = F.posexplode("gradient").alias("i", "g")
            sums = rows.mapInArrow(partial, sums_type).select("_fit", "_name", "weight", entry)
            for r in sums.groupBy("_fit", "_name", "i").agg(F.sum("g").alias("g"), F.sum("weight").alias("weight")).collect():
                key, name = fits_of[r["_fit"]], r["_name"]
                norms.setdefault(key, {}).setdefault(name, [np.zeros(len(solved[key][name])), 0.0])[0][r["i"]] = r["g"]
                norms[key][name][1] = r["weight"]
            for key, fits in norms.items():
                norms[key] = {n: gradient_norm(g, solved[key][n], weight, c_of[key]) for n, (g, weight) in fits.items()}
            return solved

        def merge(part: pd.DataFrame) -> pd.DataFrame:
            i, name = int(part["_fit"].iloc[0]), part["_name"].iloc[0]
            g = np.sum(np.stack(part["gradient"].to_numpy()), axis=0)
            h = np.sum(np.stack(part["hessian"].to_numpy()), axis=0)
            state = states[i][name]
            state.feed(float(part["loss"].sum()), g, h.reshape(len(g), len(g)))
            return pd.DataFrame(
                [(i, name, state.best, state.kept, state.move, state.scale, state.done)],
                columns=["_fit", "_name", "best", "kept", "move", "scale", "done"],
            )

        # one row of coefficients per fit comes back: the size of the grid, not of the data
        moved = rows.mapInArrow(partial, sums_type).groupBy("_fit", "_name").applyInPandas(merge, next_type)
        for r in moved.collect():
            state = states[r["_fit"]][r["_name"]]
            state.best, state.scale, state.done = r.best, r.scale, bool(r.done)
            state.kept, state.move, state.steps = np.asarray(r.kept), np.asarray(r.move), state.steps + 1
            state.done = state.done or state.steps >= MAX_STEPS


def split_by_size(rows: DataFrame, keys: Sequence[str], limit: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of groups up to ``limit`` rows, and those of larger groups (None if there are none)."""
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    large = sizes.where(F.col("_n") > limit).select(*keys)
    if large.isEmpty():
        return rows, None
    large = cut(large, "large-groups")
    return rows.join(large, list(keys), "left_anti"), rows.join(large, list(keys), "left_semi")


def fit_platt(
    rows: DataFrame, keys: Sequence[str], logit: str, label: str, limit: int = LOCAL_ROWS, c: float = PLATT_C,
    copies: str | None = None,
) -> DataFrame:
    """Slope and intercept of label on logit per group.

    Equal rows are merged first and weigh as many as they are; ``copies`` names a count of
    rows that are merged already. Groups with fewer than four usable rows or a single class
    have no row.
    """
    keys = list(keys)
    number = F.lit(1) if copies is None else F.col(copies)
    usable = rows.select(*keys, F.col(logit).alias("v"), F.col(label).cast("double").alias("y"), number.alias("w")).where(
        "v is not null and y is not null"
    )
    # the sizes and the fits read the merged rows
    usable = cut(usable.groupBy(*keys, "v", "y").agg(F.sum("w").cast("double").alias("w")), "platt-values")
    small, large = split_by_size(usable, keys, limit)
    out_type = T.StructType(
        [*[usable.schema[k] for k in keys], *T.StructType.fromDDL("slope double, intercept double, fit_n bigint").fields]
    )

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        y, w = part["y"].to_numpy(), part["w"].to_numpy()
        if w.sum() < 4 or y.min() == y.max():
            return pd.DataFrame([], columns=out_type.names)
        beta = solve(part[["v"]].to_numpy(), y, w, c)
        return pd.DataFrame([(*part[keys].iloc[0], beta[0], beta[1], int(w.sum()))], columns=out_type.names)

    fits = small.groupBy(*keys).applyInPandas(fit, out_type)
    if large is None:
        return fits
    spread = cut(large.select(*keys, F.array("v").alias("x"), "y", "w"), "platt-rows")
    classes = large.groupBy(*keys).agg(F.min("y").alias("lo"), F.max("y").alias("hi"), F.sum("w").cast("bigint").alias("n"))
    sizes = {tuple(r[k] for k in keys): r.n for r in classes.where("lo < hi").collect()}
    solved = solve_spread(spread, keys, {k: {"platt": [0]} for k in sizes}, c)
    table = [(*k, float(v["platt"][0]), float(v["platt"][1]), sizes[k]) for k, v in solved.items()]
    return fits.unionByName(rows.sparkSession.createDataFrame(table, out_type))


def platt_probability(logit: Column) -> Column:
    """Probability under the joined slope and intercept."""
    return sigmoid(F.col("slope") * logit + F.col("intercept"))
