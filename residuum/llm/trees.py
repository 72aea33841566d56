"""Spark ML tree ensembles trained on bounded samples and scored as SQL expressions.

A fitted ensemble is turned into nested CASE expressions, so it can score
candidates inside an array of one text: no exploding, no shuffle, no Python.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residuum.storage import cut

_SPLIT = re.compile(r"If \(feature (\d+) <= (-?[\d.eE+-]+)\)")
_LEAF = re.compile(r"Predict: (-?[\d.eE+-]+)")


@dataclass
class Ensemble:
    """Weighted trees; ``boosted`` gives the logistic of twice the sum, otherwise the share of votes."""

    trees: list[tuple[float, object]]
    boosted: bool

    def score(self, feature: Callable[[int], Column]) -> Column:
        total = reduce(lambda a, b: a + b, [F.lit(w) * _case(t, feature) for w, t in self.trees])
        return 1 / (1 + F.exp(-2 * total)) if self.boosted else total


def _case(tree, feature: Callable[[int], Column]) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    index, bound, left, right = tree
    return F.when(feature(index) <= bound, _case(left, feature)).otherwise(_case(right, feature))


def parse(text: str):
    """Nested (feature, bound, left, right) of a printed tree."""
    lines = [x.strip() for x in text.splitlines()]
    lines = [x for x in lines if x.startswith(("If", "Else", "Predict"))]

    def node(i: int):
        leaf = _LEAF.match(lines[i])
        if leaf:
            return float(leaf[1]), i + 1
        split = _SPLIT.match(lines[i])
        left, i = node(i + 1)
        right, i = node(i + 1)  # past Else
        return (int(split[1]), float(split[2]), left, right), i

    return node(0)[0]


def _prepared(sample: DataFrame, features: Sequence[str], label: str) -> tuple[DataFrame, float | None]:
    """Assembled rows; the share of label 1 where only one label is there."""
    rows = VectorAssembler(inputCols=list(features), outputCol="x", handleInvalid="keep").transform(
        sample.select(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features], F.col(label).cast("double").alias("y"))
    ).select("x", "y")
    rows = rows.persist()
    ones, n = rows.agg(F.sum("y"), F.count("*")).first()
    only = None if n and 0 < ones < n else (float(ones or 0) / n if n else 0.0)
    return rows, only


def fit_boosted(sample: DataFrame, features: Sequence[str], label: str, rounds: int = 20, depth: int = 3, seed: int = 7) -> Ensemble:
    """Gradient-boosted trees; with one label only, or no row, a constant."""
    rows, only = _prepared(sample, features, label)
    try:
        if only is not None:
            return Ensemble([(1.0, 2.0 if only else -2.0)], True)
        model = GBTClassifier(featuresCol="x", labelCol="y", maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=seed).fit(rows)
        return Ensemble([(float(w), parse(t.toDebugString)) for w, t in zip(model.treeWeights, model.trees)], True)
    finally:
        rows.unpersist()


def fit_forest(sample: DataFrame, features: Sequence[str], label: str, trees: int = 30, depth: int = 6, seed: int = 7) -> Ensemble:
    """Random forest by votes; with one label only, or no row, a constant."""
    rows, only = _prepared(sample, features, label)
    try:
        if only is not None:
            return Ensemble([(1.0, 1.0 if only else 0.0)], False)
        model = RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=trees, maxDepth=depth, seed=seed).fit(rows)
        return Ensemble([(1.0 / trees, parse(t.toDebugString)) for t in model.trees], False)
    finally:
        rows.unpersist()


def thresholds(scored: DataFrame, kinds: Sequence[str], precision: float, steps: int = 50) -> dict[str, float]:
    """Per kind the lowest score from which at least ``precision`` of the rows (kind, score, y) have y = 1; 2.0 where none."""
    cells = scored.groupBy("kind", F.floor(F.col("score") * steps).cast("int").alias("cell")).agg(F.sum("y").alias("ones"), F.count("*").alias("n"))
    by: dict[str, list] = {}
    for r in cells.where(F.col("kind").isin(list(kinds))).collect():  # kinds x steps rows at most
        by.setdefault(r["kind"], []).append((r["cell"], r["ones"], r["n"]))
    out = {}
    for kind in kinds:
        ones = n = 0
        best = 2.0
        for cell, a, b in sorted(by.get(kind, []), reverse=True):
            ones, n = ones + a, n + b
            if ones >= precision * n:
                best = cell / steps
        out[kind] = best
    return out


def few_files(rows: DataFrame, label: str) -> DataFrame:
    """The rows of a bounded sample: computed and written at full width, then read into few partitions."""
    return cut(rows, label).coalesce(6)


def bounded(frame: DataFrame, key: str, rows: int) -> DataFrame:
    """About ``rows`` rows of ``frame``, chosen by a hash of ``key``; all of a smaller table. For training only."""
    n = frame.count()
    if n <= rows:
        return frame
    return frame.where(F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(29)), F.lit(1_000_000)) < int(1_000_000 * rows / n))
