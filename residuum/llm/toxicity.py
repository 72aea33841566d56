"""Toxicity by a convolutional text classifier trained in numpy.

A word is the sum of hashed embeddings of itself and of its beginnings, so forms
of one stem share weight. Filters of widths 1, 2 and 3 run over the words, each
keeps its maximum over the whole text, and a linear layer gives the score.

Training takes a bounded sample of labelled rows (``MAX_LABELLED``); scoring is a
narrow pass over all texts. As a filter is linear before its maximum, every
distinct word is projected once per task and a text only adds and compares rows of
that table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residuum.llm.text import texts, words

#: Labelled rows used for training: half of them at most with label 1.
MAX_LABELLED = 4000
BUCKETS = 1 << 15
SIZE = 16
FILTERS = 12
WIDTHS = (1, 2, 3)
EPOCHS = 5
BATCH = 32
#: Score that the decision threshold of the training rows is mapped to.
CUT = 0.3
#: Words a task keeps projected before it starts anew.
TASK_WORDS = 150_000
_STRIP = b".,;:!?\"'()[]{}#*$%&|<>"


def word_features(word: bytes) -> list[int]:
    """Buckets of the word and of its proper beginnings of 3 to 8 characters; bucket 0 is left for padding.

    A beginning counts only where the word goes on, so a stem that is harmless alone differs from its derived forms.
    """
    plain = word.strip(_STRIP).decode("utf-8", "replace").lower()
    grams = ["=" + plain] + [plain[:k] for k in range(3, min(9, len(plain)))]
    return [1 + xxhash.xxh3_64_intdigest(g.encode("utf-8", "replace")) % (BUCKETS - 1) for g in grams]


class Ragged:
    """Rows of unequal length (one or more) in one flat array."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        self.flat, self.sizes = flat, sizes

    @classmethod
    def of(cls, rows: list[list[int]]) -> Ragged:
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        return cls(np.fromiter((v for r in rows for v in r), np.int64, int(sizes.sum())), sizes)

    def take(self, rows: np.ndarray) -> Ragged:
        sizes = self.sizes[rows]
        ends = np.cumsum(sizes)
        begin = (np.cumsum(self.sizes) - self.sizes)[rows]
        return Ragged(self.flat[np.repeat(begin - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)], sizes)


@dataclass
class Model:
    embed: np.ndarray  # buckets x size
    filters: list[np.ndarray]  # per width: width x size x filters
    bias: list[np.ndarray]
    out: np.ndarray
    offset: float
    scale: float = 1.0
    shift: float = 0.0

    def word_vectors(self, features: Ragged) -> np.ndarray:
        starts = np.cumsum(features.sizes) - features.sizes
        return np.add.reduceat(self.embed[features.flat], starts, axis=0) / features.sizes[:, None].astype(np.float32)

    def probability(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * (raw - self.shift) + np.log(CUT / (1 - CUT)), -40, 40)))


class Projected(dict):
    """Row of each word in the projected tables of a model; row 0 is padding."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.tables, self.waiting = model, None, []
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.waiting = []
        self.used = 1
        self.tables = [[np.zeros((1024, f.shape[2]), np.float32) for _ in range(f.shape[0])] for f in self.model.filters]

    def __missing__(self, word: bytes) -> int:
        self.waiting.append(word)
        row = self[word] = self.used + len(self.waiting) - 1
        return row

    def settle(self) -> None:
        if not self.waiting:
            return
        x = self.model.word_vectors(Ragged.of([word_features(w) for w in self.waiting]))
        end = self.used + len(x)
        for f, tables in zip(self.model.filters, self.tables):
            for j in range(f.shape[0]):
                if end > len(tables[j]):
                    tables[j] = np.concatenate([tables[j], np.zeros((end, f.shape[2]), np.float32)])
                tables[j][self.used : end] = x @ f[j]
        self.used, self.waiting = end, []


def raw_score(tokens: list[bytes], seen: Projected) -> float:
    """Output of the network for one whole text."""
    if seen.used > TASK_WORDS:
        seen.reset()
    m, pad = seen.model, len(WIDTHS) - 1
    rows = np.zeros(max(len(tokens), 1) + pad, np.int64)
    rows[: len(tokens)] = np.fromiter(map(seen.__getitem__, tokens), np.int64, len(tokens))
    seen.settle()
    n, total, place = max(len(tokens), 1), m.offset, 0
    for f, bias, tables in zip(m.filters, m.bias, seen.tables):
        y = tables[0][rows[:n]]
        for j in range(1, f.shape[0]):
            y = y + tables[j][rows[j : n + j]]
        top = np.maximum(y.max(axis=0) + bias, 0)
        total += float(top @ m.out[place : place + len(top)])
        place += len(top)
    return total


def train(rows: list[tuple[list[bytes], int]], seed: int = 7) -> Model:
    """Adam on the logistic loss; a fifth of the rows sets the decision point."""
    rng = np.random.default_rng(seed)
    model = Model(
        rng.normal(0, 0.05, (BUCKETS, SIZE)).astype(np.float32),
        [rng.normal(0, 0.1, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.full(FILTERS, -0.5, np.float32) for _ in WIDTHS], np.full(FILTERS * len(WIDTHS), 0.1, np.float32), -2.5,
    )
    model.embed[0] = 0
    labels = {y for _, y in rows}
    if len(labels) < 2:  # nothing to learn: one score for all
        model.out[:] = 0
        model.offset = 5.0 if labels == {1} else -5.0
        return model
    index: dict[bytes, int] = {}
    features = [[0]]
    docs = []
    for tokens, y in rows:
        ids = np.zeros(max(len(tokens), 1) + len(WIDTHS) - 1, np.int64)
        for k, w in enumerate(tokens):
            i = index.get(w)
            if i is None:
                i = index[w] = len(features)
                features.append(word_features(w))
            ids[k] = i
        docs.append((ids, y))
    features = Ragged.of(features)
    order = rng.permutation(len(docs))
    held, fit = order[: len(docs) // 5], order[len(docs) // 5 :]
    # warm start: the first embedding column is the smoothed log-odds of each bucket, and filters begin by reading it
    model.embed[:, 0] = _log_odds([docs[i] for i in fit], features)
    for f in model.filters:
        f[:, 0, :] += 1 / len(f)
    params = [model.embed, *model.filters, *model.bias, model.out]
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    off = np.zeros(2)
    step = 0
    for epoch in range(EPOCHS):
        rate = 0.004 * 0.7**epoch
        for start in range(0, len(fit), BATCH):
            chosen = fit[start : start + BATCH]
            step += 1
            grads, g_off = _gradients(model, [docs[i] for i in chosen], features)
            correct = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for p, g, a, b in zip(params, grads, first, second):
                if isinstance(g, tuple):  # rows of the embedding
                    rows_, values = g
                    a[rows_] = 0.9 * a[rows_] + 0.1 * values
                    b[rows_] = 0.999 * b[rows_] + 0.001 * values * values
                    p[rows_] -= rate * correct * a[rows_] / (np.sqrt(b[rows_]) + 1e-8)
                else:
                    a *= 0.9
                    a += 0.1 * g
                    b *= 0.999
                    b += 0.001 * g * g
                    p -= rate * correct * a / (np.sqrt(b) + 1e-8)
            off = np.array([0.9, 0.999]) * off + np.array([0.1 * g_off, 0.001 * g_off**2])
            model.offset -= rate * correct * off[0] / (np.sqrt(off[1]) + 1e-8)
    seen = Projected(model)
    some = held if len({docs[i][1] for i in held}) > 1 else order
    raw = np.array([raw_score(rows[i][0], seen) for i in some])
    model.shift = _best_cut(raw, np.array([docs[i][1] for i in some]))
    return model


def _log_odds(docs: list, features: Ragged, prior: float = 10.0) -> np.ndarray:
    """Log-odds of label 1 given a bucket, less that of all rows; ``prior`` rows of the common share are added to each."""
    counts = np.zeros((2, BUCKETS))
    for ids, y in docs:
        counts[y, np.unique(features.take(np.unique(ids)).flat)] += 1
    share = sum(y for _, y in docs) / len(docs)
    share = min(max(share, 1e-3), 1 - 1e-3)
    p = (counts[1] + prior * share) / (counts.sum(axis=0) + prior)
    out = np.log(p / (1 - p)) - np.log(share / (1 - share))
    out[0] = 0
    return out.astype(np.float32)


def _gradients(model: Model, docs: list, features: Ragged) -> tuple[list, float]:
    every, at = np.unique(np.concatenate([d[0] for d in docs]), return_inverse=True)
    chosen = features.take(every)
    x = model.word_vectors(chosen)
    x[every == 0] = 0
    lengths = [len(d[0]) for d in docs]
    starts = np.cumsum([0] + lengths)
    projected = [[x @ f[j] for j in range(f.shape[0])] for f in model.filters]
    g_x = np.zeros_like(x)
    g_f = [np.zeros_like(f) for f in model.filters]
    g_b = [np.zeros_like(b) for b in model.bias]
    g_o = np.zeros_like(model.out)
    g_off = 0.0
    columns = np.arange(FILTERS)
    for (ids, y), s, n in zip(docs, starts, lengths):
        row = at[s : s + n]
        m = n - (len(WIDTHS) - 1)
        tops, places = [], []
        for f, bias, tables in zip(model.filters, model.bias, projected):
            v = tables[0][row[:m]]
            for j in range(1, f.shape[0]):
                v = v + tables[j][row[j : m + j]]
            place = v.argmax(axis=0)
            tops.append(np.maximum(v[place, columns] + bias, 0)), places.append(place)
        top = np.concatenate(tops)
        z = float(top @ model.out) + model.offset
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(docs)
        g_o += d * top
        g_off += d
        back = d * model.out * (top > 0)
        for k, f in enumerate(model.filters):
            g = back[k * FILTERS : (k + 1) * FILTERS]
            g_b[k] += g
            for j in range(f.shape[0]):
                hit = row[places[k] + j]
                g_f[k][j] += x[hit].T * g
                np.add.at(g_x, hit, g[:, None] * f[j].T)
    touched = np.flatnonzero(np.abs(g_x).sum(axis=1) > 0)
    touched = touched[every[touched] > 0]
    hit = chosen.take(touched)
    flat, share, sizes = hit.flat, np.repeat(touched, hit.sizes), chosen.sizes.astype(np.float32)
    rows_, inverse = np.unique(flat, return_inverse=True)
    values = np.zeros((len(rows_), SIZE), np.float32)
    np.add.at(values, inverse, g_x[share] / sizes[share][:, None])
    for grad, p in ((g_o, model.out), *zip(g_f, model.filters)):
        grad += 1e-4 * p / len(docs)
    return [(rows_, values), *g_f, *g_b, g_o], g_off


def _best_cut(raw: np.ndarray, y: np.ndarray) -> float:
    """Middle of the gap at which F1 is best."""
    order = np.argsort(-raw, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(raw) + 1) + y.sum())
    k = int(f1.argmax())
    following = raw[order[k + 1]] if k + 1 < len(raw) else raw[order[k]] - 1
    return float((raw[order[k]] + following) / 2)


def labelled_rows(docs: DataFrame, labels: DataFrame, usable: Column, max_rows: int = MAX_LABELLED) -> list[tuple[list[bytes], int]]:
    """At most ``max_rows`` labelled texts in the order of a hash of their ids, at most half of them with label 1."""
    marked = labels.where(usable & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id", F.lit(11)), F.col("doc_id")]
    some = marked.where("toxic = 1").orderBy(*order).limit(max_rows // 2).unionByName(
        marked.where("toxic = 0").orderBy(*order).limit(max_rows // 2))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(some, "doc_id").orderBy(
        F.xxhash64("doc_id", F.lit(13)), "doc_id", F.xxhash64("text")).limit(2 * max_rows).collect()
    return [(words((r["text"] or "").encode()), int(r["toxic"])) for r in rows]


def decision_point(scored: DataFrame, model: Model, steps: int = 50) -> Model:
    """``model`` with the decision point at the best F1 over all rows of ``scored`` (raw, toxic 0/1); unchanged where a label is missing.

    Counts and ends of score cells only; the point is the middle of the gap below the best cell.
    """
    cells = scored.groupBy(F.floor(F.greatest(F.least("raw", F.lit(100.0)), F.lit(-100.0)) * steps).cast("int").alias("cell")).agg(
        F.sum("toxic").alias("ones"), F.count("*").alias("n"), F.min("raw").alias("low"), F.max("raw").alias("high"))
    rows = sorted(cells.collect(), key=lambda r: -r["cell"])  # 200 x steps rows at most
    ones, n = sum(r["ones"] for r in rows), sum(r["n"] for r in rows)
    if not 0 < ones < n:
        return model
    hits = np.cumsum([r["ones"] for r in rows])
    k = int((2 * hits / (np.cumsum([r["n"] for r in rows]) + ones)).argmax())
    following = rows[k + 1]["high"] if k + 1 < len(rows) else rows[k]["low"] - 1
    return replace(model, shift=float((rows[k]["low"] + following) / 2))


def probability(raw: Column, model: Model) -> Column:
    """``Model.probability`` as an SQL expression."""
    z = (raw - model.shift) * model.scale + float(np.log(CUT / (1 - CUT)))
    return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(40.0)), F.lit(-40.0))))


def raw_scores(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with a column raw, the output of the network for each whole text."""
    return _scored(docs, model, text_col, "raw", lambda m, raw: raw)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with a column score in 0..1 for each whole text; null and empty texts get the network's score of no word.

    Only the text is read. Repeated texts score alike; a column named score is replaced.
    """
    return _scored(docs, model, text_col, "score", Model.probability)


def _scored(docs: DataFrame, model: Model, text_col: str, name: str, value) -> DataFrame:
    source = docs.drop(name)
    at = source.columns.index(text_col)
    schema = source.withColumn(name, F.lit(0.0)).schema
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Projected(sent.value)
        for batch in batches:
            raw = np.array([raw_score(words(t), seen) for t in texts(batch.column(at))])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(value(sent.value, raw), pa.float64())], [*batch.schema.names, name]
            )

    return source.mapInArrow(run, schema)


def language_thresholds(scored: DataFrame, steps: int = 100) -> DataFrame:
    """(lang, threshold): the score at which F1 over labelled rows is best in each language, ``CUT`` where a label is missing.

    Counts per language and score step only; null is a language of its own.
    """
    cells = scored.groupBy("lang", F.floor(F.col("score") * steps).cast("int").alias("cell")).agg(
        F.sum("toxic").alias("ones"), F.count("*").alias("rows"))
    from pyspark.sql import Window

    above = Window.partitionBy("lang").orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("lang")
    found = cells.select("lang", "cell", F.sum("ones").over(above).alias("hits"), F.sum("rows").over(above).alias("taken"),
                         F.sum("ones").over(whole).alias("ones"), F.sum("rows").over(whole).alias("all"))
    f1 = 2 * F.col("hits") / (F.col("taken") + F.col("ones"))
    best = F.max_by("cell", F.struct(f1, "cell")) / steps
    return found.groupBy("lang").agg(F.when((F.max("ones") == 0) | (F.max("ones") == F.max("all")), F.lit(CUT)).otherwise(best).alias("threshold"))
