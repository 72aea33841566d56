"""Scores of whole texts by a gated recurrent language model in numpy.

Words are counted over all training texts in Spark. The output is a
class-factored softmax: the ``SOFTMAX`` most frequent tokens are split into
classes of equal size with a softmax inside each; every other word belongs to a
class of its form (its ending), inside which it has its smoothed share of the
counts. So each word of any vocabulary has a probability and they sum to one.

Weights start from the log counts and are trained by truncated backpropagation
in Spark tasks: all training texts are dealt to shards by a hash of their text, every
shard trains from the same weights, and their weights are averaged, ``ROUNDS``
times. A step touches only the input rows and classes of its tokens. Shards, their
order and the order of merging do not depend on how the input is packed. Scoring runs many texts side by side, in windows, and carries each text's
state from window to window, so a text of any length is scored whole. The
``HEAD`` most frequent words are sent to every task with their counts (a fixed
bound); rarer words leave the task as rows and get their counts by a join.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residuum.llm.frequent import most_frequent
from residuum.llm.text import texts, words
from residuum.storage import cut

HEAD = 100_000
SOFTMAX = 2048
CLASS_SIZE = 64
FORMS = 16
HIDDEN = 24
#: Texts of a shard at least, and shards at most.
SHARD_DOCS, SHARDS = 2000, 1024
ROUNDS = 1
#: Streams side by side at most, steps of a window, and updates a shard should make at least (fewer streams give more).
LANES, WINDOW, UPDATES = 512, 16, 150
RATE = 0.01
#: Tokens a shard trains on in one go, tokens held to be scored, rows of a softmax pass, counted words held.
TRAIN_TOKENS = 1_500_000
GO_TOKENS = 3_000_000
HELD_ROWS = 8192
TASK_WORDS = 300_000
SPLIT_BYTES = 4 << 20  # of texts split into words in one go
OFTEN = 12  # values of a row that are added one by one at most
END = b""  # the end of a text; no word is empty


@cache
def _form_of_ending(ending: bytes) -> int:
    return xxhash.xxh3_64_intdigest(ending) % FORMS


def form(word: bytes) -> int:
    return _form_of_ending(word[-2:])


def split_words(column: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Words of the texts of a column as one array, and how many each text has, some megabytes of texts at a time.

    Arrow's white space is \\x20 and \\x09-\\x0D, like that of ``words``; it leaves an empty word at an end with space.
    """
    if column.null_count:
        column = pc.fill_null(column, "")
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SPLIT_BYTES, "right")))
        lists = pc.ascii_split_whitespace(pc.ascii_lower(column.slice(start, stop - start)))
        found, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        empty = pc.binary_length(found).to_numpy(zero_copy_only=False) == 0
        if empty.any():
            sizes = sizes - np.bincount(np.repeat(np.arange(len(sizes)), sizes)[empty], minlength=len(sizes))
            found = found.filter(pa.array(~empty))
        yield found.cast(pa.large_binary() if pa.types.is_large_string(found.type) else pa.binary()), sizes
        start = stop


def count_words(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, c) over all texts, the end of each text as the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])

        for batch in batches:
            for text in texts(batch.column(0)):
                seen.update(words(text))
                seen[END] += 1
                if len(seen) > TASK_WORDS:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """Head words with counts; ids below ``softmax`` have a place in a class, then come the forms."""

    index: dict[bytes, int]
    counts: np.ndarray
    softmax: int
    form_mass: np.ndarray
    total: int
    distinct: int
    head: pa.Array | None = field(default=None, repr=False, compare=False)  # the words of ``index``, where texts are read

    def __getstate__(self) -> dict:
        return self.__dict__ | {"head": None}

    @property
    def classes(self) -> int:
        return -(-max(self.softmax, 1) // CLASS_SIZE)

    def tokens(self, column: pa.Array) -> Iterator[tuple[np.ndarray, list[bytes]]]:
        """Of each text, ids of its tokens, its end included: a place in ``index``, or -1 - form outside it; and the words outside."""
        end = self.index.get(END, -1 - form(END))
        for found, sizes in split_words(column):
            if self.head is None or self.head.type != found.type:
                self.head = pa.array(list(self.index), found.type)
            places = pc.index_in(found, value_set=self.head)
            outside = pc.is_null(places)
            ids = pc.fill_null(places, -1).to_numpy(zero_copy_only=False).astype(np.int64)
            rare = found.filter(outside).to_pylist()
            at = np.flatnonzero(ids < 0)
            ids[at] = [-1 - form(w) for w in rare]
            ends = np.cumsum(sizes)
            cuts = np.searchsorted(at, ends).tolist()
            begin = before = 0
            for stop, cut_ in zip(ends.tolist(), cuts):
                yield np.append(ids[begin:stop], end), rare[before:cut_]
                begin, before = stop, cut_


class Net:
    """The weights, as a dictionary of float32 arrays."""

    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params

    @classmethod
    def start(cls, v: Vocabulary, forms: np.ndarray, seed: int = 5) -> Net:
        rng = np.random.default_rng(seed)
        n, h = v.classes * CLASS_SIZE, HIDDEN
        word_bias = np.full(n, -20.0)
        word_bias[: v.softmax] = np.log(v.counts[: v.softmax] + 0.5)
        mass = np.exp(word_bias).reshape(v.classes, CLASS_SIZE).sum(axis=1)
        class_bias = np.log(np.concatenate([mass, v.form_mass]))
        word_bias = word_bias.reshape(v.classes, CLASS_SIZE) - np.log(mass)[:, None]
        u = rng.normal(0, 1 / np.sqrt(h), (h, 3 * h))
        p = {
            "x": rng.normal(0, 0.1, (n + FORMS, 3 * h)), "u": u, "b": np.concatenate([np.zeros(h), np.zeros(2 * h)]),
            "c": rng.normal(0, 0.05, (h, v.classes + FORMS)), "cb": class_bias - np.log(np.exp(class_bias).sum()),
            "w": rng.normal(0, 0.05, (v.classes, h, CLASS_SIZE)), "wb": word_bias,
        }
        return cls({k: np.ascontiguousarray(a, np.float32) for k, a in p.items()})

    def gates(self) -> tuple[np.ndarray, np.ndarray]:
        """The input table with its bias as (row, gate, hidden) and the recurrent weights as (gate, hidden, hidden)."""
        k = HIDDEN
        return (self.p["x"] + self.p["b"]).reshape(-1, 3, k), np.ascontiguousarray(self.p["u"].reshape(k, 3, k).transpose(1, 0, 2))

    def step(self, rows: np.ndarray, h: np.ndarray):
        """One GRU step; ``rows`` are the input rows of the tokens before."""
        x, u = self.gates()
        (z, r), n, gn, out = _advance(np.ascontiguousarray(x[rows].transpose(1, 0, 2)), u, h)
        return out, z, r, n, gn

    def log_likelihood(self, h: np.ndarray, target: np.ndarray, classes: int) -> np.ndarray:
        """Natural log of the class and, for softmax words, of the word in it. Targets: place, or classes * CLASS_SIZE + form."""
        limit = classes * CLASS_SIZE
        c = np.where(target < limit, target // CLASS_SIZE, classes + target - limit)
        # a column a token: maxima and sums then run along the tokens
        logits = self.p["c"].T @ h.T
        logits += self.p["cb"][:, None]
        out = logits[c, np.arange(len(c))]
        out -= _log_sum(logits)
        order = np.argsort(c.astype(np.int16), kind="stable")
        ends = np.searchsorted(c[order], np.arange(classes + 1))
        own, place, found = h[order], (target - c * CLASS_SIZE)[order], np.zeros(len(c), np.float32)
        for k in range(classes):
            at = slice(ends[k], ends[k + 1])
            if ends[k] < ends[k + 1]:
                inner = self.p["w"][k].T @ own[at].T
                inner += self.p["wb"][k][:, None]
                found[at] = inner[place[at], np.arange(inner.shape[1])]
                found[at] -= _log_sum(inner)
        out[order] += found
        return out


def _advance(x: np.ndarray, u: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gates (2, rows, hidden), candidate, its recurrent part and the new state. ``x`` is (3, rows, hidden)."""
    g = np.matmul(h, u)
    zr = g[:2] + x[:2]
    np.negative(zr, out=zr)
    np.exp(zr, out=zr)
    zr += np.float32(1)
    np.reciprocal(zr, out=zr)
    n = zr[1] * g[2]
    n += x[2]
    np.tanh(n, out=n)
    out = h - n
    out *= zr[0]
    out += n
    return zr, n, g[2], out


def _log_sum(columns: np.ndarray) -> np.ndarray:
    """log of the sum of exp of each column; ``columns`` are overwritten."""
    top = columns.max(axis=0)
    columns -= top
    np.exp(columns, out=columns)
    return np.log(columns.sum(axis=0)) + top


def _less_target(columns: np.ndarray, place: np.ndarray, size: np.float32) -> np.ndarray:
    """Gradient of the mean log loss at the logits of each column, in their place: softmax less one at the target."""
    columns -= columns.max(axis=0)
    np.exp(columns, out=columns)
    columns *= 1 / (columns.sum(axis=0) * size)
    columns[place, np.arange(columns.shape[1])] -= 1 / size
    return columns


def _rows(v: Vocabulary, ids: np.ndarray, forms: np.ndarray) -> np.ndarray:
    """Row of each token in the tables of the net: place in the softmax, else the row of its form."""
    limit = v.classes * CLASS_SIZE
    out = np.where(ids >= v.softmax, limit + forms[np.maximum(ids, 0)], ids)
    return np.where(ids < 0, limit - 1 - ids, out)


def _by_row(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the sums of their values."""
    order = np.argsort(rows.astype(np.int16) if rows.max(initial=0) < 1 << 15 else rows, kind="stable")
    own, values = rows[order], np.take(values, order, axis=0)
    starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    many = np.diff(np.append(starts, len(own)))
    out = np.take(values, starts, axis=0)
    # a row met often is one sum; the others take their second, third, ... values together
    often = np.flatnonzero(many > OFTEN)
    for i, start, n in zip(often.tolist(), starts[often].tolist(), many[often].tolist()):
        np.sum(values[start : start + n], axis=0, out=out[i])
    left = np.flatnonzero((many > 1) & (many <= OFTEN))
    for k in range(1, OFTEN):
        left = left[many[left] > k]
        if not len(left):
            break
        out[left] += np.take(values, starts[left] + k, axis=0)
    return own[starts], out


class Steps:
    """Adam over the touched parts of the weights."""

    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.first, self.second = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}

    def __call__(self, grads: dict[str, tuple[np.ndarray | None, np.ndarray]]) -> None:
        """``grads``: rows touched (None: all) and their gradients, which are scaled to a norm of at most one."""
        self.t += 1
        norm = np.sqrt(sum(float(np.vdot(g, g)) for _, g in grads.values()))
        scale = np.float32(min(1.0, 1.0 / (norm + 1e-9)))
        step = np.float32(self.rate * np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t))
        for key, (rows, g) in grads.items():
            at = slice(None) if rows is None else rows
            g = g * scale
            m, q = self.first[key][at], self.second[key][at]
            part = g - m
            part *= np.float32(0.1)
            m += part
            np.multiply(g, g, out=part)
            part -= q
            part *= np.float32(0.01)
            q += part
            if rows is not None:
                self.first[key][at], self.second[key][at] = m, q
            np.sqrt(q, out=part)
            part += np.float32(1e-7)
            np.divide(m, part, out=part)
            part *= step
            self.p[key][at] -= part


def train_shard(net: Net, v: Vocabulary, forms: np.ndarray, docs: list[np.ndarray], rate: float) -> Net:
    """One pass of truncated backpropagation over the texts, ``LANES`` streams side by side; a text's end clears the state."""
    limit, end_row = v.classes * CLASS_SIZE, int(_rows(v, np.array([v.index.get(END, -1 - form(END))]), forms)[0])
    stream = np.concatenate([_rows(v, d, forms) for d in docs]) if docs else np.zeros(0, np.int64)
    lanes = max(1, min(LANES, len(stream) // (WINDOW * UPDATES), len(stream) // WINDOW))
    length = len(stream) // lanes
    if not length:
        return net
    data = stream[: lanes * length].reshape(lanes, length)
    p = {k: a.copy() for k, a in net.p.items()}
    net, update = Net(p), Steps(p, rate)
    h, k = np.zeros((lanes, HIDDEN), np.float32), HIDDEN
    came = np.concatenate([np.full((lanes, 1), end_row), data[:, :-1]], axis=1)  # the token before each
    for start in range(0, length, WINDOW):
        target, rows = (np.ascontiguousarray(d[:, start : start + WINDOW].T) for d in (data, came))
        many = len(target)
        table, u = net.gates()
        x = np.ascontiguousarray(table[rows].transpose(0, 2, 1, 3))
        clear = (rows != end_row)[:, :, None].astype(np.float32)
        hidden, h0s, kept = np.empty((many, lanes, k), np.float32), np.empty((many, lanes, k), np.float32), []
        for j in range(many):
            np.multiply(h, clear[j], out=h0s[j])
            zr, n, gn, h = _advance(x[j], u, h0s[j])
            kept.append((zr, n, gn))
            hidden[j] = h
        hidden, target = hidden.reshape(-1, k), target.reshape(-1)
        size = np.float32(len(target))
        c = np.where(target < limit, target // CLASS_SIZE, v.classes + target - limit)
        logits = p["c"].T @ hidden.T
        logits += p["cb"][:, None]
        d = _less_target(logits, c, size)
        grads: dict = {"c": (None, (d @ hidden).T), "cb": (None, d.sum(axis=1))}
        dh = d.T @ p["c"].T
        order = np.argsort(c.astype(np.int16), kind="stable")
        ends = np.searchsorted(c[order], np.arange(v.classes + 1))
        touched = np.flatnonzero(np.diff(ends))
        gw, gwb = np.zeros((len(touched), k, CLASS_SIZE), np.float32), np.zeros((len(touched), CLASS_SIZE), np.float32)
        order = order[: ends[-1]]
        sorted_, place, back = hidden[order], (target - c * CLASS_SIZE)[order], np.empty((len(order), k), np.float32)
        for i, q in enumerate(touched):
            at = slice(ends[q], ends[q + 1])
            own = sorted_[at]
            inner = p["w"][q].T @ own.T
            inner += p["wb"][q][:, None]
            d = _less_target(inner, place[at], size)
            gw[i], gwb[i] = (d @ own).T, d.sum(axis=1)
            back[at] = d.T @ p["w"][q].T
        dh[order] += back
        if len(touched):
            grads["w"], grads["wb"] = (touched, gw), (touched, gwb)
        dh = dh.reshape(many, lanes, k)
        carry, ut = np.zeros((lanes, k), np.float32), np.ascontiguousarray(u.transpose(0, 2, 1))
        dxs, dgs = np.empty((many, 3, lanes, k), np.float32), np.empty((3, many, lanes, k), np.float32)
        for j in range(many - 1, -1, -1):
            (z, r), n, gn = kept[j]
            dx, dg, h0 = dxs[j], dgs[:, j], h0s[j]
            dy = dh[j]
            dy += carry
            by_z = dy * z
            np.subtract(dy, by_z, out=dx[2])
            dx[2] *= 1 - n * n
            np.multiply(h0 - n, by_z, out=dx[0])
            dx[0] *= 1 - z
            np.multiply(dx[2], r, out=dg[2])
            np.multiply(dg[2], gn, out=dx[1])
            dx[1] *= 1 - r
            dg[:2] = dx[:2]
            carry = np.matmul(dg, ut).sum(axis=0)
            carry += by_z
            carry *= clear[j]
        dxs = np.ascontiguousarray(dxs.transpose(0, 2, 1, 3)).reshape(-1, 3 * k)
        gu = np.matmul(h0s.reshape(-1, k).T, dgs.reshape(3, -1, k))
        grads["x"] = _by_row(rows.reshape(-1), dxs)
        grads["b"], grads["u"] = (None, grads["x"][1].sum(axis=0)), (None, gu.transpose(1, 0, 2).reshape(k, 3 * k))
        update(grads)
    return net


def score_tokens(net: Net, v: Vocabulary, forms: np.ndarray, docs: list[np.ndarray]) -> np.ndarray:
    """Natural log-likelihood of each text (softmax and class parts), ``LANES`` texts of like length side by side, state carried over windows."""
    total = np.zeros(len(docs))
    lengths = np.array([len(d) for d in docs])
    order = np.argsort(-lengths, kind="stable")
    end_row = int(_rows(v, np.array([v.index.get(END, -1 - form(END))]), forms)[0])
    table, u = net.gates()
    for first in range(0, len(docs), LANES):
        own = order[first : first + LANES]
        sorted_lengths = lengths[own]
        flat = np.concatenate([_rows(v, docs[i], forms) for i in own])
        begin = np.cumsum(sorted_lengths) - sorted_lengths
        h, before = np.zeros((len(own), HIDDEN), np.float32), np.full(len(own), end_row)
        t, longest = 0, int(sorted_lengths[0])
        # texts longer than t, for each t
        running = np.searchsorted(-sorted_lengths, -np.arange(longest), "left").tolist()
        while t < longest:
            hidden, target, active = [], [], []
            held = 0
            while t < longest and held < HELD_ROWS:
                n = running[t]
                h = _advance(np.ascontiguousarray(table[before[:n]].transpose(1, 0, 2)), u, h[:n])[3]
                before = flat[begin[:n] + t]
                hidden.append(h), target.append(before), active.append(n)
                held += n
                t += 1
            value = net.log_likelihood(np.concatenate(hidden), np.concatenate(target), v.classes)
            place = np.arange(held) - np.repeat(np.cumsum(active) - active, active)
            total[own] += np.bincount(place, weights=value, minlength=len(own))
    return total


def fit(docs: DataFrame, counts: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> tuple[Vocabulary, np.ndarray, Net]:
    """Vocabulary, form of each head word and trained weights. ``docs`` are the training texts, ``counts`` their words."""
    head = sorted(most_frequent(counts, "c", HEAD, split=True).collect(), key=lambda r: (-r["c"], bytes(r["word"])))
    index = {bytes(r["word"]): i for i, r in enumerate(head)}
    forms = np.array([form(w) for w in index] or [0], np.int64)
    softmax = min(SOFTMAX, len(index))
    sent = docs.sparkSession.sparkContext.broadcast({w for w, i in index.items() if i < softmax})

    def masses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass = np.zeros(FORMS)
        for batch in batches:
            for w, c in zip(batch.column(0), batch.column(1)):
                w = w.as_py()
                if w not in sent.value:
                    mass[form(w)] += c.as_py() + 0.5
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(FORMS)), pa.array(mass)], ["form", "mass"])

    rows = counts.select("word", "c").mapInArrow(masses, "form long, mass double").groupBy("form").agg(F.sum("mass").alias("mass")).collect()
    mass = np.full(FORMS, 0.5)
    for r in rows:
        mass[r["form"]] += r["mass"]
    total, distinct = counts.agg(F.sum("c"), F.count("*")).first()
    v = Vocabulary(index, np.array([r["c"] for r in head] or [0], np.float64), softmax, mass, int(total or 0), int(distinct))
    net = Net.start(v, forms)
    n = docs.count()
    shards = max(1, min(SHARDS, n // SHARD_DOCS))
    every = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("place", F.xxhash64("text", "id"))
    every = every.withColumn("shard", F.pmod("place", F.lit(shards)))
    every = cut(every.repartition(shards, "shard").sortWithinPartitions("shard", "place").select("shard", "text"), "lm-train")
    spark = docs.sparkSession
    for turn in range(ROUNDS):
        state = spark.sparkContext.broadcast((net, v, forms))

        def run(batches: Iterator[pa.RecordBatch], state=state, turn=turn) -> Iterator[pa.RecordBatch]:
            start, v, forms = state.value
            own, net, docs_, held, seen = None, start, [], 0, 0

            def learned() -> None:
                nonlocal net, docs_, held, seen
                net = train_shard(net, v, forms, docs_, RATE / (1 + turn))
                docs_, held, seen = [], 0, seen + held

            def out() -> pa.RecordBatch:
                learned()
                return pa.RecordBatch.from_arrays([pa.array([own]), pa.array([float(seen)]), pa.array([pickle.dumps(net.p)], pa.binary())], ["part", "weight", "net"])

            for b in batches:
                for shard, (ids, _) in zip(b.column(0).to_pylist(), v.tokens(b.column(1))):
                    if shard != own:
                        if own is not None:
                            yield out()
                        own, net, docs_, held, seen = shard, start, [], 0, 0
                    docs_.append(ids)
                    held += len(ids)
                    if held > TRAIN_TOKENS:
                        learned()
            if own is not None:
                yield out()

        def merge(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("part")
            weight = frame["weight"].sum()
            out = None
            for w, blob in zip(frame["weight"], frame["net"]):
                own = {k: a * np.float32(w / weight) for k, a in pickle.loads(blob).items()}
                out = own if out is None else {k: out[k] + own[k] for k in out}
            return pd.DataFrame({"part": [frame["part"].iloc[0]], "weight": [weight], "net": [pickle.dumps(out)]})

        schema = "part long, weight double, net binary"
        parts = cut(every.mapInArrow(run, schema), "lm-weights")
        merged = parts.groupBy(F.pmod("part", F.lit(32)).alias("k")).applyInPandas(lambda f: merge(f), schema)
        last = merged.groupBy(F.lit(0).alias("k")).applyInPandas(lambda f: merge(f), schema).collect()
        if last:
            net = Net({k: np.ascontiguousarray(a, np.float32) for k, a in pickle.loads(bytes(last[0]["net"])).items()})
    return v, forms, net


def score(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row.

    ``training`` marks the rows whose texts are learned from (null: not). Tokens are
    the words and one end; null and empty texts have the end only. base_score is the
    unigram log10 probability with half a count added to each word, score that of
    the recurrent model. Repeated rows count and score each for itself; with no
    training text every token is unknown. Other columns are ignored.
    """
    used = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    learned = used.where("training")
    counts = cut(count_words(learned, "text"), "lm-counts")
    v, forms, net = fit(learned, counts, "text", "id")
    state = docs.sparkSession.sparkContext.broadcast((v, forms, net))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, forms, net = state.value
        # per head id: log10 of the smoothed count, and what the net leaves out: the share within the form
        log_count = np.log10(v.counts + 0.5)
        log_mass = np.log10(v.form_mass)
        inside = np.where(np.arange(len(log_count)) < v.softmax, 0.0, log_count - log_mass[forms])
        base_norm = np.log10(v.total + 0.5 * (v.distinct + 1))
        place = TaskContext.get().partitionId() << 33
        waiting: list = []
        held = 0

        def out() -> pa.RecordBatch:
            nonlocal place
            nats = score_tokens(net, v, forms, [w[2] for w in waiting])
            keys = place + np.arange(len(waiting))
            place += len(waiting)
            known, base, full, rare, many, ends = [], [], [], [], [], [0]
            for (_, _, ids, outside), value in zip(waiting, nats):
                seen = ids[ids >= 0]
                unseen = -1 - ids[ids < 0]
                known.append(len(seen))
                base.append(float(log_count[seen].sum() - base_norm * len(ids)))
                full.append(float(value / np.log(10) + inside[seen].sum() - log_mass[unseen].sum()))
                found = Counter(outside)
                rare.extend(found)
                many.extend(found.values())
                ends.append(len(rare))
            listed = pa.StructArray.from_arrays([pa.array(rare, pa.binary()), pa.array(many, pa.int64())], ["word", "n"])
            return pa.RecordBatch.from_arrays(
                [pa.array(keys), pa.array([w[0] for w in waiting], pa.int64()), pa.array([w[1] for w in waiting], pa.bool_()),
                 pa.array([len(w[2]) for w in waiting], pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(full, pa.float64()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), listed)],
                ["key", "id", "training", "n_tokens", "head_known", "head_base", "head_score", "rare"],
            )

        for batch in batches:
            for i, learned_, (ids, outside) in zip(batch.column(0), batch.column(2), v.tokens(batch.column(1))):
                waiting.append((i.as_py(), learned_.as_py(), ids, outside))
                held += len(ids)
                if held > GO_TOKENS:
                    yield out()
                    waiting.clear()
                    held = 0
        if waiting:
            yield out()

    scored = cut(used.mapInArrow(run, "key long, id long, training boolean, n_tokens long, head_known long, head_base double, head_score double, "
                                      "rare array<struct<word:binary,n:long>>"), "lm-scores")
    rare = scored.select("key", F.explode("rare").alias("r")).select("key", "r.word", "r.n")
    found = rare.join(counts, "word", "left").groupBy("key").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known"), F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("log_counts"))
    more = F.coalesce("log_counts", F.lit(0.0))
    return scored.drop("rare").join(found, "key", "left").select(
        "id", (~F.col("training")).alias("held_out"), "n_tokens", (F.col("head_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(v.total).cast("long").alias("train_tokens"), (F.col("head_base") + more).alias("base_score"), (F.col("head_score") + more).alias("score"))
