"""Document fingerprints by Order MinHash (Marcais et al., 2019).

Every run of ``WIDTH`` code points is taken with its occurrence number, so that
repeats count. Each of ``FUNCTIONS`` hash functions picks the ``PICKED`` pairs
with the smallest values; they go back into the order in which they stand in the
text, and the tuple of the runs (without their numbers) is hashed to one entry.
Two texts agree in an entry only if they share the picked runs *and* their order, so
the share of equal entries falls with edit distance, not just with the set of runs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residuum.llm.text import mix

#: Code points in a run, runs in a tuple, entries of a fingerprint.
WIDTH, PICKED, FUNCTIONS = 8, 2, 64
#: Hash values computed side by side; bounds the memory of a long text.
BLOCK = 1 << 16
#: Rows of an output batch.
OUT_ROWS = 512
#: Rows of a slice of the order, and slices at most (their first rows are sent to every task).
SLICE_ROWS, SLICES = 2000, 10_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_LONG_MIN = -(1 << 63)


def multipliers(functions: int = FUNCTIONS) -> np.ndarray:
    """One odd factor for each hash function, drawn from its number."""
    return (mix(np.arange(1, functions + 1, dtype=np.uint64) * _ODD) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def runs(text: str, width: int = WIDTH) -> np.ndarray:
    """64-bit hash of each run of ``width`` code points, in text order; a shorter text is one run, an empty one has none."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    width = min(width, len(points))
    if not width:
        return points
    # a run is put together from runs of half its length: few passes for any width
    done, total = 0, np.zeros(len(points) - width + 1, np.uint64)
    power, length = (points + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9), 1
    left = width
    while left:
        if left & 1:
            total = mix(total * _ODD + power[done : done + len(total)])
            done += length
        left >>= 1
        if left:
            power = power[: len(power) - length] * _ODD + power[length:]
            power ^= power >> np.uint64(29)
            length *= 2
    return total


def numbered(hashes: np.ndarray) -> np.ndarray:
    """Hash of each run with its occurrence number (0 for the first)."""
    # one sort of values whose low bits hold the place: equal runs come out side by side, in text order
    bits = np.uint64(len(hashes).bit_length())
    ordered = np.sort((hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64))
    new = np.append(True, (ordered[1:] ^ ordered[:-1]) >> bits != 0)
    if new.all():
        return hashes
    later = np.flatnonzero(~new)
    starts = np.flatnonzero(new)
    number = later - starts[np.searchsorted(starts, later) - 1]
    at = (ordered[later] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    out = hashes.copy()
    out[at] = mix(hashes[at] + number.astype(np.uint64) * _ODD)
    return out


def sketch(text: str, factors: np.ndarray, width: int = WIDTH, picked: int = PICKED) -> np.ndarray:
    """The fingerprint's entries (16 bits each); none for an empty text."""
    hashes = runs(text, width)
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint16)
    keys = (numbered(hashes) >> np.uint64(32)).astype(np.uint32)
    many = min(picked, n)
    places = np.empty((len(factors), many), np.int64)
    step = max(1, BLOCK // n)
    for begin in range(0, len(factors), step):
        own = factors[begin : begin + step]
        values = own[:, None] * keys
        row = np.arange(len(own))
        for j in range(many):
            at = values.argmin(axis=1)
            places[begin : begin + len(own), j] = at
            values[row, at] = 0xFFFFFFFF
    places.sort(axis=1)
    total = np.arange(len(factors), dtype=np.uint64)
    for j in range(many):
        total = mix(total * _ODD + hashes[places[:, j]])
    return (total >> np.uint64(48)).astype(np.uint16)


def named(entries: np.ndarray) -> str:
    """Four hexadecimal digits for each entry; the empty text has the empty name."""
    return entries.astype(">u2").tobytes().hex()


def agreement(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal entries; two empty texts agree, an empty one agrees with no other."""
    if len(a) != len(b):
        return 0.0
    return float((a == b).mean()) if len(a) else 1.0


def likeness(a: Column, b: Column) -> Column:
    """``agreement`` of two fingerprint columns, without Python; a null fingerprint gives null."""
    digits = F.sequence(F.lit(0), F.greatest(F.length(a) / 4 - 1, F.lit(0)).cast("int"))
    equal = F.size(F.filter(digits, lambda i: F.substr(a, i * 4 + 1, F.lit(4)) == F.substr(b, i * 4 + 1, F.lit(4))))
    return F.when(a.isNull() | b.isNull(), None).when(F.length(a) != F.length(b), 0.0).when(F.length(a) == 0, 1.0).otherwise(equal / (F.length(a) / 4))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, fingerprint) of each row.

    Null texts are empty and have the empty fingerprint; a text shorter than a run is one run. Equal texts have equal
    fingerprints wherever they stand. Ids are not looked at: null and repeated ones keep their rows. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = multipliers()
        for batch in batches:
            whole = [v.as_py() or "" for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in whole], pa.int64()), pa.array([named(sketch(t, factors)) for t in whole], pa.string())],
                ["id", "n_chars", "fingerprint"],
            )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "id long, n_chars long, fingerprint string"
    )


def slices(rows: DataFrame) -> DataFrame:
    """``rows`` (key, tie, ...) with ``slice``: consecutive parts of the order by key and tie, descending.

    The limits are percentiles of the key over all rows; a key that fills more than one slice is cut by its ties.
    """
    n = rows.count()
    count = max(1, min(SLICES, n // SLICE_ROWS))
    limits = np.zeros(0, np.int64)
    if count > 1:
        shares = [i / count for i in range(1, count)]
        found = rows.agg(F.percentile_approx("key", F.array(*map(F.lit, shares)), 20 * count).alias("p")).first()["p"]
        limits = np.sort(np.array(found, np.int64))

    @F.pandas_udf("long")
    def place(key: pd.Series, tie: pd.Series) -> pd.Series:
        k = key.to_numpy(np.int64)
        low, high = np.searchsorted(limits, k, "left"), np.searchsorted(limits, k, "right")
        share = (tie.to_numpy(np.int64).astype(np.float64) + 2.0**63) / 2.0**64
        inner = np.maximum(high - low - 1, 0)
        own = low + 1 + np.minimum((share * inner).astype(np.int64), inner - 1)
        return pd.Series(len(limits) - np.where(inner > 0, own, low))

    return rows.withColumn("slice", place("key", "tie"))


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints beside those of an edited text and of the next document.

    Returns (id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next). The edit replaces the last half of the code points
    (rounded down) by the first as many, or all, of the next document in descending
    id order; after the last row comes the first. A null id ranks as the smallest
    long; rows that share an id stand by a hash of their texts, so equal rows are
    neighbours. A single row is its own next one. Null texts are empty. Other columns are ignored.

    The order is never in one place: texts are dealt to slices of it in one
    shuffle, and the first row of each slice is also sent to the slice before.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    ).select("id", "text", F.coalesce("id", F.lit(_LONG_MIN)).alias("key"), F.xxhash64("text").alias("tie"))
    rows = slices(rows)
    firsts = rows.groupBy("slice").agg(F.max(F.struct("key", "tie")).alias("f")).select("slice", "f.key", "f.tie").collect()
    firsts = sorted((r["slice"], r["key"], r["tie"]) for r in firsts)
    before = [(s, k, t, firsts[i - 1][0]) for i, (s, k, t) in enumerate(firsts)]  # of the first slice, the last
    sent = docs.sparkSession.createDataFrame(before, "slice long, key long, tie long, before long")
    own = F.struct(F.col("slice"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("before").alias("slice"), F.lit(True).alias("guest"))
    dealt = rows.join(F.broadcast(sent), ["slice", "key", "tie"], "left").select(
        "id", "text", "key", "tie", F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, guest))).alias("at")
    ).select("at.slice", "at.guest", "key", "tie", "id", "text")
    dealt = dealt.repartition("slice").sortWithinPartitions("slice", "guest", F.desc("key"), F.desc("tie"))
    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = multipliers()
        out: list[tuple] = []
        last: tuple | None = None  # slice, id, text, entries

        def packed() -> pa.RecordBatch:
            columns = list(zip(*out))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in schema.split(", ")])

        for batch in batches:
            for slice_, guest_, i, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                text = value.as_py()
                entries = last[3] if last is not None and last[2] == text else sketch(text, factors)
                if last is not None and last[0] == slice_:
                    half = len(last[2]) // 2
                    edited = last[2][: len(last[2]) - half] + text[:half]
                    changed = last[3] if edited == last[2] else sketch(edited, factors)
                    out.append((last[1], len(last[2]), hashlib.sha256(edited.encode()).hexdigest(), named(last[3]), named(changed),
                                agreement(last[3], changed), agreement(last[3], entries)))
                    if len(out) >= OUT_ROWS:
                        yield packed()
                        out.clear()
                last = None if guest_ else (slice_, i, text, entries)
        if out:
            yield packed()

    return dealt.select("slice", "guest", "id", "text").mapInArrow(run, schema)
