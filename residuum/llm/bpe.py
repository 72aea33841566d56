"""BPE encoding through a table of distinct words, and decoding through a table of pieces.

A byte-level BPE never joins a non-space character with a space that follows, so
a text may be cut before each run of white space: each unit (white space and the
word after it) encodes alike wherever it stands. The units of all texts are
counted in Spark, each of the ``TABLE_WORDS`` most frequent ones is encoded once in
Spark, and ids are joined back by position in one narrow pass. The table is
bounded, so it is sent to every task; a rarer unit is encoded where it stands and
remembered there, which gives the same ids. Decoding joins each id with its piece
(the vocabulary bounds that table) and puts the bytes together in order.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct units in the table sent to tasks, and their longest length in characters.
TABLE_WORDS = 200_000
TABLE_CHARS = 40
#: Units a task counts, or remembers, before it starts anew.
TASK_WORDS = 300_000
#: Rows of ids made at once.
SLICE_ROWS = 500
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
UNIT = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")


def special_tokens(path: str) -> list[str]:
    with open(path, encoding="utf-8") as f:
        return [t["content"] for t in json.load(f)["added_tokens"]]


def units(text: str, special: re.Pattern | None) -> list[str]:
    """Units of a text in order; special tokens are units and cut the text."""
    if special is None or not special.search(text):
        return UNIT.findall(text)
    out: list[str] = []
    for k, part in enumerate(special.split(text)):
        out += [part] if k % 2 else UNIT.findall(part)
    return out


def special_pattern(tokens: list[str]) -> re.Pattern | None:
    return re.compile("(" + "|".join(re.escape(t) for t in sorted(tokens, key=len, reverse=True)) + ")") if tokens else None


class Encoder(dict):
    """Unit to its ids as int32 bytes; a unit outside the table is encoded once and remembered."""

    def __init__(self, path: str, known: dict[str, bytes]):
        from tokenizers import Tokenizer

        super().__init__(known)
        self.known, self.tokenizer = known, Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def __missing__(self, unit: str) -> bytes:
        if len(self) > len(self.known) + TASK_WORDS:
            self.clear()
            self.update(self.known)
        ids = self[unit] = np.array(self.tokenizer.encode(unit, add_special_tokens=False).ids, np.int32).tobytes()
        return ids


def count_units(docs: DataFrame, text_col: str, special: re.Pattern | None) -> DataFrame:
    """(unit, n) over all texts, summed inside tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["unit", "n"]
            )

        for batch in batches:
            for text in batch.column(0):
                text = text.as_py()
                if text:
                    seen.update(units(text, special))
                    if len(seen) > TASK_WORDS:
                        yield out()
                        seen.clear()
        yield out()

    parts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "unit string, n long")
    return parts.groupBy("unit").agg(F.sum("n").alias("n"))


def word_table(docs: DataFrame, path: str, text_col: str = "text", size: int = TABLE_WORDS) -> DataFrame:
    """(unit, ids): the ``size`` most frequent units (ties by unit), each encoded once."""
    pattern = special_pattern(special_tokens(path))
    top = count_units(docs, text_col, pattern).where(F.length("unit") <= TABLE_CHARS).orderBy(F.desc("n"), "unit").limit(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, {})
        for batch in batches:
            ids = [np.frombuffer(encoder[u], np.int32) for u in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["unit", "ids"])

    return top.select("unit").mapInArrow(run, "unit string, ids array<int>")


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", table: DataFrame | None = None) -> DataFrame:
    """``docs`` with ``ids_col``: the ids of the whole text, as the tokenizer of ``path`` gives them without adding special tokens.

    Null and empty texts have no ids (an empty array). Special tokens written in
    a text are special tokens. ``table`` is a ``word_table``; without one it is made
    from the same texts. Rows, repeated ones too, stay as they are; a column named
    ``ids_col`` is replaced.
    """
    rows = (word_table(docs, path, text_col) if table is None else table).collect()
    known = {r["unit"]: np.array(r["ids"], np.int32).tobytes() for r in rows}
    sent = docs.sparkSession.sparkContext.broadcast(known)
    pattern = special_pattern(special_tokens(path))
    source = docs.drop(ids_col)
    at = source.columns.index(text_col)
    schema = source.withColumn(ids_col, F.array().cast("array<int>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, sent.value)
        find = encoder.__getitem__
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                joined = [b"".join(map(find, units(t or "", pattern))) for t in part.column(at).cast(pa.string()).to_pylist()]
                ends = np.cumsum([0] + [len(j) // 4 for j in joined]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(joined), np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, ids], [*part.schema.names, ids_col])

    return source.mapInArrow(run, schema)


def piece_table(path: str) -> list[bytes]:
    """Bytes of each id of a byte-level vocabulary; special tokens are their own text."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
    letters = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    pieces = {i: bytes(letters[c] for c in p) for p, i in model["model"]["vocab"].items()}
    pieces |= {t["id"]: t["content"].encode() for t in model["added_tokens"]}
    return [pieces.get(i, b"") for i in range(max(pieces) + 1)]


def decode(frame: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``frame`` with ``text_col``: the text of ``ids_col``, special tokens included.

    Bytes that are no UTF-8 become U+FFFD. Null ids and no ids give an empty
    text; an id outside the vocabulary gives nothing. A column named ``text_col`` is replaced.
    """
    source = frame.drop(text_col)
    at = source.columns.index(ids_col)
    schema = source.withColumn(text_col, F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_table(path)
        table = dict(enumerate(pieces))
        find = lambda i: table.get(i, b"")
        for batch in batches:
            out = []
            for ids in batch.column(at):
                values = ids.values
                if values is None or not len(values):
                    out.append("")
                    continue
                ids = values.to_numpy(zero_copy_only=False)
                known = ids.dtype.kind == "i" and ids.min() >= 0 and ids.max() < len(pieces)
                out.append(b"".join(map(pieces.__getitem__ if known else find, ids.tolist())).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, text_col])

    return source.mapInArrow(run, schema)
