"""Benchmark decontamination by size-partitioned MinHash containment search.

An item with n shingles, of which a text must hold ``percent``, may lack at most
``absent`` of them. Its sketch is the bottom of its MinHash order: the
``absent + depth`` smallest shingle hashes, of which a match must hold ``depth`` or
more, whatever it lacks. So the sketch of the small set is searched in the long
text (containment MinHash) without loss. Texts are partitioned by size and the
depth grows with the partition, since long texts hit a single shingle by chance
more often. Candidates are verified by exact containment of the full sets.

Items are taken in blocks of bounded size; each block is one pass over the texts
without a shuffle, so memory depends on the block and not on either table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residuum.llm.text import WordHashes, gram_hashes, hashes_of, shingle_set, texts, words
from residuum.storage import cut

#: Item shingles in one block (about 16 bytes each in every task).
BLOCK_SHINGLES = 2_000_000
#: Text sizes (words) up to which 1, 2, ... hits are asked; larger texts need one more.
PARTITIONS = (256, 4096)
_BITS = 20


def item_sets(items: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(item_id, width, shingles): an item with fewer than ``n`` words is one shingle of its own width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            widths, sets = [], []
            for text in texts(batch.column(1)):
                tokens = words(text)
                widths.append(min(n, len(tokens)))
                sets.append(shingle_set(hashes_of(tokens, cache), n).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(widths, pa.int32()), pa.array(sets, pa.list_(pa.int64()))],
                ["item_id", "width", "shingles"],
            )

    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "item_id long, width int, shingles array<long>").where("width > 0")


class Block:
    """Sketches and full sets of the items of one block and one shingle width."""

    def __init__(self, sets: list[np.ndarray], ids: list[int | None], percent: int):
        self.sets, self.ids = sets, ids
        self.need = [-(-len(s) * percent // 100) for s in sets]
        depths = len(PARTITIONS) + 1
        parts = [(s[: len(s) - need + depths], i, len(s) - need) for i, (s, need) in enumerate(zip(sets, self.need))]
        hashes = np.concatenate([p[0] for p in parts])
        owner = np.concatenate([np.full(len(p[0]), p[1]) for p in parts])
        # depth from which a sketch entry counts
        depth = np.concatenate([np.maximum(np.arange(len(p[0])) - p[2] + 1, 1) for p in parts])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owner, self.depth = hashes[order], owner[order], depth[order]
        self.seen = np.zeros(1 << _BITS, dtype=bool)
        self.seen[(self.hashes >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def find(self, grams: np.ndarray, size: int) -> list[tuple[int | None, int, int]]:
        """(item id, item shingles, shared) of each item that the text contains."""
        some = grams[self.seen[(grams >> np.uint64(64 - _BITS)).astype(np.int64)]]
        if not len(some):
            return []
        some = np.unique(some)
        left = np.searchsorted(self.hashes, some, "left")
        count = np.searchsorted(self.hashes, some, "right") - left
        if not count.any():
            return []
        at = np.repeat(left - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        depth = 1 + sum(size > bound for bound in PARTITIONS)
        hits = np.bincount(self.owner[at[self.depth[at] <= depth]], minlength=len(self.sets))
        wanted = np.minimum(depth, self.need)
        candidates = np.flatnonzero(hits >= np.maximum(wanted, 1))
        if not len(candidates):
            return []
        full = np.unique(grams)
        out = []
        for i in candidates:
            s = self.sets[i]
            place = np.minimum(np.searchsorted(full, s), len(full) - 1)
            shared = int((full[place] == s).sum())
            if shared >= self.need[i]:
                out.append((self.ids[i], len(s), shared))
        return out


def contained_items(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", doc_text: str = "text",
    item_text: str = "text", n: int = 5, percent: int = 80,
) -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_shared, containment): each text and item with containment of ``percent``.

    Containment is the share of the item's distinct ``n``-word shingles found in
    the text. An item with fewer words is searched as one run of its words; null
    and empty items are in no text, null and empty texts hold no item. Null ids
    keep their rows. Repeated texts and repeated items give a row for each pair.
    Texts are read whole. Other columns are ignored.
    """
    sets = cut(item_sets(items, item_id, item_text, n), "items")
    total = sets.agg(F.sum(F.size("shingles"))).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_SHINGLES))
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(doc_text).cast("string").alias("text"))
    out = None
    for k in range(blocks):
        rows = sets.where(F.pmod(F.xxhash64("item_id", "shingles"), F.lit(blocks)) == k).collect()
        found = _search(source, rows, percent)
        out = found if out is None else out.unionByName(found)
    return out


def _search(source: DataFrame, rows: list, percent: int) -> DataFrame:
    groups: dict[int, tuple[list, list]] = {}
    for r in rows:
        ids, sets = groups.setdefault(r["width"], ([], []))
        ids.append(r["item_id"]), sets.append(np.array(r["shingles"], dtype=np.int64).view(np.uint64))
    sent = source.sparkSession.sparkContext.broadcast(groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        blocks = {w: Block(sets, ids, percent) for w, (ids, sets) in sent.value.items()}
        for batch in batches:
            found = []
            for i, text in enumerate(texts(batch.column(1))):
                hashes = hashes_of(words(text), cache)
                for width, block in blocks.items():
                    for item, size, shared in block.find(gram_hashes(hashes, width), len(hashes)):
                        found.append((i, item, size, shared))
            at = pa.array([f[0] for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), *[pa.array([f[j] for f in found], pa.int64()) for j in (1, 2, 3)],
                 pa.array([f[3] / f[2] for f in found], pa.float64())],
                ["doc_id", "item_id", "n_item_shingles", "n_shared", "containment"],
            )

    return source.mapInArrow(run, "doc_id long, item_id long, n_item_shingles long, n_shared long, containment double")


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose text contains no item; every row is judged by its own text, whatever its id."""
    keyed = cut(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    hit = contained_items(keyed, items, **{**options, "doc_id": "_row"}).select(F.col("doc_id").alias("_hit")).distinct()
    return keyed.join(hit, keyed["_row"] == hit["_hit"], "left_anti").drop("_row")
