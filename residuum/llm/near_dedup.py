"""Near-duplicate classes by one-permutation MinHash.

One hash per shingle; the hash range is cut into bins and each bin keeps its
minimum. Empty bins borrow by optimal densification (Shrivastava, 2017): bin i
asks bins drawn by its own hash sequence until one is filled, so that two texts
borrow alike exactly as often as their sets agree. Bins are grouped to bands, texts that share a
band's hash meet in a bucket, and a bucket gives a star of candidate edges (its
hub with every member), never all pairs. Every edge is confirmed on full sets.

Texts with equal sets are one node. Each node is compared with one of its hubs only, which joins
most groups at the cost of one set a node. A star may miss a link between two members
that both fail at the hub; so buckets whose members are then in different components are confirmed in
cells: a bucket's members outside its largest component are cut into blocks, so is that component, and each
block of the first meets each block of both once. A set travels once to a cell, not once to a pair; all its
links are found there on full sets, and only those that join components leave. Before a star's full sets are
compared, a few bits of each bin rule out pairs that are ``BOUND`` standard deviations below the
threshold. Losses are a pair that shares no band and a pair ruled out by its bits: each
below 1e-5 for a pair at the threshold, less above it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residuum.llm.components import components
from residuum.llm.text import WordHashes, hashes_of, mix, shingle_set, texts, words
from residuum.storage import cut

#: Bins per band.
BAND_ROWS = 6
#: Chance that a pair at the threshold shares no band.
MISS = 1e-5
#: Bits kept of each bin for the estimate that rules out pairs, and its one-sided bound in standard deviations.
PLANES = 4
BOUND = 4.3
#: Nodes up to which their ids are sent to every task (16 bytes each); more are joined by a shuffle.
SENT_IDS = 1_000_000
SENT_NAMES = 500_000
#: Members of one hub verified in one slice.
SLICE = 500
#: Members and shingles of one block of a cell (about), and shingles compared side by side.
CELL, CELL_SHINGLES, COLUMNS = 256, 2_000_000, 4096


def band_count(percent: int, rows: int = BAND_ROWS, miss: float = MISS) -> int:
    """Bands after which a pair at ``percent`` is missed with probability ``miss``."""
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))


def borrow_table(bins: int, tries: int = 64) -> np.ndarray:
    """Bin asked at each attempt by each empty bin: fixed draws, alike for all texts."""
    i = np.arange(bins * tries, dtype=np.uint64) + np.uint64(1)
    return (mix(i * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(bins)).astype(np.int64).reshape(tries, bins)


def bin_minima(shingles: np.ndarray, bins: int, table: np.ndarray) -> np.ndarray:
    """Minimum of each bin of a sorted shingle set, with empty bins densified."""
    edges = (np.arange(bins, dtype=np.uint64) * np.uint64((1 << 64) // bins)).astype(np.uint64)
    at = np.searchsorted(shingles, edges)
    ends = np.append(at[1:], len(shingles))
    filled = ends > at
    out = np.zeros(bins, dtype=np.uint64)
    out[filled] = shingles[at[filled]]
    if filled.all():
        return out
    empty = np.flatnonzero(~filled)
    for row in table:
        asked = row[empty]
        hit = filled[asked]
        out[empty[hit]] = out[asked[hit]]
        empty = empty[~hit]
        if not len(empty):
            return out
    full = np.flatnonzero(filled)  # very small sets: the first filled bin in a fixed order of all bins, one order for each empty bin
    order = mix((empty[:, None] * bins + full + bins * len(table) + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out[empty] = out[full[order.argmin(axis=1)]]
    return out


def band_hashes(minima: np.ndarray, bands: int) -> np.ndarray:
    rows = minima.reshape(bands, -1)
    total = np.arange(bands, dtype=np.uint64)
    for j in range(rows.shape[1]):
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
    return total


def bin_bits(minima: np.ndarray) -> np.ndarray:
    """The lowest ``PLANES`` bits of each bin, plane by plane, as 64-bit words."""
    width = -(-len(minima) // 64) * 64
    bits = np.zeros((PLANES, width), dtype=np.uint8)
    for p in range(PLANES):
        bits[p, : len(minima)] = (minima >> np.uint64(p)) & np.uint64(1)
    return np.packbits(bits, axis=1).reshape(-1).view(np.int64)


def may_link(a: str, b: str, n_a: Column, n_b: Column, bins: int, percent: int) -> Column:
    """Whether the bits of two nodes leave a link possible; small sets fill their bins from few shingles and get a wider bound."""
    words_ = -(-bins // 64)
    differing = F.lit(0)
    for w in range(words_):
        planes = [F.get(a, F.lit(p * words_ + w)).bitwiseXOR(F.get(b, F.lit(p * words_ + w))) for p in range(PLANES)]
        union = planes[0]
        for x in planes[1:]:
            union = union.bitwiseOR(x)
        differing = differing + F.bit_count(union)
    q = percent / 100 + (1 - percent / 100) / (1 << PLANES)
    samples = F.least(F.lit(bins), n_a, n_b)
    return differing <= bins * ((1 - q) + BOUND * math.sqrt(q * (1 - q)) / F.sqrt(samples))


def signatures(docs: DataFrame, id_col: str, text_col: str, n: int, bands: int, rows: int = BAND_ROWS) -> DataFrame:
    """(id, n_shingles, node, bands, bits) per row; node is a 128-bit name of the set, null without words."""
    bins = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, table = WordHashes(), borrow_table(bins)
        for batch in batches:
            sizes, nodes, marks, bits = [], [], [], []
            for text in texts(batch.column(1)):
                s = shingle_set(hashes_of(words(text), cache), n)
                sizes.append(len(s))
                if not len(s):
                    nodes.append(None), marks.append(None), bits.append(None)
                    continue
                nodes.append(f"{int(s.sum(dtype=np.uint64)):016x}{int(mix(s * np.uint64(3)).sum(dtype=np.uint64)):016x}")
                minima = bin_minima(s, bins, table)
                marks.append(band_hashes(minima, bands).view(np.int64)), bits.append(bin_bits(minima))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.string()), pa.array(marks, pa.list_(pa.int64())),
                 pa.array(bits, pa.list_(pa.int64()))],
                ["id", "n_shingles", "node", "bands", "bits"],
            )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "id long, n_shingles long, node string, bands array<long>, bits array<long>"
    )


def shingle_sets(docs: DataFrame, text_col: str, n: int) -> DataFrame:
    """(node, shingles): the full set of each row that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            nodes, sets = [], []
            for text in texts(batch.column(0)):
                s = shingle_set(hashes_of(words(text), cache), n)
                if len(s):
                    nodes.append(f"{int(s.sum(dtype=np.uint64)):016x}{int(mix(s * np.uint64(3)).sum(dtype=np.uint64)):016x}")
                    sets.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.string()), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"]
            )

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "node string, shingles array<long>")


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(hub, node, shared): common shingles of each pair of nodes.

    A hub with many members is cut into slices of ``SLICE`` members, each of
    which gets the hub's set once, so no task waits for one hub.
    """
    degree = pairs.groupBy("hub").agg(F.count("*").alias("degree"))
    slices = degree.select("hub", F.explode(F.sequence(F.lit(0), F.floor(F.col("degree") / SLICE).cast("int"))).alias("slice"))
    dealt = pairs.join(degree, "hub").select(
        "hub", "node", F.pmod(F.xxhash64("node"), F.floor(F.col("degree") / SLICE).cast("int") + 1).cast("int").alias("slice"))
    hubs = sets.select(F.col("node").alias("hub"), F.col("shingles").alias("hub_shingles")).join(sent(cut(slices, "slices")), "hub")
    members = sets.join(sent(cut(dealt, "dealt")), "node")
    return members.join(hubs, ["hub", "slice"]).select(
        "hub", "node", F.size(F.array_intersect("shingles", "hub_shingles")).cast("long").alias("shared")
    )


def sent(names: DataFrame) -> DataFrame:
    """A written table of names: sent to the tasks up to ``SENT_NAMES`` rows (a hundred bytes each), joined by a shuffle beyond."""
    return F.broadcast(names) if names.count() <= SENT_NAMES else names


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, percent: int = 85, rows: int = BAND_ROWS
) -> DataFrame:
    """Class of each row: (id, n_shingles, component_id, kept).

    Two rows are linked if 100 * shared shingles >= ``percent`` * all shingles of
    both. component_id is the smallest id reachable over links, kept marks that
    row. Null and empty texts have no shingle and stay alone; a null id keeps its
    row, takes part in links and is never a component's id unless all ids there
    are null (then null, and kept is true). Repeated rows are linked like any
    copies and all with the smallest id are kept. Other columns are ignored.
    """
    bands = band_count(percent, rows)
    marked = cut(signatures(docs, id_col, text_col, n, bands, rows), "signatures")
    nodes = cut(
        marked.where("node IS NOT NULL").groupBy("node", "n_shingles")
        .agg(F.min("id").alias("low"), F.count("*").alias("copies"), F.any_value("bands").alias("bands"), F.any_value("bits").alias("bits")),
        "nodes",
    )
    # only names travel until it is known which buckets have two members
    exploded = nodes.select(F.unhex("node").alias("name"), F.posexplode("bands").alias("band", "mark"))
    exploded = exploded.select("name", F.xxhash64("band", "mark").alias("bucket"))
    shared = exploded.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    met = cut(exploded.join(shared.select("bucket"), "bucket").select(F.lower(F.hex("name")).alias("node"), "bucket"), "met")
    about = nodes.select("node", "n_shingles", "copies", F.coalesce("low", F.lit((1 << 63) - 1)).alias("rank"))
    members = cut(met.join(about, "node"), "buckets")

    wanted = members.select("node").distinct()
    ids = cut(nodes.join(wanted, "node", "left_semi").select(F.col("low").alias(id_col)).distinct(), "wanted")
    if ids.count() <= SENT_IDS:
        ids = F.broadcast(ids)
    some = docs.select(F.col(id_col).cast("long").alias(id_col), text_col)
    known = some.join(ids, id_col, "left_semi").unionByName(some.where(F.col(id_col).isNull()))
    sets = cut(shingle_sets(known, text_col, n).join(wanted, "node", "left_semi").dropDuplicates(["node"]), "sets")

    fits = F.least("n_shingles", "hub_size") * 100 >= F.greatest("n_shingles", "hub_size") * percent
    size = nodes.select("node", "n_shingles")
    bits = cut(nodes.join(wanted, "node", "left_semi").select("node", "n_shingles", "bands", "bits"), "bits")
    bins = bands * rows
    order = F.struct((-F.col("copies")).alias("c"), "rank", "node")
    hubs = members.groupBy("bucket").agg(F.min(F.struct(order.alias("order"), "n_shingles")).alias("h"))
    hubs = hubs.select("bucket", "h.order", F.col("h.n_shingles").alias("hub_size"))
    # of a node's hubs the first by the order that elects them, so that buckets of one group agree
    pairs = members.join(hubs, "bucket").where((F.col("order.node") != F.col("node")) & fits)
    pairs = pairs.groupBy("node").agg(F.min("order").alias("h")).select(F.col("h.node").alias("hub"), "node")
    pairs = cut(_possible(cut(pairs, "stars"), bits, bins, percent), "pairs")
    roots = cut(components(_links(_measured(_sized(verify(pairs, sets), size), percent))), "roots")
    now = members.select("bucket", "node", "n_shingles").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    now = cut(now, "rooted")
    mixed = now.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("bucket")
    open_members = cut(now.join(mixed, "bucket"), "open")
    if open_members.isEmpty():
        return _result(marked, nodes, roots)
    links = in_cells(open_members, sets, percent).unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
    return _result(marked, nodes, cut(components(links), "roots"))


def _links(tested: DataFrame) -> DataFrame:
    return tested.where("linked").select(F.col("hub").alias("a"), F.col("node").alias("b"))


def _sized(found: DataFrame, size: DataFrame) -> DataFrame:
    hubs = size.select(F.col("node").alias("hub"), F.col("n_shingles").alias("hub_size"))
    return found.join(size, "node").join(hubs, "hub").select("hub", "node", "shared", "n_shingles", "hub_size")


def _measured(tested: DataFrame, percent: int) -> DataFrame:
    union = F.col("n_shingles") + F.col("hub_size") - F.col("shared")
    return tested.withColumn("linked", F.col("shared") * 100 >= union * percent)


def _possible(pairs: DataFrame, bits: DataFrame, bins: int, percent: int) -> DataFrame:
    """The pairs whose bits leave a link possible."""
    hubs = bits.select(F.col("node").alias("hub"), F.col("n_shingles").alias("hub_size"), F.col("bits").alias("hub_bits"))
    both = pairs.join(bits, "node").join(hubs, "hub")
    return both.where(may_link("bits", "hub_bits", F.col("n_shingles"), F.col("hub_size"), bins, percent)).select("hub", "node")


def in_cells(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between members (bucket, node, n_shingles, root) of one bucket and different roots, enough to join all that are linked.

    The members outside a bucket's largest component and those inside are dealt to blocks by a hash. Every block outside
    shares a cell with each block of either side, so no pair is left out. A bucket with one large component
    and few members outside costs in proportion to its size. Buckets around the same component become one region where that takes
    fewer sets than their own cells would (a node is in many buckets of its group).
    """
    largest = _largest(members, "bucket")
    placed = members.join(largest.select("bucket", "main", "cost"), "bucket").withColumn("inside", F.col("root") == F.col("main"))
    once = placed.groupBy("main", "node").agg(F.any_value("root").alias("root"), F.any_value("n_shingles").alias("n_shingles"))
    whole = _largest(once.withColumn("bucket", F.col("main")), "bucket", main=True).select("main", F.col("cost").alias("whole_cost"))
    costs = largest.groupBy("main").agg(F.sum("cost").alias("cost")).join(whole, "main")
    merged = costs.where("whole_cost <= cost").select("main", F.lit(True).alias("merged"))
    region = F.when(F.col("merged"), F.xxhash64("main", F.lit(11))).otherwise(F.xxhash64("bucket", F.lit(12)))
    dealt = placed.drop("cost").join(merged, "main", "left").select(region.alias("region"), "main", "node", "root", "n_shingles").distinct()
    dealt = dealt.join(_largest(dealt, "region", main=True).select("region", "outside", "within"), "region")
    side = F.col("root") == F.col("main")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), F.when(side, F.col("within")).otherwise(F.col("outside"))).cast("int"))
    numbers = lambda n: F.sequence(F.lit(0), n - 1)
    cell = lambda low, kind, high: F.xxhash64(F.col("region"), low.cast("int"), F.lit(kind), high.cast("int"))
    with_main = F.transform(numbers(F.col("within")), lambda j: cell(F.col("block"), 1, j))
    with_others = F.transform(numbers(F.col("outside")), lambda j: cell(F.least("block", j), 0, F.greatest("block", j)))
    inner = F.transform(numbers(F.col("outside")), lambda i: cell(i, 1, F.col("block")))
    cells = dealt.select("node", "root", F.when(side, inner).otherwise(F.concat(with_main, with_others)).alias("cells"))
    by_node = cut(cells.groupBy("node").agg(F.any_value("root").alias("root"), F.flatten(F.collect_list("cells")).alias("cells")), "cells")
    rows = sets.join(sent(by_node), "node").select(F.explode("cells").alias("cell"), "node", "root", "shingles")
    columns = COLUMNS
    return rows.groupBy("cell").applyInPandas(lambda frame: _joined(frame, percent, columns), "a string, b string")


def _largest(members: DataFrame, place: str, main: bool = False) -> DataFrame:
    """(place, main, outside, within, cost): a place's largest root (or the given ``main``), blocks of both sides, and sets that its cells take."""
    sizes = members.groupBy(place, *(["main"] if main else []), "root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("weight"))
    chosen = F.max(F.when(F.col("root") == F.col("main"), F.struct("n", "root", "weight"))) if main else F.max(F.struct("n", "root", "weight"))
    most = sizes.groupBy(place, *(["main"] if main else [])).agg(chosen.alias("m"), F.sum("n").alias("n"), F.sum("weight").alias("weight"))
    blocks = lambda n, weight: F.greatest(F.ceil(n / CELL), F.ceil(weight / CELL_SHINGLES), F.lit(1)).cast("int")
    out, within = F.col("n") - F.col("m.n"), F.col("m.n")
    most = most.select(
        place, F.col("m.root").alias("main") if not main else F.col("main"), out.alias("out_n"), within.alias("in_n"),
        blocks(out, F.col("weight") - F.col("m.weight")).alias("outside"), blocks(within, F.col("m.weight")).alias("within"))
    return most.withColumn("cost", F.col("in_n") * F.col("outside") + F.col("out_n") * (F.col("outside") + F.col("within")))


def _joined(frame: pd.DataFrame, percent: int, columns: int) -> pd.DataFrame:
    """Links of one cell that join different components."""
    frame = frame.sort_values("node").drop_duplicates("node")
    sets = frame["shingles"].tolist()
    n, sizes = len(sets), np.array([len(s) for s in sets])
    _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1  # shingles of one set only are in no intersection
    shared_ones = times[place] > 1
    owner, column = np.repeat(np.arange(n), sizes)[shared_ones], column[place[shared_ones]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    shared = np.zeros((n, n), np.float32)  # whole numbers below 2 ** 24 are exact
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        low, high = np.searchsorted(column, [begin, begin + columns])
        part = np.zeros((n, columns), np.float32)
        part[owner[low:high], column[low:high] - begin] = 1
        shared += part @ part.T
    shared = shared.astype(np.float64)
    union = sizes[:, None] + sizes - shared
    names, roots = frame["node"].tolist(), frame["root"].tolist()
    top = {r: r for r in roots}

    def find(r: str) -> str:
        while top[r] != r:
            top[r] = top[top[r]]
            r = top[r]
        return r

    out = []
    for i, j in zip(*np.nonzero(np.triu(shared * 100.0 >= union * float(percent), 1))):
        a, b = find(roots[i]), find(roots[j])
        if a != b:
            top[max(a, b)] = min(a, b)
            out.append((names[i], names[j]))
    return pd.DataFrame(out, columns=["a", "b"])


def _result(marked: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    lowest = nodes.join(roots, "node").groupBy("root").agg(F.min("low").alias("lowest"))
    moved = roots.join(lowest, "root").select("node", "lowest")
    label = nodes.join(moved, "node", "left").select("node", F.when(F.col("lowest").isNull(), F.col("low")).otherwise(F.col("lowest")).alias("component_id"))
    return marked.select("id", "n_shingles", "node").join(label, "node", "left").select(
        "id", "n_shingles",
        F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
