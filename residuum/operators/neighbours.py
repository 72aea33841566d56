"""Exact nearest neighbours and the support measures built on them.

The join never forms all pairs as rows. Source vectors are cut into pieces of
bounded size around pivots; a query visits only groups of pieces of which the
triangle inequality cannot rule out all, in chunks of bounded size, and every visit
returns at most k neighbours. A vector is sent to groups of up to VISIT_ROWS rows,
not to each piece, packed as bytes (a fingerprint as one bit a position), and
compared in tiles of TILE_ROWS by BLOCK_ROWS; fingerprints are compared bit by bit
(see ``fingerprints``). Hot pieces and hot query sets are split, so one task never
holds more than two packed blocks and one tile.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from residuum.functions.columns import canonical_id, hit_columns, hit_passes, prefixed_id
from residuum.operators.fingerprints import nearest_fingerprints
from residuum.storage import cut

SUPPORT_NEIGHBOURS = 5
FINGERPRINT_BITS = 2048
BLOCK_ROWS = 2048
MAX_PIVOTS = 256
MAX_PIECES = 200_000
VISIT_ROWS = 32_768  # rows of each side that meet in one group; fewer where vectors are wide or rows are few
VISIT_BYTES = 1 << 24  # of packed vectors
VISITS_PER_CORE = 4  # groups by chunks that all cores share, at least
TILE_ROWS = 512  # queries compared at once in a task
ROUTE_CELLS = 1_000_000  # query x piece distances held at once


class Metric:
    """Distances between two blocks of vectors, all obeying the triangle inequality."""

    def __init__(self, name: str, bits: int = FINGERPRINT_BITS):
        if name not in ("cosine", "euclidean", "tanimoto"):
            raise ValueError(f"unknown metric: {name}")
        self.name, self.bits = name, bits

    def matrix(self, vectors) -> np.ndarray:
        if self.name == "tanimoto":
            out = np.zeros((len(vectors), self.bits), dtype=np.float32)
            for i, on in enumerate(vectors):
                out[i, np.asarray(on, dtype=np.int64)] = 1.0
            return out
        out = np.asarray([np.asarray(v, dtype=np.float64) for v in vectors])
        if self.name == "cosine":
            norm = np.linalg.norm(out, axis=1, keepdims=True)
            out = out / np.where(norm > 0.0, norm, 1.0)
        return out

    def packed(self, matrix: np.ndarray) -> list[bytes]:
        """Rows of ``matrix`` as bytes."""
        rows = np.packbits(matrix.astype(bool), axis=1) if self.name == "tanimoto" else matrix
        return [row.tobytes() for row in rows]

    def unpacked(self, rows) -> np.ndarray:
        kind = np.uint8 if self.name == "tanimoto" else np.float64
        out = np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1)
        return np.unpackbits(out, axis=1, count=self.bits).astype(np.float32) if self.name == "tanimoto" else out

    def distances(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        dot = left @ right.T
        if self.name == "tanimoto":
            dot = dot.astype(np.float64)
            union = left.sum(1, dtype=np.float64)[:, None] + right.sum(1, dtype=np.float64)[None, :] - dot
            return 1.0 - np.divide(dot, union, out=np.zeros_like(dot), where=union > 0.0)
        if self.name == "cosine":
            return np.sqrt(np.clip(2.0 - 2.0 * dot, 0.0, None))
        square = (left * left).sum(1)[:, None] + (right * right).sum(1)[None, :] - 2.0 * dot
        return np.sqrt(np.clip(square, 0.0, None))

    def reported(self, distances: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Distances of chosen row pairs in the form the caller sees."""
        if self.name == "cosine":
            return distances * distances / 2.0
        return np.sqrt(((left - right) ** 2).sum(1)) if self.name == "euclidean" else distances


def _vector_type(metric: Metric) -> str:
    return "array<int>" if metric.name == "tanimoto" else "array<double>"


def _extended(df: DataFrame, extra: str) -> T.StructType:
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(extra).fields])


def _smallest(distances: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the k smallest per row, ties by ``order``."""
    by_order = np.argsort(order, kind="stable")
    table = distances[:, by_order]
    k = min(k, table.shape[1])
    edge = np.partition(table, k - 1, axis=1)[:, k - 1 : k]
    rows, cols = np.nonzero(table <= edge)
    ranked = np.lexsort((cols, table[rows, cols], rows))
    rows, cols = rows[ranked], cols[ranked]
    first = np.searchsorted(rows, rows, side="left")
    keep = np.arange(len(rows)) - first < k
    return rows[keep], by_order[cols[keep]]


def nearest_neighbours(
    queries: DataFrame,
    source: DataFrame,
    metric: str,
    k: int = SUPPORT_NEIGHBOURS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The k nearest source rows of each query: id, neighbour, distance, rank.

    Both frames carry ``id`` and ``vec``; the source also ``ord`` (bigint), the
    tie order. Distances are exact; a source entity finds itself. Fingerprints are
    as wide as the largest position in either frame asks for.
    """
    bits = FINGERPRINT_BITS
    if metric == "tanimoto":
        top = F.max(F.array_max("vec")).alias("top")
        widest = queries.agg(top).unionByName(source.agg(top)).agg(F.max("top")).first()[0]
        bits = max(bits, int(widest if widest is not None else -1) + 1)
    measure = Metric(metric, bits)
    vec = _vector_type(measure)
    # of equal vectors only the first k can ever be neighbours
    same = Window.partitionBy("vec").orderBy("ord")
    source = source.select("id", F.col("ord").cast("bigint").alias("ord"), F.col("vec").cast(vec).alias("vec"))
    source = cut(source.withColumn("_r", F.row_number().over(same)).where(F.col("_r") <= k).drop("_r"), "knn-source")
    queries = queries.select("id", F.col("vec").cast(vec).alias("vec"))

    n = source.count()
    # a very large source gets larger pieces, so that the index of the pieces stays small
    block_rows = max(block_rows, math.ceil(2 * n / MAX_PIECES))
    wanted = max(1, math.ceil(n / block_rows))
    pivots = (
        source.orderBy(F.md5(F.col("id").cast("string")), "id").limit(min(wanted, MAX_PIVOTS)).select("vec").collect()
    )
    if not pivots:
        return queries.sparkSession.createDataFrame(
            [], _extended(queries.select("id"), "neighbour string, distance double, rank int")
        )
    centres = measure.matrix([r.vec for r in pivots])

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for start in range(0, len(whole), TILE_ROWS):
                batch = whole.iloc[start : start + TILE_ROWS]
                own = measure.matrix(batch["vec"])
                d = measure.distances(own, centres)
                cell = d.argmin(1)
                yield pd.DataFrame({
                    "id": batch["id"], "ord": batch["ord"], "vec": measure.packed(own), "cell": cell.astype("int32"), "away": d[np.arange(len(d)), cell]})

    placed = source.mapInPandas(assign, _extended(source.select("id", "ord"), "vec binary, cell int, away double"))
    sizes = placed.groupBy("cell").agg(
        F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("subs")
    )
    placed = cut(
        placed.join(sizes, "cell").withColumn("sub", F.pmod(F.xxhash64("id"), F.col("subs")).cast("int")).drop("subs"),
        "knn-pieces",
    )
    pieces = placed.groupBy("cell", "sub").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius"))
    # at most MAX_PIECES / 2 full pieces and one more for each pivot
    stats = pieces.toPandas().sort_values(["cell", "sub"], ignore_index=True)
    cells, counts, radii = stats["cell"].to_numpy(), stats["n"].to_numpy(), stats["radius"].to_numpy()
    # pieces decide what a query must see; whole groups of pieces are what its vector is sent to
    share = math.ceil(n / math.sqrt(VISITS_PER_CORE * queries.sparkSession.sparkContext.defaultParallelism))
    visit_rows = max(256, min(VISIT_ROWS, VISIT_BYTES // len(measure.packed(centres[:1])[0]), max(share, TILE_ROWS)))
    group = (np.cumsum(counts) - 1) // visit_rows
    firsts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    groups = queries.sparkSession.createDataFrame(
        pd.DataFrame({"cell": cells, "sub": stats["sub"], "visit": group}), "cell int, sub int, visit int"
    )
    placed = placed.join(F.broadcast(groups), ["cell", "sub"])

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a batch visits up to every piece: its visits are found and handed on in slices
        step = max(1, min(TILE_ROWS, ROUTE_CELLS // max(len(cells), 1)))
        for whole in batches:
            for start in range(0, len(whole), step):
                batch = whole.iloc[start : start + step]
                own = measure.matrix(batch["vec"])
                d = measure.distances(own, centres)[:, cells]
                far = d + radii
                turn = np.argsort(far, axis=1, kind="stable")
                enough = np.cumsum(counts[turn], axis=1) >= min(k, counts.sum())
                at = enough.argmax(1)
                bound = far[np.arange(len(far)), turn[np.arange(len(far)), at]]
                needed = d - radii <= (bound + 1e-9 * (1.0 + bound))[:, None]
                reached, visits = np.logical_or.reduceat(needed, firsts, axis=1), group[firsts].astype("int32")
                yield pd.DataFrame({"id": batch["id"], "vec": measure.packed(own), "visits": [visits[r] for r in reached]})

    # a query is stored once with the numbers of its visits; only the shuffle repeats its vector
    routed = cut(queries.mapInPandas(route, _extended(queries.select("id"), "vec binary, visits array<int>")), "knn-routes")
    routed = routed.withColumn("visit", F.explode("visits")).drop("visits")
    loads = routed.groupBy("visit").agg(F.ceil(F.count(F.lit(1)) / visit_rows).cast("int").alias("chunks"))
    asked = routed.join(F.broadcast(loads), "visit").withColumn(
        "chunk", F.pmod(F.xxhash64("id", F.lit(7)), F.col("chunks")).cast("int")
    )
    offered = placed.join(F.broadcast(loads), "visit").withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    )

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"id": [], "neighbour": [], "ord": [], "distance": []})
        left_vec, right_vec, order = left["vec"].tolist(), right["vec"].tolist(), right["ord"].to_numpy()
        ids, names, found = left["id"].to_numpy(), right["id"].to_numpy(), []
        if metric == "tanimoto":
            blocks = (np.frombuffer(b"".join(v), np.uint8).reshape(len(v), -1) for v in (left_vec, right_vec))
            rows, cols, distance = nearest_fingerprints(*blocks, order, k)
            return pd.DataFrame({"id": ids[rows], "neighbour": names[cols], "ord": order[cols], "distance": distance})
        for start in range(0, len(left_vec), TILE_ROWS):
            near, best = measure.unpacked(left_vec[start : start + TILE_ROWS]), []
            for first in range(0, len(right_vec), BLOCK_ROWS):
                far = measure.unpacked(right_vec[first : first + BLOCK_ROWS])
                d = measure.distances(near, far)
                rows, cols = _smallest(d, order[first : first + BLOCK_ROWS], k)
                best.append((rows, cols + first, d[rows, cols], measure.reported(d[rows, cols], near[rows], far[cols])))
            rows, cols, d, distance = (np.concatenate(x) for x in zip(*best))
            ranked = np.lexsort((order[cols], d, rows))
            rows = rows[ranked]
            keep = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < k
            found.append((rows[keep] + start, cols[ranked][keep], distance[ranked][keep]))
        rows, cols, distance = (np.concatenate(x) for x in zip(*found))
        return pd.DataFrame({"id": ids[rows], "neighbour": names[cols], "ord": order[cols], "distance": distance})

    out_type = _extended(queries.select("id"), "neighbour string, ord bigint, distance double")
    out_type["neighbour"].dataType = source.schema["id"].dataType
    keys = ["visit", "chunk"]
    found = (
        asked.select(*keys, "id", "vec")
        .groupBy(*keys)
        .cogroup(offered.select(*keys, "id", "ord", "vec").groupBy(*keys))
        .applyInPandas(meet, out_type)
    )
    best = Window.partitionBy("id").orderBy("distance", "ord")
    return (
        found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("id", "neighbour", "distance", "rank")
    )


def distance_support(neighbours: DataFrame) -> DataFrame:
    """Nearest and mean distance per entity."""
    return neighbours.groupBy("id").agg(F.min("distance").alias("nearest"), F.avg("distance").alias("density"))


def neighbour_lists(neighbours: DataFrame) -> DataFrame:
    """Neighbours of each entity as one ordered array of (id, sim)."""
    item = F.struct("rank", F.col("neighbour").alias("id"), (1.0 - F.col("distance")).alias("sim"))
    return neighbours.groupBy("id").agg(F.array_sort(F.collect_list(item)).alias("items")).select(
        "id", F.transform("items", lambda x: F.struct(x["id"].alias("id"), x["sim"].alias("sim"))).alias("neighbours")
    )


def cosine_support(vectors: DataFrame, source_ids: DataFrame, **options) -> DataFrame:
    """Cosine distance of every entity to its nearest source entities."""
    source = vectors.join(source_ids, "id", "left_semi").withColumn("ord", F.xxhash64("id"))
    return distance_support(nearest_neighbours(vectors, source, "cosine", **options))


def projected_support(vectors: DataFrame, source_ids: DataFrame, max_components: int = 32, **options) -> DataFrame:
    """Euclidean support after standardising and projecting on the source."""
    source = vectors.join(source_ids, "id", "left_semi")
    n = source.count()
    if n < 2:
        return vectors.sparkSession.createDataFrame([], "id string, nearest double, density double")
    dims = len(source.select("vec").first().vec)
    as_vector = lambda df: df.withColumn("raw", array_to_vector("vec"))
    # population deviation as in the usual scaler; constant columns keep scale one
    scale = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True).fit(as_vector(source))
    std, mean = scale.std.toArray() * math.sqrt((n - 1) / n), scale.mean.toArray()
    std = np.where(std > 0.0, std, 1.0)
    centred = lambda v: F.zip_with(
        v, F.array(*[F.struct(F.lit(float(m)), F.lit(float(s))) for m, s in zip(mean, std)]),
        lambda x, ms: (x - ms["col1"]) / ms["col2"],
    )
    scaled = vectors.select("id", centred(F.col("vec")).alias("vec"))
    components = min(max_components, n - 1, dims)
    if components >= 2 and dims > components:
        train = as_vector(scaled.join(source_ids, "id", "left_semi"))
        model = PCA(k=components, inputCol="raw", outputCol="projected").fit(train)
        scaled = model.transform(as_vector(scaled)).select("id", vector_to_array("projected").alias("vec"))
    else:
        components = dims
    reference = scaled.join(source_ids, "id", "left_semi").withColumn("ord", F.xxhash64("id"))
    width = max(math.sqrt(max(components, 1)), 1.0)
    found = nearest_neighbours(scaled, reference, "euclidean", **options)
    return distance_support(found.withColumn("distance", F.col("distance") / width))


def tanimoto_neighbours(prints: DataFrame, source_ids: DataFrame, k: int = SUPPORT_NEIGHBOURS, **options) -> DataFrame:
    """Most similar source fingerprints by Tanimoto; ties keep the source order ``ord``."""
    source = prints.join(source_ids, "id", "left_semi").select("id", "vec", "ord")
    return nearest_neighbours(prints, source, "tanimoto", k, **options)


# --- alignment hits ----------------------------------------------------------


def scored_hits(hits: DataFrame) -> DataFrame:
    """Hit table with clean ids, coverage and support score."""
    return hit_columns(hits).withColumns(
        {"query_id": prefixed_id("query"), "target_id": prefixed_id("target")}
    )


def direct_neighbours(hits: DataFrame, source_ids: DataFrame, k: int = SUPPORT_NEIGHBOURS) -> DataFrame:
    """Best k source targets per query: query_id, target_id, score, rank."""
    usable = hits.where("query_id <> '' and target_id <> '' and support_score is not null")
    usable = usable.join(source_ids.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    best = usable.groupBy("query_id", "target_id").agg(
        F.max(F.struct("support_score", "bits")).alias("best")
    )
    order = Window.partitionBy("query_id").orderBy(
        F.col("best.support_score").desc(), F.col("best.bits").desc(), F.col("target_id").asc()
    )
    return (
        best.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "target_id", F.col("best.support_score").alias("score"), "rank")
    )


def direct_support(entities: DataFrame, neighbours: DataFrame, k: int = SUPPORT_NEIGHBOURS) -> DataFrame:
    """Distance to the best hit and mean over k slots; missing hits count zero."""
    item = F.struct("rank", F.col("target_id").alias("id"), F.col("score").alias("sim"))
    grouped = neighbours.groupBy(F.col("query_id").alias("id")).agg(
        F.max("score").alias("_best"), F.sum("score").alias("_sum"), F.array_sort(F.collect_list(item)).alias("items")
    )
    return entities.select("id").distinct().join(grouped, "id", "left").select(
        "id",
        (1.0 - F.coalesce("_best", F.lit(0.0))).alias("nearest"),
        (1.0 - F.coalesce("_sum", F.lit(0.0)) / k).alias("density"),
        F.transform(
            F.coalesce("items", F.array().cast("array<struct<rank:int,id:string,sim:double>>")),
            lambda x: F.struct(x["id"].alias("id"), x["sim"].alias("sim")),
        ).alias("neighbours"),
    )


def family_support(entities: DataFrame, hits: DataFrame, source_ids: DataFrame) -> DataFrame:
    """Support through reference families (column ``target``) that a source target also hits."""
    good = hits.where(hit_passes())
    families = good.join(source_ids.select(F.col("id").alias("query_id")), "query_id", "left_semi")
    families = families.select("target").distinct()
    reach = good.join(families, "target", "left_semi").groupBy("query_id", "target").agg(
        F.max("support_score").alias("score")
    )
    best = reach.groupBy(F.col("query_id").alias("id")).agg(
        F.max("score").alias("_best"), F.count(F.lit(1)).alias("_families")
    )
    count = F.coalesce("_families", F.lit(0))
    return entities.select("id").distinct().join(best, "id", "left").select(
        "id",
        (1.0 - F.least(F.greatest(F.coalesce("_best", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))).alias("distance"),
        (count == 0).cast("double").alias("family_unseen"),
        (1.0 / (1.0 + count)).alias("family_sparsity"),
    )


def joint_distance(
    pairs: DataFrame, drug_lists: DataFrame, target_lists: DataFrame, source_pairs: DataFrame
) -> DataFrame:
    """Distance of each distinct pair to the closest observed similar pair.

    At most k x k neighbour pairs per query pair are formed; the pair itself is
    never its own support.
    """
    asked = pairs.select(canonical_id("dr_id").alias("d"), canonical_id("pr_id").alias("t")).distinct()
    left = drug_lists.select(F.col("id").alias("d"), F.col("neighbours").alias("_dn"))
    right = target_lists.select(F.col("id").alias("t"), F.col("neighbours").alias("_tn"))
    wide = asked.join(left, "d").join(right, "t")
    wide = wide.select("d", "t", F.explode("_dn").alias("a"), "_tn").select("d", "t", "a", F.explode("_tn").alias("b"))
    near = wide.select(
        "d", "t", F.col("a.id").alias("key_a"), F.col("b.id").alias("key_b"), (F.col("a.sim") * F.col("b.sim")).alias("sim")
    ).where(~((F.col("key_a") == F.col("d")) & (F.col("key_b") == F.col("t"))))
    seen = near.join(source_pairs.select("key_a", "key_b"), ["key_a", "key_b"], "left_semi")
    best = seen.groupBy("d", "t").agg(F.max("sim").alias("_best"))
    return asked.join(best, ["d", "t"], "left").select(
        F.col("d").alias("dr_id"),
        F.col("t").alias("pr_id"),
        (1.0 - F.least(F.greatest(F.coalesce("_best", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))).alias(
            "joint_nearest_train_distance"
        ),
    )


def covered_rows(rows: DataFrame, stores: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Rows whose ids occur in every store; stores are (id column, table with id).

    The stores of one column are met with each other first, so rows meet one table of
    ids per column; that is stored, so that its size is known.
    """
    known: dict[str, DataFrame] = {}
    for key, store in stores:
        ids = store.select(F.col("id").alias("_id")).distinct()
        known[key] = known[key].join(ids, "_id", "left_semi") if key in known else ids
    out = rows
    for key, ids in known.items():
        out = out.join(cut(ids, "covered-ids"), canonical_id(out[key]) == F.col("_id"), "left_semi")
    return out
