"""Entity registries, prior vectors, vector clusters and letter averages."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from residuum.functions.columns import canonical_id, main_component, pair_vector, sequence_composition, unit

POSITION_BLOCK = 256  # positions of one key that meet in one group
POSITION_ROWS = 1024  # groups whose positions are summed at once, fewer where vectors are wide
POSITION_CELLS = 1 << 22  # components of positions summed at once


def entity_registry(rows: DataFrame, id_column: str, text_column: str, phase: str = "phase") -> DataFrame:
    """Per entity: smallest non-empty text, its length and status, sorted phases."""
    text = F.trim(F.col(text_column))
    grouped = rows.groupBy(canonical_id(id_column).alias("id")).agg(
        F.coalesce(F.min(F.when(text != "", text)), F.lit("")).alias("text"),
        F.array_join(F.array_sort(F.collect_set(phase)), "|").alias("phases"),
    )
    return grouped.select(
        "id", "text", F.length("text").alias("text_length"),
        F.when(F.col("text") != "", "ok").otherwise("missing").alias("status"), "phases",
    )


def with_main_component(registry: DataFrame) -> DataFrame:
    """Registry of component texts with the selected component, count, status and note."""
    part = main_component(F.col("text"))
    return registry.withColumn("_c", part).select(
        "id", "text", F.col("_c.selected").alias("selected_component"), F.col("_c.num_components"),
        F.col("_c.status").alias("component_status"), F.col("_c.note").alias("standardization_note"), "phases",
    )


def prior_vectors(entities: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Embedding (where there is one) followed by the sequence composition."""
    composition = sequence_composition(F.col("sequence"))
    both = entities.select("id", composition.alias("_c")).join(
        embeddings.select("id", F.col("vec").alias("_e")), "id", "left"
    )
    found = F.col("_e").isNotNull()
    return both.select(
        "id",
        F.when(found, F.concat("_e", "_c")).otherwise(F.col("_c")).alias("vec"),
        F.when(found, "ok").otherwise("sequence_only_missing_esm_cls").alias("status"),
        F.when(found, F.size("_e") + F.size("_c")).otherwise(F.size("_c")).alias("feature_dim"),
        F.when(found, F.size("_e")).otherwise(0).alias("esm_cls_dim"),
        F.size("_c").alias("sequence_feature_dim"),
    )


def store_coverage(entities: dict[str, DataFrame], stores: dict[str, tuple[str, DataFrame, bool]]) -> DataFrame:
    """Entities of each side covered by every evidence table.

    ``stores``: name -> (side, table with id, is core).
    """
    out = None
    for name, (side, table, core) in stores.items():
        ids = table.select("id").distinct().withColumn("_in", F.lit(1))
        part = entities[side].select("id").distinct().join(ids, "id", "left").agg(
            F.count(F.lit(1)).alias("entities"), F.count("_in").alias("covered")
        )
        part = part.select(
            F.lit(name).alias("store"), F.lit(side).alias("side"), F.lit(core).alias("core"), "entities", "covered",
            F.coalesce(F.try_divide("covered", "entities"), F.lit(0.0)).alias("coverage"),
        )
        out = part if out is None else out.unionByName(part)
    complete = out.groupBy().agg(F.bool_and(~F.col("core") | (F.col("covered") > 0)).alias("core_complete"))
    return out.withColumn("_all", F.lit(1)).join(complete.withColumn("_all", F.lit(1)), "_all").drop("_all")


def tendency_histogram(rows: DataFrame, id_column: str, label: str) -> DataFrame:
    """Share of entities per mean label rounded to tenths, on the grid 0.0 to 1.0."""
    tenth = F.rint(F.col("_m") * 10).cast("int")
    means = rows.where(F.col(label).isNotNull()).groupBy(id_column).agg(F.avg(label).alias("_m"))
    counts = means.groupBy(tenth.alias("tenth")).agg(F.count(F.lit(1)).alias("n"))
    grid = rows.sparkSession.range(11).select(F.col("id").cast("int").alias("tenth"))
    total = counts.agg(F.sum("n").alias("total")).withColumn("_all", F.lit(1))
    full = grid.join(counts, "tenth", "left").withColumn("_all", F.lit(1)).join(total, "_all")
    return full.select(
        (F.col("tenth") / 10.0).alias("tendency"), F.coalesce("n", F.lit(0)).alias("entities"),
        (F.coalesce("n", F.lit(0)) / F.col("total")).alias("frequency"),
    )


def _clustered(vectors: DataFrame, k: int, seed: int) -> DataFrame:
    n = vectors.limit(k).count()
    if n <= 1:
        return vectors.withColumn("env_id", F.lit(0))
    features = vectors.withColumn("features", array_to_vector("vec"))
    model = KMeans(k=n, seed=seed, featuresCol="features", predictionCol="env_id").fit(features)
    return model.transform(features).drop("features")


def environments(
    rows: DataFrame, right: DataFrame, buckets: int, seed: int, left: DataFrame | None = None
) -> DataFrame:
    """k-means buckets of unique targets, or of unique pairs when ``left`` vectors are given."""
    tagged = rows.withColumns({"_d": canonical_id("dr_id"), "_t": canonical_id("pr_id")})
    right = right.select(F.col("id").alias("_t"), F.col("vec").alias("_rv"))
    if left is None:
        keys = ["_t"]
        entity = tagged.select("_t").distinct().join(right, "_t").select("_t", unit(F.col("_rv")).alias("vec"))
    else:
        keys = ["_d", "_t"]
        left = left.select(F.col("id").alias("_d"), F.col("vec").alias("_lv"))
        entity = tagged.select(*keys).distinct().join(left, "_d").join(right, "_t").select(
            *keys, pair_vector(F.col("_lv"), F.col("_rv")).alias("vec")
        )
    found = _clustered(entity, buckets, seed).select(*keys, "env_id")
    return tagged.join(found, keys).drop("_d", "_t")


def cluster_prior(vectors: DataFrame, k: int, seed: int) -> DataFrame:
    """Centre and share of every k-means cluster of entity vectors."""
    found = _clustered(vectors, k, seed)
    sums = mean_vectors(found, ["env_id"], "vec")
    total = found.agg(F.count(F.lit(1)).alias("total")).withColumn("_all", F.lit(1))
    return sums.withColumn("_all", F.lit(1)).join(total, "_all").select(
        "env_id", F.col("vec").alias("centre"), "n", (F.col("n") / F.col("total")).alias("prior")
    )


def mean_vectors(rows: DataFrame, keys: Sequence[str], vector: str, weight: Column | None = None) -> DataFrame:
    """Weighted mean vector per group, built from per-dimension sums."""
    w = F.lit(1.0) if weight is None else weight
    long = rows.select(*keys, w.alias("_w"), F.posexplode(vector).alias("_p", "_x"))
    sums = long.groupBy(*keys, "_p").agg(
        (F.sum(F.col("_w") * F.col("_x")) / F.sum("_w")).alias("_m"), F.count(F.lit(1)).alias("_n")
    )
    # one value per dimension and group: the list below is as long as the vector
    return sums.groupBy(*keys).agg(
        F.max("_n").alias("n"),
        F.transform(F.array_sort(F.collect_list(F.struct("_p", "_m"))), lambda s: s["_m"]).alias("vec"),
    )


def letter_means(sequences: DataFrame) -> DataFrame:
    """Average vector of every letter: rows carry ``sequence`` and per-position ``vecs``."""
    letters = F.split(F.col("sequence"), "")
    pairs = F.arrays_zip(letters.alias("letter"), F.col("vecs").alias("v"))
    long = sequences.select(F.explode(pairs).alias("_z")).select("_z.letter", F.col("_z.v").alias("v"))
    return mean_vectors(long.where("letter <> '' and v is not null"), ["letter"], "v")


def merge_chunk_vectors(chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Chunk vectors averaged by chunk length (start, end, vec)."""
    return mean_vectors(chunks, keys, "vec", F.greatest(F.col("end") - F.col("start"), F.lit(1)).cast("double"))


def merge_positions(chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per-position vectors of overlapping chunks averaged by how often they are covered.

    Chunks are cut at multiples of ``POSITION_BLOCK`` and the pieces of a block meet as
    arrays: a position becomes a row only after the shuffle, from sums over whole arrays.
    """
    start, size, block = F.col("start"), F.col("_n"), F.col("_b") * POSITION_BLOCK
    whole = chunks.withColumn("_n", F.size("vecs")).where("_n > 0")
    cuts = whole.withColumn("_b", F.explode(F.sequence(
        F.floor(start / POSITION_BLOCK).cast("bigint"), F.floor((start + size - 1) / POSITION_BLOCK).cast("bigint"))))
    first, end = F.greatest(start, block), F.least(start + size, block + POSITION_BLOCK)
    vectors = F.col("vecs").cast("array<array<double>>")
    piece = F.struct(first.cast("bigint").alias("at"), F.slice(vectors, (first - start + 1).cast("int"), (end - first).cast("int")).alias("vecs"))
    blocks = cuts.select(*keys, "_b", piece.alias("_piece")).groupBy(*keys, "_b").agg(F.collect_list("_piece").alias("_pieces"))
    added = T.StructType.fromDDL("position bigint, n bigint, vec array<double>")
    out_type = T.StructType([*[blocks.schema[k] for k in keys], *added.fields])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, POSITION_ROWS)
                while part.num_rows > 1 and part.num_rows * POSITION_BLOCK * _widest(part["_pieces"]) > POSITION_CELLS:
                    part = part.slice(0, part.num_rows // 2)
                at += part.num_rows
                places, position, n, vec = _merged_pieces(part["_pieces"], part["_b"].to_numpy())
                columns = [part[k].take(pa.array(places)) for k in keys]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(position), pa.array(n), vec], names=out_type.names)

    return blocks.mapInArrow(merged, out_type)


def _widest(pieces: pa.ListArray) -> int:
    vectors = pieces.flatten().field("vecs").flatten()
    return int(pc.max(pc.list_value_length(vectors)).as_py() or 0)


def _merged_pieces(pieces: pa.ListArray, block: np.ndarray):
    """Block row, position, number of vectors and mean vector of each covered position of some blocks."""
    flat = pieces.flatten()
    row = np.repeat(np.arange(len(pieces)), pc.list_value_length(pieces).to_numpy())
    first, lists = flat.field("at").to_numpy(), flat.field("vecs")
    lengths = pc.list_value_length(lists).to_numpy()
    starts = np.cumsum(lengths) - lengths
    place = (row * POSITION_BLOCK + first - block[row] * POSITION_BLOCK - starts).repeat(lengths) + np.arange(lengths.sum())
    vectors = lists.flatten()
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy()
    values = vectors.flatten()
    known, values = values.is_valid().to_numpy(zero_copy_only=False), pc.fill_null(values, 0.0).to_numpy()
    count = len(pieces) * POSITION_BLOCK
    n = np.bincount(place[sizes > 0], minlength=count)
    widths = np.zeros(count, np.int64)
    np.maximum.at(widths, place, sizes)
    wide = int(widths.max(initial=0))
    # a null component counts as a row but adds nothing, as in ``mean_vectors``
    component = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    cell = np.repeat(place, sizes) * wide + component
    rows, seen = np.bincount(cell, minlength=count * wide), np.bincount(cell[known], minlength=count * wide)
    mean = np.bincount(cell, weights=values, minlength=count * wide) / np.maximum(rows, 1)
    covered = np.flatnonzero(n)
    inside = (np.arange(wide) < widths[covered, None]).ravel()
    pick = lambda x: x.reshape(count, wide)[covered].ravel()[inside]
    ends = pa.array(np.r_[0, np.cumsum(widths[covered])], pa.int32())
    vec = pa.ListArray.from_arrays(ends, pa.array(pick(mean), mask=pick(seen) == 0))
    places = covered // POSITION_BLOCK
    return places, block[places] * POSITION_BLOCK + covered % POSITION_BLOCK, n[covered], vec


def class_weights(rows: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Balanced row weights n/(2*count) and the ratio of negatives to positives."""
    positive = F.col(label) > 0.5
    counts = rows.where(F.col(label).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(positive).alias("positives"), F.count_if(~positive).alias("negatives")
    )
    share = lambda c: F.when(F.col(c) > 0, F.try_divide(F.col("n"), 2.0 * F.col(c))).otherwise(1.0)
    one = lambda c: F.greatest(F.col(c).cast("double"), F.lit(1.0))
    return counts.withColumns(
        {
            "weight_positive": share("positives"),
            "weight_negative": share("negatives"),
            "pos_weight": one("negatives") / one("positives"),
        }
    )
