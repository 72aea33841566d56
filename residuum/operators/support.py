"""Label-free support of a pair in the source table: counts, clusters, overlap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from residuum.functions.columns import canonical_id, finite, or_null, strict_max, support_columns, support_state
from residuum.operators.policy import table_flags
from residuum.storage import cut

SOURCE_KINDS = ["drug", "target", "pair", "drug_cluster", "target_cluster", "cluster_pair"]
SIDES = {"drug": "dr_id", "target": "pr_id"}
MISSING_REASONS = ["missing_test_root", "missing_test_audit", "missing_validation_audit"]


def cluster_map(tables: DataFrame, id_column: str, cluster_column: str) -> DataFrame:
    """First non-empty cluster of each entity by (file_order, row_id)."""
    rows = tables.select(
        canonical_id(id_column).alias("id"),
        canonical_id(cluster_column).alias("cluster"),
        F.struct("file_order", "row_id").alias("_at"),
    ).where("id <> '' and cluster <> ''")
    return rows.groupBy("id").agg(F.min_by("cluster", "_at").alias("cluster"))


def source_pairs(train: DataFrame, drug_clusters: DataFrame, target_clusters: DataFrame) -> DataFrame:
    """Distinct source pairs (d, t) with their rows n and the clusters dc and tc of both sides.

    The target side is met first: where its map is small, only the drug side moves the
    pairs, and a drug's pairs lie together in the result.
    """
    ids = train.select(canonical_id("dr_id").alias("d"), canonical_id("pr_id").alias("t"))
    pairs = ids.groupBy("d", "t").agg(F.count(F.lit(1)).alias("n"))
    pairs = pairs.join(target_clusters.select(F.col("id").alias("t"), F.col("cluster").alias("tc")), "t", "left")
    return pairs.join(drug_clusters.select(F.col("id").alias("d"), F.col("cluster").alias("dc")), "d", "left")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """Source pairs as counts per kind: (kind, key_a, key_b, n).

    One branch per kind: a reader of one kind aggregates that kind only.
    """
    keys = {
        "drug": ("d", None), "target": ("t", None), "pair": ("d", "t"),
        "drug_cluster": ("dc", None), "target_cluster": ("tc", None), "cluster_pair": ("dc", "tc"),
    }
    out = None
    for kind, (a, b) in keys.items():
        used = [k for k in (a, b) if k]
        known = pairs.dropna(subset=used)
        # pairs are distinct already
        part = known if kind == "pair" else known.groupBy(*used).agg(F.sum("n").alias("n"))
        part = part.select(F.lit(kind).alias("kind"), F.col(a).alias("key_a"), (F.col(b) if b else F.lit("")).alias("key_b"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def source_counts(train: DataFrame, drug_clusters: DataFrame, target_clusters: DataFrame) -> DataFrame:
    """Rows per entity, pair, cluster and cluster pair as (kind, key_a, key_b, n)."""
    return pair_counts(source_pairs(train, drug_clusters, target_clusters))


def entity_side(counts: DataFrame, clusters: DataFrame, side: str) -> DataFrame:
    """One row per known entity: its source count, cluster and cluster count."""
    own = counts.where(F.col("kind") == side).select(
        F.col("key_a").alias("id"), F.col("n").cast("double").alias(f"source_{side}_count")
    )
    group = counts.where(F.col("kind") == f"{side}_cluster").select(
        F.col("key_a").alias("cluster"), F.col("n").cast("double").alias(f"source_{side}_cluster_count")
    )
    return (
        own.join(clusters, "id", "full_outer")
        .join(group, "cluster", "left")
        .withColumnRenamed("cluster", f"_{side}_cluster")
    )


def attach_counts(
    rows: DataFrame,
    counts: DataFrame,
    drug_clusters: DataFrame,
    target_clusters: DataFrame,
    kinds: Sequence[str] = SOURCE_KINDS,
) -> DataFrame:
    """Add the source counts of ``kinds``; unknown keys count zero.

    Everything known about an entity is joined in one go, so a row meets at most
    four lookups. Lookups are stored first, so that their size is known when the
    joins are planned; rows are not moved for the small ones.
    """
    out = rows.withColumns({"_d": canonical_id("dr_id"), "_t": canonical_id("pr_id")})
    for side, key, clusters in (("target", "_t", target_clusters), ("drug", "_d", drug_clusters)):
        if not {side, f"{side}_cluster", "cluster_pair"}.intersection(kinds):
            continue
        table = entity_side(counts, clusters, side).withColumnRenamed("id", key)
        wanted = [c for c, k in ((f"source_{side}_count", side), (f"source_{side}_cluster_count", f"{side}_cluster"),
                                 (f"_{side}_cluster", "cluster_pair")) if k in kinds]
        out = out.join(cut(table.select(key, *wanted), f"{side}-side"), key, "left")
    if "cluster_pair" in kinds:
        cluster_pair = counts.where(F.col("kind") == "cluster_pair").select(
            F.col("key_a").alias("_drug_cluster"),
            F.col("key_b").alias("_target_cluster"),
            F.col("n").cast("double").alias("source_cluster_pair_count"),
        )
        out = out.join(cut(cluster_pair, "cluster-pairs"), ["_drug_cluster", "_target_cluster"], "left").drop(
            "_drug_cluster", "_target_cluster")
    if "pair" in kinds:
        pair = counts.where(F.col("kind") == "pair").select(
            F.col("key_a").alias("_d"), F.col("key_b").alias("_t"), F.col("n").cast("double").alias("source_pair_count")
        )
        out = out.join(pair, ["_d", "_t"], "left")
    return out.withColumns(
        {f"source_{k}_count": F.coalesce(F.col(f"source_{k}_count"), F.lit(0.0)) for k in kinds}
    ).drop("_d", "_t")


def source_count_columns(df: DataFrame) -> dict[str, Column]:
    """Log counts, minima, imbalances and novelties of the source counts."""
    count = {}
    for kind in SOURCE_KINDS:
        raw = finite(or_null(df, f"source_{kind}_count"))
        count[kind] = F.when(raw.isNotNull(), F.greatest(raw, F.lit(0.0)))
    out = {f"log_source_{k}_count": F.log1p(c) for k, c in count.items()}
    entity = support_columns(
        count["drug"],
        count["target"],
        ["source_entity_support_min", "source_entity_support_imbalance", "source_joint_novelty", "source_one_sided_novelty"],
    )
    cluster = support_columns(
        count["drug_cluster"],
        count["target_cluster"],
        ["source_cluster_support_min", "source_cluster_support_imbalance", "_joint", "_sided"],
    )
    return {**out, **entity, **{k: v for k, v in cluster.items() if not k.startswith("_")}}


def attach_distances(rows: DataFrame, side: str, table: DataFrame, names: dict[str, str]) -> DataFrame:
    """Left lookup of per-entity values; entities without one stay null."""
    key = SIDES[side]
    values = table.select(
        F.col("id").alias("_id"), *[F.col(source).alias(target) for source, target in names.items()]
    )
    return rows.join(values, canonical_id(rows[key]) == F.col("_id"), "left").drop("_id")


def shift_columns(df: DataFrame) -> DataFrame:
    """Row maxima and imbalances of the two sides' distances, null if a side is null."""
    out = {}
    if "drug_nearest_train_distance" in df.columns and "target_nearest_train_distance" in df.columns:
        out["domain_shift_score"] = strict_max(
            F.col("drug_nearest_train_distance"), F.col("target_nearest_train_distance")
        )
        out["domain_density_distance"] = strict_max(
            F.col("drug_train_knn_distance"), F.col("target_train_knn_distance")
        )
    if "drug_morgan_nearest_train_distance" in df.columns and "target_esm_nearest_train_distance" in df.columns:
        near = F.col("drug_morgan_nearest_train_distance"), F.col("target_esm_nearest_train_distance")
        dense = F.col("drug_morgan_knn_distance"), F.col("target_esm_knn_distance")
        out["native_domain_shift_score"] = strict_max(*near)
        out["native_domain_density_distance"] = strict_max(*dense)
        out["native_support_imbalance"] = F.abs(near[0] - near[1])
        out["native_density_imbalance"] = F.abs(dense[0] - dense[1])
    return df.withColumns(out) if out else df


def leave_one_out_counts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per row: other rows of its group with the same drug, target and pair."""
    keys = list(keys)
    out = rows
    for name, ids in (("drug", ["dr_id"]), ("target", ["pr_id"]), ("pair", ["dr_id", "pr_id"])):
        n = rows.groupBy(*keys, *ids).agg((F.count(F.lit(1)) - 1).alias(f"{name}_count"))
        out = out.join(n, [*keys, *ids])
    return out


def fold_counts(rows: DataFrame, keys: Sequence[str], ids: Sequence[str], folds: int, out: str) -> DataFrame:
    """Rows per id and fold as one array, so any fold can be left out by subtraction."""
    return rows.groupBy(*keys, *ids).agg(
        F.array(*[F.count_if(F.col("fold") == f) for f in range(folds)], ).alias(out),
        F.count(F.lit(1)).alias(f"{out}_all"),
    )


def domain_strata(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Residual errors by support state and overall, per reference.

    ``rows``: keys, support_reference, drug_seen, target_seen, base_wrong.
    """
    keys = [*keys, "support_reference"]
    tagged = rows.withColumn("support_state", support_state(F.col("drug_seen"), F.col("target_seen")))
    # the states and the overall level in one aggregate; five rows per key from here on
    both = tagged.groupingSets([[*keys, "support_state"], keys], *keys, "support_state").agg(
        F.count(F.lit(1)).alias("residual_n"), F.coalesce(F.sum("base_wrong"), F.lit(0.0)).alias("error_count"),
        F.count("base_wrong").alias("_labelled"), F.grouping("support_state").alias("_overall"),
    ).withColumn("support_state", F.when(F.col("_overall") == 1, "all").otherwise(F.col("support_state")))
    whole = lambda c: F.max(F.when(F.col("_overall") == 1, c)).over(Window.partitionBy(*keys))
    both = both.withColumns({"_all_n": whole(F.col("residual_n")), "_all_rate": whole(F.try_divide(F.col("error_count"), F.col("_labelled")))})
    rate = F.try_divide(F.col("error_count"), F.col("_labelled"))
    return both.select(
        *keys,
        "support_state",
        "residual_n",
        (F.col("residual_n") / F.col("_all_n")).alias("residual_share"),
        "error_count",
        rate.alias("error_rate"),
        (rate - F.col("_all_rate")).alias("error_rate_delta_vs_all"),
    )


def key_overlap(reference: DataFrame, evaluated: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct drugs, targets and pairs that both row sets of a group contain."""
    keys = list(keys)
    both = reference.select(*keys, "dr_id", "pr_id", F.lit(True).alias("_ref")).unionByName(
        evaluated.select(*keys, "dr_id", "pr_id", F.lit(False).alias("_ref"))
    )
    pairs = both.groupBy(*keys, "dr_id", "pr_id").agg(F.count_if("_ref").alias("_r"), F.count_if(~F.col("_ref")).alias("_e"))
    # pairs are told apart by now: all pairs of a group are one row from here on
    kinds = F.explode(
        F.array(
            F.struct(F.lit("drug").alias("kind"), F.col("dr_id").alias("a")),
            F.struct(F.lit("target").alias("kind"), F.col("pr_id").alias("a")),
            F.struct(F.lit("pair").alias("kind"), F.lit("").alias("a")),
        )
    )
    shared = (F.col("_r") > 0) & (F.col("_e") > 0)
    per_id = pairs.select(*keys, "_r", "_e", kinds.alias("k")).groupBy(*keys, "k").agg(
        F.count_if(shared).alias("_shared"), F.sum("_r").alias("_r"), F.sum("_e").alias("_e")
    )
    kind = F.col("k.kind")
    of_pairs = lambda c: F.sum(F.when(kind == "pair", F.col(c)).otherwise(0))
    return per_id.groupBy(*keys).agg(
        of_pairs("_r").alias("reference_n"),
        of_pairs("_e").alias("evaluation_n"),
        *[F.count_if(shared & (kind == k)).alias(f"overlap_{k}_count") for k in ("drug", "target")],
        of_pairs("_shared").alias("overlap_pair_count"),
    )


def reference_row(overlap: DataFrame) -> DataFrame:
    """Overlap counts with the fixed statements about the fit reference."""
    return overlap.withColumns(
        {
            "reference_role": F.lit("fixed_validation_policy_residual"),
            "evaluation_role": F.lit("held_out_test_policy_residual"),
            "reference_outcomes_used_for_support": F.lit(False),
            "evaluation_batch_appended_to_reference": F.lit(False),
            "reference_frozen_before_test_scoring": F.lit(True),
            "exact_pair_support_enabled_in_core": F.lit(False),
        }
    )


NATIVE_COLUMNS = [
    "drug_morgan_nearest_train_distance",
    "drug_morgan_knn_distance",
    "target_esm_nearest_train_distance",
    "target_esm_knn_distance",
    "native_domain_shift_score",
    "native_domain_density_distance",
    "native_support_imbalance",
    "native_density_imbalance",
]


def capabilities(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Which evidence each table offers and the audit modes that follow."""
    blocks = {
        "uncertainty": ["p_base", "s_base"],
        "prior": ["p_prior", "s_prior"],
        "native": NATIVE_COLUMNS,
        "direct": ["target_direct_nearest_train_distance", "target_direct_knn_distance"],
        "joint": ["joint_nearest_train_distance"],
    }
    present = {b: [c for c in cols if c in df.columns] for b, cols in blocks.items()}
    flags = table_flags(df, keys, [c for cols in present.values() for c in cols])

    def any_of(block: str) -> Column:
        out = F.lit(False)
        for c in present[block]:
            out = out | F.col(f"has_{c}")
        return out

    entity = F.lit("dr_id" in df.columns and "pr_id" in df.columns)
    u, p, native = any_of("uncertainty"), any_of("prior"), any_of("native")
    e = entity | native
    modes = F.array_compact(
        F.array(
            F.when(u, "U"), F.when(u & p, "U+P"), F.when(u & e, "U+E"), F.when(u & p & e, "U+P+E")
        )
    )
    return flags.select(
        *keys,
        u.alias("uncertainty_available"),
        p.alias("prior_available"),
        e.alias("empirical_support_available"),
        native.alias("native_support_available"),
        any_of("direct").alias("direct_target_support_available"),
        any_of("joint").alias("joint_support_available"),
        F.array_join(modes, "|").alias("available_modes"),
        F.coalesce(F.try_element_at(modes, F.lit(-1)), F.lit("unavailable")).alias("maximum_mode"),
    )
