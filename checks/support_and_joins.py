"""Checked queries: counts, lookups, neighbours, overlap, unique pairs, registries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.ranking_and_policy import BUDGETS, GRID, GRID_DOUBLES, GRID_SQL, METRIC_CTES, METRIC_DOUBLES, first_states, states
from checks.registry import check
from residuum.functions import columns as C
from residuum.operators import dedup, neighbours, permute, policy, quality, ranking, registry, support
from residuum.sources import scans

RUN = ["model", "dataset", "test_run"]


@check("support_counts", "SELECT kind, key_a, key_b, n FROM source_counts")
def support_counts(t):
    return t.counts()[0]


@check(
    "leakage_check",
    """SELECT true AS free_of_outcomes, false AS labels_free, (SELECT count(*) FROM source_counts) AS rows, 0 AS changed, true AS moved""",
)
def leakage_check(t):
    """Support counts resolve without any outcome column and do not change when outcomes are dealt anew."""
    related = t.related()
    maps = [support.cluster_map(related, f"{side}_id", f"{kind}_cluster") for side, kind in (("dr", "drug"), ("pr", "target"))]
    build = lambda rows: support.source_counts(rows, *maps)
    draw = F.pmod(F.xxhash64("dr_id", "pr_id"), F.lit(2)).cast("double")
    source = t.train().withColumn("label", draw)
    effects = quality.outcome_effects(build, source, "label")
    by_label = quality.needs_no_outcome(lambda rows: rows.groupBy("dr_id").agg(F.sum("label").alias("n")), source)
    return effects.select(
        F.lit(quality.needs_no_outcome(build, source)).alias("free_of_outcomes"), F.lit(by_label).alias("labels_free"), "rows", "changed", (F.col("moved") > 0).alias("moved"))


@check("first_wins_cluster_map", "SELECT id, cluster FROM drug_map")
def first_wins_cluster_map(t):
    return support.cluster_map(t.related(), "dr_id", "drug_cluster")


COUNTS = [f"source_{k}_count" for k in support.SOURCE_KINDS]


@check("count_lookups", f"SELECT row_id, {', '.join(COUNTS)} FROM counted", COUNTS)
def count_lookups(t):
    return support.attach_counts(t.base(), *t.counts()).select("row_id", *COUNTS)


@check(
    "leave_one_out_counts",
    """SELECT row_id, count(*) OVER (PARTITION BY model, dataset, test_run, dr_id) - 1 AS drug_count,
              count(*) OVER (PARTITION BY model, dataset, test_run, pr_id) - 1 AS target_count,
              count(*) OVER (PARTITION BY model, dataset, test_run, dr_id, pr_id) - 1 AS pair_count FROM base""",
)
def leave_one_out_counts(t):
    out = support.leave_one_out_counts(t.base(), RUN)
    return out.select("row_id", "drug_count", "target_count", "pair_count")


@check(
    "fold_fit_support",
    """WITH f AS (SELECT *, (row_id % 3)::INT AS fold FROM base),
            d AS (SELECT model, dataset, test_run, fold, dr_id, count(*) AS n FROM f GROUP BY ALL),
            a AS (SELECT model, dataset, test_run, dr_id, count(*) AS n FROM f GROUP BY ALL)
       SELECT f.row_id, ln(1 + a.n - d.n) AS log_drug_fit_count FROM f JOIN d USING (model, dataset, test_run, fold, dr_id) JOIN a USING (model, dataset, test_run, dr_id)""",
    ["log_drug_fit_count"],
)
def fold_fit_support(t):
    rows = t.base().withColumn("fold", (F.col("row_id") % 3).cast("int"))
    counts = support.fold_counts(rows, RUN, ["dr_id"], 3, "c")
    held = rows.join(counts, [*RUN, "dr_id"])
    fit = F.col("c_all") - F.get(F.col("c"), F.col("fold"))
    return held.select("row_id", F.log1p(fit.cast("double")).alias("log_drug_fit_count"))


@check(
    "validation_overlap_removal",
    """SELECT row_id FROM base b WHERE split = 'test' AND NOT EXISTS (SELECT 1 FROM base v WHERE v.split = 'validation' AND v.model = b.model
         AND v.dataset = b.dataset AND v.dr_id = b.dr_id AND v.pr_id = b.pr_id)""",
)
def validation_overlap_removal(t):
    rows = t.base()
    out = dedup.drop_overlap(rows.where("split = 'test'"), rows.where("split = 'validation'"), ["model", "dataset"])
    return out.select("row_id")


@check("source_semi_join", "SELECT target_id, count(*) AS n FROM hits WHERE target_id IN (SELECT pr_id FROM train) GROUP BY target_id")
def source_semi_join(t):
    ids = t.source_ids("pr_id").select(F.col("id").alias("target_id"))
    return t.hits().join(ids, "target_id", "left_semi").groupBy("target_id").agg(F.count(F.lit(1)).alias("n"))


# --- neighbours -----------------------------------------------------------------

COSINE = """SELECT q.id, 1 - list_dot_product(q.vec, s.vec) / (sqrt(list_dot_product(q.vec, q.vec)) * sqrt(list_dot_product(s.vec, s.vec))) AS d
            FROM vecs q, vecs s WHERE s.id IN (SELECT pr_id FROM train)"""
NEAREST = lambda inner: f"""SELECT id, min(d) AS nearest, avg(d) AS density FROM (
    SELECT id, d, row_number() OVER (PARTITION BY id ORDER BY d) AS rn FROM ({inner})) WHERE rn <= 5 GROUP BY id"""


@check("cosine_knn_support", NEAREST(COSINE), ["nearest", "density"])
def cosine_knn_support(t):
    return neighbours.cosine_support(t.vectors(), t.source_ids("pr_id"))


@check("cosine_knn_support_in_pieces", NEAREST(COSINE), ["nearest", "density"])
def cosine_knn_support_in_pieces(t):
    return neighbours.cosine_support(t.vectors(), t.source_ids("pr_id"), block_rows=64)


@check(
    "standardised_euclidean_support",
    """WITH short AS (SELECT id, vec[1:8] AS vec FROM vecs), src AS (SELECT * FROM short WHERE id IN (SELECT pr_id FROM train)),
            st AS (SELECT i, avg(vec[i]) AS m, stddev_pop(vec[i]) AS s FROM src, range(1, 9) r(i) GROUP BY i),
            sc AS (SELECT id, list((vec[i] - m) / s ORDER BY i) AS vec FROM short, st GROUP BY id),
            ds AS (SELECT q.id, list_distance(q.vec, s.vec) / sqrt(8.0) AS d FROM sc q, sc s WHERE s.id IN (SELECT id FROM src))
       SELECT id, min(d) AS nearest, avg(d) AS density FROM (SELECT id, d, row_number() OVER (PARTITION BY id ORDER BY d) AS rn FROM ds) WHERE rn <= 5 GROUP BY id""",
    ["nearest", "density"],
)
def standardised_euclidean_support(t):
    vectors = scans.vector_store(t.raw("embeddings"), "vec_id", "embedding", 8)
    return neighbours.projected_support(vectors, t.source_ids("pr_id"))


@check("projected_euclidean_support")
def projected_euclidean_support(t):
    return neighbours.projected_support(t.vectors(), t.source_ids("pr_id"))


@check("tanimoto_knn_support", "SELECT id, min(distance) AS nearest, avg(distance) AS density FROM drug_near GROUP BY id", ["nearest", "density"])
def tanimoto_knn_support(t):
    return neighbours.distance_support(neighbours.tanimoto_neighbours(t.fingerprints(), t.source_ids("dr_id")))


def drug_lists(t):
    return t.stored("drug-lists", lambda: neighbours.tanimoto_neighbours(t.fingerprints(), t.source_ids("dr_id")))


@check("tanimoto_neighbour_list", "SELECT id, neighbour, rank::INT AS rank, 1 - distance AS sim FROM drug_near", ["sim"])
def tanimoto_neighbour_list(t):
    lists = neighbours.neighbour_lists(drug_lists(t))
    rows = lists.select("id", F.posexplode("neighbours").alias("pos", "n"))
    return rows.select("id", F.col("n.id").alias("neighbour"), (F.col("pos") + 1).alias("rank"), F.col("n.sim").alias("sim"))


@check(
    "direct_sequence_neighbours",
    """SELECT v.id, 1 - coalesce(max(score), 0) AS nearest, 1 - coalesce(sum(score), 0) / 5 AS density,
              coalesce(string_agg(target_id, '|' ORDER BY rank), '') AS neighbours
       FROM vecs v LEFT JOIN target_near n ON n.query_id = v.id GROUP BY v.id""",
    ["nearest", "density"],
)
def direct_sequence_neighbours(t):
    near = neighbours.direct_neighbours(t.hits(), t.source_ids("pr_id"))
    out = neighbours.direct_support(t.vectors(), near)
    return out.select("id", "nearest", "density", F.array_join(F.transform("neighbours", lambda n: n["id"]), "|").alias("neighbours"))


@check(
    "family_support",
    """WITH q AS (SELECT * FROM hits WHERE identity >= 30 AND query_coverage >= 0.5 AND evalue <= 0.001),
            f AS (SELECT DISTINCT target FROM q WHERE query_id IN (SELECT pr_id FROM train)),
            b AS (SELECT query_id, max(support_score) AS s, count(DISTINCT target) AS n FROM q WHERE target IN (SELECT target FROM f) GROUP BY query_id)
       SELECT id, 1 - coalesce(s, 0) AS distance, CASE WHEN coalesce(n, 0) = 0 THEN 1.0 ELSE 0.0 END AS family_unseen, 1.0 / (1 + coalesce(n, 0)) AS family_sparsity
       FROM vecs LEFT JOIN b ON query_id = id""",
    ["distance", "family_unseen", "family_sparsity"],
)
def family_support(t):
    return neighbours.family_support(t.vectors(), t.hits(), t.source_ids("pr_id"))


@check(
    "joint_neighbour_distance",
    """WITH p AS (SELECT DISTINCT dr_id AS d, pr_id AS t FROM base),
            b AS (SELECT p.d, p.t, max((1 - n.distance) * m.score) AS best FROM p JOIN drug_near n ON n.id = p.d JOIN target_near m ON m.query_id = p.t
                  JOIN (SELECT DISTINCT dr_id, pr_id FROM train) s ON s.dr_id = n.neighbour AND s.pr_id = m.target_id
                  WHERE NOT (n.neighbour = p.d AND m.target_id = p.t) GROUP BY ALL)
       SELECT p.d AS dr_id, p.t AS pr_id, 1 - coalesce(best, 0) AS joint_nearest_train_distance FROM p LEFT JOIN b USING (d, t)""",
    ["joint_nearest_train_distance"],
)
def joint_neighbour_distance(t):
    lists = neighbours.neighbour_lists(drug_lists(t))
    near = neighbours.direct_support(t.vectors(), neighbours.direct_neighbours(t.hits(), t.source_ids("pr_id")))
    pairs = t.counts()[0].where("kind = 'pair'")
    return neighbours.joint_distance(t.base(), lists, near, pairs)


@check(
    "distance_lookups",
    """WITH v AS (SELECT id, vec[1] AS near FROM vecs), b AS (SELECT id, n / 1000.0 AS near FROM bit_n)
       SELECT row_id, b.near AS drug_distance, v.near AS target_distance, CASE WHEN b.near IS NOT NULL AND v.near IS NOT NULL THEN greatest(b.near, v.near) END AS shift
       FROM base LEFT JOIN b ON b.id = dr_id LEFT JOIN v ON v.id = pr_id""",
    ["drug_distance", "target_distance", "shift"],
)
def distance_lookups(t):
    near = t.vectors().select("id", F.get("vec", F.lit(0)).alias("near"))
    size = t.fingerprints().select("id", (F.size("vec") / 1000.0).alias("near"))
    rows = support.attach_distances(t.base(), "drug", size, {"near": "drug_distance"})
    rows = support.attach_distances(rows, "target", near, {"near": "target_distance"})
    return rows.select(
        "row_id", "drug_distance", "target_distance",
        C.strict_max(F.col("drug_distance"), F.col("target_distance")).alias("shift"),
    )


@check(
    "feature_coverage_filter",
    """SELECT model, dataset, count(*) AS covered FROM base WHERE dr_id IN (SELECT id FROM bit_n) AND pr_id IN (SELECT id FROM vecs)
         AND pr_id IN (SELECT query_id FROM hits) GROUP BY ALL""",
)
def feature_coverage_filter(t):
    rows = neighbours.covered_rows(
        t.base(),
        # only ids are read: no fingerprint or hit score is computed for them
        [("dr_id", t.word_bits()), ("pr_id", t.vectors()), ("pr_id", t.unstored_hits().select(F.col("query_id").alias("id")))],
    )
    return rows.groupBy("model", "dataset").agg(F.count(F.lit(1)).alias("covered"))


@check(
    "cardinality_checked_merge",
    """SELECT l.model, l.dataset, l.test_run, l.split, l.n, r.mean_label FROM (SELECT model, dataset, test_run, split, count(*) AS n FROM base GROUP BY ALL) l
       LEFT JOIN (SELECT model, dataset, test_run, avg(label) AS mean_label FROM base GROUP BY ALL) r USING (model, dataset, test_run)""",
    ["mean_label"],
)
def cardinality_checked_merge(t):
    left = t.base().groupBy(*RUN, "split").agg(F.count(F.lit(1)).alias("n"))
    right = t.base().groupBy(*RUN).agg(F.avg("label").alias("mean_label"))
    return quality.cardinality_join(left, right, RUN)


# --- overlap and strata -----------------------------------------------------------


@check(
    "key_overlap_counts",
    """WITH s AS (SELECT * FROM states WHERE state = 'residual'), v AS (SELECT * FROM s WHERE split = 'validation'), e AS (SELECT * FROM s WHERE split = 'test'),
            k AS (SELECT DISTINCT model, dataset, test_run, confidence_threshold, uncertainty_reject_fraction FROM s),
            pairs AS (SELECT 'drug' AS kind, dr_id AS a, '' AS b, * FROM s UNION ALL SELECT 'target', pr_id, '', * FROM s UNION ALL SELECT 'pair', dr_id, pr_id, * FROM s),
            twice AS (SELECT model, dataset, test_run, confidence_threshold, uncertainty_reject_fraction, kind, a, b FROM pairs GROUP BY ALL HAVING count(DISTINCT split) = 2)
       SELECT k.*, (SELECT count(*) FROM v WHERE (v.model, v.dataset, v.test_run, v.confidence_threshold, v.uncertainty_reject_fraction) = (k.model, k.dataset, k.test_run, k.confidence_threshold, k.uncertainty_reject_fraction)) AS reference_n,
              (SELECT count(*) FROM e WHERE (e.model, e.dataset, e.test_run, e.confidence_threshold, e.uncertainty_reject_fraction) = (k.model, k.dataset, k.test_run, k.confidence_threshold, k.uncertainty_reject_fraction)) AS evaluation_n,
              count(*) FILTER (kind = 'drug') AS overlap_drug_count, count(*) FILTER (kind = 'target') AS overlap_target_count, count(*) FILTER (kind = 'pair') AS overlap_pair_count
       FROM k LEFT JOIN twice USING (model, dataset, test_run, confidence_threshold, uncertainty_reject_fraction) GROUP BY k.model, k.dataset, k.test_run, k.confidence_threshold, k.uncertainty_reject_fraction""",
    GRID_DOUBLES,
)
def key_overlap_counts(t):
    keys = [*RUN, *GRID_DOUBLES]
    rows = states(t).where("state = 'residual'")
    out = support.key_overlap(rows.where("split = 'validation'"), rows.where("split = 'test'"), keys)
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("reference_n", "evaluation_n")})


@check(
    "domain_support_strata",
    """WITH r AS (SELECT s.*, coalesce(d.n, 0) > 8 AS ds, coalesce(p.n, 0) > 200 AS ts FROM states s
                  LEFT JOIN source_counts d ON d.kind = 'drug' AND d.key_a = s.dr_id LEFT JOIN source_counts p ON p.kind = 'target' AND p.key_a = s.pr_id
                  WHERE state = 'residual' AND split = 'test' AND confidence_threshold = 0.8 AND uncertainty_reject_fraction = 0.1),
            l AS (SELECT model, dataset, test_run, CASE WHEN ds AND ts THEN 'both_seen' WHEN ts THEN 'drug_unseen' WHEN ds THEN 'target_unseen' ELSE 'both_unseen' END AS support_state, base_wrong FROM r),
            g AS (SELECT model, dataset, test_run, coalesce(support_state, 'all') AS support_state, count(*) AS residual_n, sum(base_wrong) AS error_count, avg(base_wrong) AS error_rate
                  FROM l GROUP BY GROUPING SETS ((model, dataset, test_run, support_state), (model, dataset, test_run)))
       SELECT g.model, g.dataset, g.test_run, 'source_train' AS support_reference, g.support_state, g.residual_n, g.residual_n::DOUBLE / a.residual_n AS residual_share, g.error_count, g.error_rate,
              g.error_rate - a.error_rate AS error_rate_delta_vs_all FROM g JOIN g a USING (model, dataset, test_run) WHERE a.support_state = 'all'""",
    ["residual_share", "error_count", "error_rate", "error_rate_delta_vs_all"],
)
def domain_support_strata(t):
    rows = first_states(t).where("state = 'residual' and split = 'test'")
    counted = support.attach_counts(rows.select(*RUN, "dr_id", "pr_id", "base_wrong"), *t.counts(), kinds=["drug", "target"])
    seen = {"drug_seen": F.col("source_drug_count") > 8, "target_seen": F.col("source_target_count") > 200}
    return support.domain_strata(counted.withColumns(seen).withColumn("support_reference", F.lit("source_train")), RUN)


@check(
    "audit_fit_reference",
    """WITH s AS (SELECT * FROM states WHERE state = 'residual' AND confidence_threshold = 0.8 AND uncertainty_reject_fraction = 0.1),
            twice AS (SELECT model, dataset, test_run, dr_id FROM s GROUP BY ALL HAVING count(DISTINCT split) = 2),
            bt AS (SELECT model, dataset, test_run, pr_id FROM s GROUP BY ALL HAVING count(DISTINCT split) = 2),
            bp AS (SELECT model, dataset, test_run, dr_id, pr_id FROM s GROUP BY ALL HAVING count(DISTINCT split) = 2),
            n AS (SELECT model, dataset, test_run, count(*) FILTER (split = 'validation') AS reference_n, count(*) FILTER (split = 'test') AS evaluation_n FROM s GROUP BY ALL)
       SELECT n.*, (SELECT count(*) FROM twice b WHERE b.model = n.model AND b.dataset = n.dataset AND b.test_run = n.test_run) AS overlap_drug_count,
              (SELECT count(*) FROM bt b WHERE b.model = n.model AND b.dataset = n.dataset AND b.test_run = n.test_run) AS overlap_target_count,
              (SELECT count(*) FROM bp b WHERE b.model = n.model AND b.dataset = n.dataset AND b.test_run = n.test_run) AS overlap_pair_count,
              'fixed_validation_policy_residual' AS reference_role, 'held_out_test_policy_residual' AS evaluation_role, false AS reference_outcomes_used_for_support,
              false AS evaluation_batch_appended_to_reference, true AS reference_frozen_before_test_scoring, false AS exact_pair_support_enabled_in_core FROM n""",
)
def audit_fit_reference(t):
    rows = first_states(t).where("state = 'residual'")
    out = support.key_overlap(rows.where("split = 'validation'"), rows.where("split = 'test'"), RUN)
    out = out.withColumns({c: F.col(c).cast("bigint") for c in ("reference_n", "evaluation_n")})
    return support.reference_row(out)


# --- unique pairs -------------------------------------------------------------------

PAIR_ROWS = """SELECT b.model, b.dataset, b.test_run, b.split, b.row_id, b.dr_id, b.pr_id, b.base_wrong, s.state, abs(b.p_base - coalesce(b.p_prior, 0.5)) AS score
     FROM base b LEFT JOIN (SELECT row_id, state FROM states WHERE confidence_threshold = 0.8 AND uncertainty_reject_fraction = 0.1) s USING (row_id)"""
PAIR_CTES = {
    "pr_rows": PAIR_ROWS,
    "pr_test": "SELECT * FROM pr_rows WHERE split = 'test'",
    "pr_seen": "SELECT DISTINCT dataset, dr_id, pr_id FROM pr_rows WHERE split = 'validation'",
    "pr_pairs": """SELECT t.dataset, t.dr_id, t.pr_id, avg(base_wrong) AS base_wrong, min(base_wrong) <> max(base_wrong) AS conflict,
                          coalesce(bool_or(state = 'deferred'), false) AS d, coalesce(bool_or(state = 'residual'), false) AS r, avg(score) FILTER (state = 'residual') AS score,
                          count(*) AS n, any_value(s.dr_id) IS NOT NULL AS seen
                   FROM pr_test t LEFT JOIN pr_seen s ON s.dataset = t.dataset AND s.dr_id = t.dr_id AND s.pr_id = t.pr_id GROUP BY ALL""",
}


def _pair_rows(t):
    """All rows with the state of the policy (0.8, 0.1), null for rows that are no candidates: no join tells them apart."""
    score = F.abs(F.col("p_base") - F.coalesce("p_prior", F.lit(0.5))).alias("score")
    columns = [*RUN, "split", "row_id", "dr_id", "pr_id", "base_wrong", score]
    candidate = policy.is_candidate(F.col("p_base"), F.col("base_pred"), F.col("base_confidence"), F.lit(0.8))
    rest = t.base().where(~candidate).select(*columns, F.lit(None).cast("string").alias("state"))
    return first_states(t).select(*columns, "state").unionByName(rest)


@check(
    "pair_collapse",
    "SELECT dataset, dr_id AS pair_a, pr_id AS pair_b, base_wrong, score, n AS pair_rows, conflict AS label_conflict, d AND r AS mixed_state, CASE WHEN d THEN 'deferred' WHEN r THEN 'residual' END AS state FROM pr_pairs",
    ["base_wrong", "score"],
    PAIR_CTES,
)
def pair_collapse(t):
    return dedup.collapse_pairs(dedup.with_pair_key(_pair_rows(t).where("split = 'test'")), ["dataset"])


@check(
    "pair_deduplication_diagnostics",
    """SELECT dataset, sum(n)::BIGINT AS test_rows_before, (SELECT count(*) FROM pr_seen s WHERE s.dataset = p.dataset) AS validation_unique_pairs,
              coalesce(sum(n) FILTER (seen), 0)::BIGINT AS cross_split_overlap_rows_removed, count(*) FILTER (seen) AS cross_split_overlap_pairs_removed,
              sum(n) FILTER (NOT seen)::BIGINT AS eligible_test_rows, count(*) FILTER (NOT seen) AS eligible_unique_pairs,
              (sum(n) FILTER (NOT seen) - count(*) FILTER (NOT seen))::BIGINT AS within_test_duplicate_rows_collapsed,
              count(*) FILTER (NOT seen AND conflict) AS pair_label_conflicts, count(*) FILTER (NOT seen AND d AND r) AS mixed_policy_state_pairs FROM pr_pairs p GROUP BY dataset""",
    ctes=PAIR_CTES,
)
def pair_deduplication_diagnostics(t):
    rows = _pair_rows(t)
    return dedup.dedup_diagnostics(rows.where("split = 'test'"), rows.where("split = 'validation'"), ["dataset"], ["dataset"])


@check(
    "pair_deduplicated_metrics",
    "SELECT * FROM m_out",
    METRIC_DOUBLES,
    {**PAIR_CTES, **METRIC_CTES("SELECT dataset, CASE WHEN d THEN 'deferred' WHEN r THEN 'residual' END AS state, base_wrong, score FROM pr_pairs WHERE NOT seen AND NOT conflict", "dataset"), **BUDGETS(0.2)},
)
def pair_deduplicated_metrics(t):
    rows = _pair_rows(t)
    kept = dedup.drop_overlap(rows.where("split = 'test'"), rows.where("split = 'validation'"), ["dataset"])
    pairs = dedup.collapse_pairs(kept, ["dataset"]).where("not label_conflict")
    return ranking.evaluate_ranking(pairs, ["dataset"], [0.2])


# --- registries, vectors ---------------------------------------------------------------


@check(
    "entity_registry",
    """WITH r AS (SELECT CAST(p_partkey % 700 AS VARCHAR) AS id, CASE WHEN p_size % 5 = 0 THEN ' ' ELSE p_name END AS text, p_type AS phase FROM part)
       SELECT id, coalesce(min(CASE WHEN trim(text) <> '' THEN trim(text) END), '') AS text, length(coalesce(min(CASE WHEN trim(text) <> '' THEN trim(text) END), ''))::INT AS text_length,
              CASE WHEN min(CASE WHEN trim(text) <> '' THEN trim(text) END) IS NULL THEN 'missing' ELSE 'ok' END AS status, string_agg(DISTINCT phase, '|' ORDER BY phase) AS phases
       FROM r GROUP BY id""",
)
def entity_registry(t):
    rows = t.raw("part").select(
        (F.col("p_partkey") % 700).alias("id"),
        F.when(F.col("p_size") % 5 == 0, " ").otherwise(F.col("p_name")).alias("text"), F.col("p_type").alias("phase"),
    )
    return registry.entity_registry(rows, "id", "text")


@check("environment_clusters")
def environment_clusters(t):
    rows = registry.environments(t.base().select("row_id", "dr_id", "pr_id"), t.vectors(), 8, 2026)
    return rows.groupBy("env_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("pr_id").alias("targets"))


@check("pair_environment_clusters")
def pair_environment_clusters(t):
    left = t.vectors().select("id", F.slice("vec", 1, 16).alias("vec"))
    rows = registry.environments(t.base().select("row_id", "dr_id", "pr_id"), t.vectors(), 8, 2026, left)
    return rows.groupBy("env_id").agg(F.count(F.lit(1)).alias("n"))


@check("cluster_centres_and_prior")
def cluster_centres_and_prior(t):
    return registry.cluster_prior(t.vectors(), 6, 2026).select("env_id", "n", "prior", F.get("centre", F.lit(0)).alias("first_value"))


@check(
    "letter_mean_vector",
    """WITH c AS (SELECT sequence[i] AS letter, i, id FROM (SELECT id, sequence, unnest(range(1, length(sequence) + 1)) AS i FROM seqs)),
            v AS (SELECT letter, i, length(letter) + i % 7 AS x, i % 11 AS y FROM c)
       SELECT letter, count(*) AS n, avg(x) AS v0, avg(y) AS v1 FROM v GROUP BY letter""",
    ["v0", "v1"],
)
def letter_mean_vector(t):
    pos = F.sequence(F.lit(1), F.length("sequence"))
    rows = t.sequences().where("sequence <> ''").withColumn(
        "vecs", F.transform(pos, lambda i: F.array((1 + i % 7).cast("double"), (i % 11).cast("double")))
    )
    out = registry.letter_means(rows)
    return out.select("letter", "n", F.get("vec", F.lit(0)).alias("v0"), F.get("vec", F.lit(1)).alias("v1"))


SPANS = """WITH d AS (SELECT doc_id, length(text) AS n FROM documents),
     s AS (SELECT doc_id, n, unnest(range(0, CASE WHEN n <= 1024 THEN 1 ELSE CAST(ceil((n - 1024) / 768.0) AS BIGINT) + 1 END)) * 768 AS a FROM d),
     t AS (SELECT DISTINCT doc_id, a, b FROM (SELECT doc_id, a, least(a + 1024, n) AS b FROM s UNION ALL SELECT doc_id, greatest(n - 1024, 0), n FROM d))"""


def _chunks(t):
    docs = t.raw("documents").select("doc_id", F.length("text").alias("size")).repartition(t.spark.sparkContext.defaultParallelism)
    docs = docs.select("doc_id", F.explode(C.chunk_spans(F.col("size"))).alias("s")).select("doc_id", "s.*")
    return docs.withColumn("vec", F.array((F.col("start") % 13).cast("double"), (F.col("end") % 17).cast("double")))


@check(
    "chunk_weighted_vector_merge",
    SPANS + " SELECT doc_id, count(*) AS n, sum((a % 13) * (b - a)) / sum(b - a)::DOUBLE AS v0, sum((b % 17) * (b - a)) / sum(b - a)::DOUBLE AS v1 FROM t GROUP BY doc_id",
    ["v0", "v1"],
)
def chunk_weighted_vector_merge(t):
    out = registry.merge_chunk_vectors(_chunks(t), ["doc_id"])
    return out.select("doc_id", "n", F.get("vec", F.lit(0)).alias("v0"), F.get("vec", F.lit(1)).alias("v1"))


@check(
    "overlapping_position_merge",
    SPANS + """, p AS (SELECT doc_id, a + i AS position, a % 13 + i % 5 AS x FROM t, range(0, 1024) r(i) WHERE a + i < b)
        SELECT doc_id, count(*) AS positions, sum(v0) AS total, max(n) AS most FROM (SELECT doc_id, position, avg(x) AS v0, count(*) AS n FROM p GROUP BY ALL) GROUP BY doc_id""",
    ["total"],
)
def overlapping_position_merge(t):
    steps = F.sequence(F.lit(0), F.col("end") - F.col("start") - 1)
    chunks = _chunks(t).where("end > start").withColumn(
        "vecs", F.transform(steps, lambda i: F.array((F.col("start") % 13 + i % 5).cast("double")))
    )
    out = registry.merge_positions(chunks, ["doc_id"])
    return out.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("positions"), F.sum(F.get("vec", F.lit(0))).alias("total"), F.max("n").alias("most")
    )


# --- permutation ---------------------------------------------------------------------


@check(
    "column_permutation",
    """WITH a AS (SELECT model, dataset, test_run, row_id, row_number() OVER (PARTITION BY model, dataset, test_run ORDER BY row_id) AS i FROM base),
            p AS (SELECT model, dataset, test_run, s_base, row_number() OVER (PARTITION BY model, dataset, test_run ORDER BY md5('7-s_base-' || row_id), row_id) AS i FROM base),
            q AS (SELECT model, dataset, test_run, s_prior, row_number() OVER (PARTITION BY model, dataset, test_run ORDER BY md5('7-s_prior-' || row_id), row_id) AS i FROM base)
       SELECT row_id, s_base, s_prior FROM a JOIN p USING (model, dataset, test_run, i) JOIN q USING (model, dataset, test_run, i)""",
    ["s_base", "s_prior"],
)
def column_permutation(t):
    rows = t.base().select(*RUN, "row_id", "s_base", "s_prior")
    return permute.permute_columns(rows, RUN, ["s_base", "s_prior"], 7).select("row_id", "s_base", "s_prior")


RANDOM_CTES = {
    "rc_rows": "SELECT model, dataset, row_id, dr_id, pr_id, label, s_base FROM base WHERE label IS NOT NULL AND split = 'test'",
    "rc_at": "SELECT *, row_number() OVER (PARTITION BY model, dataset ORDER BY row_id) AS i FROM rc_rows",
    "rc_d": "SELECT model, dataset, dr_id AS nd, row_number() OVER (PARTITION BY model, dataset ORDER BY md5('11-dr_id-' || row_id), row_id) AS i FROM rc_rows",
    "rc_t": "SELECT model, dataset, pr_id AS nt, row_number() OVER (PARTITION BY model, dataset ORDER BY md5('11-pr_id-' || row_id), row_id) AS i FROM rc_rows",
    "rc_all": """SELECT a.*, v.variant, CASE WHEN variant IN ('random_drug', 'random_both') THEN nd ELSE dr_id END AS fd, CASE WHEN variant IN ('random_target', 'random_both') THEN nt ELSE pr_id END AS ft
                 FROM rc_at a JOIN rc_d USING (model, dataset, i) JOIN rc_t USING (model, dataset, i), (VALUES ('original'), ('random_drug'), ('random_target'), ('random_both')) v(variant)""",
    "rc_scored": "SELECT *, s_base - (CAST(fd AS BIGINT) % 4) * 0.25::DOUBLE - (CAST(ft AS BIGINT) % 5) * 0.125::DOUBLE AS s FROM rc_all",
    "rc_auc": """SELECT model, dataset, variant, (sum(CASE WHEN label = 1 THEN rk END) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label))) AS auroc FROM (
                   SELECT *, rank() OVER (PARTITION BY model, dataset, variant ORDER BY s) + (count(*) OVER (PARTITION BY model, dataset, variant, s) - 1) / 2.0 AS rk FROM rc_scored) GROUP BY ALL""",
    "rc_steps": "SELECT model, dataset, variant, s, count(*) AS n, sum(label) AS pos FROM rc_scored GROUP BY ALL",
    "rc_cum": """SELECT *, sum(n) OVER o AS cn, sum(pos) OVER o AS cp, sum(pos) OVER (PARTITION BY model, dataset, variant) AS tp FROM rc_steps
                 WINDOW o AS (PARTITION BY model, dataset, variant ORDER BY s DESC)""",
    "rc_ap": "SELECT model, dataset, variant, sum(pos * cp / cn) / any_value(tp) AS auprc FROM rc_cum GROUP BY ALL",
    "rc_corr": """SELECT x.model, x.dataset, x.variant, corr(x.s, o.s) AS c, avg(x.label) AS pos_rate, count(*) AS num_samples FROM rc_scored x
                  JOIN rc_scored o ON o.variant = 'original' AND o.row_id = x.row_id GROUP BY ALL""",
}


@check(
    "entity_randomisation_control",
    """SELECT a.model, a.dataset, a.variant, a.auroc, p.auprc, CASE WHEN a.variant <> 'original' THEN a.auroc - b.auroc END AS delta_auroc_vs_original,
              CASE WHEN a.variant <> 'original' THEN p.auprc - q.auprc END AS delta_auprc_vs_original, CASE WHEN a.variant <> 'original' THEN a.auroc / b.auroc END AS auroc_retention_ratio,
              CASE WHEN a.variant <> 'original' THEN p.auprc / q.auprc END AS auprc_retention_ratio, CASE WHEN a.variant <> 'original' THEN c END AS score_corr_with_original, pos_rate, num_samples
       FROM rc_auc a JOIN rc_ap p USING (model, dataset, variant) JOIN rc_auc b ON b.variant = 'original' AND b.model = a.model AND b.dataset = a.dataset
       JOIN rc_ap q ON q.variant = 'original' AND q.model = a.model AND q.dataset = a.dataset JOIN rc_corr k ON k.model = a.model AND k.dataset = a.dataset AND k.variant = a.variant""",
    ["auroc", "auprc", "delta_auroc_vs_original", "delta_auprc_vs_original", "auroc_retention_ratio", "auprc_retention_ratio", "score_corr_with_original", "pos_rate"],
    RANDOM_CTES,
)
def entity_randomisation_control(t):
    rows = t.base().where("label is not null and split = 'test'")
    rows = rows.select("model", "dataset", "row_id", "dr_id", "pr_id", "label", "s_base")
    number = lambda c: F.col(c).cast("bigint")
    score = F.col("s_base") - (number("dr_id") % 4) * 0.25 - (number("pr_id") % 5) * 0.125
    return permute.randomisation_control(rows, ["model", "dataset"], score, "label", 11)
