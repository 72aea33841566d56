import numpy as np
import pytest
from pyspark.sql import functions as F

from residuum.operators import dedup, neighbours, quality, support
from residuum.plans import evidence
from residuum.sources import scans


def test_source_counts_and_clusters(spark):
    """Four source pairs around one busy drug; the query pair's drug is known by its cluster only."""
    ddl = "dr_id int, pr_id int, drug_cluster int, target_cluster int"
    train = spark.createDataFrame([(21, 61, 5, 8), (21, 62, 5, 9), (21, 63, 5, 8), (22, 61, 6, 8)], ddl)
    later = spark.createDataFrame([(24, 64, 5, 7)], ddl)
    order = lambda df, name: df.withColumns({"file_order": F.lit(name), "row_id": F.monotonically_increasing_id()})
    related = order(train, "").unionByName(order(later, "later"))
    vectors = lambda d: spark.createDataFrame([(str(k), v) for k, v in d.items()], "id string, vec array<double>")
    tables = evidence.build_support(
        train, related,
        drug_features=vectors({21: [2.0, 1.0], 22: [1.0, 2.0], 24: [-3.0, 5.0]}),
        target_features=vectors({61: [1.0, 0.5], 62: [0.5, 1.0], 63: [3.0, 3.0], 64: [-1.0, 4.0]}),
    )
    rows = spark.createDataFrame([(7, 21, 61), (8, 24, 64)], "row_id int, dr_id int, pr_id int")
    known, new = evidence.attach_support(rows, tables).orderBy("row_id").collect()
    assert (known.source_drug_count, known.source_target_count, known.source_pair_count) == (3.0, 2.0, 1.0)
    assert (new.source_drug_count, new.source_drug_cluster_count, new.source_target_cluster_count) == (0.0, 3.0, 0.0)
    assert known.drug_nearest_train_distance == pytest.approx(0.0, abs=1e-12)
    assert new.drug_nearest_train_distance > 0 and new.target_nearest_train_distance > 0


def test_support_does_not_read_outcomes(spark):
    train = spark.createDataFrame([(1, 10, 1.0)], "dr_id int, pr_id int, label double")
    assert scans.source_interactions(train).columns == ["dr_id", "pr_id"]
    none = spark.createDataFrame([], "id string, cluster string")
    counts = support.source_counts(scans.source_interactions(train), none, none)
    assert quality.reads_no_outcome(counts)
    assert not quality.reads_no_outcome(train.select("label"))
    build = lambda rows: rows.groupBy("dr_id").count()
    leaky = lambda rows: rows.groupBy("dr_id").agg(F.sum("label").alias("n"))
    labelled = spark.range(40).select((F.col("id") % 5).alias("dr_id"), (F.col("id") % 2).cast("double").alias("label"), "id")
    assert quality.needs_no_outcome(build, labelled) and not quality.needs_no_outcome(leaky, labelled)
    clean, dirty = (quality.outcome_effects(f, labelled, "label").first() for f in (build, leaky))
    assert clean.changed == 0 and clean.moved > 0 and dirty.changed > 0


def hits(spark, rows):
    lines = spark.createDataFrame([("\t".join(map(str, r)),) for r in rows], "value string")
    return neighbours.scored_hits(scans.parse_hits(lines))


def line(query, target, share, bits, size=60):
    """A hit of ``size`` letters that covers both sides; ``share`` percent of them agree."""
    return [query, target, share, size, 1, size, 1, size, 1e-9, bits, size, size]


def test_family_support_uses_source_families(spark):
    """31 brings family F to the source; 32 is four fifths like it, 33 has only a family of its own."""
    rows = [line("pr_id=31", "F", 100, 90), line("pr_id=32", "F", 80, 70), line("pr_id=33", "G", 100, 95)]
    ids = spark.createDataFrame([("31",), ("32",), ("33",)], "id string")
    got = {r.id: r for r in neighbours.family_support(ids, hits(spark, rows), ids.where("id = '31'")).collect()}
    assert got["31"].distance == pytest.approx(0.0) and got["32"].distance == pytest.approx(0.2)
    assert (got["32"].family_unseen, got["33"].family_unseen, got["33"].distance) == (0.0, 1.0, 1.0)


def test_direct_support_pads_to_five(spark):
    """Two neighbours of 43 at 0.4 and 0.6 and three missing ones at 1: density (0.4 + 0.6 + 3) / 5."""
    rows = [line("pr_id=41", "pr_id=41", 100, 50), line("pr_id=43", "pr_id=41", 60, 30), line("pr_id=43", "pr_id=42", 40, 20)]
    ids = spark.createDataFrame([("41",), ("42",), ("43",)], "id string")
    near = neighbours.direct_neighbours(hits(spark, rows), ids.where("id <> '43'"))
    got = {r.id: r for r in neighbours.direct_support(ids, near).collect()}
    assert got["43"].nearest == pytest.approx(0.4) and got["43"].density == pytest.approx(0.8)
    assert [n[0] for n in got["43"].neighbours[:2]] == ["41", "42"]
    assert got["41"].nearest == pytest.approx(0.0) and (got["42"].nearest, got["42"].density) == (1.0, 1.0)


def test_joint_distance_equals_brute_force(spark):
    """The best product of similarities over seen pairs other than the pair itself."""
    rng = np.random.default_rng(8)
    sims = {side: {f"{side}{i}": [(f"{side}{j}", round(float(rng.uniform(0.1, 0.9)), 3)) for j in rng.choice(9, 3, replace=False)] for i in range(9)} for side in "ab"}
    seen = {(f"a{rng.integers(9)}", f"b{rng.integers(9)}") for _ in range(25)}
    ddl = "id string, neighbours array<struct<id:string,sim:double>>"
    left, right = (spark.createDataFrame(list(sims[s].items()), ddl) for s in "ab")
    pairs = spark.createDataFrame([(f"a{i}", f"b{i}") for i in range(9)] + [("other", "b1")], "dr_id string, pr_id string")
    known = spark.createDataFrame(sorted(seen), "key_a string, key_b string")
    got = {(r.dr_id, r.pr_id): r[2] for r in neighbours.joint_distance(pairs, left, right, known).collect()}
    for i in range(9):
        own = (f"a{i}", f"b{i}")
        found = [(p, q, s, t) for p, s in sims["a"][own[0]] for q, t in sims["b"][own[1]] if (p, q) in seen and (p, q) != own]
        best = max((s * t for _, _, s, t in found), default=0.0)
        assert got[own] == pytest.approx(1 - best, abs=1e-6)
    assert got[("other", "b1")] == 1.0


def test_capabilities(spark):
    ddl = "run string, p_base double, p_prior double, dr_id string, pr_id string, target_direct_nearest_train_distance double"
    rows = spark.createDataFrame([("x", 0.4, 0.7, "k", "l", None), ("y", 0.4, None, "k", "l", 0.6)], ddl)
    got = {r.run: r for r in support.capabilities(rows, ["run"]).collect()}
    assert got["x"].uncertainty_available and got["y"].uncertainty_available
    assert got["y"].empirical_support_available and got["y"].direct_target_support_available


def test_unique_pairs(spark):
    """Five test rows: two of a validation pair, two of one pair, one alone."""
    validation = spark.createDataFrame([(5, 50), (9, 90)], "dr_id int, pr_id int").withColumn("run", F.lit("q"))
    rows = [(5, 50, 1.0, 0.3), (5, 50, 1.0, 0.4), (6, 60, 0.0, 0.2), (6, 60, 0.0, 0.4), (7, 70, 1.0, 0.8)]
    test = spark.createDataFrame(rows, "dr_id int, pr_id int, base_wrong double, score double").withColumns(
        {"run": F.lit("q"), "state": F.lit("residual")})
    info = dedup.dedup_diagnostics(test, validation, ["run"], ["run"]).first()
    assert (info.cross_split_overlap_rows_removed, info.cross_split_overlap_pairs_removed) == (2, 1)
    assert (info.within_test_duplicate_rows_collapsed, info.validation_unique_pairs) == (1, 2)
    from residuum.operators.ranking import evaluate_ranking

    pairs = dedup.collapse_pairs(dedup.drop_overlap(test, validation, ["run"]), ["run"])
    row = evaluate_ranking(pairs, ["run"], [0.5], 2).first()
    assert row.universe_n == 2 and row.error_detection_auroc == 1.0


def brute(x, s, k, metric):
    if metric == "cosine":
        x, s = x / np.linalg.norm(x, axis=1, keepdims=True), s / np.linalg.norm(s, axis=1, keepdims=True)
        return np.sort(1 - x @ s.T, axis=1)[:, :k]
    return np.sort(np.sqrt(((x[:, None] - s[None]) ** 2).sum(-1)), axis=1)[:, :k]


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_neighbours_are_exact_in_small_pieces_with_many_copies(spark, metric):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 5))
    x[::3] = x[0]  # a third of all rows are copies of one
    df = spark.createDataFrame([(str(i), v.tolist(), i) for i, v in enumerate(x)], "id string, vec array<double>, ord bigint")
    got = neighbours.nearest_neighbours(df, df.where("ord % 2 = 0"), metric, 4, block_rows=16).toPandas()
    got["id"] = got["id"].astype(int)
    table = got.sort_values(["id", "rank"])["distance"].to_numpy().reshape(-1, 4)
    assert np.abs(table - brute(x, x[::2], 4, metric)).max() < 1e-7


def test_tanimoto_ties_keep_source_order(spark):
    rng = np.random.default_rng(1)
    bits = [sorted(rng.choice(40, size=int(rng.integers(0, 9)), replace=False).tolist()) for _ in range(120)]
    df = spark.createDataFrame([(str(i), b, i) for i, b in enumerate(bits)], "id string, vec array<int>, ord bigint")
    got = neighbours.tanimoto_neighbours(df, df.where("ord % 2 = 0").select("id"), 5, block_rows=11).toPandas()
    for i, b in enumerate(bits):
        sims = []
        for j in range(0, 120, 2):
            union = len(set(b) | set(bits[j]))
            sims.append((1 - (len(set(b) & set(bits[j])) / union if union else 0.0), j))
        part = got[got["id"] == str(i)].sort_values("rank")
        assert part["neighbour"].astype(int).tolist() == [j for _, j in sorted(sims)[:5]]


def test_no_source_means_no_neighbours(spark):
    df = spark.createDataFrame([("1", [1.0, 0.0], 1)], "id string, vec array<double>, ord bigint")
    assert neighbours.nearest_neighbours(df, df.where("ord < 0"), "cosine").count() == 0


def test_counts_move_rows_only_for_large_lookups(spark):
    """Counts equal brute force, the kinds asked for come alone, and small lookups do not move the rows."""
    train = spark.range(400).select(
        (F.col("id") % 17).alias("dr_id"), (F.col("id") % 11).alias("pr_id"), (F.col("id") % 17 % 3).alias("drug_cluster"),
        (F.col("id") % 11 % 2).alias("target_cluster"), F.lit("").alias("file_order"), F.col("id").alias("row_id"))
    drugs, targets = (support.cluster_map(train, c, k) for c, k in (("dr_id", "drug_cluster"), ("pr_id", "target_cluster")))
    counts = support.source_counts(train, drugs, targets)
    rows = spark.range(300).select("id", (F.col("id") % 19).alias("dr_id"), (F.col("id") % 13).alias("pr_id"), F.lit("payload").alias("wide"))
    out = support.attach_counts(rows, counts, drugs, targets)
    known = [(i % 17, i % 11) for i in range(400)]
    sames = {"drug": lambda a, b: a[0] == b[0], "target": lambda a, b: a[1] == b[1], "pair": lambda a, b: a == b,
             "drug_cluster": lambda a, b: b[0] < 17 and a[0] % 3 == b[0] % 3, "target_cluster": lambda a, b: b[1] < 11 and a[1] % 2 == b[1] % 2,
             "cluster_pair": lambda a, b: b[0] < 17 and b[1] < 11 and a[0] % 3 == b[0] % 3 and a[1] % 2 == b[1] % 2}
    for r in out.collect():
        for kind, same in sames.items():
            assert r[f"source_{kind}_count"] == sum(same(a, (r.dr_id, r.pr_id)) for a in known), (kind, r)
    two = support.attach_counts(rows, counts, drugs, targets, kinds=["drug", "target"])
    assert {c for c in two.columns if c.startswith("source_")} == {"source_drug_count", "source_target_count"}
    plan = two._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and plan.count("BroadcastHashJoin") == 2
