import pytest
from pyspark.sql import functions as F

from residuum.operators import quality, registry
from residuum.sources import scans, sinks


def test_prediction_files_carry_their_run_keys(spark, tmp_path):
    folder = tmp_path / "first_model_runs" / "set_b" / "seed_4"
    folder.mkdir(parents=True)
    header = [f.split()[0] for f in scans.AUDIT_SCHEMA.split(", ")]
    row = {h: "" for h in header} | {"dr_id": "7", "pr_id": "3", "label": "1", "s_base": "2.0", "p_base": "nan"}
    (folder / "rows.csv").write_text(",".join(header) + "\n" + ",".join(row[h] for h in header) + "\n")
    got = scans.read_predictions(spark, str(tmp_path), {"first_model": "First"}).first()
    assert (got.model, got.dataset, got.test_run) == ("First", "set_b", "seed_4")
    assert got.label == 1.0 and got.p_base is None


def test_prediction_files_give_split_and_row_id(spark, tmp_path):
    folder = tmp_path / "m" / "d" / "seed_1"
    folder.mkdir(parents=True)
    header = [f.split()[0] for f in scans.AUDIT_SCHEMA.split(", ")]
    lines = [",".join({"split": "source_a", "phase": "test", "dr_id": str(i)}.get(h, "") for h in header) for i in range(50)]
    (folder / "rows.csv").write_text("\n".join([",".join(header), *lines]) + "\n")
    rows = scans.read_predictions(spark, str(tmp_path)).orderBy("row_id").collect()
    assert [r.dr_id for r in rows] == [str(i) for i in range(50)] and len({r.row_id for r in rows}) == 50
    assert {(r.split, r.source_split) for r in rows} == {("test", "source_a")}


def test_related_files_keep_their_own_headers(spark, tmp_path):
    (tmp_path / "b_with_id.csv").write_text("drug_cluster,pr_id,dr_id\n7,20,2\n6,21,3\n")
    (tmp_path / "c_with_id.csv").write_text("nothing,of use\n1,2\n")
    (tmp_path / "train_with_id.csv").write_text("dr_id,pr_id,target_cluster\n1,10,5\n")
    rows = scans.read_related_splits(spark, str(tmp_path), "train_with_id.csv").orderBy("file_order", "row_id").collect()
    assert [(r.dr_id, r.pr_id, r.drug_cluster, r.target_cluster) for r in rows] == [("1", "10", None, "5"), ("2", "20", "7", None), ("3", "21", "6", None)]


@pytest.mark.parametrize("block,open_cost", [("128m", "4m"), ("2k", "0"), ("700b", "0"), ("20k", "0")])
def test_row_ids_are_line_numbers_under_any_packing(spark, tmp_path, block, open_cost):
    header = [f.split()[0] for f in scans.AUDIT_SCHEMA.split(", ")]
    for run, n in (("seed_1", 400), ("seed_2", 3), ("seed_3", 90)):
        (tmp_path / "m" / "d" / run).mkdir(parents=True)
        lines = [",".join({"phase": "test", "dr_id": str(i), "label": "x" if i % 7 == 0 else "1"}.get(h, "") for h in header) + ("\n" if i % 11 == 0 else "") for i in range(n)]
        (tmp_path / "m" / "d" / run / "rows.csv").write_text("\n".join([",".join(header), *lines]) + "\n")
    (tmp_path / "b_with_id.csv").write_text("pr_id,dr_id\n" + "".join(f"1,{i}\n" for i in range(500)))
    (tmp_path / "train_with_id.csv").write_text("dr_id,pr_id\n" + "".join(f"{i},1\n" for i in range(300)))
    (tmp_path / "c_with_id.csv").write_text("nothing\n1\n")
    (tmp_path / "d_with_id.csv").write_text("\n")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", block), spark.conf.set("spark.sql.files.openCostInBytes", open_cost)
        rows = scans.read_predictions(spark, str(tmp_path / "m")).select("test_run", "dr_id", "row_id").collect()
        assert sorted((r.test_run, r.row_id) for r in rows) == [(f"seed_{k}", i) for k, n in ((1, 400), (2, 3), (3, 90)) for i in range(n)]
        assert all(r.dr_id == str(r.row_id) for r in rows)
        related = scans.read_related_splits(spark, str(tmp_path), "train_with_id.csv").collect()
        assert sorted((r.file_order, r.row_id) for r in related) == [("", i) for i in range(300)] + [("b_with_id.csv", i) for i in range(500)]
        assert all(r.dr_id == str(r.row_id) for r in related)
        reasons = {r.path.rsplit("/", 1)[1]: r.reason for r in scans.split_headers(spark, str(tmp_path)).collect()}
        assert reasons == {"b_with_id.csv": None, "train_with_id.csv": None, "c_with_id.csv": "no_source_column", "d_with_id.csv": "empty_file"}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_rejected_rows_are_counted_by_reason(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", None), (None, None), (None, 2.0)], "id string, v double")
    kept, rejects = scans.rejected(rows, {"no_id": F.col("id").isNull(), "no_value": F.col("v").isNull()})
    assert kept.count() == 1 and {r.reason: r["rows"] for r in rejects.collect()} == {"no_id": 2, "no_value": 1}


def test_no_local_folder_on_a_cluster(monkeypatch):
    from residuum import storage

    class Session:
        class conf:
            get = staticmethod(lambda key, default: None)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: {})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_folder(Session)


def test_related_files_come_train_first(spark, tmp_path):
    (tmp_path / "a_with_id.csv").write_text("dr_id,pr_id,drug_cluster,Y\n1,10,9,1\n")
    (tmp_path / "train_with_id.csv").write_text("dr_id,pr_id,drug_cluster,Y\n1,10,8,1\n")
    (tmp_path / "other.csv").write_text("x\n1\n")
    from residuum.operators.support import cluster_map

    rows = scans.read_related_splits(spark, str(tmp_path), "train_with_id.csv")
    assert rows.count() == 2 and "Y" not in rows.columns
    assert cluster_map(rows, "dr_id", "drug_cluster").first().cluster == "8"


def test_hit_file(spark, tmp_path):
    path = tmp_path / "hits.tsv"
    path.write_text("pr_id=1\tpr_id=2\t50\t80\t1\t80\t1\t80\tbad\t12\t100\t0\n")
    from residuum.operators.neighbours import scored_hits

    row = scored_hits(scans.read_hits(spark, str(path))).first()
    assert row.query_id == "1" and row.query_coverage == 0.8 and row.target_coverage is None
    assert row.support_score == pytest.approx(0.4)


def test_vectors_must_be_finite_and_long_enough(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [1.0]), (3, [float("nan"), 1.0]), (4, [])], "i int, v array<float>")
    assert [r.id for r in scans.vector_store(df, "i", "v", 2).collect()] == ["1"]
    assert {r.id for r in scans.vector_store(df, "i", "v").collect()} == {"1", "2"}


def test_rounded_sink_and_resume(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.1234565, 3), ("b", 2.5, 4)], "k string, v double, n int")
    sinks.write_table(df, str(tmp_path / "t"), 3, partition_by=["k"])
    back = spark.read.parquet(str(tmp_path / "t"))
    assert {(r.k, r.v) for r in back.collect()} == {("a", 0.123), ("b", 2.5)}
    sinks.write_table(df.where("k = 'b'").withColumn("v", F.lit(9.0)), str(tmp_path / "t"), 3, partition_by=["k"])
    back = spark.read.parquet(str(tmp_path / "t"))
    assert {(r.k, r.v) for r in back.collect()} == {("a", 0.123), ("b", 9.0)}
    wanted = spark.createDataFrame([("a",), ("c",)], "k string")
    assert [r.k for r in sinks.missing_runs(wanted, back, ["k"]).collect()] == ["c"]


def test_sequence_records(spark, tmp_path):
    df = spark.createDataFrame([("1", "A" * 100), ("2", " "), ("3", "C" * 80)], "id string, sequence string")
    got = {r.id: r.record for r in sinks.fasta_records(df).collect()}
    assert got == {"1": ">pr_id=1\n" + "A" * 80 + "\n" + "A" * 20, "3": ">pr_id=3\n" + "C" * 80}
    sinks.write_records(sinks.fasta_records(df), str(tmp_path / "fasta"))
    assert spark.read.text(str(tmp_path / "fasta")).count() == 5


def test_accession_table_needs_its_columns(spark):
    with pytest.raises(ValueError):
        sinks.accession_map(spark.createDataFrame([(1,)], "pr_id int"))


def test_preferred_text_is_a_column_choice(spark):
    df = spark.createDataFrame([(1, None, "x")], "i int, best string, other string")
    row = scans.preferred_text(df, "i", ["missing", "best", "other"]).first()
    assert row.text == "" and row.text_column == "best"


def test_overlapping_positions_are_averaged(spark):
    rows = [("a", 0, 3, [[1.0], [2.0], [3.0]]), ("a", 2, 4, [[5.0], [7.0]])]
    df = spark.createDataFrame(rows, "k string, start int, end int, vecs array<array<double>>")
    got = {r.position: r.vec[0] for r in registry.merge_positions(df, ["k"]).collect()}
    assert got == {0: 1.0, 1: 2.0, 2: 4.0, 3: 7.0}


def test_cardinality_is_checked(spark):
    left = spark.createDataFrame([("a",), ("a",)], "k string")
    right = spark.createDataFrame([("a", 1)], "k string, v int")
    assert quality.cardinality_join(left, right, ["k"]).count() == 2
    with pytest.raises(quality.ShardError):
        quality.cardinality_join(left, right, ["k"], one_to_one=True)
    with pytest.raises(quality.ShardError):
        quality.cardinality_join(right, left.withColumn("w", F.lit(1)), ["k"])
