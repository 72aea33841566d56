from pyspark.sql import functions as F

from residuum.functions import columns as C


def values(df, name):
    return [r[name] for r in df.collect()]


def test_error_risk_follows_the_predicted_class(spark):
    df = spark.createDataFrame([(1.0, 0.2), (0.0, 0.8), (1.0, 0.9), (0.0, 0.1), (None, 0.3)], "pred double, p double")
    risk = values(df.select(C.error_risk(F.col("p"), F.col("pred")).alias("r")), "r")
    assert [round(x, 9) for x in risk] == [0.8, 0.8, 0.1, 0.1, 0.3]


def test_prior_columns_keep_direction(spark):
    df = spark.createDataFrame([(0.8, 0.2, 3.0, 1.0), (0.8, 0.9, 1.0, 3.0), (0.8, None, 1.0, None)],
                               "p double, q double, s double, t double")
    named = C.prior_columns(F.col("p"), F.col("q"), F.col("s"), F.col("t"))
    a, b, c = df.select(*[v.alias(k) for k, v in named.items()]).collect()
    assert round(a.prior_contradiction_probability, 9) == 0.6 and a.prior_contradiction_logit == 2.0
    assert a.prior_support_probability == 0.0
    assert b.prior_contradiction_probability == 0.0 and round(b.prior_support_probability, 9) == 0.1
    assert b.prior_support_logit == 2.0
    assert all(v is None for v in c)


def test_base_columns_count_a_missing_label_as_wrong(spark):
    df = spark.createDataFrame([(1.0, 4.0), (0.0, 4.0), (None, 4.0), (0.0, None)], "label double, s_base double")
    rows = C.base_columns(df).collect()
    assert [r.base_wrong for r in rows] == [0.0, 1.0, 1.0, 0.0]
    assert rows[3].p_base is None and rows[3].base_pred == 0.0


def test_given_base_columns_are_kept(spark):
    df = spark.createDataFrame([(1.0, 0.7, 0.0, 3.0)], "label double, p_base double, base_pred double, base_confidence double")
    row = C.base_columns(df).first()
    assert (row.base_pred, row.base_wrong, row.base_confidence) == (0.0, 1.0, 1.0)


def test_identifiers_and_numbers(spark):
    df = spark.createDataFrame([("7.0",), (" x1 ",), (None,), ("1e3",), ("7.5",), ("inf",)], "v string")
    assert values(df.select(C.canonical_id("v").alias("i")), "i") == ["7", "x1", "", "1000", "7.5", "inf"]
    assert values(df.select(C.finite("v").alias("i")), "i") == [7.0, None, None, 1000.0, 7.5, None]
    df = spark.createDataFrame([("pr_id=10",), ("12.0",)], "v string")
    assert values(df.select(C.prefixed_id("v").alias("i")), "i") == ["10", "12"]


def test_row_extremes_are_null_with_a_null_side(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, None)], "a double, b double")
    got = df.select(C.strict_max(F.col("a"), F.col("b")).alias("x"), C.strict_min(F.col("a"), F.col("b")).alias("y")).collect()
    assert [tuple(r) for r in got] == [(2.0, 1.0), (None, None)]


def test_sequences(spark):
    df = spark.createDataFrame([("aDe K",), ("",), (None,)], "s string")
    v = values(df.select(C.sequence_composition(C.clean_sequence("s")).alias("v")), "v")
    assert v[0][0] == 4.0 and v[0][1] == 0.5 and v[0][2] == 0.25 and len(v[0]) == 28
    assert sum(v[1]) == 0.0
    code = values(df.select(C.letter_encoding(F.coalesce(C.clean_sequence("s"), F.lit("")), 6).alias("v")), "v")
    assert code[0] == [1, 5, 4, 10, 0, 0] and code[1] == [0] * 6
    assert values(spark.range(1).select(C.clean_sequence(F.lit(" nan")).alias("s")), "s") == [""]


def test_chunk_spans_cover_the_sequence(spark):
    for n in (1, 1024, 1025, 1792, 5000):
        spans = [tuple(s) for s in spark.range(1).select(C.chunk_spans(F.lit(n)).alias("s")).first().s]
        assert spans[0][0] == 0 and max(e for _, e in spans) == n and len(set(spans)) == len(spans)
        assert (max(n - 1024, 0), n) in spans
        covered = set()
        for a, b in spans:
            covered |= set(range(a, b))
        assert covered == set(range(n))


def test_main_component(spark):
    df = spark.createDataFrame([("CC.CCCO.N",), ("",), ("..",), ("CCC",)], "s string")
    got = [tuple(r.c) for r in df.select(C.main_component("s").alias("c")).collect()]
    assert got[0][:3] == ("CCCO", 3, "ok") and got[1][2] == "missing" and got[2][2] == "invalid"
    assert got[3][3] == "single_component"


def test_pair_vector_has_length_one(spark):
    v = spark.range(1).select(C.pair_vector(F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(2.0))).alias("v")).first().v
    assert abs(sum(x * x for x in v) - 1.0) < 1e-12 and abs(v[0] - 0.6 / 2 ** 0.5) < 1e-12
