import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
SAMPLE = [
    "residual_review", "evaluate_ranking", "audit_table_scan", "count_lookups", "cosine_knn_support", "tanimoto_neighbour_list",
    "grouped_stratified_folds", "policy_coverage", "pair_collapse", "column_permutation", "overlapping_chunk_spans",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 120


def plain(v):
    return round(v, 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(str(tuple(plain(v) for v in r)) for r in df.select(*columns).collect())
    cur = duck.execute(entry.oracle_sql()[name])
    at = [[d[0] for d in cur.description].index(c) for c in columns]
    want = sorted(str(tuple(plain(r[i]) for i in at)) for r in cur.fetchall())
    assert got == want


def test_flagship_query(spark):
    rows = entry.entry(spark).collect()
    assert rows and {"review_error_rate", "error_detection_auprc"} <= set(rows[0].asDict())
