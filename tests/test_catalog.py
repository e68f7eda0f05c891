"""Every registered query against its SQL in DuckDB, at the smallest scale."""

from __future__ import annotations

import datetime
import decimal

import duckdb
import pytest

from civicspark.plans import catalog, catalog_answers, catalog_import, catalog_items, catalog_jobs, catalog_reports, catalog_streams, catalog_text  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, small, duck, name):
    df = catalog.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    if name in catalog.ORACLE_SQL:
        want = duck.sql(catalog.ORACLE_SQL[name])
        assert columns == sorted(want.columns)
        assert rows == sorted(repr(tuple(map(plain, r))) for r in want.select(*(f'"{c}"' for c in columns)).fetchall())
    else:
        assert rows


def test_no_query_hides_a_nested_loop_between_tables(spark, small):
    for name in ("j8_e8_dictionary_join", "r1_t1_lexical_recall", "j9_w6_banded_name_join", "r2_t3_vector_recall", "r3_w2_best_chunk", "r4_top_then_threshold", "r5_similar_items", "r11_centroid_classes", "a22_distance_histogram", "g5_documents_with_all_terms", "j12_name_correction"):
        plan = catalog.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
