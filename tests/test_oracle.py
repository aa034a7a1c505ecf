"""Every registered query against its SQL, and the driver contract."""

import pytest
from harness import connect, duck_rows, spark_rows

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    assert spark_rows(QUERIES[name](spark, SF)) == duck_rows(con, SQL[name])


#: Searches, which may find nothing in the smallest tables.
SEARCHES = {"op5_decontamination", "op9_secrets"}
#: Queries with one row for each row of a table.
ROW_BY_ROW = {
    "op2_main_text": "pages", "op3_lm_score": "documents", "op4_token_counts": "documents",
    "op7_token_store": "documents", "op8_language": "documents", "op10_simhash": "documents",
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    rows = QUERIES[name](spark, SF).count()
    if name in ROW_BY_ROW:
        assert rows == spark.read.parquet(f"{SF}/{ROW_BY_ROW[name]}.parquet").count()
    elif name == "op1_packing":
        assert rows >= spark.read.parquet(f"{SF}/documents.parquet").count()
    else:
        assert rows >= (0 if name in SEARCHES else 1)


def test_sql_has_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    row = entry_module.entry(spark).first()
    assert (row.rows_source, row.deleted_rows, row.rows_kept, row.k_after) == (150, 150, 0, 0)
