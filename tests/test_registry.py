"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as contract

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def views():
    from tests.conftest import SF_DIR

    if not os.path.isdir(SF_DIR):
        pytest.skip("no table folder")
    con = duckdb.connect()
    for name in os.listdir(SF_DIR):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF_DIR}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(contract.queries()))
@pytest.mark.filterwarnings("ignore:no data for language")
def test_query(spark, sf_dir, views, name):
    df = contract.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(repr([r[c] for c in columns]) for r in df.collect())
    assert got
    sql = contract.oracle_sql().get(name)
    if sql is not None:
        cursor = views.execute(sql)
        names = [d[0] for d in cursor.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert got == sorted(repr([r[i] for i in at]) for r in cursor.fetchall())


def test_flagship(spark):
    blocks = contract.entry(spark)
    assert blocks.columns == ["batch_id", "block_ord", "n_tokens", "ids_md5"]
    assert blocks.count() == 3790
