"""Every registered query of the engine runs on the smallest tables and equals its SQL oracle."""

import duckdb
import pytest

from quillmark.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"sparse_cosine_pairs", "connected_components", "cluster_events"}


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(map(repr, df[cols].astype(object).where(df[cols].notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - SLOW))
def test_query_equals_oracle(spark, db, tmp_path, name):
    out = str(tmp_path / name)
    registry.queries()[name](spark, SF).write.parquet(out)
    if name in registry.oracle_sql():
        assert rows(db.sql(registry.oracle_sql()[name]).df()) == rows(db.sql(f"select * from '{out}/*.parquet'").df())


def test_entry_and_keys():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
