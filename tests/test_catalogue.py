"""Every query with an oracle agrees with DuckDB on the smallest tables; the others return rows of a stable schema."""

import os

import duckdb
import pytest

from weft import catalogue

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{D}/{t}.parquet"
        inner = os.path.isdir(p) and any(x.endswith(".parquet") for x in os.listdir(p))
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}/*.parquet'" if inner else f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return con


def rows(frame):
    def plain(v):
        v = v.item() if hasattr(v, "item") else v
        return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    return sorted(repr([plain(v) for v in r]) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    got = catalogue.queries()[name](spark, D).toPandas()
    if name in catalogue.oracle_sql():
        expected = duck.sql(catalogue.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(expected.columns)
        assert rows(got) == rows(expected)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
