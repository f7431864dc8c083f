"""Every registered query of the library against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from storyspark.plans.registry import registered

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def plain(frame):
    columns = sorted(frame.columns)
    values = frame[columns].map(lambda v: None if v is None or v != v else repr(float(v)) if isinstance(v, float) else str(v))
    return columns, sorted(map(str, values.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(registered()))
def test_query_equals_sql(spark, db, name):
    run, sql = registered()[name]
    got = run(spark, SF).toPandas()
    if sql is None:
        assert len(got.columns)
    else:
        assert plain(got) == plain(db.execute(sql).df())
