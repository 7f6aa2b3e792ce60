"""The queries whose rows SQL can say, against that SQL on the smallest tables."""

import duckdb
import pytest

from textlode.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    got = con.execute(queries.SQL[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(str, df.select(*columns).toPandas().itertuples(index=False, name=None))) == sorted(map(str, df.sparkSession.createDataFrame(
        got.fetchall(), df.select(*columns).schema).toPandas().itertuples(index=False, name=None)))
