"""The SQL of the numbered queries gives their rows."""

import duckdb
import pytest

from lodestone.llm import registry

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql_equals_query(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "labels", "embeddings"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DIR}/{table}.parquet'")
    found = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    got = registry.queries()[name](spark, DIR)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(found.fetchall(), key=repr)
