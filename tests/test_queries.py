"""Every query that has an SQL oracle, against DuckDB over the same tables."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return db


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return int(value) if isinstance(value, bool) or type(value).__name__ == "Decimal" else value


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query_matches_its_oracle(spark, duck, name):
    found = __spark_entry__.queries()[name](spark, DATA)
    wanted = duck.sql(__spark_entry__.oracle_sql()[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    order = [wanted.columns.index(c) for c in found.columns]
    got = Counter(tuple(map(plain, r)) for r in found.collect())
    assert got == Counter(tuple(plain(r[i]) for i in order) for r in wanted.fetchall())
    spark.catalog.clearCache()


def test_every_reference_query_has_an_oracle():
    from ledgerloom.plans import registry

    assert set(registry.queries()) == set(registry.oracle_sql())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
