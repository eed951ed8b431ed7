"""Every query with an SQL equivalent against DuckDB on the same tables."""

from decimal import Decimal

import duckdb
import pytest

from wayfare import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(found, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda x: round(float(x), 5) if isinstance(x, float | Decimal) else x
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_matches_sql(spark, db, name):
    got = registry.queries()[name](spark, SF)
    want = db.execute(registry.oracles()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    a, b = rows([tuple(r) for r in got.collect()], got.columns), rows(want.fetchall(), names)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x == pytest.approx(y, rel=1e-4, abs=2e-5, nan_ok=True) if all(isinstance(v, int | float) for v in x) else x == y


def test_order_of_partitions_does_not_matter(spark):
    q = registry.queries()["route_turn_fidelity"]
    first = q(spark, SF).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert q(spark, SF).collect() == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
