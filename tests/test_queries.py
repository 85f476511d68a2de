"""Every registered query against its SQL in DuckDB."""

from collections import Counter

import duckdb
import pytest
from laminae.queries.catalogue import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def value(v):
    return round(v, 9) if isinstance(v, float) else v


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES) and len(QUERIES) > 180


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    found = duck.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    got = Counter(tuple(map(value, r)) for r in df.select(*(f"`{n}`" for n in names)).collect())
    assert got == Counter(tuple(map(value, r)) for r in found.fetchall())
