"""Every matrix query against its SQL on the same tables."""

import math

import duckdb
import pytest

from sparkmat.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = ("lineitem", "supplier", "part", "nation", "orders", "customer", "events", "embeddings")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def close(a, b):
    if isinstance(a, float) and isinstance(b, float) and math.isnan(a):
        return math.isnan(b)
    return a == b or a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(r[c] for c in cols) for r in df.collect())
    want = sorted(tuple(map(lambda v: v, r)) for r in duck.execute(f"SELECT {', '.join(cols)} FROM ({registry.oracle_sql()[name]})").fetchall())
    assert len(got) == len(want) > 0
    assert all(close(x, y) for a, b in zip(got, want) for x, y in zip(a, b))
