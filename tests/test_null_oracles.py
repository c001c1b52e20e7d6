"""Queries whose rows hold nulls, or whose SQL was once not run to its end: against SQL on a larger table, rows sorted by their keys."""

import duckdb
import pytest

from sparkmat.plans import registry
from tests.test_matrix_oracles import close

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name,keys", [("embedding_frame", ("node",)), ("mutual_edges", ("src", "dst"))])
def test_oracle_by_keys(spark, name, keys):
    duck = duckdb.connect()
    for t in ("lineitem", "part"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = registry.queries()[name](spark, SF)
    cols = [*keys, *sorted(set(df.columns) - set(keys))]
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=lambda r: r[: len(keys)])
    want = duck.execute(f"SELECT {', '.join(cols)} FROM ({registry.oracle_sql()[name]}) ORDER BY {', '.join(keys)}").fetchall()
    assert len(got) == len(want) > 0
    assert all(close(x, y) for a, b in zip(got, want) for x, y in zip(a, b))
