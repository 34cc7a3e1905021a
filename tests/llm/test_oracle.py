"""Each operator's query against its DuckDB SQL, whole tables at sf0.001."""

import duckdb
import pytest

from flowlens.llm import oracle, queries

from ..conftest import SF_SMALL
from ..test_entry_oracle import _norm

TABLES = ["documents", "embeddings", "pages", "benchmark", "labels"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_oracle_matches(spark, duck, name):
    df = queries.queries()[name](spark, SF_SMALL)
    res = duck.execute(oracle.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(cols)
    s = sorted("|".join(_norm(r[c]) for c in sorted(cols)) for r in df.collect())
    d = sorted("|".join(_norm(r[cols.index(c)]) for c in sorted(cols)) for r in res.fetchall())
    assert s == d
