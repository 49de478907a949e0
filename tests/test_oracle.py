"""Every registered query of the core against its SQL in DuckDB."""

import duckdb
import pandas as pd
import pytest

from quern.more_queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        v = v.tolist() if hasattr(v, "tolist") else v
        if isinstance(v, list):
            return str(v)
        if v is None or v is pd.NaT or v is pd.NA or v != v:
            return "None"
        if isinstance(v, pd.Timestamp):
            return v.isoformat()
        return str(round(float(v), 6)) if isinstance(v, (bool, int, float)) else str(v)

    return sorted(tuple(map(one, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, sf, duck, name):
    ours, theirs = QUERIES[name](spark, sf).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canonical(ours) == canonical(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, sf, name):
    QUERIES[name](spark, sf).collect()


def test_typed_pairs_of_keys_a_million_apart(spark, tmp_path):
    keys = [0, 1, 2, 1000000, 1000001, 1000002, 2000001, 2000001, 3000003, None]
    path = tmp_path / "orders.parquet"
    pd.DataFrame({"o_orderkey": pd.array(keys, dtype="Int64")}).to_parquet(path)
    con = duckdb.connect()
    con.sql(f"create view orders as select * from '{path}'")
    ours, theirs = QUERIES["typed_pairs"](spark, str(tmp_path)).toPandas(), con.sql(ORACLE_SQL["typed_pairs"]).df()
    assert len(ours) == len(keys) and canonical(ours) == canonical(theirs)
