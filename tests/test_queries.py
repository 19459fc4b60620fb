"""Every query with an oracle against DuckDB, at the smallest scale."""

import math

import duckdb
import pytest

from lexloom.catalog import TABLES, oracle, run_sql
from lexloom.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def text_of(value) -> str:
    return ("nan" if math.isnan(value) else f"{value:.6g}") if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    rows = sorted(tuple(text_of(r[c]) for c in columns) for r in frame.collect())
    if name not in ORACLES:
        return
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert rows == sorted(tuple(text_of(r[names.index(c)]) for c in columns) for r in result.fetchall())


def test_literal_braces(spark):
    assert run_sql(spark, SF, "SELECT count(*) AS n FROM {region} WHERE regexp_like(r_name, '[A-Z]{4,}')").first()["n"] == 5


def test_oracle_names_what_tables_need():
    assert oracle("SELECT * FROM {edges}").startswith("WITH provenance AS (") and "{" not in oracle("SELECT * FROM {edges}")
