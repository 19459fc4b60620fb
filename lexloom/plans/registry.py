"""Where plan modules put their queries: a Spark plan for each name, and SQL that states the same rows."""

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..catalog import oracle, run_sql

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def sql(name: str, text: str, duck: str | None = None) -> None:
    """A query in SQL over the catalog; duck: its oracle where DuckDB's dialect differs."""
    QUERIES[name] = lambda spark, sf_dir: run_sql(spark, sf_dir, text)
    ORACLES[name] = oracle(duck or text)


def query(name: str, duck: str | None = None) -> Callable:
    """A query as a function (spark, sf_dir) -> DataFrame; duck: its oracle over the catalog."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = f
        if duck:
            ORACLES[name] = oracle(duck)
        return f

    return add
