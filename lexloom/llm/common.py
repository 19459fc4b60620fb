"""What every operator of this subpackage shares: reading tables, the working folder, lower-level text helpers.

Null texts count as empty texts everywhere. Input frames may carry extra columns of any name: operators take the
columns they need by name first, so a clash cannot happen.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import Workspace, shared_folder  # noqa: F401

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark from wherever sf_dir lies."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def word_count(text):
    """Number of words of a text column; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def remainder(doc_id, modulus: int):
    """crc32 of the id written as text, modulo modulus; null ids give null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def words(text: str | None) -> list[bytes]:
    """The words of a text with A-Z lower-cased, as UTF-8: bytes.lower() and bytes.split() know ASCII only, as is asked for."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def most_frequent(counts: DataFrame, key: str, most: int):
    """The rows (key, n) of the highest n, as pandas, highest n first, ties by key: at most `most`, fewer where more would tie in a class of n.

    A histogram of n gives the lowest n to collect, so tasks send no more than what is kept.
    """
    level = F.floor(F.log2("n") * 32).cast("int")
    histogram = sorted(((r["level"], r["count"]) for r in counts.groupBy(level.alias("level")).count().collect()), reverse=True)
    lowest, total = None, 0
    for at, rows in histogram:
        total += rows
        if total > most:
            break
        lowest = at
    chosen = counts.where(level >= lowest) if lowest is not None else counts.where(F.lit(False))
    return chosen.select(key, "n").toPandas().sort_values(["n", key], ascending=[False, True], kind="stable")
