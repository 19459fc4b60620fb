"""Lexical match, vector match and their fusion by reciprocal ranks.

Ranks are taken after a limit, so no window sees more rows than an arm's candidates.
"""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import cosine


def vector_arm(vectors: DataFrame, query: list[float], candidates: int) -> DataFrame:
    """chunk_id, rank: the nearest chunks by cosine similarity, to six places."""
    score = F.round(cosine(F.col("embedding"), F.array(*map(F.lit, query))), 6)
    return ranked(vectors.where("embedding IS NOT NULL").select("chunk_id", score.alias("score")).where("score IS NOT NULL").orderBy(F.desc("score"), "chunk_id").limit(candidates))


def ranked(top: DataFrame) -> DataFrame:
    """chunk_id, rank (from 1) of rows that a limit has bounded."""
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "chunk_id"))).select("chunk_id", "rank")


def fused(arms: list[DataFrame], k: int = 60, limit: int = 20) -> DataFrame:
    """chunk_id, score: the sum of 1 / (k + rank) over the arms, the best `limit`."""
    rows = arms[0]
    for arm in arms[1:]:
        rows = rows.unionByName(arm)
    scored = rows.groupBy("chunk_id").agg(F.round(F.sum(1 / (k + F.col("rank"))), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "chunk_id").limit(limit)
