"""Connected components by alternating large-star and small-star steps, each a shuffle over the links left.

No step gathers a node's links: it takes their minimum and joins it back, so a node may have any number of links.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace


def components(links: DataFrame, ws: Workspace, most_rounds: int = 60) -> DataFrame:
    """node, label (the smallest node of its component) for each node of links (a, b)."""
    edges = ws.save(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges-0")
    state = None
    for k in range(1, most_rounds + 1):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("_u")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "_u")
        small = large.join(down, F.col("u") == F.col("_u")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = ws.save(small.unionByName(down.select(F.col("_u").alias("u"), F.col("m").alias("v"))).distinct(), f"edges-{k}")
        ws.drop(f"edges-{k - 1}")
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components: star steps did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
