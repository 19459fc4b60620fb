"""Bounded graph traversal as joins: every hop is one join of the frontier with the edges of both directions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..stars import components
from ..workspace import Workspace


def both_ways(edges: DataFrame) -> DataFrame:
    """a, b for each edge in each direction."""
    return edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b")))


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """id, depth: nodes within `hops` of the seeds (column id), each with its least depth.

    A hop joins the edges with what the last one reached, a written table: Spark sends it to every task while it is small.
    """
    ws = Workspace(edges.sparkSession, "neighbourhood")
    steps = both_ways(edges)
    seen = ws.save(seeds.select("id").distinct().withColumn("depth", F.lit(0)), "depth-0")
    frontier = seen
    for depth in range(1, hops + 1):
        reached = steps.join(frontier, F.col("a") == F.col("id"), "left_semi").select(F.col("b").alias("id")).distinct()
        frontier = ws.save(reached.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)), f"depth-{depth}")
        seen = seen.unionByName(frontier)
    return seen


def induced_edges(edges: DataFrame, nodes: DataFrame, limit: int | None = None) -> DataFrame:
    """The edges with both ends among nodes (id), by falling evidence."""
    ids = nodes.select("id").distinct()
    inner = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return inner.orderBy(F.desc("evidence"), "src", "predicate", "dst").limit(limit) if limit else inner


def shortest_paths(edges: DataFrame, start: str, end: str, most: int = 4) -> DataFrame:
    """path (array of ids): the least of the shortest undirected paths of at most `most` edges; no row without one.

    The frontier keeps one path a node (the least), so it never outgrows the nodes.
    """
    ws = Workspace(edges.sparkSession, "paths")
    steps = both_ways(edges)
    frontier = seen = ws.save(edges.sparkSession.createDataFrame([(start, [start])], "id string, path array<string>"), "depth-0")
    for depth in range(1, most + 1 if start != end else 1):
        walked = steps.join(frontier, F.col("id") == F.col("a")).select(F.col("b").alias("id"), F.concat("path", F.array("b")).alias("path"))
        frontier = ws.save(walked.groupBy("id").agg(F.min("path").alias("path")).join(seen.select("id"), "id", "left_anti"), f"depth-{depth}")
        if not frontier.limit(1).count() or frontier.where(F.col("id") == end).count():
            break
        seen = seen.unionByName(frontier)
    return frontier.where((F.col("id") == end) & (F.size("path") > 1)).select("path")


def label_components(links: DataFrame) -> DataFrame:
    """id, label: the least id reachable over links (src, dst), in any number of steps."""
    return components(links.select(F.col("src").alias("a"), F.col("dst").alias("b")), Workspace(links.sparkSession, "components")).withColumnRenamed("node", "id")
