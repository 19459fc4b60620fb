"""Centroid clustering with Yinyang bounds.

Vectors are quantised to integers, so every distance and every mean is exact. Centroids are put into groups once, by
their own distances. Each vector keeps an upper bound of the distance to its own centroid and, for each group, one lower
bound of the distance to any other centroid in it. After centroids have moved, bounds move by as much. A vector whose
upper bound lies under all lower bounds keeps its centroid (the global filter, before and after its upper bound is made
exact); of the others, groups whose lower bound lies above the upper bound are passed over (the group filter), and the
centroids of the groups that are left are scanned exactly. A bound only excludes what is strictly farther, so ties still
go to the smaller number, and results equal those of plain rounds.

A round is one pass over the vectors, written with their bounds to the shared folder; sums by cluster are added up
before they are shuffled, and only k rows of them reach the driver.

Defined cases: vectors of another size, null ones, and those that hold null or non-finite components take no part;
fewer vectors than k make as many centroids; vectors without an id are clustered but start no centroid unless too few
others exist; of rows that share an id the smaller vector starts first; components beyond 2**27 in size after scaling
count as 2**27, so that squared distances fit a long; an empty table gives an empty result.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

#: Largest size of a quantised component: 64 squares of twice that fit a long.
MOST = 1 << 27
#: Bounds are floating-point numbers: they give way by this share, far above their rounding and far below what decides.
SLACK = 1e-9
FIELDS = "vec_id long, v array<int>, cluster int, distance long, upper double, lower array<double>, scanned int"


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all centroids, as whole numbers."""
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if x.shape[1] * (2 * largest) ** 2 < 2**53:  # then doubles hold every sum
        a, b = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centroids], axis=1)


def grouped(centroids: np.ndarray, groups: int) -> np.ndarray:
    """Group of each centroid: the centroids' own clusters, by five rounds from spread-out starts."""
    d = distances(centroids, centroids)
    starts = [0]
    while len(starts) < min(groups, len(centroids)):
        starts.append(int(d[:, starts].min(1).argmax()))
    means = centroids[starts].astype(np.float64)
    for _ in range(5):
        at = ((centroids[:, None, :] - means[None]) ** 2).sum(2).argmin(1)
        for g in range(len(means)):
            if (at == g).any():
                means[g] = centroids[at == g].mean(0)
    return np.unique(at, return_inverse=True)[1]


def first_pass(x: np.ndarray, centroids: np.ndarray, group: np.ndarray) -> tuple:
    """cluster, distance, upper, lower, scanned of rows that have no bounds yet."""
    d = distances(x, centroids)
    cluster = d.argmin(1)
    rows = np.arange(len(x))
    best = d[rows, cluster]
    rest = np.sqrt(d.astype(np.float64))
    rest[rows, cluster] = np.inf
    lower = np.stack([rest[:, group == g].min(1) for g in range(group.max() + 1)], axis=1)
    return cluster, best, np.sqrt(best.astype(np.float64)), lower, np.full(len(x), len(centroids))


def next_pass(x: np.ndarray, centroids: np.ndarray, group: np.ndarray, moved: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple:
    """The same after centroids have moved by `moved`, with as few exact distances as the bounds leave."""
    upper = (upper + moved[cluster]) * (1 + SLACK)
    lower = np.maximum(lower - np.array([moved[group == g].max() for g in range(lower.shape[1])]), 0.0) * (1 - SLACK)
    scanned = np.zeros(len(x), np.int64)
    open_rows = np.flatnonzero(lower.min(1) <= upper)
    own = ((x[open_rows] - centroids[cluster[open_rows]]) ** 2).sum(1)
    upper[open_rows] = np.sqrt(own.astype(np.float64)) * (1 + SLACK)
    scanned[open_rows] = 1
    left = lower[open_rows].min(1) <= upper[open_rows]
    open_rows, own = open_rows[left], own[left]
    before = cluster[open_rows]
    d = np.full((len(open_rows), len(centroids)), np.iinfo(np.int64).max)
    d[np.arange(len(open_rows)), before] = own
    looked = lower[open_rows] <= upper[open_rows][:, None]
    for g in range(lower.shape[1]):
        at, members = np.flatnonzero(looked[:, g]), np.flatnonzero(group == g)
        if len(at):
            d[at[:, None], members[None, :]] = distances(x[open_rows[at]], centroids[members])
            scanned[open_rows[at]] += len(members)
    now = d.argmin(1)
    rows = np.arange(len(open_rows))
    best = d[rows, now]
    rest = np.where(d == np.iinfo(np.int64).max, np.inf, np.sqrt(d.astype(np.float64)))
    rest[rows, now] = np.inf
    for g in range(lower.shape[1]):
        least = rest[:, group == g].min(1) * (1 - SLACK)
        # a group that was passed over keeps its bound, but for the centroid that a vector has just left
        lower[open_rows, g] = np.where(looked[:, g], least, np.minimum(lower[open_rows, g], least))
    cluster = cluster.copy()
    cluster[open_rows] = now
    upper[open_rows] = np.sqrt(best.astype(np.float64)) * (1 + SLACK)
    return cluster, upper, lower, scanned


def _array(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)), pa.array(np.ascontiguousarray(values).reshape(-1), kind))


def _pass(centroids: np.ndarray, group: np.ndarray, moved: np.ndarray | None, last: bool, rows: int = 8192):
    """Task of one round: vectors, with their bounds where moved is given, to clusters and bounds."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                x = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.int64)
                if moved is None:
                    cluster, distance, upper, lower, scanned = first_pass(x, centroids, group)
                else:
                    lower = batch.column("lower").flatten().to_numpy().reshape(batch.num_rows, -1)
                    cluster, upper, lower, scanned = next_pass(x, centroids, group, moved, batch.column("cluster").to_numpy(), batch.column("upper").to_numpy().copy(), lower.copy())
                    scanned = scanned + batch.column("scanned").to_numpy()
                    distance = ((x - centroids[cluster]) ** 2).sum(1) if last else np.zeros(len(x), np.int64)
                columns = [batch.column("vec_id"), batch.column("v"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64()), pa.array(upper), _array(lower, pa.float64()), pa.array(scanned, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in FIELDS.split(", ")])

    return task


def quantised(vectors: DataFrame, id_column: str, vector_column: str, scale: float, dim: int) -> DataFrame:
    """vec_id, v: whole vectors of `dim` finite components, floor(scale * component) as whole numbers."""
    v = F.col(vector_column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(v, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(MOST))), F.lit(-float(MOST)))).cast("int"))
    return vectors.where(v.isNotNull() & (F.size(v) == dim)).where(finite).select(F.col(id_column).cast("long").alias("vec_id"), whole.alias("v"))


def clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, groups: int = 4, scale: float = 64.0, dim: int = 64, seed: str = "1:", id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """For each vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, and scanned, the exact distances that were computed.

    Centroids start at the k vectors with the smallest SHA-256 of seed and id; after `rounds` rounds of moving them, vectors are assigned once more.
    """
    spark = vectors.sparkSession
    ws = Workspace(spark, "centroids")
    state = ws.save(quantised(vectors, id_column, vector_column, scale, dim), "vectors")
    starts = state.orderBy(F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "v").limit(k).collect()
    if not starts:
        none = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, scanned int"
        return spark.createDataFrame([], none)
    centroids = np.array([r["v"] for r in starts], np.int64)
    group, moved = grouped(centroids, groups), None
    name = "vectors"
    for turn in range(rounds + 1):
        state = ws.save(state.mapInArrow(_pass(centroids, group, moved, turn == rounds), FIELDS), f"round-{turn}")
        ws.drop(name)
        name = f"round-{turn}"
        if turn < rounds:
            sums = [F.sum(F.col("v")[i].cast("long")).cast("decimal(38,0)").alias(f"s{i}") for i in range(dim)]
            before = centroids.copy()
            for r in state.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():  # k rows at most
                centroids[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(dim)]
            moved = np.sqrt(((centroids - before).astype(np.float64) ** 2).sum(1)) * (1 + SLACK)
    within = {r["cluster"]: int(r["d"]) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    total = sum(within.values())
    known = spark.createDataFrame([(c, d, total, ",".join(map(str, centroids[c]))) for c, d in within.items()], "cluster int, cluster_inertia long, inertia long, centroid string")
    known = known.select("cluster", "cluster_inertia", "inertia", F.sha2("centroid", 256).alias("centroid_sha256"))
    return state.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "scanned")  # k rows


def _oracle(k: int = 16, rounds: int = 3, scale: int = 64, dim: int = 64) -> str:
    distance = "CAST(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    nearest = f"SELECT row_id, vec_id, v, arg_min(cluster, ({distance}, cluster)) AS cluster, min({distance}) AS distance FROM v CROSS JOIN c{{0}} GROUP BY row_id, vec_id, v"
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS cluster, v AS c FROM (SELECT sha256('1:' || CAST(vec_id AS VARCHAR)) AS h, v FROM v) ORDER BY h NULLS LAST, v LIMIT {k})",
    ]
    for i in range(rounds):
        parts.append(f"a{i} AS MATERIALIZED ({nearest.format(i)})")
        parts.append(
            f"""m{i} AS (SELECT cluster, list(m ORDER BY j) AS m FROM (SELECT cluster, j, CAST(floor(sum(x) / count(*)) AS BIGINT) AS m
  FROM (SELECT cluster, unnest(v) AS x, unnest(range({dim})) AS j FROM a{i}) GROUP BY cluster, j) GROUP BY cluster)"""
        )
        parts.append(f"c{i + 1} AS MATERIALIZED (SELECT cluster, coalesce(m, c) AS c FROM c{i} LEFT JOIN m{i} USING (cluster))")
    parts.append(f"a AS MATERIALIZED ({nearest.format(rounds)})")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a JOIN c{rounds} USING (cluster)"""


#: DuckDB SQL for op13_centroid_clusters.
ORACLE_SQL = _oracle()
