"""Exact top-k by inner product with Fagin's threshold algorithm.

Vectors are quantised to integers. Candidates are dealt into blocks; a block sorts one list per dimension. A query walks
its lists in step, each from the end that its component's sign prefers, scores every vector it meets by random access,
and stops once the sum of the list values at its depth cannot beat its kth score (or tie with it: ties go to the smaller
id). Queries come in blocks too, and every block of queries meets every block of candidates as one task-sized row, so
no task, and not the driver, holds all of either side. The best k of each block are merged per query.

Defined cases: vectors that are null, empty or hold a null or non-finite component take no part, nor do null ids;
vectors meet only vectors of their own dimension; rows that share an id are all candidates, except for a query with that
id; an empty table gives an empty result.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .words import runs


def quantised(vectors: DataFrame, id_column: str, vector_column: str, scale: float) -> DataFrame:
    """id, v (array of long: floor(scale * component)), dim."""
    v = F.col(vector_column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    good = vectors.where(F.col(id_column).isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(finite)
    return good.select(F.col(id_column).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("v"), F.size(v).alias("dim"))


def threshold_search(matrix: np.ndarray, ids: np.ndarray, rising: np.ndarray, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
    """The k best (score, id) of one block: ids ascend, rising[d] lists the rows by component d."""
    n, used = len(ids), np.flatnonzero(query)
    met, scores, rows = np.zeros(n, bool), np.empty(0, np.int64), np.empty(0, np.int64)
    met[ids == own] = True
    depth, step = 0, 64
    up = query[used] > 0
    while depth < n:
        upto = min(n, depth + step)
        lists = [rising[d, n - upto : n - depth] if u else rising[d, depth:upto] for d, u in zip(used, up, strict=True)]
        fresh = np.zeros(n, bool)
        if lists:
            fresh[np.concatenate(lists)] = True
        else:  # an all-zero query ties with everything
            fresh[depth:upto] = True
        fresh = np.flatnonzero(fresh & ~met)
        met[fresh] = True
        scores = np.concatenate([scores, matrix[fresh] @ query])
        rows = np.concatenate([rows, fresh])
        if len(rows) > k:
            best = np.lexsort((rows, -scores))[:k] if len(rows) < 4 * k else _best(scores, rows, k)
            scores, rows = scores[best], rows[best]
        depth, step = upto, step * 4
        if len(rows) == k and depth < n:
            at = np.where(up, rising[used, n - depth], rising[used, depth - 1])
            if scores.min() > int(matrix[at, used] @ query[used]):
                break
    order = np.lexsort((rows, -scores))
    return [(int(scores[i]), int(ids[rows[i]])) for i in order]


def _best(scores: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: those above the kth score and, of those that tie with it, the first rows."""
    kth = np.partition(scores, len(scores) - k)[len(scores) - k]
    near = np.flatnonzero(scores >= kth)
    return near[np.lexsort((rows[near], -scores[near]))[:k]]


def packed(rows: DataFrame, count, per: int, name: str) -> DataFrame:
    """dim, <name>, ids, cells, cell: rows (id, v, dim) in blocks of about `per`, dealt by a hash of their ids; cells in the narrowest whole numbers, of type cell."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["dim", name]):
            table = table.combine_chunks()
            cells = table.column("v").chunk(0).flatten().to_numpy()
            kind = next(t for t in ("<i2", "<i4", "<i8") if t == "<i8" or np.abs(cells.astype(np.float64)).max() < np.iinfo(t).max)
            row = [[table.column("dim")[0]], [table.column(name)[0]], [table.column("id").to_numpy().astype("<i8").tobytes()], [cells.astype(kind).tobytes()], [kind]]
            types = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([x.as_py() if isinstance(x, pa.Scalar) else x for x in c], t) for c, t in zip(row, types, strict=True)], names=["dim", name, "ids", "cells", "cell"])

    dealt = rows.withColumn(name, F.pmod(F.xxhash64("id"), F.ceil(count / per))).select("dim", name, "id", "v")
    return dealt.repartition("dim", name).sortWithinPartitions("dim", name, "id").mapInArrow(pack, f"dim int, {name} long, ids binary, cells binary, cell string")


def exact_top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, id_column: str = "vec_id", vector_column: str = "embedding", block: int = 8192, query_block: int = 512, group: int = 64) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose id is divisible by `every`, its k best other rows.

    block, query_block: about how many vectors a row of packed candidates or queries holds; group: query blocks a task takes for one block of candidates.
    """
    base = quantised(vectors, id_column, vector_column, scale)
    n = base.groupBy("dim").agg(F.count("*").alias("n"), F.count_if(F.col("id") % every == 0).alias("asked"))  # one row per dimension
    sized = base.join(n, "dim")
    parts = n.agg(F.coalesce(F.sum(F.ceil(F.col("n") / block) * F.ceil(F.col("asked") / (query_block * group))), F.lit(1))).first()[0]
    parts = int(min(max(parts, 1) * 2, 20_000))  # each with a candidate block and a group of query blocks or two; fewer rows than that need no more
    groups = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("asked") / (query_block * group)) - 1)
    candidates = packed(sized, F.col("n"), block, "cb").join(n, "dim").where("asked > 0")
    candidates = candidates.select("dim", "cb", F.explode(groups).alias("qg"), F.col("ids").alias("c_ids"), F.col("cells").alias("c_cells"), F.col("cell").alias("c_cell"))
    queries = packed(sized.where(F.col("id") % every == 0), F.col("asked"), query_block, "qb").join(n, "dim")
    every_block = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / block) - 1)
    queries = queries.select("dim", F.floor(F.col("qb") / group).alias("qg"), F.col("ids").alias("q_ids"), F.col("cells").alias("q_cells"), F.col("cell").alias("q_cell"), F.explode(every_block).alias("cb"))
    keys = ["dim", "cb", "qg"]
    pairs = queries.repartition(parts, *keys).join(candidates.repartition(parts, *keys).hint("merge"), keys)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids, matrix, rising = None, None, None, None
        for batch in batches:
            for x in range(batch.num_rows):
                dim, cb, _, q_ids, q_cells, q_cell, c_ids, c_cells, c_cell = (batch.column(i)[x].as_py() for i in range(9))
                if last != (dim, cb):
                    last, ids = (dim, cb), np.frombuffer(c_ids, np.int64)
                    whole = np.frombuffer(c_cells, c_cell).reshape(-1, dim).astype(np.int64)
                    rising, largest = np.argsort(whole, axis=0, kind="stable").T.copy(), float(np.abs(whole).max())
                    floats = whole.astype(np.float64)
                asked = np.frombuffer(q_cells, q_cell).reshape(-1, dim).astype(np.int64)
                exact = dim * largest * float(np.abs(asked).max()) < 2**52  # then doubles hold every sum, and numpy multiplies them faster
                matrix, asked = (floats, asked.astype(np.float64)) if exact else (whole, asked)
                found = [(int(q), score, vec) for q, v in zip(np.frombuffer(q_ids, np.int64), asked, strict=True) for score, vec in threshold_search(matrix, ids, rising, v, int(q), k)]
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], names=["query_id", "score", "vec_id"])

    found = pairs.select(*keys, "q_ids", "q_cells", "q_cell", "c_ids", "c_cells", "c_cell").mapInArrow(search, "query_id long, score long, vec_id long")
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: DuckDB SQL for op8_exact_top_k.
ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
q AS (SELECT vec_id AS query_id, v AS qv FROM v WHERE vec_id % 50 = 0),
s AS (
  SELECT query_id, vec_id, CAST(list_sum(list_transform(list_zip(qv, v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM q JOIN v ON q.query_id <> v.vec_id AND len(qv) = len(v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
