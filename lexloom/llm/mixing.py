"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a word budget. Whole epochs of a source come first; what is left of its budget is filled by a weighted
sample without replacement: each document draws the exponential key -ln(u) / quality weight, documents are sorted by key
within their source and taken until the running sum of their sizes meets the rest of the budget. The last document is
taken in part, so a source meets its budget to the word.

u comes from a hash of doc_id and a seed, so reruns agree. A source may hold any share of the rows: sums run over
(source, key bucket) groups, and only one row per bucket meets in the window of a source.

Defined cases: null text has size 0 and is never taken; null source is a source of its own, after all others; rows with
one doc_id share a key and are ordered by size and text hash, rows that are equal in all may swap places; an empty table
gives an empty result.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Workspace, text_or_empty, word_count


def quality_weight(text: Column) -> Column:
    """Between 0.5 and 1: a half, and half the share of the text that is Latin letters."""
    letters = F.length(F.regexp_replace(text, "[^A-Za-zÀ-ɏ]+", ""))
    return F.lit(0.5) + F.lit(0.5) * letters / F.greatest(F.length(text), F.lit(1))


def sampling_key(doc_id: Column, weight: Column, seed: int) -> Column:
    """-ln(u) / weight, with u in (0, 1) from the first 52 bits of an MD5; smaller keys are taken first."""
    digits = F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}"))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("long") + 1) / F.lit(float(2**52 + 1))
    return -F.log(u) / weight


def source_targets(sizes: DataFrame, weights: tuple[int, ...], most_epochs: int) -> DataFrame:
    """source, source_size -> also target. One row per source: sources are few beside documents.

    Water-filling in closed form: by rising limit per weight, a source is full if its limit is within its share of what the
    full ones before it leave; all others share the rest by weight.
    """
    one = W.partitionBy(F.lit(0))
    ranked = sizes.withColumn("place", F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())))
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = ranked.select("source", "source_size", "place", F.element_at(cycle, ((F.col("place") - 1) % len(weights) + 1).cast("int")).cast("long").alias("weight"))
    by_limit = one.orderBy(F.col("source_size") * most_epochs / F.col("weight"), "place")
    limit = F.col("source_size") * most_epochs
    levels = ranked.select(
        "*",
        limit.alias("limit"),
        (F.sum("source_size").over(one) - (F.sum(limit).over(by_limit.rowsBetween(W.unboundedPreceding, W.currentRow)) - limit)).alias("left"),
        F.sum("weight").over(by_limit.rowsBetween(W.currentRow, W.unboundedFollowing)).alias("heavy"),
    ).withColumn("level", F.col("left") / F.col("heavy"))
    open_ = F.col("limit") > F.col("weight") * F.col("level")
    final = F.coalesce(F.max(F.when(open_, F.struct(-F.col("limit") / F.col("weight"), -F.col("place"), F.col("level")))).over(one).getField("level"), F.lit(0.0))
    return levels.select("source", "source_size", F.least(F.col("limit").cast("double"), F.col("weight") * final).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_epochs: int = 3, seed: int = 20, weight: Column | None = None, buckets: int = 4096) -> DataFrame:
    """doc_id, source, tie (a hash of the text), size, source_size, target, taken (words taken, repeats counted), for each row of docs.

    weights go to the sources in order of code points, repeating; targets share the size of all documents and stop at
    most_epochs times their source. weight: a document's quality weight, by default quality_weight of its text.
    """
    text = text_or_empty()
    ws = Workspace(docs.sparkSession, "mix")
    rows = docs.select("doc_id", "source", word_count(text).alias("size"), F.xxhash64(text).alias("tie"), (quality_weight(text) if weight is None else weight).alias("w"))
    rows = rows.withColumn("key", sampling_key(F.col("doc_id"), F.col("w"), seed))
    # keys are exponential with a rate of 0.5 to 1: this spreads them evenly over the buckets
    rows = ws.save(rows.withColumn("bucket", F.floor((1 - F.exp(-0.75 * F.col("key"))) * buckets)).drop("w"), "rows")
    per_bucket = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = per_bucket.withColumn("before", F.sum("bucket_size").over(W.partitionBy("source").orderBy("bucket")) - F.col("bucket_size"))
    targets = source_targets(before.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, most_epochs)
    plan = before.alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source")))
    plan = plan.select("b.source", "bucket", "before", "source_size", "target")
    inside = W.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", "tie").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = rows.withColumn("upto", F.sum("size").over(inside)).alias("r")
    joined = ranked.join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.bucket") == F.col("p.bucket")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.floor(F.col("target") - epochs * F.col("source_size"))
    partial = F.greatest(F.lit(0), F.least(F.col("size"), rest - (F.col("before") + F.col("upto") - F.col("size"))))
    return joined.select("doc_id", F.col("r.source").alias("source"), "tie", "size", "source_size", "target", (epochs * F.col("size") + partial).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs as mix() takes them: a row as often as its words are taken, the document that is cut by half or more counted as whole."""
    taken = mix(docs, **options).where("size > 0").groupBy("doc_id", "source", "tie").agg(F.floor(F.avg(F.col("taken") / F.col("size")) + 0.5).cast("int").alias("copies")).where("copies > 0")
    taken = taken.select(F.col("doc_id").alias("t_id"), F.col("source").alias("t_source"), F.col("tie").alias("t_tie"), "copies")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.xxhash64(text_or_empty()).alias("own_tie"))
    same = F.col("row.doc_id").eqNullSafe(F.col("t_id")) & F.col("row.source").eqNullSafe(F.col("t_source")) & (F.col("own_tie") == F.col("t_tie"))
    return rows.join(taken, same).select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


#: DuckDB SQL for op4_mixing_sources.
ORACLE_SQL = r"""
WITH r AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
k AS (
  SELECT doc_id, source, size, t,
    -ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':20'), 1, 13) AS BIGINT) + 1) / 4503599627370497.0::DOUBLE)
    / (0.5::DOUBLE + 0.5::DOUBLE * length(regexp_replace(t, '[^A-Za-zÀ-ɏ]+', '', 'g')) / greatest(length(t), 1)) AS key
  FROM r),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM r GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM s),
w AS (SELECT *, 1 + (place - 1) % 3 AS weight, 3 * source_size AS lim FROM p),
l AS (
  SELECT *, (sum(source_size) OVER () - (sum(lim) OVER (ORDER BY lim::DOUBLE / weight, place) - lim))::DOUBLE
    / sum(weight) OVER (ORDER BY lim::DOUBLE / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level
  FROM w),
f AS (
  SELECT coalesce((SELECT level FROM l WHERE lim > weight * level ORDER BY lim::DOUBLE / weight, place LIMIT 1), 0.0::DOUBLE) AS level),
t AS (SELECT source, source_size, least(lim::DOUBLE, weight * f.level) AS target FROM w, f),
e AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
c AS (
  SELECT k.*, e.source_size, e.target, e.epochs,
    sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, floor(target - epochs * source_size) - before)) AS BIGINT) AS taken
FROM c
"""
