"""Stages over documents: a registry in order of what they need, a drained ledger, token buckets, sinks that replace."""

from collections.abc import Callable, Iterator
from graphlib import TopologicalSorter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workspace import Workspace
from .ledger import claimable


class Stages:
    """Named functions DataFrame -> DataFrame with the names of those they need; each runs once, after them, on their tables."""

    def __init__(self):
        self.found: dict[str, tuple[Callable, tuple[str, ...]]] = {}

    def add(self, name: str, *needs: str):
        def keep(f: Callable) -> Callable:
            self.found[name] = (f, needs)
            return f

        return keep

    def order(self) -> list[str]:
        """Raises CycleError where stages need each other, KeyError where one is missing."""
        for f, needs in self.found.values():
            for n in needs:
                self.found[n]
        return list(TopologicalSorter({n: needs for n, (_, needs) in self.found.items()}).static_order())

    def run(self, ws: Workspace, **given: DataFrame) -> dict[str, DataFrame]:
        tables = dict(given)
        for name in self.order():
            if name not in tables:
                f, needs = self.found[name]
                tables[name] = ws.save(f(*(tables[n] for n in needs)), name)
        return tables


def drained(ledger: DataFrame, needs: DataFrame, now: str, fails: Column, most_passes: int = 20) -> DataFrame:
    """The ledger after passes over what is due, until nothing is: rows that `fails` holds for are failed once more, others done.

    ledger: document_id, feature, version, attempts, last_attempt, status. A failed row waits for its backoff, so it does not
    come up again at the same `now`. Each pass is a written table.
    """
    ws = Workspace(ledger.sparkSession, "drain")
    columns = ["document_id", "feature", "version", "attempts", "last_attempt", "status"]
    now_ = F.lit(now).cast("timestamp")
    table = ws.save(ledger.select(*columns), "pass-0")
    for k in range(1, most_passes + 1):
        due = ws.save(claimable(table, needs, now).select("document_id", "feature").distinct().withColumn("due", F.lit(True)), f"due-{k}")
        if not due.limit(1).count():
            return table
        hit = F.col("due").isNotNull()
        status = F.when(hit, F.when(fails, "failed").otherwise("done")).otherwise(F.col("status"))
        marked = table.join(due, ["document_id", "feature"], "left")
        table = ws.save(marked.select("document_id", "feature", "version", F.when(hit, F.col("attempts") + 1).otherwise(F.col("attempts")).alias("attempts"), F.when(hit, now_).otherwise(F.col("last_attempt")).alias("last_attempt"), status.alias("status")), f"pass-{k}")
    raise RuntimeError("drained: rows stay due")


def seeded(ledger: DataFrame, documents: DataFrame, stages: DataFrame) -> DataFrame:
    """ledger rows (document_id, feature, version, status) with a pending row for each document and stage (feature, version; few) that has none."""
    held = ledger.select("document_id", "feature", "version", "status")
    wanted = documents.select("document_id").distinct().join(F.broadcast(stages))  # a catalog of stages, a row each
    fresh = wanted.join(held.select("document_id", "feature"), ["document_id", "feature"], "left_anti")
    return held.unionByName(fresh.select("document_id", "feature", "version", F.lit("pending").alias("status")))


def rate_limited(calls: DataFrame, capacity: float, per_second: float) -> DataFrame:
    """call_id, key, allowed, retry_after for calls (call_id, key, at: seconds): a token bucket for each key, which begins full.

    Calls of a key are folded in order of time as they stream past, so a key may have any number of them.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, tokens, last = None, capacity, 0.0
        for batch in batches:
            allowed, retry = [], []
            for key, at in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if key != last_key:
                    last_key, tokens, last = key, capacity, at
                tokens, last = min(capacity, tokens + (at - last) * per_second), at
                allowed.append(tokens >= 1)
                tokens -= allowed[-1]
                retry.append(0 if allowed[-1] else int((1 - tokens) / per_second) + 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(allowed), pa.array(retry, pa.int32())], names=["call_id", "key", "allowed", "retry_after"])

    ordered = calls.select("call_id", F.col("key").cast("string").alias("key"), F.col("at").cast("double").alias("at")).repartition("key").sortWithinPartitions("key", "at", "call_id")
    return ordered.mapInArrow(fold, "call_id long, key string, allowed boolean, retry_after int")


def replace_partitions(rows: DataFrame, folder: str, by: list[str]) -> None:
    """Write rows under folder by partition columns; partitions that the rows name are replaced, others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(folder)


def mime_of(content: Column) -> Column:
    """The type of binary content by its first bytes, whatever its name says: fixed values of common formats, then markup, then text or not."""
    head = F.hex(F.substr(content, F.lit(1), F.lit(8)))
    text = F.decode(F.substr(content, F.lit(1), F.lit(400)), "ISO-8859-1")
    kinds = [("25504446", "application/pdf"), ("89504E470D0A1A0A", "image/png"), ("FFD8FF", "image/jpeg"), ("47494638", "image/gif"), ("504B0304", "application/zip"), ("1F8B", "application/gzip"), ("49492A00", "image/tiff"), ("4D4D002A", "image/tiff"), ("D0CF11E0", "application/x-ole-storage")]
    out = F.when(F.coalesce(F.length(content), F.lit(0)) == 0, "application/x-empty")
    for magic, kind in kinds:
        out = out.when(head.startswith(magic), kind)
    out = out.when(text.rlike(r"(?i)^\s*<(?:!doctype html|html)"), "text/html").when(text.rlike(r"^\s*<\?xml"), "text/xml").when(text.rlike(r"^\s*[{\[]\s*[\"\[{]"), "application/json")
    return out.when(text.rlike(r"[\x00-\x08\x0E-\x1A\x1C-\x1F]"), "application/octet-stream").otherwise("text/plain")


def verdict_of(mime: Column, size: Column, most_bytes: int) -> Column:
    """reject for empty and oversized content, quarantine for content of no known kind, else admit."""
    return F.when((mime == "application/x-empty") | (size > most_bytes), "reject").when(mime == "application/octet-stream", "quarantine").otherwise("admit")


def hmac_sha256(key: str, message: Column) -> Column:
    """HMAC-SHA256 in hexadecimal, by its definition: two hashes with the padded key."""
    import hashlib

    raw = key.encode()
    block = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ pad for b in block).hex())) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def projected(vectors: DataFrame, components: int = 2, clusters: int = 8, seed: int = 7) -> DataFrame:
    """chunk_id, point (array of `components` numbers), cluster: principal components of the vectors, and k-means clusters in that plane.

    Vectors that are null or of another length than most take no part; with fewer rows than components or clusters there are
    fewer clusters, and points are zero.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    sizes = vectors.where("embedding IS NOT NULL").groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()  # one row
    if not sizes or sizes[0]["n"] < 1:
        return vectors.limit(0).select("chunk_id", F.array().cast("array<double>").alias("point"), F.lit(0).alias("cluster"))
    n, rows = sizes[0]["n"], sizes[0]["count"]
    good = vectors.where(F.size("embedding") == n).select("chunk_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    if rows <= components:
        return good.select("chunk_id", F.array_repeat(F.lit(0.0), components).alias("point"), F.lit(0).alias("cluster"))
    plane = PCA(k=min(components, n), inputCol="v", outputCol="p").fit(good).transform(good)
    found = KMeans(k=min(clusters, rows), seed=seed, featuresCol="p", predictionCol="cluster").fit(plane).transform(plane)
    return found.select("chunk_id", vector_to_array("p").alias("point"), "cluster")
