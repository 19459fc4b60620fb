"""The ingest loop: files that have been quiet for a while, admitted by content, each content once.

Every micro-batch writes a folder of its own under the registry, so a batch that runs twice leaves its rows once, and the
registry is what earlier batches wrote. Spark's file sources pass over files without content, so those are no jobs.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.stages import mime_of, verdict_of

JOB = "path string, sha256 string, size long, mime string, state string, duplicate_of string, batch_id long"


def waiting_files(spark: SparkSession, folder: str, quiet_seconds: int, now=None) -> DataFrame:
    """path, size, modified of the files that nobody has written to for quiet_seconds; others may still grow."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return files.where(F.col("modified") <= (F.current_timestamp() if now is None else F.lit(now).cast("timestamp")) - F.make_interval(secs=F.lit(quiet_seconds)))


def jobs_of(files: DataFrame, known: DataFrame, most_bytes: int) -> DataFrame:
    """path, sha256, size, mime, state, duplicate_of of files (path, content): rejected, quarantined, duplicate of a known or an earlier file, or active.

    known: sha256, path of what is active.
    """
    rows = files.select("path", F.sha2("content", 256).alias("sha256"), F.coalesce(F.length("content"), F.lit(0)).cast("long").alias("size"), mime_of(F.col("content")).alias("mime"))
    rows = rows.withColumn("verdict", verdict_of(F.col("mime"), F.col("size"), most_bytes))
    first = rows.where("verdict = 'admit'").groupBy("sha256").agg(F.min("path").alias("first"))
    held = first.join(known.groupBy("sha256").agg(F.min("path").alias("held")), "sha256", "left").select("sha256", F.coalesce("held", "first").alias("owner"))
    found = rows.join(held, "sha256", "left")
    copy = F.col("owner") != F.col("path")
    state = F.when(F.col("verdict") == "reject", "failed").when(F.col("verdict") == "quarantine", "quarantined").when(copy, "duplicate").otherwise("active")
    return found.select("path", "sha256", "size", "mime", state.alias("state"), F.when((F.col("verdict") == "admit") & copy, F.col("owner")).alias("duplicate_of"))


def ingest(spark: SparkSession, folder: str, registry: str, checkpoint: str, most_bytes: int = 50 << 20) -> StreamingQuery:
    """Take in the files of folder that no earlier run has seen; registry gets a row for each (see jobs_of)."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(folder)

    def take(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        path = session._jvm.org.apache.hadoop.fs.Path(registry)
        seen = path.getFileSystem(session._jsc.hadoopConfiguration()).exists(path)
        known = session.read.schema(JOB).parquet(registry).where((F.col("state") == "active") & (F.col("batch_id") < batch_id)).select("sha256", "path") if seen else session.createDataFrame([], "sha256 string, path string")
        jobs_of(batch, known, most_bytes).write.mode("overwrite").parquet(f"{registry}/batch_id={batch_id}")

    return files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
