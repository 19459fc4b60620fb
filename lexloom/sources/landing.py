"""A landing folder as a stream, and tables kept by micro-batch, so a batch that runs twice leaves its rows once."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def landing_stream(spark: SparkSession, folder: str, schema: StructType, kind: str = "parquet", files_at_once: int = 1000) -> DataFrame:
    """Files as they land in folder, oldest first."""
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_at_once).load(folder)


def write_batches(rows: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write what is there, a folder batch_id=N for each micro-batch; a batch that is run again replaces its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")

    return rows.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_rows(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """Of a table that write_batches keeps in update mode: each key's row of the newest batch."""
    rows = spark.read.parquet(folder)
    others = [c for c in rows.columns if c not in [*keys, "batch_id"]]
    found = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch_id").alias("row"))
    return found.select(*keys, "row.*")
