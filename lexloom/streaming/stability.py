"""Files that have settled: a file is taken once its size and time of change have stayed the same for a while.

Each look at the landing folder is a row a file (observations), landed as a table that is read as a stream; the gate keeps
one small state a path. What it emits depends on the observations alone, not on how they fall into micro-batches, so a run
that is stopped and started again on its checkpoint emits each settled file once.

Defined cases: hidden files (a leading dot) are passed over; a file that changes after it was emitted is a new one and has to
settle again; so is a file that was not seen for forget_seconds; a file that is seen once, or grows until the last look, is
not emitted; repeated observations count once; rows without path, size or time are passed over.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

OBSERVATION = "path string, size long, modified long, seen long"
SETTLED = "path string, size long, modified long, since long, settled_at long"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def observed(spark: SparkSession, folder: str, seen: int) -> DataFrame:
    """One look at a folder and all below it: OBSERVATION rows of its files, times in seconds; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("modified"), F.lit(seen).cast("long").alias("seen"))


def visible(rows: DataFrame) -> DataFrame:
    """Observations of files that are not hidden."""
    return rows.where(~F.element_at(F.split("path", "/"), -1).startswith(".")).na.drop(subset=["path", "size", "modified", "seen"])


class Gate(StatefulProcessor):
    """Holds each path's last size and time of change, since when they stand and whether they were emitted; a timer forgets paths that are gone."""

    def __init__(self, quiet_seconds: int, forget_seconds: int):
        self.quiet, self.forget = quiet_seconds, forget_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.file = handle.getValueState("file", "size long, modified long, since long, last long, emitted boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.file.get() if self.file.exists() else None
        armed = held is not None
        seen = pd.concat([r[["seen", "size", "modified"]] for r in rows]).drop_duplicates().sort_values(["seen", "modified", "size"])
        out = []
        for now, size, modified in seen.itertuples(index=False):
            now, size, modified = int(now), int(size), int(modified)
            if held is None or (held[0], held[1]) != (size, modified) or now - held[3] > self.forget:
                held = (size, modified, now, now, False)
                continue
            settled = now - held[2] >= self.quiet
            if settled and not held[4]:
                out.append((key[0], size, modified, held[2], now))
            held = (size, modified, held[2], now, held[4] or settled)
        self.file.update(held)
        if not armed:
            self.handle.registerTimer((held[3] + self.forget) * 1000)
        if out:
            yield pd.DataFrame(out, columns=["path", "size", "modified", "since", "settled_at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = (self.file.get()[3] + self.forget) * 1000 if self.file.exists() else 0
        if due > expiredTimerInfo.getExpiryTimeInMs():  # seen since: one timer a path stays armed
            self.handle.registerTimer(due)
        else:
            self.file.clear()
        return iter([])

    def close(self) -> None:
        pass


def settled_files(observations: DataFrame, quiet_seconds: int, forget_seconds: int = 3600) -> DataFrame:
    """SETTLED rows of a stream of observations; late ones are waited for as long as a path is remembered."""
    timed = visible(observations).withColumn("seen_at", F.timestamp_seconds("seen")).withWatermark("seen_at", f"{forget_seconds} seconds")
    return timed.groupBy("path").transformWithStateInPandas(Gate(quiet_seconds, forget_seconds), outputStructType=SETTLED, outputMode="Append", timeMode="EventTime")


def gate_run(spark: SparkSession, log: str, settled: str, checkpoint: str, quiet_seconds: int, forget_seconds: int = 3600, files_at_once: int | None = None) -> StreamingQuery:
    """Read what is new in the log of observations; settled gets a folder batch_id=N for each micro-batch, so one that is run again leaves its rows once."""
    source = spark.readStream.schema(OBSERVATION)
    source = source.option("maxFilesPerTrigger", files_at_once) if files_at_once else source

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{settled}/batch_id={batch_id}")

    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKS)  # the stream keeps its own copy of the settings once it has started
    try:
        found = settled_files(source.parquet(log), quiet_seconds, forget_seconds)
        return found.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(STATE_STORE, before) if before else spark.conf.unset(STATE_STORE)


def pending(observations: DataFrame) -> DataFrame:
    """files, bytes: the visible files of the last look, whether they have settled or not (0 and 0 if there was none)."""
    rows = visible(observations)
    last = rows.agg(F.max("seen").alias("_last"))
    now = rows.join(F.broadcast(last), F.col("seen") == F.col("_last")).groupBy("path").agg(F.max_by("size", F.struct("modified", "size")).alias("size"))  # one row is broadcast
    return now.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"))
