"""Streams over landed files against the same operators on the whole table."""

import os

import pytest
from pyspark.sql import functions as F

from lexloom.sources.landing import landing_stream, latest_rows, write_batches
from lexloom.streaming.activity import first_views, session_counts, windowed_counts

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet(f"{SF}/events.parquet")


@pytest.fixture
def stream(spark, events, tmp_path):
    """The events as a stream of three files, in order of time."""
    rows = events.toPandas().sort_values(["ts", "event_id"])
    (tmp_path / "in").mkdir()
    for i in range(3):
        part = rows.iloc[i * len(rows) // 3 : (i + 1) * len(rows) // 3]
        spark.createDataFrame(part, events.schema).coalesce(1).write.parquet(str(tmp_path / f"part{i}"))
        source = next((tmp_path / f"part{i}").glob("*.parquet"))
        target = tmp_path / "in" / f"{i}.parquet"
        source.rename(target)
        os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))
    return landing_stream(spark, str(tmp_path / "in"), events.schema, files_at_once=1)


def rows_of(frame):
    return sorted(map(str, frame.select(sorted(frame.columns)).collect()))


@pytest.mark.parametrize("slide", [None, "15 minutes"])
def test_windows(spark, events, stream, tmp_path, slide):
    write_batches(windowed_counts(stream, slide=slide), str(tmp_path / "out"), str(tmp_path / "state"), "update").awaitTermination(120)
    assert rows_of(latest_rows(spark, str(tmp_path / "out"), ["start", "event_type"])) == rows_of(windowed_counts(events, slide=slide))


def test_sessions(spark, events, stream, tmp_path):
    write_batches(session_counts(stream), str(tmp_path / "out"), str(tmp_path / "state"), "complete").awaitTermination(120)
    found = spark.read.parquet(str(tmp_path / "out"))
    last = found.agg(F.max("batch_id")).first()[0]
    assert rows_of(found.where(F.col("batch_id") == last).drop("batch_id")) == rows_of(session_counts(events))


def test_first_views(spark, events, stream, tmp_path):
    write_batches(first_views(stream), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    found = spark.read.parquet(str(tmp_path / "out"))
    buckets = events.where("event_type = 'view'").select("user_id", F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 5).alias("bucket")).distinct()
    assert rows_of(found.select("user_id", "bucket")) == rows_of(buckets)
