"""The ingest loop, waiting files, stages, tools, windows, drained ledgers, projections."""

import os
import time
from graphlib import CycleError

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.operators import stages, windows
from lexloom.plans.states import gateway
from lexloom.sources.landing import landing_stream  # noqa: F401
from lexloom.streaming import ingest
from lexloom.workspace import Workspace


def test_ingest_in_two_runs(spark, tmp_path):
    inbox, registry, checkpoint = (str(tmp_path / x) for x in ("inbox", "registry", "checkpoint"))
    os.makedirs(inbox)

    def put(name, data):
        (tmp_path / "inbox" / name).write_bytes(data)

    put("a.txt", b"hello there")
    put("b.pdf", b"hello there")
    put("c.txt", b"%PDF-1.7 x")
    put("empty", b"")
    put("odd", b"\x00\x01\x02\x03")
    ingest.ingest(spark, inbox, registry, checkpoint, 100).awaitTermination()
    put("d.txt", b"hello there")
    put("big", b"x" * 101)
    ingest.ingest(spark, inbox, registry, checkpoint, 100).awaitTermination()
    got = {os.path.basename(r["path"]): r for r in spark.read.schema(ingest.JOB).parquet(registry).collect()}
    assert {n: (r["state"], r["mime"]) for n, r in got.items()} == {"a.txt": ("active", "text/plain"), "b.pdf": ("duplicate", "text/plain"), "c.txt": ("active", "application/pdf"), "odd": ("quarantined", "application/octet-stream"), "d.txt": ("duplicate", "text/plain"), "big": ("failed", "text/plain")}
    assert {os.path.basename(got[n]["duplicate_of"]) for n in ("b.pdf", "d.txt")} == {"a.txt"} and got["d.txt"]["batch_id"] == 1


def test_waiting_files(spark, tmp_path):
    for name, age in (("old", 100), ("new", 0)):
        (tmp_path / name).write_text("x")
        os.utime(tmp_path / name, (time.time() - age,) * 2)
    assert [os.path.basename(r["path"]) for r in ingest.waiting_files(spark, str(tmp_path), 60).collect()] == ["old"]


def test_stage_order(spark):
    registry = stages.Stages()
    for name, needs in (("c", ("b", "a")), ("b", ("a",)), ("a", ())):
        registry.add(name, *needs)(lambda *x: None)
    assert registry.order() == ["a", "b", "c"]
    registry.add("a", "c")(lambda *x: None)
    with pytest.raises(CycleError):
        registry.order()


def test_tools(spark):
    tools = gateway()
    assert not tools.call("nothing", spark, "").ok
    assert "merchant" in tools.call("aggregate_transactions", spark, "", merchant=3).error
    assert "extra" in tools.call("list_categories", spark, "", extra=1).error
    assert tools.call("list_categories", spark, "/root/testdata/sf0.001").rows.count() == 5


def test_windows(spark):
    docs = spark.createDataFrame([(1, "aa\nbb\ncc\ndd\n"), (2, "x" * 50), (3, ""), (4, None), (5, "one two three four")], "id int, text string")
    got = {}
    for r in windows.line_windows(docs, 6, 1).orderBy("id", "ordinal").collect():
        got.setdefault(r["id"], []).append(r["text"])
    assert got == {1: ["aa\nbb\n", "bb\ncc\n", "cc\ndd\n"], 2: ["x" * 50], 5: ["one two three four"]}
    parts = [r["text"] for r in windows.break_windows(docs.where("id = 5"), 10).orderBy("ordinal").collect()]
    assert parts == ["one two", " three", " four"] or "".join(parts) == "one two three four"


def test_stitching_keeps_genuine_repeats(spark):
    rows = [(1, 0, i, k) for i, k in enumerate("abab")] + [(1, 1, i, k) for i, k in enumerate("abc")] + [(1, 2, i, k) for i, k in enumerate("xx")] + [(2, 0, 0, "a"), (2, 1, 0, "b")]
    got = windows.stitched(spark.createDataFrame(rows, "document_id int, window int, position int, k string"), ["k"])
    seen = {}
    for r in got.orderBy("document_id", "window", "position").collect():
        seen[r["document_id"]] = seen.get(r["document_id"], "") + r["k"]
    assert seen == {1: "ababcxx", 2: "ab"}


def test_projection(spark):
    random = np.random.default_rng(1)
    rows = [(i, [float(x) for x in random.normal(size=6) * [9, 4, 1, 1, 1, 1]]) for i in range(300)] + [(300, None), (301, [1.0])]
    got = {r["chunk_id"]: np.array(r["point"]) for r in stages.projected(spark.createDataFrame(rows, "chunk_id int, embedding array<double>")).collect()}
    data = np.array([v for _, v in rows[:300]])
    _, _, axes = np.linalg.svd(data - data.mean(0), full_matrices=False)
    for k in range(2):
        want, have = data @ axes[k], np.array([got[i][k] for i in range(300)])
        assert len(got) == 300 and abs(abs(np.corrcoef(want, have)[0, 1]) - 1) < 1e-6
    assert stages.projected(spark.createDataFrame(rows[:2], "chunk_id int, embedding array<double>")).count() == 2
    assert stages.projected(spark.createDataFrame([], "chunk_id int, embedding array<double>")).count() == 0


def test_seeded(spark):
    ledger = spark.createDataFrame([(1, "a", 1, "done")], "document_id long, feature string, version int, status string")
    docs = spark.createDataFrame([(1,), (2,), (2,)], "document_id long")
    got = sorted(tuple(r) for r in stages.seeded(ledger, docs, spark.createDataFrame([("a", 3), ("b", 1)], "feature string, version int")).collect())
    assert got == [(1, "a", 1, "done"), (1, "b", 1, "pending"), (2, "a", 3, "pending"), (2, "b", 1, "pending")]


def test_replace_partitions(spark, tmp_path):
    folder = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    stages.replace_partitions(rows, folder, ["k"])
    stages.replace_partitions(rows.where("k = 1 AND v = 'b'"), folder, ["k"])
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(folder).collect()) == [(1, "b"), (2, "c")]


def test_workspace_needs_a_named_folder_on_a_cluster(spark):
    assert Workspace(spark, "x").root.startswith(spark.conf.get("spark.checkpoint.dir"))
    assert spark.range(3).where(F.col("id") > 1).count() == 1
