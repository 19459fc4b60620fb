"""The stability gate against a plain walk, in one run and in many, and over real files."""

import os

import pytest

from lexloom.streaming import stability

QUIET, FORGET = 10, 40


def walk(rows, quiet=QUIET, forget=FORGET):
    """What has settled, by one pass over the observations of each path."""
    held, out = {}, []
    for path, size, modified, seen in sorted(set(rows), key=lambda r: (r[3], r[2], r[1])):
        if path.rsplit("/", 1)[-1].startswith("."):
            continue
        last = held.get(path)
        if last is None or last["is"] != (size, modified) or seen - last["last"] > forget:
            held[path] = {"is": (size, modified), "since": seen, "last": seen, "done": False}
            continue
        last["last"] = seen
        if seen - last["since"] >= quiet and not last["done"]:
            last["done"] = True
            out.append((path, size, modified, last["since"], seen))
    return sorted(out)


LOOKS = [
    *[("/in/grows", 10 * i, i, 5 * i) for i in range(20)],
    *[("/in/settles", min(i, 3), min(i, 3), 5 * i) for i in range(20)],
    *[("/in/stalls", 1 if i < 2 else 2, 1 if i < 2 else 2, 5 * i) for i in range(10)],
    *[("/in/again", 1 if i < 8 else 2, 1, 5 * i) for i in range(20)],
    *[("/in/gone", 7, 7, 5 * i) for i in (0, 1, 2, 3, 15, 16, 17, 18)],
    *[("/in/.hidden", 1, 1, 5 * i) for i in range(20)],
    ("/in/once", 1, 1, 0), ("/in/settles", 3, 3, 50),
]
START = 1_000_000
LOOKS = [(path, size, modified, START + seen) for path, size, modified, seen in LOOKS]


def run(spark, base, quiet=QUIET, forget=FORGET, **more):
    stability.gate_run(spark, f"{base}/log", f"{base}/settled", f"{base}/checkpoint", quiet, forget, **more).awaitTermination()
    if not os.path.isdir(f"{base}/settled"):
        return []
    return sorted(tuple(r)[:5] for r in spark.read.schema(stability.SETTLED + ", batch_id long").parquet(f"{base}/settled").collect())


def land(spark, rows, base, mode="append"):
    spark.createDataFrame(rows, stability.OBSERVATION).coalesce(1).write.mode(mode).parquet(f"{base}/log")


def test_one_run(spark, tmp_path):
    rows = LOOKS + [(None, 1, 1, START), ("/in/none", None, 1, START)]
    land(spark, rows, tmp_path)
    want = walk(LOOKS)
    assert run(spark, tmp_path) == want
    assert [r[0] for r in want].count("/in/again") == 2 and [r[0] for r in want].count("/in/gone") == 2
    assert not {"/in/grows", "/in/once", "/in/.hidden"} & {r[0] for r in want}


def test_restarts_emit_once(spark, tmp_path):
    for low, high in ((0, 20), (20, 45), (45, 100)):
        land(spark, [r for r in LOOKS if low <= r[3] - START < high], tmp_path)
        found = run(spark, tmp_path)
        assert found == walk([r for r in LOOKS if r[3] - START < high])
    assert run(spark, tmp_path) == found  # nothing new: nothing is emitted twice


def test_growing_file_is_held_back(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    for name, now, text in (("a", 100, "x"), ("b", 100, "x"), ("a", 105, "xx"), (None, 112, ""), (None, 116, "")):
        if name:
            (inbox / name).write_text(text)
            os.utime(inbox / name, (now, now))
        if name != "a" or now > 100:
            stability.observed(spark, str(inbox), now).write.mode("append").parquet(f"{tmp_path}/log")
    got = run(spark, tmp_path)
    assert [(os.path.basename(r[0]), r[1], r[3], r[4]) for r in got] == [("a", 2, 105, 116), ("b", 1, 100, 112)]
    assert stability.pending(spark.read.schema(stability.OBSERVATION).parquet(f"{tmp_path}/log")).first() == (2, 3)


def test_empty_log(spark, tmp_path):
    none = spark.createDataFrame([], stability.OBSERVATION)
    assert stability.pending(none).first() == (0, 0)
    none.write.parquet(f"{tmp_path}/log")
    assert run(spark, tmp_path) == []


@pytest.mark.parametrize("state", ["spark.sql.streaming.stateStore.providerClass"])
def test_session_setting_stays(spark, state):
    assert spark.conf.get(state).endswith("HDFSBackedStateStoreProvider")
