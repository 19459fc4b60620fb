"""Jobs that stop between any two steps and run again; jobs that race; contents that repeat."""

import pytest

from lexloom.operators.activation import ROW, ActiveTable, activate

SCHEMA = "document_id long, content string"
FIRST = [(3, "a"), (1, "a"), (2, "b"), (4, None), (5, ""), (None, "x"), (6, "c"), (6, "c")]
SECOND = [(7, "a"), (8, "d"), (0, "b"), (2, "changed")]
WANT = {1: ("active", None), 3: ("duplicate", 1), 2: ("active", None), 4: ("active", None), 5: ("duplicate", 4), 6: ("active", None), 7: ("duplicate", 1), 8: ("active", None), 0: ("duplicate", 2)}


class Stop(Exception):
    pass


def table_of(spark, tmp_path):
    return ActiveTable(spark, f"file://{tmp_path}/table")


def found(table):
    rows = table.read().collect()
    assert len({r["document_id"] for r in rows}) == len(rows)
    return {r["document_id"]: (r["state"], r["duplicate_of"]) for r in rows}


def stopper(at):
    def after(step):
        if step == at:
            raise Stop

    return after


@pytest.mark.parametrize("at", ["staged", "decided", "committed"])
def test_stop_and_repeat(spark, tmp_path, at):
    table, first, second = table_of(spark, tmp_path), spark.createDataFrame(FIRST, SCHEMA), spark.createDataFrame(SECOND, SCHEMA)
    with pytest.raises(Stop):
        activate(table, "one", first, stopper(at))
    assert (at == "committed") == bool(found(table))
    assert activate(table, "one", first) == (0 if at == "committed" else 1)
    with pytest.raises(Stop):
        activate(table, "two", second, stopper(at))
    activate(table, "two", second)
    assert found(table) == WANT and table.version() == 2
    table.clean()
    assert found(table) == WANT


def test_staged_rows_are_used_again(spark, tmp_path):
    table = table_of(spark, tmp_path)
    with pytest.raises(Stop):
        activate(table, "one", spark.createDataFrame(FIRST, SCHEMA), stopper("staged"))
    activate(table, "one", spark.createDataFrame([], SCHEMA))
    assert set(found(table)) == {1, 2, 3, 4, 5, 6}


def test_lost_race(spark, tmp_path):
    table, done = table_of(spark, tmp_path), []

    def other(step):
        if step == "decided" and not done:
            done.append(activate(table, "one", spark.createDataFrame(FIRST, SCHEMA)))

    assert activate(table, "two", spark.createDataFrame(SECOND[:3], SCHEMA), other) == 2 and done == [1]
    assert found(table) == WANT


def test_stopped_commit(spark, tmp_path):
    """A claim without its marker: named, it is finished; empty, it is withdrawn."""
    table, first = table_of(spark, tmp_path), spark.createDataFrame(FIRST, SCHEMA)
    activate(table, "one", first)
    marker = next((tmp_path / "table" / "markers").glob("0*"))
    marker.unlink()
    assert table.version() == 0
    with pytest.raises(RuntimeError, match="repair"):
        activate(table, "two", spark.createDataFrame(SECOND, SCHEMA))
    table.repair()
    assert table.version() == 1
    (tmp_path / "table" / "claims" / "000000002").write_text("")
    with pytest.raises(RuntimeError, match="repair"):
        activate(table, "two", spark.createDataFrame(SECOND, SCHEMA))
    table.repair()
    assert activate(table, "two", spark.createDataFrame(SECOND, SCHEMA)) == 2
    assert found(table) == WANT


def test_nothing_to_take(spark, tmp_path):
    table = table_of(spark, tmp_path)
    assert activate(table, "none", spark.createDataFrame([], SCHEMA)) == 0
    assert table.version() == 0 and table.read().columns == [c.split()[0] for c in ROW.split(", ")]
