import pytest

from pulsecart.operators import keyed
from pulsecart.sinks.keyed_table import KeyedTable
from pulsecart.workspace import run_folder, shared_folder

SCHEMA = "id string, name string, seq int"
DAILY = "dt string, id string, name string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# One id is sent twice in a batch; the later action survives.
ACTIONS = [("7", "old", 1), ("2", "plain", 2), ("7", "new", 3)]


def test_last_action_of_an_id_wins(spark):
    df = spark.createDataFrame(ACTIONS, SCHEMA).repartition(3)
    assert [r[:2] for r in rows(keyed.last_by(df, ["id"], ["seq"]))] == [("2", "plain"), ("7", "new")]


def test_generated_ids_never_replace_each_other(spark):
    df = spark.createDataFrame([(None, "a", 1), (None, "b", 2), ("1", "c", 3)], SCHEMA)
    out = keyed.last_by(keyed.with_generated_ids(df, "id"), ["id"], ["seq"])
    assert sorted(r["name"] for r in out.collect()) == ["a", "b", "c"]
    assert all(r["id"] for r in out.collect())


def test_upsert(spark):
    base = spark.createDataFrame([("1", "a", 1), ("2", "b", 1)], SCHEMA)
    changes = spark.createDataFrame([("2", "B", 2), ("3", "c", 2)], SCHEMA)
    assert rows(keyed.upsert(base, changes, ["id"])) == [("1", "a", 1), ("2", "B", 2), ("3", "c", 2)]


@pytest.fixture
def table(spark):
    return KeyedTable(spark, run_folder(spark, "t"), SCHEMA, ["id"])


def write(table, batch, *data, writer="w", order=("seq",)):
    return table.write(table.spark.createDataFrame(list(data), SCHEMA), writer, batch, order)


def test_table_starts_empty(table):
    assert rows(table.read()) == [] and table.parts() == []


def test_table_last_write_wins(table):
    write(table, 0, *ACTIONS)
    write(table, 1, ("2", "newer", 0), ("9", "x", 0))
    assert rows(table.read(columns=["id", "name"])) == [("2", "newer"), ("7", "new"), ("9", "x")]


def test_replayed_batch_is_skipped(table):
    assert write(table, 0, ("1", "a", 1))
    assert write(table, 1, ("1", "b", 1))
    assert not write(table, 0, ("1", "a", 1))
    assert rows(table.read()) == [("1", "b", 1)]
    assert write(table, 0, ("1", "c", 1), writer="other")
    assert rows(table.read()) == [("1", "c", 1)]


def test_empty_batch(table):
    write(table, 0, ("1", "a", 1))
    table.write(table.spark.createDataFrame([], SCHEMA), "w", 1)
    assert rows(table.read()) == [("1", "a", 1)]


def test_unpublished_rows_are_not_seen(table):
    write(table, 0, ("1", "a", 1))
    half = table.spark.createDataFrame([("1", "half", 9), ("2", "half", 9)], SCHEMA)
    half.write.mode("append").parquet(f"{table.path}/rows/_write=99999999999999999999-dead00/_part=all")
    assert rows(table.read()) == [("1", "a", 1)]


def test_fold_changes_nothing_but_the_layout(table):
    for batch in range(3):
        write(table, batch, ("1", f"v{batch}", batch), (f"k{batch}", "x", batch))
    before = rows(table.read())
    table.fold()
    assert rows(table.read()) == before
    assert [len(t) for t in table._layout().values()] == [1]
    assert "Aggregate" not in table.read()._jdf.queryExecution().toString()
    write(table, 3, ("1", "v3", 3))
    assert ("1", "v3", 3) in rows(table.read())


def test_daily_table(spark):
    table = KeyedTable(spark, run_folder(spark, "daily"), DAILY, ["id"], day_column="dt")
    put = lambda batch, *data: table.write(spark.createDataFrame(list(data), DAILY), "w", batch)
    put(0, ("2024-01-14", "1", "a"), ("2024-01-15", "1", "b"))
    put(1, ("2024-01-15", "1", "c"), ("2024-01-15", "2", "d"))
    put(2, ("2024-01-16", "1", "e"))
    assert table.parts() == ["2024-01-14", "2024-01-15", "2024-01-16"]
    assert rows(table.read(["2024-01-15"])) == [("2024-01-15", "1", "c"), ("2024-01-15", "2", "d")]
    everything = rows(table.read())
    assert len(everything) == 4
    table.fold("2024-01-15")
    assert rows(table.read()) == everything
    assert {p: len(t) for p, t in table._layout().items()} == dict.fromkeys(table.parts(), 1)
    assert sorted(tuple(r) for r in table.written_keys(["2024-01-14"]).collect()) == [("1", "2024-01-14")]


def test_monthly_parts_still_key_and_read_by_day(spark):
    table = KeyedTable(spark, run_folder(spark, "monthly"), DAILY, ["id"], day_column="dt", part_length=7)
    put = lambda batch, *data: table.write(spark.createDataFrame(list(data), DAILY), "w", batch)
    put(0, ("2024-01-14", "1", "a"), ("2024-01-15", "1", "b"), ("2024-02-01", "1", "x"))
    put(1, ("2024-01-15", "1", "c"))
    assert table.parts() == ["2024-01", "2024-02"]
    assert rows(table.read(["2024-01-15"])) == [("2024-01-15", "1", "c")]
    everything = rows(table.read())
    table.fold("2024-01")
    assert rows(table.read()) == everything == [
        ("2024-01-14", "1", "a"), ("2024-01-15", "1", "c"), ("2024-02-01", "1", "x"),
    ]


def test_single_document_upsert(table):
    write(table, 0, ("1001", "first", 0))
    write(table, 1, ("1001", "second", 0))
    assert rows(table.read()) == [("1001", "second", 0)]


def test_shared_folder_is_the_cluster_setting(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_null_keys_are_kept_and_named_alike_on_replay(table):
    write(table, 0, (None, "a", 1), (None, "a", 1), (None, "b", 2), ("1", "c", 3))
    assert sorted(r["name"] for r in table.read().collect()) == ["a", "a", "b", "c"]
    df = table.spark.createDataFrame([(None, "a", 1), (None, "a", 1), (None, "b", 2)], SCHEMA)
    once, again = (rows(keyed.with_generated_ids(df.repartition(n), "id", "w", "0")) for n in (1, 3))
    assert once == again and len({r[0] for r in once}) == 3
