"""Tables as snapshots: a stop at any step leaves the old rows or the new ones, never a mixture."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from usagelens.contract import PARTITION_COLUMN, REQUEST_SCHEMA
from usagelens.sources import keys as K
from usagelens.sources import snapshots as S
from usagelens.sources import tables

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("source_path", T.StringType()), T.StructField("day", T.StringType())])
OLD = [(1, "a", "d1"), (2, "a", "d2"), (3, "b", "d1"), (4, "c", "d2"), (5, "c", "d 3"), (6, "e", None)]
NEW = [(7, "a", "d2"), (8, "f", "d4")]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def paths(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "source_path string")


def read(spark, folder, version=None):
    return sorted((tuple(r) for r in S.read_snapshot(spark, folder, SCHEMA, "day", version).collect()), key=repr)


@pytest.fixture
def folder(spark, tmp_path):
    place = str(tmp_path / "a table")
    S.rewrite(spark, place, SCHEMA, "day", fresh=frame(spark, OLD))
    return place


def change(spark, folder):
    """Source a is read again, source e is gone."""
    return S.rewrite(spark, folder, SCHEMA, "day", frame(spark, NEW), paths(spark, "a", "e"))


EXPECTED = sorted([OLD[2], OLD[3], OLD[4], *NEW], key=repr)


def test_replace_in_one_commit(spark, folder):
    before = S.current(spark, folder).folders
    assert change(spark, folder) == 3
    assert read(spark, folder) == EXPECTED
    assert read(spark, folder, 1) == sorted(OLD, key=repr)
    # Partitions without a deleted row are not written again.
    assert [f for f in before if f.startswith("day=d 3")] == [f for f in S.current(spark, folder).folders if f.startswith("day=d 3")]


class Stop(Exception):
    pass


@pytest.mark.parametrize("step", ["write_commit", "publish", "_rename_new", "after"])
def test_a_stop_leaves_the_old_table_or_the_new_one(spark, folder, monkeypatch, step):
    real = getattr(S, step, None)

    def stops(*args):
        if step == "write_commit":
            real(*args)  # the rows are written, then the writer dies
        raise Stop

    if step == "after":
        change(spark, folder)
        monkeypatch.setattr(S, "_entry", lambda *a: (_ for _ in ()).throw(Stop()))
        with pytest.raises(Stop):
            S.vacuum(spark, folder, 1)
        monkeypatch.undo()
        assert read(spark, folder) == EXPECTED
        return
    monkeypatch.setattr(S, step, stops)
    with pytest.raises(Stop):
        change(spark, folder)
    monkeypatch.undo()
    assert read(spark, folder) == sorted(OLD, key=repr)
    assert change(spark, folder) == 3 and read(spark, folder) == EXPECTED
    S.vacuum(spark, folder, 1)
    assert read(spark, folder) == EXPECTED


def test_a_task_that_fails_leaves_the_old_table(spark, folder):
    bad = frame(spark, NEW).withColumn("id", F.when(F.col("id") == 8, F.raise_error(F.lit("broken")).cast("bigint")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="broken"):
        S.rewrite(spark, folder, SCHEMA, "day", bad, paths(spark, "a", "e"))
    assert read(spark, folder) == sorted(OLD, key=repr)


def test_of_two_writers_one_wins(spark, folder):
    base = S.current(spark, folder)
    S.rewrite(spark, folder, SCHEMA, "day", frame(spark, NEW[:1]), base=base)
    with pytest.raises(S.ConcurrentCommit):
        S.rewrite(spark, folder, SCHEMA, "day", frame(spark, NEW[1:]), base=base)
    assert read(spark, folder) == sorted([*OLD, NEW[0]], key=repr)


def test_vacuum_and_compact(spark, folder):
    change(spark, folder)
    S.rewrite(spark, folder, SCHEMA, "day", frame(spark, [(9, "g", "d1")]))
    S.rewrite(spark, folder, SCHEMA, "day", frame(spark, [(10, "h", "d1")]))
    now = read(spark, folder)
    assert S.compact(spark, folder, SCHEMA, "day", 3) == 3 and read(spark, folder) == now
    assert S.compact(spark, folder, SCHEMA, "day", 3) == 0
    assert len([f for f in S.current(spark, folder).folders if f.startswith("day=d1/")]) == 1
    assert S.vacuum(spark, folder, 2) and read(spark, folder) == now and read(spark, folder, 4) == now
    with pytest.raises(FileNotFoundError):
        S.current(spark, folder, 1)
    assert S.vacuum(spark, folder, 1) and read(spark, folder) == now
    assert not [p for p in os.listdir(folder) if "HIVE_DEFAULT" in p]  # its only row was deleted
    assert S.vacuum(spark, folder, 1) == []


def test_empty_tables(spark, tmp_path):
    place = str(tmp_path / "t")
    assert S.rewrite(spark, place, SCHEMA, "day", again=paths(spark, "a")) == 0
    assert S.current(spark, place) == S.Snapshot() and S.versions(spark, place) == []
    S.rewrite(spark, place, SCHEMA, "day", frame(spark, OLD))
    assert S.rewrite(spark, place, SCHEMA, "day", again=paths(spark, *"abce")) == 6
    assert read(spark, place) == []


def test_a_plain_table_is_taken_over(spark, tmp_path):
    place = str(tmp_path / "plain")
    frame(spark, OLD).write.partitionBy("day").parquet(place)
    S.adopt(spark, place, "day")
    assert read(spark, place) == sorted(OLD, key=repr)
    assert change(spark, place) == 3 and read(spark, place) == EXPECTED


def keyed(spark, rows):
    return spark.createDataFrame(rows, "request_id string, source_path string")


def found(spark, folder, commits, names, dropped=None):
    ids = spark.createDataFrame([(n,) for n in names], "_k string")
    gone = None if dropped is None else spark.createDataFrame([(d,) for d in dropped], "source string")
    return sorted(r[0] for r in K.stored_keys(spark, folder, ids, commits, gone).collect())


def test_key_index(spark, tmp_path):
    place = str(tmp_path / "it's")
    assert found(spark, place, (), ["r1"]) == []
    one = K.add_keys(keyed(spark, [("r1", "a"), ("r2", "b"), (None, "c"), ("r3", "c")]), place, "request_id", "source_path")
    assert found(spark, place, (one,), ["r1", "r2", "r9", "r3"]) == ["r1", "r2", "r3"]
    assert found(spark, place, (one,), ["r1", "r2"], dropped=["a"]) == ["r2"]
    # Source a is read again: r1 is gone, r4 comes, and so does what a stopped writer leaves.
    again = spark.createDataFrame([("a",)], "source_path string")
    two = K.add_keys(keyed(spark, [("r4", "a")]), place, "request_id", "source_path", (one,), again)
    K.add_keys(keyed(spark, [("stopped", "z")]), place, "request_id", "source_path", (one, two), again)
    assert found(spark, place, (one, two), ["r1", "r2", "r4", "stopped"]) == ["r2", "r4"]
    assert found(spark, place, (one,), ["r1", "r4"]) == ["r1"]
    three = K.add_keys(keyed(spark, [("r1", "x")]), place, "request_id", "source_path", (one, two))
    assert found(spark, place, (one, two, three), ["r1", "r4"]) == ["r1", "r4"]


def test_the_index_is_not_shuffled(spark, tmp_path):
    place = str(tmp_path / "keys")
    rows = spark.range(20_000).selectExpr("cast(id as string) request_id", "'s' source_path")
    commit = K.add_keys(rows, place, "request_id", "source_path")
    asked = spark.range(10_000, 40_000).selectExpr("cast(id as string) _k").distinct()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = K.stored_keys(spark, place, asked, (commit,))
        plan = df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().executedPlan().toString()
        assert df.count() == 10_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # One exchange for the keys asked for; none above the scan of the index.
    tree = df._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in tree.splitlines() if "Bucketed: true" in line)
    above = tree.splitlines()[: tree.splitlines().index(scan)][::-1]
    first = next(line for line in above if "Exchange" in line or "Join" in line)
    assert "SortMergeJoin" in first or "ShuffledHashJoin" in first, plan


def requests(spark, rows):
    """(request_id, source_path, date_local) as request rows."""
    df = spark.createDataFrame(rows, "request_id string, source_path string, date_local string")
    named = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in REQUEST_SCHEMA]
    return df.select(*named)


def test_ids_and_rows_change_in_one_step(spark, tmp_path, monkeypatch):
    place = str(tmp_path / "requests")

    def ids(*names):
        base = tables.prepare_requests(spark, place)
        return sorted(r[0] for r in tables.stored_ids(spark, place, base, spark.createDataFrame([(n,) for n in names], "_k string")).collect())

    def commit(rows, again=None):
        base = tables.prepare_requests(spark, place)
        return tables.commit_requests(spark, place, base, requests(spark, rows) if rows else None, again)

    commit([("r1", "a", "d1"), ("r2", "b", "d1")])
    assert ids("r1", "r2", "r3") == ["r1", "r2"]
    monkeypatch.setattr(S, "publish", lambda *a, **k: (_ for _ in ()).throw(Stop()))
    with pytest.raises(Stop):
        commit([("r3", "c", "d1")], paths(spark, "a"))
    monkeypatch.undo()
    assert ids("r1", "r2", "r3") == ["r1", "r2"]
    assert commit([("r3", "a", "d2")], paths(spark, "a")) == 1
    assert ids("r1", "r2", "r3") == ["r2", "r3"]
    monkeypatch.setattr(tables, "INDEX_COMMITS", 2)
    commit([("r4", "d", "d2")])
    S.vacuum(spark, place, 1)
    assert ids("r1", "r2", "r3", "r4") == ["r2", "r3", "r4"] and len(S.current(spark, place).notes) == 1
    assert commit(None, paths(spark, "b", "d")) == 2
    assert ids("r2", "r3", "r4") == ["r3"]
    # Rows that went another way void the index: the table itself is asked, and the next commit builds a new one.
    tables.replace_by_source(spark, place, paths(spark, "a"))
    tables.write_requests(requests(spark, [("r5", "e", "d1")]), place)
    assert S.current(spark, place).notes == () and ids("r3", "r5") == ["r5"]
    commit([("r6", "f", "d1")])
    assert S.current(spark, place).notes and ids("r5", "r6", "r3") == ["r5", "r6"]
    assert PARTITION_COLUMN == "date_local"
