"""Pending files stay a table: which files are opened is decided while they are listed."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from usagelens.sources import raw as R


def write(folder, n):
    for i in range(n):
        place = folder / f"day {i % 3}"
        place.mkdir(parents=True, exist_ok=True)
        (place / f"é {i}+[x]%.json").write_text(json.dumps({"i": i}))


def paths(spark, names):
    return spark.createDataFrame([(n,) for n in names], "source_path string")


def files_read(df):
    """Rows, and how many files the scan opened."""
    rows = df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return rows, max(leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size()) if leaves.apply(i).metrics().contains("numFiles"))


@pytest.mark.parametrize("wanted", [0, 1, 7, 60])
def test_only_pending_files_are_opened(spark, tmp_path, wanted):
    write(tmp_path / "raw", 60)
    names = sorted(f"day {i % 3}/é {i}+[x]%.json" for i in range(60))[:wanted]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows, opened = files_read(R.read_raw(spark, str(tmp_path / "raw"), only=paths(spark, names)).select("source_path", F.col("v").isNull().alias("bad")))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sorted(r.source_path for r in rows) == names and not any(r.bad for r in rows)
    # Paths that share a bit with a pending one may be opened, and are dropped before they are parsed.
    assert opened <= wanted + 60 * wanted / (16 * max(wanted, 4)) + 3


def test_many_paths_take_bounded_space(spark):
    many = spark.range(400_000).select(F.concat(F.lit("p/"), F.col("id").cast("string")).alias("source_path"))
    found = R.marks(many)
    assert len(found) * 8 == R._MARKS
    hits = many.where(R._marked(F.col("source_path"), found)).count()
    others = spark.range(20_000).select(F.concat(F.lit("q/"), F.col("id").cast("string")).alias("source_path"))
    assert hits == 400_000 and others.where(R._marked(F.col("source_path"), found)).count() < 3_000
    assert R.marks(many.limit(0)).sum() == 0 and isinstance(found, np.ndarray)


def test_touched_late_and_unreadable_files(spark, tmp_path):
    """Files from before the newest recorded one are read again if they are pending, whatever their time is."""
    from usagelens.plans.ingest import Places, ingest

    places = Places(*[str(tmp_path / n) for n in ("raw", "requests", "manifest", "quarantine")])
    os.makedirs(places.raw)

    def put(name, text, at):
        path = os.path.join(places.raw, name)
        with open(path, "w") as f:
            f.write(text)
        os.utime(path, (at, at))

    def doc(rid):
        return json.dumps({"request": {"request_id": rid}, "time": {"received_at": "2026-07-21T10:00:00Z"}, "identity": {"username": "u"}})

    for i in range(5):
        put(f"{i}.json", doc(f"r{i}"), 1_700_000_000 + i)
    put("bad.json", "{", 1_600_000_000)
    assert ingest(spark, places, "1").first().failed == 1
    put("bad.json", doc("repaired"), 1_600_000_000)  # same time, other size
    put("late.json", doc("late"), 1_500_000_000)
    put("2.json", doc("r2b"), 1_700_000_001)  # touched
    got = ingest(spark, places, "2").first()
    assert (got.scanned, got.processed, got.skipped, got.reprocessed, got.replaced_rows, got.rows, got.failed) == (7, 3, 4, 1, 1, 3, 0)
    assert ingest(spark, places, "3").first().skipped == 7
