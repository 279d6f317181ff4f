"""Micro-batches: replayed ones change nothing, and changed files come in beside the stream. No server is started."""

import datetime
import json
import os

import pytest

from usagelens.plans import ingest as I
from usagelens.plans import stream
from usagelens.plans.ingest import Places
from usagelens.plans.stream import apply_batch, catch_up, follow
from usagelens.sources import manifest as M
from usagelens.sources import raw as R
from usagelens.sources import tables as T

AT = datetime.datetime(2026, 1, 1)


def put(places, name, rid, at=1_700_000_000):
    path = os.path.join(places.raw, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    doc = {"request": {"request_id": rid}, "time": {"received_at": "2026-07-21T10:00:00Z"}, "identity": {"username": "u"}}
    with open(path, "w") as f:
        f.write(json.dumps(doc) if rid else "{")
    os.utime(path, (at, at))


def stored(spark, places):
    return sorted((r.source_path, r.request_id) for r in T.read_requests(spark, places.requests).collect())


@pytest.fixture
def places(tmp_path):
    return Places(*[str(tmp_path / n) for n in ("raw", "requests", "manifest", "quarantine")])


def test_available_now_and_changed_files(spark, places, tmp_path):
    for i in range(5):
        put(places, f"d{i % 2}/{i}.json", f"r{i}")
    put(places, "bad.json", None)
    checkpoint = str(tmp_path / "checkpoint")
    follow(spark, places, checkpoint, at=AT, files_per_batch=4).awaitTermination()
    first = [(f"d{i % 2}/{i}.json", f"r{i}") for i in range(5)]
    assert stored(spark, places) == sorted(first)
    assert T.last_batch(T.prepare_requests(spark, places.requests), "raw") == 1
    # New files come by the stream, a repeated id is left out; changed and repaired ones beside it.
    put(places, "d0/9.json", "r9")
    put(places, "d0/again.json", "r1")
    follow(spark, places, checkpoint, at=AT, files_per_batch=4).awaitTermination()
    assert stored(spark, places) == sorted([*first, ("d0/9.json", "r9")])
    put(places, "d0/2.json", "changed", 1_700_000_050)
    put(places, "bad.json", "repaired", 1_700_000_050)
    report = catch_up(spark, places, "beside", AT).first()
    assert (report.reprocessed, report.replaced_rows, report.rows, report.processed) == (1, 1, 2, 2)
    wanted = sorted([f for f in first if f[1] != "r2"] + [("d0/9.json", "r9"), ("d0/2.json", "changed"), ("bad.json", "repaired")])
    assert stored(spark, places) == wanted
    follow(spark, places, checkpoint, at=AT).awaitTermination()
    assert stored(spark, places) == wanted


@pytest.mark.parametrize("step", ["before the commit", "after the commit"])
def test_a_batch_that_comes_again_gives_the_same_table(spark, places, monkeypatch, step):
    put(places, "a.json", "r1")
    put(places, "b.json", None)
    args = (places, "s", AT, "Asia/Shanghai")
    apply_batch(spark, R.read_raw(spark, places.raw), 0, *args)
    put(places, "c.json", "r2")
    put(places, "a.json", "r3", 1_700_000_009)  # a batch may hold a file that was read before
    batch = R.read_raw(spark, places.raw)

    def stop(*a, **k):
        raise RuntimeError("stop")

    monkeypatch.setattr(T if step == "before the commit" else M, "commit_requests" if step == "before the commit" else "write_manifest", stop)
    with pytest.raises(RuntimeError, match="stop"):
        apply_batch(spark, batch, 1, *args)
    monkeypatch.undo()
    for _ in range(2):
        apply_batch(spark, batch, 1, *args)
        assert stored(spark, places) == [("a.json", "r3"), ("c.json", "r2")]
    assert sorted(r.source_path for r in M.read_manifest(spark, places.manifest).collect()) == ["a.json", "c.json"]
    assert T.last_batch(T.prepare_requests(spark, places.requests), "s") == 1
    assert I.ingest(spark, places, "run", AT).first().failed == 1 and stream.follow
