"""Levels that follow the request table equal those built from all of it, whatever the batches hold."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from usagelens.contract import REQUEST_SCHEMA
from usagelens.plans import incremental
from usagelens.plans.identity import build_registry
from usagelens.plans.incremental import read_updated, update_levels
from usagelens.plans.levels import build_thread, build_turn, build_user
from usagelens.sources import snapshots as S
from usagelens.sources import tables as T

START = datetime.datetime(2026, 7, 20, 12)


def request(rng, i, source):
    at = None if rng.random() < 0.03 else START + datetime.timedelta(minutes=rng.randrange(60 * 24 * 3))
    local = at and at + datetime.timedelta(hours=8)
    thread = rng.choice([None, "t1", "t2", "t3", "t4"])
    return {
        "request_id": f"r{i}", "source_path": source, "ts_utc": at and at.replace(tzinfo=datetime.timezone.utc), "ts_local": local, "date_local": local and str(local.date()),
        "username": rng.choice(["u1", "u2", "u3", None]), "thread_id": thread, "turn_id": thread and rng.choice([None, f"{thread}a", f"{thread}b", "hot"]),
        "client_type": "codex" if thread else "direct", "endpoint": rng.choice(["/a", "/b"]), "status_code": rng.choice([200, 400]),
        "error_code": rng.choice([None, "e1", "e2"]), "prompt_tokens": rng.choice([None, 5, 7]), "message_count": rng.choice([None, rng.randrange(9)]),
        "user_message_count": rng.randrange(5), "assistant_message_count": rng.randrange(3), "tool_types": rng.choice([None, "", "f,g", "g,h"]),
        "model_family": rng.choice([None, "m1", "m2"]), "usage_missing": rng.choice([True, False]), "latency_ms": rng.randrange(99),
        "user_account": "B1227XXX@x", "reasoning_effort": rng.choice([None, "low", "high"]),
    }


def frame(spark, records):
    names = list(request(random.Random(0), 0, "s"))
    kinds = ", ".join(f"{n} {'timestamp' if n == 'ts_utc' else REQUEST_SCHEMA[n].dataType.simpleString()}" for n in names)
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in records], kinds)
    columns = [(F.col(f.name) if f.name in names else F.lit(None)).cast(f.dataType).alias(f.name) for f in REQUEST_SCHEMA]
    return df.select(*columns)


def rows_of(df):
    return sorted((tuple(sorted(r.asDict().items())) for r in df.collect()), key=repr)


def same(spark, requests, home):
    rows = T.requests_at(spark, requests)
    registry = build_registry(rows)
    got = read_updated(spark, home, registry)
    assert rows_of(got["turn"]) == rows_of(build_turn(rows))
    assert rows_of(got["thread"]) == rows_of(build_thread(rows))
    assert rows_of(got["user"]) == rows_of(build_user(rows, registry))


@pytest.mark.parametrize("seed", range(2))
def test_random_batches(spark, tmp_path, seed):
    rng = random.Random(seed)
    requests, home = str(tmp_path / "requests"), str(tmp_path / "levels")
    with pytest.raises(FileNotFoundError):
        read_updated(spark, home, None)
    sources, n = {}, 0
    for step in range(3):
        again = [] if not step else rng.sample(sorted(sources), 2)
        for source in [*again, f"f{step}", f"g{step}"]:
            count = 0 if source in again and rng.random() < 0.4 else rng.randrange(1, 40)
            sources[source] = [request(rng, n + i, source) for i in range(count)]
            n += count
        batch = [r for s in [*again, f"f{step}", f"g{step}"] for r in sources[s]]
        gone = spark.createDataFrame([(s,) for s in again], "source_path string") if again else None
        T.commit_requests(spark, requests, T.prepare_requests(spark, requests), frame(spark, batch), gone)
        # Turns are cut into pieces when they are large: here the limit is so low that the hot one is.
        update_levels(spark, requests, home, min_rows=8 if seed else None)
        same(spark, requests, home)
    assert update_levels(spark, requests, home) == {"turn": 0, "thread": 0, "user": 0}


def test_only_what_a_batch_touches_is_merged_again(spark, tmp_path):
    rng = random.Random(7)
    requests, home = str(tmp_path / "requests"), str(tmp_path / "levels")
    records = [{**request(rng, i, "f"), "username": f"u{i % 20}", "thread_id": f"t{i % 20}", "turn_id": f"n{i % 20}"} for i in range(200)]
    T.commit_requests(spark, requests, T.prepare_requests(spark, requests), frame(spark, records))
    assert update_levels(spark, requests, home) == {"turn": 20, "thread": 20, "user": 20}
    T.commit_requests(spark, requests, T.prepare_requests(spark, requests), frame(spark, [{**records[0], "request_id": "new", "source_path": "g"}]))
    assert update_levels(spark, requests, home) == {"turn": 1, "thread": 1, "user": 1}
    same(spark, requests, home)


def test_a_stop_leaves_the_old_levels(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    requests, home = str(tmp_path / "requests"), str(tmp_path / "levels")
    T.write_requests(frame(spark, [request(rng, i, "f") for i in range(30)]), requests)
    update_levels(spark, requests, home)
    before = {k: rows_of(df) for k, df in read_updated(spark, home, build_registry(T.requests_at(spark, requests))).items() if k != "user"}
    T.write_requests(frame(spark, [request(rng, 100 + i, "g") for i in range(30)]), requests)

    def stop(*args, **kwargs):
        raise RuntimeError("stop")

    monkeypatch.setattr(S, "publish", stop)
    with pytest.raises(RuntimeError, match="stop"):
        update_levels(spark, requests, home)
    monkeypatch.undo()
    after = read_updated(spark, home, build_registry(T.requests_at(spark, requests)))
    assert {k: rows_of(df) for k, df in after.items() if k != "user"} == before
    update_levels(spark, requests, home)
    same(spark, requests, home)
    assert incremental.LEVELS.keys() == {"turn", "thread", "user"}
