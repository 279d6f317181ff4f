"""Raw files in, request table out: odd records, duplicates, changed and broken files."""

import datetime
import json
import os

import pytest
from pyspark.sql import functions as F

from conftest import rows
from usagelens.contract import REQUEST_SCHEMA
from usagelens.plans.ingest import Places, ingest
from usagelens.sources import raw as R
from usagelens.sources import tables as T
from usagelens.sources.flatten import flatten

AT = datetime.datetime(2026, 1, 1)


def record(rid, **parts):
    base = {
        "source_file": "log.json",
        "time": {"received_at": "2026-07-21T10:00:00Z", "created_at": "2026-07-21T10:00:20.126Z"},
        "identity": {"username": "user1", "user_account": "B1227XXX@x"},
        "request": {"request_id": rid, "endpoint": "/v1/responses", "status_code": 200},
        "usage_details": {"cached_tokens": 3},
    }
    for key, value in parts.items():
        base[key] = {**base[key], **value} if isinstance(value, dict) and isinstance(base.get(key), dict) else value
    return base


def one(spark, doc):
    df = spark.createDataFrame([("a/b.json", json.dumps(doc))], "source_path string, text string")
    return flatten(df.withColumn("v", F.parse_json("text")), F.lit(AT)).first()


@pytest.fixture(scope="module")
def flat(spark):
    return lambda **parts: one(spark, record("r", **parts))


def test_blank_ids_are_missing_but_other_blanks_stay(flat):
    got = flat(conversation={"thread_id": "", "turn_id": "", "conversation_key": ""}, client={"originator": ""})
    assert (got.thread_id, got.turn_id, got.client_type) == (None, None, "direct")
    assert (got.conversation_key, got.originator) == ("", "")
    assert flat(conversation={"thread_id": "t"}).client_type == "codex"


@pytest.mark.parametrize(
    "details, missing", [({}, True), (None, True), (5, True), ([1], True), ({"cached_tokens": None}, False)]
)
def test_usage_missing(spark, details, missing):
    doc = record("r")
    doc["usage_details"] = details
    assert one(spark, doc).usage_missing is missing
    del doc["usage_details"]
    assert one(spark, doc).usage_missing is True


def test_flat_location_wins_over_nested(spark):
    doc = record("r")
    doc["usage_details"] = {"cached_tokens": 0, "input_tokens_details": {"cached_tokens": 9, "text_tokens": 4}}
    got = one(spark, doc)
    assert (got.cached_tokens, got.input_text_tokens) == (0, 4)
    # The first location that holds something is the one that is read, even if it is no number.
    doc["usage_details"] = {"cached_tokens": "x", "input_tokens_details": {"cached_tokens": 9}}
    assert one(spark, doc).cached_tokens is None


def test_coercions(flat):
    got = flat(
        usage={"prompt_tokens": True, "completion_tokens": "15", "total_tokens": 12.9},
        request_options={"temperature": 0, "max_tokens": "1.5", "tool_count": [1, 2], "store": 1, "stream": False,
                         "tool_types": [], "include": ["a", "b"], "tool_choice": {"b": 1, "a": "x"}},
        request={"latency_ms": -3.7, "stream": "true"},
    )
    assert (got.prompt_tokens, got.completion_tokens, got.total_tokens) == (None, 15, 12)
    assert (got.temperature, got.max_tokens, got.tool_count) == (0.0, None, 2)
    assert (got.store, got.request_stream_option, got.stream) == (None, False, None)
    assert (got.tool_types, got.include_options, got.tool_choice) == ("", "a,b", '{"a":"x","b":1}')
    assert got.latency_ms == -3
    assert flat(request_options={"temperature": 0.3, "tool_types": "function"}).temperature == 0.3
    assert flat(request_options={"tool_types": "function", "tool_count": 4}).tool_types == "function"


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2026-07-21T23:30:00", "2026-07-22 07:30:00"),
        ("2026-07-21T23:30:00Z", "2026-07-22 07:30:00"),
        ("2026-07-21T23:30:00+08:00", "2026-07-21 23:30:00"),
        ("2026-07-21 15:59:59.999999z", "2026-07-21 23:59:59.999999"),
        ("2026-07-21T16:00-0100", "2026-07-22 01:00:00"),
        ("2026-07-21", "2026-07-21 08:00:00"),
        ("2026-02-31T00:00:00Z", None),
        ("12:30", None),
        ("2026", None),
        ("soon", None),
        (17, None),
    ],
)
def test_times(flat, text, expected):
    got = flat(time={"received_at": text})
    assert (got.ts_local and str(got.ts_local)) == expected
    assert got.date_local == (expected and expected[:10])
    if expected:
        assert got.weekday_local == got.ts_local.weekday() and got.hour_local == got.ts_local.hour
        assert got.ts_local - got.ts_utc.replace(tzinfo=None) == datetime.timedelta(hours=8)


def test_lag_is_received_minus_created(flat):
    assert flat().log_lag_ms == -20126
    assert flat(time={"created_at": None}).log_lag_ms is None


def test_error_message_never_lands(flat):
    got = flat(response_summary={"error": {"message": "my secret text", "code": "c"}})
    assert (got.error_type, got.error_code) == (None, "c")
    assert "secret" not in str(got)
    assert flat(response_summary={"error": "boom"}).error_type == "boom"
    assert flat(response_summary={"error": {"type": "t"}}).error_type == "t"


def test_only_lengths_of_content(flat):
    got = flat(content={"prompt": "héllo", "assistant_response": "", "memory": {"a": [1, 2]}})
    assert (got.prompt_len, got.assistant_response_len, got.memory_len) == (5, 0, len('{"a":[1,2]}'))
    assert "héllo" not in str(got)


def test_model_family(flat):
    assert flat(model={"model_returned": "m-mini-2026-03-17"}).model_family == "m-mini"
    assert flat(model={"model_returned": "m-2026-03"}).model_family == "m-2026-03"
    assert flat(model={"model_returned": ""}).model_family is None


def test_empty_object_has_the_full_schema(spark):
    df = spark.createDataFrame([("x.json", "{}")], "source_path string, text string")
    got = flatten(df.withColumn("v", F.parse_json("text")), F.lit(AT))
    assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in REQUEST_SCHEMA]
    assert got.first().request_id is None


@pytest.fixture
def places(tmp_path):
    (tmp_path / "raw" / "day one").mkdir(parents=True)
    return Places(*[str(tmp_path / n) for n in ("raw", "requests", "manifest", "quarantine")])


def put(places, name, doc, mtime=None):
    path = os.path.join(places.raw, name)
    with open(path, "w") as f:
        f.write(doc if isinstance(doc, str) else json.dumps(doc))
    if mtime:
        os.utime(path, (mtime, mtime))


def stored(spark, places):
    return {r.source_path: r for r in T.read_requests(spark, places.requests).collect()}


def counts(report):
    return {k: v for k, v in rows(report)[0].items() if v not in (0, None) and not k.startswith("ts_")}


def test_incremental_ingest(spark, places):
    put(places, "day one/a+b.json", record("r1"), 1_700_000_000)
    put(places, "b.json", record("r2", time={"received_at": "2026-07-21T17:00:00Z"}), 1_700_000_000)
    put(places, "c.json", record("r1"), 1_700_000_000)
    put(places, "d.json", record(None), 1_700_000_000)
    put(places, "e.json", record(None), 1_700_000_000)
    put(places, "f.json", "[1, 2]", 1_700_000_000)
    put(places, "g.json", '{"cut', 1_700_000_000)
    put(places, "not-a-log.txt", "{}")
    first = ingest(spark, places, "run1", AT)
    assert counts(first) == {"scanned": 7, "processed": 5, "failed": 2, "rows": 4, "partitions": 2, "duplicates": 1}
    # The first path in order wins.
    assert set(stored(spark, places)) == {"b.json", "c.json", "d.json", "e.json"}
    assert stored(spark, places)["b.json"].date_local == "2026-07-22"
    bad = spark.read.parquet(places.quarantine + "/run_id=run1")
    assert {r.source_path: r.error_type for r in bad.collect()} == {"f.json": "not an object", "g.json": "invalid JSON"}

    # Nothing changed: broken files are tried again, the rest is skipped.
    again = ingest(spark, places, "run2", AT)
    assert counts(again) == {"scanned": 7, "skipped": 5, "failed": 2}

    # A changed file replaces its rows even with the same id, and empties its old partition; a stored
    # id is not taken again; a broken file is repaired; a changed file that broke keeps its rows.
    put(places, "b.json", record("r2", time={"received_at": "2026-07-21T10:30:00Z"}), 1_700_000_100)
    put(places, "d.json", "{", 1_700_000_100)
    put(places, "g.json", record("r9"), 1_700_000_100)
    put(places, "h.json", record("r1"), 1_600_000_000)
    third = ingest(spark, places, "run3", AT)
    assert counts(third) == {
        "scanned": 8, "processed": 3, "skipped": 3, "failed": 2, "rows": 2, "partitions": 1,
        "reprocessed": 1, "replaced_rows": 1, "duplicates": 1,
    }
    now = stored(spark, places)
    assert set(now) == {"b.json", "c.json", "d.json", "e.json", "g.json"}
    assert now["b.json"].date_local == "2026-07-21"
    assert sorted(p for p in os.listdir(places.requests) if p.startswith("date_local=")) == ["date_local=2026-07-21"]


def test_a_lost_manifest_stores_nothing_twice(spark, places):
    put(places, "a.json", record("r1"))
    ingest(spark, places, "run1", AT)
    lost = Places(places.raw, places.requests, places.manifest + "-lost", places.quarantine)
    assert counts(ingest(spark, lost, "run2", AT)) == {"scanned": 1, "processed": 1, "duplicates": 1}
    assert len(stored(spark, places)) == 1


def test_reading_nothing_says_so(spark, places):
    with pytest.raises(FileNotFoundError, match="ingest raw logs first"):
        T.read_requests(spark, places.requests)
    with pytest.raises(FileNotFoundError, match="turn"):
        T.read_levels(spark, places.requests, places.manifest)


def test_source_paths_are_relative_and_decoded(spark, places):
    put(places, "day one/a+b%.json", record("r"))
    assert [r.source_path for r in R.list_files(spark, places.raw).collect()] == ["day one/a+b%.json"]
    assert [r.source_path for r in R.read_raw(spark, places.raw).collect()] == ["day one/a+b%.json"]


def test_a_broken_old_file_does_not_reopen_the_archive(spark, places, monkeypatch):
    put(places, "broken [1].json", '{"cut', 1_600_000_000)
    for i in range(20):
        put(places, f"day one/{i}.json", record(f"r{i}"), 1_700_000_000 + i)
    assert counts(ingest(spark, places, "run1", AT)) == {"scanned": 21, "processed": 20, "failed": 1, "rows": 20, "partitions": 1}
    opened = []
    read = R.read_raw

    def watched(*args, **kwargs):
        rows = read(*args, **kwargs)
        opened.extend(r.source_path for r in rows.select("source_path").collect())
        return rows

    monkeypatch.setattr(R, "read_raw", watched)
    assert counts(ingest(spark, places, "run2", AT)) == {"scanned": 21, "skipped": 20, "failed": 1}
    assert opened == ["broken [1].json"]
    opened.clear()
    put(places, "broken [1].json", record("late"), 1_600_000_000)
    put(places, "new.json", record("new"), 1_700_009_999)
    assert counts(ingest(spark, places, "run3", AT))["rows"] == 2
    assert sorted(opened) == ["broken [1].json", "new.json"]


def test_odd_documents_are_read(spark, places):
    put(places, "long.json", '{"s": "' + "x" * 25_000_000 + '"}')
    put(places, "twice.json", '{"k": 1, "k": 2}')
    put(places, "nan.json", '{"k": NaN}')
    got = {r.source_path: r for r in R.read_raw(spark, places.raw).select("source_path", F.variant_get("v", "$.k", "string").alias("k"), F.length(F.variant_get("v", "$.s", "string")).alias("n"), F.col("v").isNull().alias("bad")).collect()}
    assert not any(r.bad for r in got.values())
    assert got["long.json"].n == 25_000_000 and got["twice.json"].k == "2"


@pytest.mark.parametrize(("text", "expected"), [("5f", None), ("1d", None), ("5", 5.0), (" -1.5e3 ", -1500.0), (".5", 0.5), ("5.", 5.0), ("x", None), ("", None)])
def test_numbers_in_text(spark, text, expected):
    df = spark.createDataFrame([(json.dumps({"x": text}),)], "t string").select(F.parse_json("t").alias("v"))
    from usagelens.functions.variant import json_node, to_double

    assert df.select(to_double(json_node("v", "x"))).first()[0] == expected
