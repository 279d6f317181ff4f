"""Flattening goes through a record once, whatever its values are."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from usagelens.contract import REQUEST_FIELDS, Field
from usagelens.functions import times
from usagelens.functions import variant as V
from usagelens.sources import raw as R
from usagelens.sources.flatten import flatten


def flat(spark, texts, fields=REQUEST_FIELDS):
    rows = spark.createDataFrame([(f"{i:03d}", t) for i, t in enumerate(texts)], "source_path string, text string")
    found = flatten(rows.withColumn("v", R.parse("text")), F.lit(None).cast("timestamp"), fields=fields)
    return found, found.orderBy("source_path").collect()


def test_texts_come_from_one_pass(spark):
    found, _ = flat(spark, ["{}"])
    plan = found._jdf.queryExecution().optimizedPlan()
    spark.conf.set("spark.sql.debug.maxToStringFields", "2000")
    lines = [line for line in plan.toString().splitlines() if "variant_get" in line]
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    n_text = sum(len(f.sources) for f in REQUEST_FIELDS if f.read == "text")
    first = lines[-1]
    assert first.count("variant_get") < n_text
    assert "$.request.endpoint" not in "".join(lines) and "$.model.provider" not in "".join(lines)


VALUES = ["5", '" 5 "', "5.7", "-5.7", '"5.7"', '"+5"', "true", '"true"', "9223372036854775807.5", '"9223372036854775808"', "1e3", "null", "[5]", '{"a": 5}', '""']


def test_values_are_read_as_each_alone(spark):
    """An integer, a boolean and a number of all kinds of values, beside a plain integer in the same record."""
    texts = [f'{{"usage": {{"prompt_tokens": {x}, "total_tokens": 3}}, "request": {{"stream": {x}}}, "request_options": {{"temperature": {x}, "tool_count": {x}, "tool_types": {x}}}}}' for x in VALUES]
    _, rows = flat(spark, texts)
    top = 2**63 - 1
    assert [r["prompt_tokens"] for r in rows] == [5, 5, 5, -5, None, None, None, None, top, None, 1000, None, None, None, None]
    assert [r["stream"] for r in rows] == [None] * 6 + [True] + [None] * 8
    assert [r["temperature"] for r in rows] == [5, 5, 5.7, -5.7, 5.7, 5, None, None, 9223372036854775807.5, 2.0**63, 1000, None, None, None, None]
    assert [r["tool_count"] for r in rows] == [5, 5, 5, -5, None, None, None, None, top, None, 1000, None, 1, 1, None]
    assert [r["tool_types"] for r in rows] == ["5", " 5 ", "5.7", "-5.7", "5.7", "+5", "true", "true", "9223372036854775807.5", "9223372036854775808", "1000.0", None, "5", '{"a":5}', ""]
    assert {r["total_tokens"] for r in rows} == {3}


def test_first_place_that_holds_something_counts(spark):
    """Also where one place lies below another, or its steps meet no object."""
    fields = [
        Field("source_path", "string"), Field("ts_utc", "instant", "time", ("t",)), Field("ts_created_utc", "instant", "time", ("u",)),
        Field("model_returned", "string", "text", ("m",)), Field("thread_id", "string", "text", ("h",)),
        Field("one", "string", "text", ("a.b", "a", "c")), Field("yes", "boolean", "bool", ("p", "q")), Field("all", "string", "listed", ("p", "q")),
    ]
    _, rows = flat(spark, ['{"a": {"b": 1}, "c": 2, "p": "true", "q": true}', '{"a": {"x": 1}, "q": true}', '{"a": null, "c": "", "p": [1, null], "q": 1}', "[]"], fields)
    assert [r["one"] for r in rows] == ["1", '{"x":1}', "", None]
    assert [r["yes"] for r in rows] == [None, True, None, None]
    assert [r["all"] for r in rows] == ["true", "true", "1,None", None]


@pytest.mark.parametrize(
    ("text", "hour"),
    [("2024-01-02T03:04:05Z", 3), ("2024-01-02 03:04:05z", 3), ("2024-01-02T03:04:05", 3), ("2024-01-02T03:04:05.000000+02:00", 1), (" 2024-01-02T03:04:05-01:00 ", 4),
     ("2024-01-02T03:04:05+0200", 1), ("2024-01-02T03:04:05,0Z", 3), ("2024-01-02T03:04:05+02:00\n", 1), ("2024-01-02T03:04:05Z\n", 3), ("2024-13-02T03:04:05Z", None)],
)
def test_times_in_whole_are_read_as_they_are(spark, text, hour):
    row = spark.createDataFrame([(text,)], "t string").select(times.parse_ts(F.col("t")).alias("ts")).select(F.unix_seconds("ts").alias("s")).first()
    start = int(datetime.datetime(2024, 1, 2, tzinfo=datetime.UTC).timestamp())
    assert row["s"] == (None if hour is None else start + hour * 3600 + 4 * 60 + 5)


def test_object_is_told_from_other_values(spark):
    rows = spark.createDataFrame([(x,) for x in ('{"a": 1}', "{}", "[]", '"{}"', "1", "null", None)], "t string")
    found = rows.select(V.is_object(R.parse("t")).alias("o")).collect()
    assert [bool(r["o"]) for r in found] == [True, True, False, False, False, False, False]
