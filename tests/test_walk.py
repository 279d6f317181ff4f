"""Records are walked as one row each, and what they hold is written as text."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from usagelens.plans import audit
from usagelens.sources import raw as R

TEXT = '{"x": {"y": null, "z": {}}, "l": [{"m": 1}], "s": "é", "t": true, "n": 1.5, "k": 7}'
DEEP = '{"q": ' * 20 + "1" + "}" * 20


@pytest.fixture
def parked(monkeypatch):
    """What the walk writes to the shared folder."""
    seen, staged = [], audit.staged

    def watched(df, name):
        seen.append(df)
        return staged(df, name)

    monkeypatch.setattr(audit, "staged", watched)
    return seen


def records(spark, *texts):
    rows = spark.createDataFrame([(f"r{i}", t) for i, t in enumerate(texts)], "source_path string, text string")
    return rows.withColumn("v", R.parse("text"))


def test_levels_are_opened_inside_the_row(spark, parked):
    found = audit.walk_paths(records(spark, TEXT, None, "[1]"), "source_path")
    assert {tuple(r)[1:] for r in found.collect() if r["key"] == "r0"} == {
        ("x", None, True, None), ("x.y", "null", False, "null"), ("x.z", None, True, None), ("l", "list", False, '[{"m":1}]'),
        ("s", "string", False, "é"), ("t", "boolean", False, "true"), ("n", "number", False, "1.5"), ("k", "integer", False, "7"),
    }
    assert found.where("key <> 'r0'").count() == 0
    assert len(parked) == 1
    plan = parked[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1


def test_done_entries_are_not_parsed_again(spark, parked):
    found = audit.walk_paths(records(spark, DEEP), "source_path")
    rows = {r["path"]: r for r in found.collect()}
    assert len(rows) == 20 and rows[".".join("q" * 20)]["text"] == "1"
    assert sum(r["is_container"] for r in rows.values()) == 19
    assert len(parked) == 3
    for df in parked:
        assert df.where(~F.col("open") & F.col("node").isNotNull()).count() == 0


def test_shallow_walk_keeps_objects_as_leaves(spark):
    found = audit.walk_paths(records(spark, TEXT), "source_path", levels=1).where("kind = 'object'").collect()
    assert [(r["path"], r["text"]) for r in found] == [("x", '{"y":null,"z":{}}')]
