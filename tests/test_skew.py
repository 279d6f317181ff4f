"""Operators that split heavy keys give the same answer as plain Python, whatever the skew."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from usagelens.operators.dedupe import dedupe, dedupe_against
from usagelens.operators.heavy import heavy_keys, staged, with_piece
from usagelens.operators.ordered import compaction_stats, gaps, position_in
from usagelens.operators.quantiles import exact_quantiles, quantile_table
from usagelens.operators.rhythm import cadence
from usagelens.plans.levels import build_turn

MINUTE = 60


@pytest.fixture(scope="module")
def events(spark):
    """2,000 events; one key has half of them, another has many equal times, some have none."""
    rnd = random.Random(7)
    data = []
    for i in range(2000):
        key = "hot" if i % 2 == 0 else rnd.choice(["a", "b", "c", None])
        second = rnd.randrange(0, 5000) if key != "b" else rnd.randrange(0, 20)
        count = rnd.choice([None, 1, 2, 3, 4, 5])
        data.append((f"r{i:05d}", key, 1_700_000_000 + second * MINUTE, count))
    df = spark.createDataFrame(data, "id string, key string, s bigint, n bigint")
    return df.withColumn("ts", F.timestamp_seconds("s")), data


def by_key(data):
    groups = {}
    for r in sorted((r for r in data if r[1] is not None), key=lambda r: (r[2], r[0])):
        groups.setdefault(r[1], []).append(r)
    return groups


@pytest.mark.parametrize("min_rows", [None, 10, 100, 10**9])
def test_compaction(events, min_rows):
    df, data = events
    expected = {}
    for key, group in by_key(data).items():
        pairs = zip(group, group[1:])
        expected[key] = 1 + sum(a[3] is not None and b[3] is not None and b[3] < a[3] for a, b in pairs)
    got = compaction_stats(df, "key", "n", "ts", "id", min_rows).collect()
    assert {r.key: r.n_segments for r in got} == expected
    assert all(r.has_compaction == (r.n_segments > 1) for r in got)


@pytest.mark.parametrize("min_rows", [None, 10, 300])
def test_position(events, min_rows):
    df, data = events
    expected = {r[0]: i for g in by_key(data).values() for i, r in enumerate(g, 1)}
    got = position_in(df, "key", "ts", "id", min_rows=min_rows).collect()
    assert {r.id: r.position for r in got} == expected


@pytest.mark.parametrize("min_rows", [None, 10, 300])
def test_gaps(events, min_rows):
    df, data = events
    expected = sorted(
        (k, float(b[2] - a[2])) for k, g in by_key(data).items() for a, b in zip(g, g[1:])
    )
    got = sorted((r.key, r.gap_seconds) for r in gaps(df, "key", "ts", min_rows).collect())
    assert got == expected


def test_cadence_agrees_when_split(events):
    df, _ = events
    assert rows(cadence(df, "key", "ts", 10), "key") == rows(cadence(df, "key", "ts", None), "key")


def test_few_gaps_say_nothing(spark):
    df = spark.createDataFrame([("u", s) for s in (0, 1, 2)], "u string, s int").withColumn(
        "ts", F.timestamp_seconds("s")
    )
    [row] = rows(cadence(df, "u", "ts"))
    assert row == {"u": "u", "n_gaps": 2, "median_gap": None, "tight_share": None}


def test_pieces_follow_the_order(events):
    df, _ = events
    cut, split = with_piece(df.where("key is not null"), "key", "ts", min_rows=10, splits=8)
    assert split
    got = cut.groupBy("key", "_piece").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    for key in "hot", "a", "b", "c":
        spans = sorted((r._piece, r.a, r.b) for r in got.collect() if r.key == key)
        assert len(spans) > 1
        assert all(x[2] < y[1] for x, y in zip(spans, spans[1:]))


def test_every_heavy_key_is_found(spark, events):
    df, _ = events
    assert {r.key for r in heavy_keys(df, ["key"], 10).collect()} == {"hot", "a", "b", "c", None}
    assert heavy_keys(df, ["key"], 5000) is None
    many = spark.range(60_000).select((F.col("id") % 3000).alias("key"))
    assert heavy_keys(many, ["key"], 20).count() == 3000


def test_one_key_of_six_million_rows_is_split(spark):
    df = spark.range(6_000_000).select(F.lit("k").alias("key"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("tie"))
    cut, split = with_piece(df, "key", "ts")
    assert split and cut.select("_piece").distinct().count() > 100
    placed = position_in(df, "key", "ts", "tie")
    assert placed.where(F.col("position") != F.col("tie") + 1).isEmpty()


def test_positions_with_more_hot_keys_than_any_limit(spark):
    df = spark.range(60_000).select((F.col("id") % 3000).alias("key"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("tie"))
    placed = position_in(df, "key", "ts", "tie", min_rows=5)
    assert placed.where(F.col("position") != F.floor(F.col("tie") / 3000) + 1).isEmpty()


def percentile(values, q):
    values = sorted(values)
    rank = q * (len(values) - 1)
    low = int(rank)
    high = min(low + 1, len(values) - 1)
    return values[low] + (values[high] - values[low]) * (rank - low)


@pytest.mark.parametrize("shape", ["uniform", "one value", "long tail", "two values", "tiny"])
def test_bracketed_quantiles(spark, shape):
    rnd = random.Random(shape)
    n = 5000
    values = {
        "uniform": [rnd.random() for _ in range(n)],
        "one value": [3.0] * n,
        "long tail": [rnd.paretovariate(0.3) for _ in range(n)],
        "two values": [float(i % 1000 == 0) for i in range(n)],
        "tiny": [5.0, 1.0, 2.0],
    }[shape]
    df = spark.createDataFrame([("g", v) for v in values] + [("g", None), (None, 1.0)], "g string, v double")
    qs = (0.0, 0.1, 0.25, 0.5, 0.9, 0.99, 1.0)
    got = {r.g: r for r in exact_quantiles(df, ["g"], "v", qs, min_rows=1).collect()}
    for q in qs:
        assert got["g"][f"p{round(q * 100)}"] == pytest.approx(percentile(values, q), rel=1e-12)
    assert got[None].p50 == 1.0


def test_light_and_heavy_groups_side_by_side(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") < 2900, "big").otherwise("small").alias("g"), (F.col("id") * 7 % 1001).alias("v")
    )
    mixed = quantile_table(df, ["g"], "v", min_rows=1000, extra=[F.sum("v").alias("total")])
    plain = quantile_table(df, ["g"], "v", extra=[F.sum("v").alias("total")])
    assert rows(mixed, "g") == rows(plain, "g")


def test_empty_table_has_one_row_without_groups(spark):
    df = spark.createDataFrame([], "v double")
    [row] = rows(quantile_table(df, [], "v")) or [{"n": 0, "p50": None}]
    assert row["n"] == 0 and row["p50"] is None


def test_turns_do_not_depend_on_splitting(spark, sf):
    from catalog.views import requests

    r = requests(spark, sf)
    assert rows(build_turn(r, min_rows=2), "turn_id") == rows(build_turn(r, min_rows=None), "turn_id")


def test_dedupe_keeps_the_first_and_all_without_key(spark):
    df = spark.range(1000).select(
        F.col("id").alias("place"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.col("id").cast("string")).alias("k")
    )
    got = dedupe(df, "k", "place")
    assert got.where("k = 'hot'").collect()[0].place == 0
    assert got.where("k is null").count() == 333
    assert got.count() == 333 + 333 + 1
    against = dedupe_against(got, spark.createDataFrame([("hot",), (None,), ("1",)], "k string"), "k")
    assert against.count() == 333 + 332


def test_intermediates_are_staged(spark):
    df = spark.range(100).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    kept = staged(df)
    assert kept is not df and rows(kept, "k") == rows(df, "k")
