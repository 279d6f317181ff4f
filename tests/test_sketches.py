"""Sketches merged over parts say what one pass over all rows says, within the stated errors."""

import random

from pyspark.sql import functions as F

from usagelens.operators.sketches import DISTINCT_ERROR, RANK_ERROR, estimates, merge_sketches, part_sketches


def test_merging_equals_one_pass_within_the_error(spark):
    random.seed(5)
    rows = [(random.choice("ab"), f"2026-01-{random.randrange(1, 29):02d}", random.randrange(5000), random.random() ** 3 * 1000) for _ in range(30_000)]
    rows += [("hot", f"2026-01-{i % 28 + 1:02d}", i, 1.0) for i in range(15_000)]  # a third of all rows, one value
    df = spark.createDataFrame(rows, "k string, day string, u long, v double")
    parts = part_sketches(df, ["k"], "day", ["u"], ["v"])
    merged = {r.k: r for r in estimates(merge_sketches(parts, ["k"]), ["k"]).collect()}
    again = {r.k: r for r in estimates(merge_sketches(merge_sketches(parts.withColumn("half", F.col("day") < "2026-01-15"), ["k", "half"]), ["k"]), ["k"]).collect()}
    for k in ("a", "b", "hot"):
        own = sorted(r[3] for r in rows if r[0] == k)
        users = len({r[2] for r in rows if r[0] == k})
        for got in (merged[k], again[k]):
            assert got.n == len(own) and abs(got.n_u - users) <= DISTINCT_ERROR * users
            for q in (10, 25, 50, 75, 90, 99):
                v = got[f"v_p{q}"]
                below, upto = sum(x < v for x in own) / len(own), sum(x <= v for x in own) / len(own)
                assert below - RANK_ERROR <= q / 100 <= upto + RANK_ERROR


def test_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([("a", "d", None, None), ("a", "e", None, None), (None, None, 1, 2.0)], "k string, day string, u long, v double")
    got = {r.k: r for r in estimates(merge_sketches(part_sketches(df, ["k"], "day", ["u"], ["v"]), ["k"]), ["k"]).collect()}
    assert (got["a"].n, got["a"].n_u, got["a"].v_p50) == (2, 0, None) and (got[None].n_u, got[None].v_p50) == (1, 2.0)
    assert estimates(merge_sketches(part_sketches(df.limit(0), ["k"], "day", ["u"], ["v"]), ["k"]), ["k"]).collect() == []
