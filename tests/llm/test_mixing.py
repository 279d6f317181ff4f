from collections import Counter

import pytest
from helpers import AWKWARD, prose, stored

from pyspark.sql import functions as F

from usagelens.llm import mixing
from usagelens.llm.mixing import mix, source_targets


def water_filling(sizes, weights, limit=3.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > limit * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        target |= {s: limit * sizes[s] for s in over}
        left -= sum(limit * sizes[s] for s in over)
        open_ -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 500, None: 3, "c": 90}, {"a": 0, "b": 0}, {"z": 7}, {"a": 1, "b": 1, "c": 1000, "d": 5}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in source_targets(df, (1, 2, 3)).collect()}
    assert got == pytest.approx(water_filling(sizes, (1, 2, 3)))


def test_awkward_rows(spark, tmp_path):
    docs = stored(spark, tmp_path, AWKWARD)
    got = mix(docs).collect()
    assert len(got) == len(AWKWARD)
    assert Counter((r.doc_id, r.source) for r in got) == Counter((d, s) for d, _, _, s in AWKWARD)
    assert all(0 <= r.copies <= 3 and r.taken == r.copies * r.size for r in got)
    assert sorted(r.size for r in got) == sorted(len((t or "").encode().split()) for _, t, *_ in AWKWARD)
    again = mix(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_sources_come_near_their_targets(spark, tmp_path):
    rows = [(i, prose(5 + i * i % 180, i), "en", f"s{min(i % 7, 3)}") for i in range(3000)]
    rows += [(9000 + i, prose(40, i), "en", "tiny") for i in range(20)]
    got = mix(stored(spark, tmp_path, rows)).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
    for s, t in target.items():
        assert abs(taken[s] - t) < max(200, 0.02 * t), (s, taken[s], t)
    # Probabilities round to the next whole number of copies, up or down.
    rate = {r.source: r.target / r.source_size for r in got}
    assert all(int(rate[r.source] + 1e-9) <= r.copies <= int(rate[r.source] + 1 - 1e-9) + 1e-9 or r.copies == 3 for r in got)


def test_equal_rows_spread_over_buckets(spark, tmp_path, monkeypatch):
    """A third of all rows is one row again and again: no bucket grows with it, and its copies add up."""
    largest, rounded = [], mixing._rounded
    monkeypatch.setattr(mixing, "_rounded", lambda units: largest.append(units.groupBy("source", "bucket").count().agg(F.max("count")).first()[0]) or rounded(units))
    rows = [(7, "one and the same text", "en", "hot")] * 2000 + [(None, "no id", "en", "hot")] * 500 + [(100 + i, prose(30, i), "en", f"s{i % 4}") for i in range(3000)]
    got = mix(stored(spark, tmp_path, rows), fan_in=16).collect()
    assert len(got) == len(rows) and max(n for n in largest if n) <= 4 * 16
    for source in {r.source for r in got}:
        mine = [r for r in got if r.source == source]
        rate = mine[0].target / mine[0].source_size
        # Rounding keeps the sum of copies, but for one unit that stays open.
        assert abs(sum(r.copies for r in mine) - rate * len(mine)) <= 1
        assert {r.copies for r in mine} <= {int(rate), int(rate) + 1, 3}


def test_empty_table(spark, tmp_path):
    assert mix(stored(spark, tmp_path, [])).collect() == []
