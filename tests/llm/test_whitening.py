import math
import uuid

import numpy as np
import pytest

from usagelens.llm import whitening
from usagelens.llm.whitening import leading, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, component string, n string, x int, v int"


def table(spark, tmp_path, rows):
    folder = str(tmp_path / uuid.uuid4().hex)
    spark.createDataFrame([(i, v, 1, "c", "n", 2, 3) for i, v in rows], SCHEMA).repartition(3).write.parquet(folder)
    return spark.read.parquet(folder)


def clean(rows):
    """The rows that stay, and their vectors in whole steps, by plain Python."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(v) for _, v in kept), default=0)
    return [(i, [math.floor(256 * float(np.float32(c))) for c in v] + [0] * (width - len(v))) for i, v in kept]


def check(rows, got, components=4):
    kept = clean(rows)
    x = np.array([v for _, v in kept], float)
    distinct = np.array(sorted({tuple(v) for _, v in kept}), float)
    n, sums = len(distinct), [int(s) for s in distinct.sum(axis=0)]
    values, vectors = np.linalg.eigh(np.cov(distinct.T, bias=True).reshape(x.shape[1], -1))
    values, vectors = values[::-1], vectors[:, ::-1]
    c = min(components, int((values > 1e-12 * values[0]).sum()))
    assert len(got) == len(kept) * c and {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1
    assert got[0].identity_error <= 1e-9
    deviations = sorted((i, sum((n * a - s) ** 2 for a, s in zip(v, sums))) for i, v in kept for _ in range(c))
    assert sorted((r.vec_id, r.deviation) for r in got) == deviations
    expected = (x - distinct.mean(axis=0)) @ vectors[:, :c] / np.sqrt(values[:c])
    for k in range(c):
        mine = sorted((r.vec_id, r.whitened) for r in got if r.component == k + 1)
        theirs = sorted((i, expected[j, k]) for j, (i, _) in enumerate(kept))
        a, b = np.array([m[1] for m in mine]), np.array([m[1] for m in theirs])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-9
        assert [r.explained for r in got if r.component == k + 1] == pytest.approx([values[k] / values.sum()] * len(kept), rel=1e-10)


@pytest.mark.parametrize("width, spectrum", [(64, "flat"), (64, "steep"), (100, "pair"), (40, "low rank"), (8, "small"), (33, "flat")])
def test_leading_equals_a_full_decomposition(width, spectrum):
    random = np.random.default_rng(width)
    q = np.linalg.qr(random.standard_normal((width, width)))[0]
    values = {
        "flat": 100 + np.linspace(1, 0, width), "steep": 10.0 ** -np.linspace(0, 12, width), "pair": np.r_[5.0, 4, 3, 3, 3 - 1e-3, np.linspace(2.9, 0.1, width - 5)],
        "low rank": np.r_[3.0, 2, 1, np.zeros(width - 3)], "small": np.arange(width, 0.0, -1),
    }[spectrum]
    a = (q * values) @ q.T
    got, vectors = leading(lambda v: a @ v, width, 4)
    assert np.abs(got - values[:4]).max() < 1e-12 * values[0]
    assert np.abs(vectors.T @ vectors - np.eye(4)).max() < 1e-12
    # Where eigenvalues are equal any basis will do: the projector on the whole space is compared.
    if spectrum != "low rank":
        assert np.abs(vectors @ vectors.T - q[:, :4] @ q[:, :4].T).max() < 1e-8


def test_whitening_equals_a_full_decomposition(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 16)
    random = np.random.default_rng(3)
    vectors = (random.standard_normal((150, 40)) * np.linspace(2, 0.3, 40)).round(3)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(1000 + i, vectors[0].tolist()) for i in range(300)]  # a hot group of copies counts once
    rows += [(None, vectors[1].tolist()), (5003, vectors[2].tolist())]
    got = whiten(table(spark, tmp_path, rows)).collect()
    assert sum(r.vec_id is None for r in got) == 4
    check([r for r in rows if r[0] is not None], [r for r in got if r.vec_id is not None])


def test_awkward_vectors(spark, tmp_path):
    rows = [
        (1, None), (2, [1.0, None, 2.0]), (3, [float("nan"), 0.0, 0.0]), (4, [float("inf"), 0.0, 0.0]), (5, [0.0, -float("inf"), 0.0]),
        (6, [-0.0, 0.0, -0.001]), (7, [0.0, 0.0, -0.001]), (8, [1.0, 2.0]), (9, []), (10, [0.5, -2.0, 3.0]), (11, [0.5, -2.0, 3.0]), (11, [1.5, 0.25, 3.0]),
    ]
    got = whiten(table(spark, tmp_path, rows)).collect()
    assert {r.vec_id for r in got} == {6, 7, 8, 9, 10, 11} and {r.component for r in got} == {1, 2, 3}
    check(rows, got)


def test_without_variance_there_are_no_components(spark, tmp_path):
    for rows in ([], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        df = whiten(table(spark, tmp_path, rows))
        assert df.collect() == [] and df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    line = [(i, [i * 1.0, i * 2.0, 0.0]) for i in range(20)]  # one direction only
    got = whiten(table(spark, tmp_path, line)).collect()
    assert {r.component for r in got} == {1} and got[0].explained == pytest.approx(1)


def test_numbers_too_large_for_a_long(spark, tmp_path):
    rows = [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 5.0]), (4, [1e9, 5.0])]
    got = whiten(table(spark, tmp_path, rows)).collect()
    assert {r.vec_id for r in got} == {1, 2, 3, 4} and {r.deviation for r in got if r.vec_id == 1} == {None}
