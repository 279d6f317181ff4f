"""Whitened embeddings: leading principal components by Chebyshev-filtered subspace iteration."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import Stored

COMPONENTS = 4
#: Entries count in steps of 1/256.
STEPS = 256
#: Vectors of the fit list that one stored block holds.
BLOCK = 4_096
#: Directions that are iterated besides the components: the more, the faster the components part from the rest.
EXTRA = 28
#: Passes of the first look at the spectrum's ends.
_LANCZOS = 8
#: A filter damps the unwanted directions against the last component so much, in so many passes at most.
_DAMPING, _DEGREE = 1e9, 24
#: Certified: residuals below this part of the largest eigenvalue, which is what rounding leaves ..
TOLERANCE = 1e-14
#: .. or below this, if another round no longer halves them.
_SETTLED = 1e-11
#: Directions with a smaller part of the largest eigenvalue have no variance.
_NO_VARIANCE = 1e-12
_MAX_ROUNDS = 200
_PART = 60


class Whitening(NamedTuple):
    """What is fitted; of a size that depends on the number of dimensions and components alone."""

    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # dimensions x components
    explained: np.ndarray
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return _mean(self.sums, self.n)


def _mean(sums: list[int], n: int) -> np.ndarray:
    return np.array([s / n for s in sums], np.float64)


def _valid(vector: str) -> Column:
    """Not null, and every entry a finite number."""
    return F.col(vector).isNotNull() & ~F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))


def _steps(vector: str, width: int) -> Column:
    whole = F.transform(vector, lambda c: F.floor(c.cast("double") * STEPS).cast("long"))
    return F.concat(whole, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size(vector)))


def _rows(lists: pa.ListArray, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _blocks(distinct: DataFrame, width: int) -> DataFrame:
    """The vectors (x) in blocks: rows, type, and the numbers one after another in the smallest type that holds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def block() -> pa.RecordBatch:
            x = np.concatenate(held)
            low, high = int(x.min()), int(x.max())
            kind = next(k for k in ("<i2", "<i4", "<i8") if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
            return pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int64()), pa.array([kind]), pa.array([x.astype(kind).tobytes()])], ["rows", "kind", "data"])

        for batch in batches:
            x = _rows(batch.column("x"), width)
            for lo in range(0, len(x), BLOCK):
                held.append(x[lo : lo + BLOCK])
                rows += len(held[-1])
                if rows >= BLOCK:
                    yield block()
                    held, rows = [], 0
        if rows:
            yield block()

    return distinct.select("x").mapInArrow(run, "rows bigint, kind string, data binary")


def _opened(batch: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
    for kind, data in zip(batch.column("kind").to_pylist(), batch.column("data")):
        yield np.frombuffer(data.as_buffer(), kind).reshape(-1, width)


def _moments(blocks: DataFrame, width: int) -> tuple[int, list[int], list[int]]:
    """Number of vectors, and for each dimension the exact sums of entries and of their squares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, squares = 0, np.zeros(width, object), np.zeros(width, object)
        for batch in batches:
            for x in _opened(batch, width):
                exact = x.astype(np.int64 if float(np.abs(x.astype(np.float64)).max()) ** 2 * len(x) < 2**62 else object)
                n, sums, squares = n + len(x), sums + exact.sum(axis=0).astype(object), squares + (exact * exact).sum(axis=0).astype(object)
        # Squares in two parts, as whole they may be longer than a decimal.
        parts = (sums, [int(v) >> _PART for v in squares], [int(v) & ((1 << _PART) - 1) for v in squares])
        numbers = [pa.array([Decimal(int(v)) for v in c], pa.decimal128(38, 0)) for c in parts]
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([n] * width, pa.int64()), *numbers], ["i", "n", "s", "high", "low"])

    partial = blocks.mapInArrow(run, "i int, n bigint, s decimal(38,0), high decimal(38,0), low decimal(38,0)")
    rows = partial.groupBy("i").agg(*(F.sum(c).alias(c) for c in ("n", "s", "high", "low"))).collect()
    rows = sorted(rows, key=lambda r: r["i"])
    return rows[0]["n"], [int(r["s"]) for r in rows], [(int(r["high"]) << _PART) + int(r["low"]) for r in rows]


def _summed(blocks: DataFrame, mean: np.ndarray, shape: tuple[int, ...], of_block: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """One pass: the sum over all blocks of what ``of_block`` makes of the centred block.

    Each task adds up its own blocks; the partial sums are added by cell. The driver gets one number for each cell.
    """
    size = math.prod(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for x in _opened(batch, len(mean)):
                total += of_block(x - mean)
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total.ravel(), pa.float64())], ["cell", "v"])

    found = blocks.mapInArrow(run, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size)
    out[[r["cell"] for r in found]] = [r["v"] for r in found]
    return out.reshape(shape)


Product = Callable[[np.ndarray], np.ndarray]


def _ends(product: Product, width: int, random: np.random.Generator) -> tuple[float, float]:
    """Bounds of the spectrum by a few Lanczos steps: extreme Ritz values, widened by their residuals, never below zero."""
    basis = [random.standard_normal(width)]
    basis[0] /= np.linalg.norm(basis[0])
    alpha, beta = [], []
    for _ in range(min(width, _LANCZOS)):
        w = product(basis[-1][:, None])[:, 0]
        alpha.append(float(basis[-1] @ w))
        for _ in range(2):
            for b in basis:
                w = w - (b @ w) * b
        beta.append(float(np.linalg.norm(w)))
        if beta[-1] <= 1e-12 * max(map(abs, alpha)):
            break
        basis.append(w / beta[-1])
    ritz, vectors = np.linalg.eigh(np.diag(alpha) + np.diag(beta[: len(alpha) - 1], 1) + np.diag(beta[: len(alpha) - 1], -1))
    errors = beta[-1] * np.abs(vectors[-1])
    return max(0.0, ritz[0] - errors[0]), ritz[-1] + errors[-1]


def _filtered(product: Product, q: np.ndarray, low: float, high: float, top: float, degree: int) -> np.ndarray:
    """A Chebyshev polynomial of the covariance times ``q``: small on low .. high, fast growing above, about 1 at ``top``."""
    centre, half = (high + low) / 2, (high - low) / 2
    sigma = first = half / (top - centre)
    before, now = q, (product(q) - centre * q) * (sigma / half)
    for _ in range(degree - 1):
        next_sigma = 1 / (2 / first - sigma)
        before, now = now, (product(now) - centre * now) * (2 * next_sigma / half) - before * (sigma * next_sigma)
        sigma = next_sigma
    return now


def leading(product: Product, width: int, components: int, extra: int = EXTRA, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Leading eigenvalues (falling) and unit eigenvectors of a symmetric positive operator that is only known by products.

    Each round filters a block of ``components + extra`` directions, makes it orthogonal and takes Ritz values and vectors.
    It ends when the residuals of all components certify them (see TOLERANCE): a residual bounds an eigenvalue's error, and,
    divided by the gap to the next one, its vector's. Each round also takes in a fresh random direction, so that one which
    the start had missed can enter.
    """
    random = np.random.default_rng(seed)
    size = min(width, components + extra)
    components = min(width, components)
    low, top = (0.0, 0.0) if size == width else _ends(product, width, random)
    q = np.eye(width) if size == width else np.linalg.qr(random.standard_normal((width, size)))[0]
    last = math.inf
    for _ in range(_MAX_ROUNDS):
        image = product(q)
        h = q.T @ image
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, image = q @ turn, image @ turn
        worst = float(np.linalg.norm(image[:, :components] - q[:, :components] * values[:components], axis=0).max())
        scale = max(float(values[0]), 0.0)
        if size == width or scale == 0 or worst <= TOLERANCE * scale or last / 2 < worst <= _SETTLED * scale:
            return values[:components], q[:, :components]
        last = worst
        # Unwanted is what lies below the smallest Ritz value of the block.
        low, top = min(low, max(0.0, float(values[-1]))), max(top, scale)
        high = max(float(values[-1]), low + 1e-3 * (scale - low))
        growth = (values[components - 1] - (high + low) / 2) / ((high - low) / 2)
        rate = math.acosh(growth) if growth > 1 else 0.0
        degree = min(_DEGREE, max(2, math.ceil(math.log(_DAMPING) / rate))) if rate else _DEGREE
        q[:, -1] = random.standard_normal(width) / math.sqrt(width)
        q = np.linalg.qr(_filtered(product, q, low, high, top, degree))[0]
    raise RuntimeError(f"the components did not settle in {_MAX_ROUNDS} rounds: residual {last}")


def fit(vectors: DataFrame, width: int, components: int, store: Stored) -> Whitening | None:
    """The whitening of the distinct vectors (x), all of ``width`` entries; None without rows or variance."""
    if not width:
        return None
    blocks = store.keep(_blocks(vectors.select("x").distinct(), width), "blocks")
    if blocks.isEmpty():
        return None
    n, sums, squares = _moments(blocks, width)
    # Exact up to the last division: n * sum of squares less square of the sum.
    trace = sum(n * q - s * s for s, q in zip(sums, squares)) / (n * n)
    if not trace:
        return None
    mean = _mean(sums, n)

    def product(q: np.ndarray) -> np.ndarray:
        return _summed(blocks, mean, q.shape, lambda x: x.T @ (x @ q)) / n

    values, axes = leading(product, width, components)
    some = values > _NO_VARIANCE * values[0]
    values, axes = values[some], axes[:, some]
    c = len(values)
    white = axes / np.sqrt(values)

    def squared(x: np.ndarray) -> np.ndarray:
        w = x @ white
        return np.vstack([w.sum(axis=0), w.T @ w])

    sums_white = _summed(blocks, mean, (c + 1, c), squared) / n
    covariance = sums_white[1:] - np.outer(sums_white[0], sums_white[0])
    store.drop(blocks)
    return Whitening(n, sums, values, axes, values / trace, float(np.abs(covariance - np.eye(c)).max()))


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - S) ** 2, exact; None where it does not fit a long."""
    top = n * float(np.abs(x.astype(np.float64)).max(initial=0)) + max(map(abs, sums), default=0)
    kind = np.int64 if top * top * max(1, x.shape[1]) < 2**62 else object
    apart = x.astype(kind) * n - np.array(sums, kind)
    return [int(v) if v < 2**63 else None for v in (apart * apart).sum(axis=1)]


def whiten(table: DataFrame, components: int = COMPONENTS, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """Vectors of ``table`` (vec_id, embedding, ..), centred, projected on the leading components and scaled to variance 1.

    Entries count in whole steps of 1/256. The components are those of the covariance of the distinct vectors. They are found
    by passes over stored blocks of these, each a product of the covariance with a few directions; the covariance itself is
    never built, and the driver holds a few numbers for each dimension.

    Rows whose vector is null, or holds null or non-finite entries, are dropped. Shorter vectors count as filled up with zeros to the
    longest, empty ones too. Entries beyond what a long can hold are cut to it. Copies of a vector count once in the fit, and
    each gets its rows; rows that repeat vec_id, or have none, are rows of their own. Of components of equal variance any basis may come, the
    same for all rows. Directions without variance are no components: fewer than ``components`` may come, and none if all
    vectors are equal, if there is only one, or if the table is empty. A deviation that does not fit a long is null. Other columns
    are not read.

    Returns vec_id, component (from 1), n (distinct vectors), deviation (exact), whitened, explained (share of the whole variance),
    identity_error (largest departure of the whitened covariance from the identity, the same in all rows).
    """
    store = Stored(table.sparkSession)
    valid = table.select(F.col(key), F.col(vector).alias("v")).filter(_valid("v"))
    width = valid.agg(F.max(F.size("v"))).first()[0] or 0
    vectors = valid.select(F.col(key), _steps("v", width).alias("x"))
    schema = f"{key} {dict(table.dtypes)[key]}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    fitted = fit(vectors, width, components, store)
    if fitted is None:
        return table.sparkSession.createDataFrame([], schema)
    c = len(fitted.values)
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        white = fitted.vectors / np.sqrt(fitted.values)
        for batch in batches:
            x = _rows(batch.column("x"), width)
            each = np.repeat(np.arange(len(x)), c)
            columns = [
                batch.column(key).take(pa.array(each)),
                pa.array(np.tile(np.arange(1, c + 1), len(x)), pa.int32()),
                pa.array(np.full(len(each), fitted.n), pa.int64()),
                pa.array(_deviation(x, fitted.n, fitted.sums), pa.int64()).take(pa.array(each)),
                pa.array(((x - fitted.mean) @ white).ravel(), pa.float64()),
                pa.array(np.tile(fitted.explained, len(x)), pa.float64()),
                pa.array(np.full(len(each), fitted.identity_error), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    return vectors.mapInArrow(run, schema)
