"""Whitening of embeddings by the leading components of their covariance.

Entries are put on an integer grid, so sums and products over all rows are exact and do not
depend on how the rows are spread: one pass counts and sums, a second adds up products of
entries centred on the integer mean. What reaches the driver is one number per pair of
dimensions, whatever the number of rows.

The components come from contour integrals (FEAST). Counts of negative pivots of shifted
covariances say how many eigenvalues lie in an interval; intervals are cut until each holds
few of them. For every interval the resolvent is integrated around it by Gauss-Legendre
quadrature, one complex solve per node, which projects random vectors onto the wanted space;
a Rayleigh-Ritz step extracts eigenpairs, and the loop ends when their residuals are at
rounding level and their number is the one counted. Intervals are worked on side by side as
rows of a DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMPONENTS = 32
SCALE, OFFSET = 64, 1_000_000
#: Eigenvalues an interval may hold before it is cut again, and cuts of one round.
CROWD, CUTS = 8, 24
NODES = 8
#: Shares of the trace: smallest eigenvalue that counts as a component, smallest interval.
FLAT, NARROW = 1e-12, 1e-10
ROUNDS = 40
_LOW = 40
_BOUND = float(2**62)


def _rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row its length (-1 for a row to drop) and start, and all entries as doubles."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten() if column.null_count == 0 else column.values
    begin = column.offsets.to_numpy()[:-1] - (column.offsets[0].as_py() if column.null_count == 0 else 0)
    entries = values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(entries))])
    lengths = np.where(bad[begin + lengths] > bad[begin], -1, lengths)
    if column.null_count:
        lengths = np.where(column.is_null().to_numpy(zero_copy_only=False), -1, lengths)
    return lengths, begin, entries


def _grid(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of that width, their entries on the grid without the offset)."""
    lengths, begin, entries = _rows(column)
    at = np.flatnonzero(lengths == width)
    x = np.floor(SCALE * entries[begin[at, None] + np.arange(width)])
    return at, np.clip(x, -_BOUND, _BOUND).astype(np.int64)


def _big(values: np.ndarray, n: int, power: int = 1) -> np.ndarray:
    """The same numbers in a form whose sums of ``n`` (products of) them are exact."""
    most = int(np.abs(values).max(initial=0))
    return values if most**power * max(n, 1) < 2**62 else values.astype(object)


def _halves(total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (total >> _LOW).astype(np.int64), (total & ((1 << _LOW) - 1)).astype(np.int64)


def _whole(high: int, low: int) -> int:
    return (int(high) << _LOW) + int(low)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, list] = {}
    for batch in batches:
        for width in np.unique(_rows(batch.column(0))[0]):
            if width < 1:
                continue
            at, x = _grid(batch.column(0), int(width))
            high, low = _halves(_big(x, len(at)).sum(axis=0))
            had = found.setdefault(int(width), [0, np.zeros(width, np.int64), np.zeros(width, np.int64)])
            had[0] += len(at)
            had[1] += high
            had[2] += low
    for width, (n, high, low) in found.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(width, width, np.int32)), pa.array(np.arange(width, dtype=np.int32)),
             pa.array(np.full(width, n, np.int64)), pa.array(high), pa.array(low)],
            ["width", "i", "n", "high", "low"])


def _products(batches: Iterator[pa.RecordBatch], middle: np.ndarray) -> Iterator[pa.RecordBatch]:
    d = len(middle)
    high, low = np.zeros((d, d), np.int64), np.zeros((d, d), np.int64)
    for batch in batches:
        at, x = _grid(batch.column(0), d)
        y = x - middle
        most = int(np.abs(y).max(initial=0))
        if most * most * len(at) < 2**53:
            product = (y.T.astype(float) @ y.astype(float)).astype(np.int64)
        else:
            y = _big(y, len(at), 2)
            product = y.T @ y
        h, r = _halves(product)
        high += h
        low += r
    i, j = np.triu_indices(d)
    yield pa.RecordBatch.from_arrays(
        [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(high[i, j]), pa.array(low[i, j])],
        ["i", "j", "high", "low"])


@dataclass
class Fit:
    """Row count, sum per dimension without the offset, integer middle, covariance."""

    n: int
    sums: list[int]
    middle: np.ndarray
    covariance: np.ndarray


def fit(vectors: DataFrame) -> Fit | None:
    """Moments of all vectors (one array column) that are whole and finite, exactly.

    The width is that of most vectors, the larger of two as frequent; others stay outside.
    """
    sums = vectors.mapInArrow(_sums, "width int, i int, n long, high long, low long").groupBy("width", "i").agg(
        F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low"))
    widest = sums.where("i = 0").orderBy(F.desc("n"), F.desc("width")).limit(1)
    rows = sums.join(widest.select("width"), "width", "left_semi").orderBy("i").collect()
    if not rows:
        return None
    n = rows[0]["n"]
    total = [_whole(r["high"], r["low"]) for r in rows]
    middle = [round_div(s, n) for s in total]
    centre = np.array(middle, np.int64)
    pairs = vectors.mapInArrow(lambda b: _products(b, centre), "i int, j int, high long, low long").groupBy("i", "j").agg(
        F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    d = len(total)
    rest = [s - n * m for s, m in zip(total, middle)]
    covariance = np.zeros((d, d))
    for r in pairs:
        i, j = r["i"], r["j"]
        # Exact in integers up to the one division.
        covariance[i, j] = covariance[j, i] = (n * _whole(r["high"], r["low"]) - rest[i] * rest[j]) / (n * n)
    return Fit(n, total, centre, covariance)


def round_div(a: int, b: int) -> int:
    return (2 * a + b) // (2 * b)


def negative_pivots(matrix: np.ndarray) -> int:
    """Negative eigenvalues of a symmetric matrix, by pivots of one or two rows (Sylvester)."""
    a = np.array(matrix, float)
    count = 0
    while len(a):
        spread = np.abs(a)
        diagonal = spread.diagonal()
        k = int(diagonal.argmax())
        most = spread.max()
        if most == 0:
            return count
        if diagonal[k] >= 0.64 * most:
            pivot = [k]
            count += int(a[k, k] < 0)
        else:
            pivot = list(np.unravel_index(spread.argmax(), spread.shape))
            count += 1
        rest = np.setdiff1d(np.arange(len(a)), pivot)
        off = a[np.ix_(rest, pivot)]
        a = a[np.ix_(rest, rest)] - off @ np.linalg.solve(a[np.ix_(pivot, pivot)], off.T)
        a = (a + a.T) / 2
    return count


def _each(spark: SparkSession, n: int, work: Callable[[int], list[tuple]], schema: str) -> list:
    """``work(i)`` for i below n, one task each; the rows of all."""
    names = [part.strip().split(" ")[0] for part in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([row for i in frame["id"] for row in work(int(i))], columns=names)

    return spark.range(0, n, 1, n).mapInPandas(run, schema).collect()


def intervals(spark: SparkSession, v: np.ndarray, wanted: int) -> list[tuple[float, float, int]]:
    """Intervals (low, high, eigenvalues in it), highest first, with the ``wanted`` largest.

    A cut is only made where no eigenvalue is close, so that both sides agree on the count.
    """
    trace = float(np.trace(v))
    d, near = len(v), NARROW * trace
    ends = [FLAT * trace, trace * (1 + 1e-6)]

    def above(shift: float) -> int:
        return negative_pivots(shift * np.eye(d) - v)

    known = dict(zip(ends, (above(e) for e in ends)))
    while True:
        cuts = sorted(known)
        crowded = [
            (a, b) for a, b in zip(cuts, cuts[1:])
            if known[a] - known[b] > CROWD and known[b] < wanted and b - a > 4 * CUTS * near]
        if not crowded:
            break
        shifts = [a + (b - a) * k / CUTS for a, b in crowded for k in range(1, CUTS)]
        counted = _each(
            spark, len(shifts), lambda i: [(i, above(shifts[i] - near), above(shifts[i] + near))],
            "i long, below long, over long")
        fresh = {shifts[r["i"]]: r["over"] for r in counted if r["below"] == r["over"]}
        if not fresh:
            break
        known |= fresh
    # Empty stretches go; neighbours are joined while they hold few.
    out: list[tuple[float, float, int]] = []
    cuts = sorted(known, reverse=True)
    for b, a in zip(cuts, cuts[1:]):
        count = known[a] - known[b]
        if count and known[b] < wanted:
            if out and out[-1][2] + count <= CROWD and out[-1][0] == b:
                out[-1] = (a, out[-1][1], out[-1][2] + count)
            else:
                out.append((a, b, count))
    return out


def eigenpairs(v: np.ndarray, low: float, high: float, count: int, *, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs with values in (low, high), by quadrature and Rayleigh-Ritz."""
    d, scale = len(v), max(float(np.abs(v).sum(axis=1).max()), 1e-300)
    points, weights = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(1j * np.pi / 2 * (1 - points))
    middle, radius = (low + high) / 2, (high - low) / 2
    size, best = min(d, 2 * count + 8), np.inf
    draw = np.random.default_rng(seed)
    y = draw.standard_normal((d, size))
    for step in range(ROUNDS):
        q = np.zeros((d, size))
        for t, w in zip(turn, weights):
            solved = np.linalg.solve((middle + radius * t) * np.eye(d) - v, y.astype(complex))
            q += w / 2 * (radius * t * solved).real
        basis, _ = np.linalg.qr(q)
        values, small = np.linalg.eigh(basis.T @ v @ basis)
        y = basis @ small
        residual = np.linalg.norm(v @ y - y * values, axis=0) / scale
        inside = (values > low) & (values < high)
        worst = residual[inside].max(initial=0)
        if inside.sum() == count and worst < 1e-14 * d and (worst > best / 2 or worst < 1e-15):
            return values[inside], y[:, inside]
        best = min(best, worst) if inside.sum() == count else np.inf
        if step % 10 == 9 and size < d:
            more = min(d - size, size)
            y, size = np.hstack([y, draw.standard_normal((d, more))]), size + more
    raise ArithmeticError(f"{count} eigenvalues counted in ({low}, {high}), {int(inside.sum())} found")


def components(spark: SparkSession, v: np.ndarray, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues above rounding level, falling, and their unit vectors as rows.

    The sign makes the largest entry of a vector positive.
    """
    d = len(v)
    if not np.trace(v) > 0:
        return np.zeros(0), np.zeros((0, d))
    parts = intervals(spark, v, wanted)

    def solve(i: int) -> list[tuple]:
        values, vectors = eigenpairs(v, *parts[i])
        return [(float(e), [float(x) for x in u]) for e, u in zip(values, vectors.T)]

    pairs = sorted(_each(spark, len(parts), solve, "e double, u array<double>"), key=lambda r: -r["e"])[:wanted]
    vectors = np.array([r["u"] for r in pairs]).reshape(-1, d)
    top = np.abs(vectors).argmax(axis=1)
    vectors *= np.sign(vectors[np.arange(len(vectors)), top])[:, None]
    return np.array([r["e"] for r in pairs]), vectors


def _deviations(y: np.ndarray, rest: np.ndarray, n: int) -> list[int | None]:
    """Sums of squares of n*y - rest, exact; none where that exceeds a long."""
    most = n * int(np.abs(y).max(initial=0)) + int(np.abs(rest).max(initial=0))
    if most * most * y.shape[1] < 2**63:
        return ((n * y - rest) ** 2).sum(axis=1).tolist()
    wide = n * y.astype(object) - rest.astype(object)
    return [int(s) if s < 2**63 else None for s in (wide * wide).sum(axis=1)]


def whiten(rows: DataFrame, vector: str, *, wanted: int = COMPONENTS) -> DataFrame:
    """The rows with a whole, finite vector, and for each component (numbered from 1 by falling
    eigenvalue) the columns component, n, deviation, whitened, explained, identity_error.

    The other columns of ``rows`` stay but for those names. Components are those with an
    eigenvalue above rounding level, so equal vectors, or none, give no rows; null vectors,
    vectors with null or non-finite entries, empty ones, and those of another length than most
    are dropped. Repeated rows count as often as they stand. Entries beyond a long saturate;
    a deviation beyond a long is null.
    """
    spark = rows.sparkSession
    made = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    kept = [c for c in rows.columns if c != vector and c not in made]
    carried = rows.select(F.col(vector).cast("array<double>").alias("__v"), *[F.col(c).alias(f"__c{i}") for i, c in enumerate(kept)])
    found = fit(carried.select("__v"))
    values, vectors = (np.zeros(0), None) if found is None else components(spark, found.covariance, wanted)
    types = {f.name: f.dataType.simpleString() for f in carried.schema.fields}
    fields = "".join(f"{c} {types[c]}, " for c in carried.columns[1:]) + "deviation long, __w array<double>"
    if not len(values):
        out = carried.where(F.lit(False)).select(
            *carried.columns[1:], F.lit(0).cast("long").alias("deviation"), F.array(F.lit(0.0)).alias("__w"))
        error, share, n = 0.0, [0.0], 0
    else:
        n, middle, d, k = found.n, found.middle, len(found.sums), len(values)
        rest = np.array([s - n * int(m) for s, m in zip(found.sums, middle)], np.int64)
        turn = (vectors / np.sqrt(values)[:, None]).T
        share = [float(e) / float(np.trace(found.covariance)) for e in values]

        def projected(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            at, x = _grid(column, d)
            y = x - middle
            return at, y, (y - rest / n) @ turn

        def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((k + 1, k + 1))
            for batch in batches:
                _, _, w = projected(batch.column(0))
                w = np.hstack([w, np.ones((len(w), 1))])
                total += w.T @ w
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())],
                ["i", "j", "s"])

        sums = np.zeros((k + 1, k + 1))
        for r in carried.select("__v").mapInArrow(moments, "i int, j int, s double").groupBy("i", "j").agg(
                F.sum("s").alias("s")).collect():
            sums[r["i"], r["j"]] = r["s"]
        mean = sums[:k, k] / n
        error = float(np.abs(sums[:k, :k] / n - np.outer(mean, mean) - np.eye(k)).max())

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, y, w = projected(batch.column(0))
                offsets = pa.array(np.arange(len(at) + 1, dtype=np.int32) * k)
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(pa.array(at)) for c in batch.columns[1:]),
                     pa.array(_deviations(y, rest, n), pa.int64()),
                     pa.ListArray.from_arrays(offsets, pa.array(w.ravel()))],
                    [*batch.schema.names[1:], "deviation", "__w"])

        out = carried.mapInArrow(emit, fields)
    each = out.select(
        *[F.col(f"__c{i}").alias(c) for i, c in enumerate(kept)], "deviation", F.posexplode("__w").alias("__k", "whitened"))
    return each.select(
        *kept, (F.col("__k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(F.array(*map(F.lit, share)), F.col("__k")).alias("explained"), F.lit(error).alias("identity_error"))
