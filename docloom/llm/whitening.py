"""Whitening of vectors by the leading eigenvectors of their covariance, isolated by spectrum slicing."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.vectors import matrices, sound
from docloom.sources.tables import materialize

SCALE, SHIFT = 1024, 100_000
#: Larger components count as this, so that a lattice value always fits a long.
LARGEST = 1 << 62
#: Shares of the trace: eigenvalues below ZERO count as none, those closer than CLUSTER as one of several.
ZERO, CLUSTER = 1e-11, 1e-12
#: Lengths of vectors are fitted together as long as they add up to so many dimensions.
DIMENSIONS = 1 << 18
#: Of Bunch and Parlett's pivoting.
_ALPHA = (1 + 17 ** 0.5) / 8


def eigenvalues_above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix exceed ``shift``.

    By Sylvester's law of inertia these are the positive eigenvalues of D in
    matrix - shift * I = L D Lᵀ. Complete pivoting with blocks of one and two
    rows keeps the factors bounded; a block of two is always indefinite.
    """
    a, count = matrix - shift * np.eye(len(matrix)), 0
    while n := len(a):
        diagonal = np.abs(np.diagonal(a))
        p = int(diagonal.argmax())
        off = np.abs(a)
        np.fill_diagonal(off, 0)
        r, s = divmod(int(off.argmax()), n)
        if diagonal[p] >= _ALPHA * off[r, s]:
            if not diagonal[p]:
                break
            rest = np.delete(np.arange(n), p)
            column, pivot = a[rest, p], a[p, p]
            count += pivot > 0
            a = a[np.ix_(rest, rest)] - np.outer(column, column / pivot)
        else:
            rest = np.delete(np.arange(n), [r, s])
            columns = a[np.ix_(rest, [r, s])]
            count += 1
            a = a[np.ix_(rest, rest)] - columns @ np.linalg.solve(a[np.ix_([r, s], [r, s])], columns.T)
    return int(count)


@dataclass
class Spectrum:
    """Leading eigenpairs of a covariance, numbered by falling eigenvalue; ``certified`` if inertia counts confirm each number."""
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    certified: bool


def leading(matrix: np.ndarray, components: int) -> Spectrum:
    """Up to ``components`` leading eigenpairs of a positive semidefinite matrix by spectrum slicing.

    Bisection by inertia counts narrows an interval until it holds the kth
    eigenvalue alone, or several that are closer than CLUSTER of the trace.
    Inverse iteration from its middle starts Rayleigh quotient iteration, which
    converges cubically; a quotient that leaves the interval halves it and
    starts again. Each vector is kept orthogonal to those before it, which
    gives equal eigenvalues orthogonal vectors too. At the end counts on both
    sides of the quotient confirm its number. Eigenvalues of less than ZERO of
    the trace count as zero: they end the list.
    """
    d, trace = len(matrix), float(np.trace(matrix))
    values: list[float] = []
    vectors = np.zeros((0, d))
    certified = True
    if not trace > 0:
        return Spectrum(np.zeros(0), vectors, trace, True)
    counted: dict[float, int] = {-1e-9 * trace: d, trace * (1 + 1e-9): 0}

    def count(shift: float) -> int:
        if shift not in counted:
            counted[shift] = eigenvalues_above(matrix, shift)
        return counted[shift]

    for k in range(1, min(components, d) + 1):
        low = max(s for s, n in counted.items() if n >= k)
        high = min(s for s, n in counted.items() if n < k and s > low)

        def halve() -> None:
            nonlocal low, high
            middle = (low + high) / 2
            low, high = (middle, high) if count(middle) >= k else (low, middle)

        while (count(low) != k or count(high) != k - 1) and high - low > CLUSTER * trace:
            halve()
        if high <= ZERO * trace:
            break
        start = np.random.default_rng(k).standard_normal(d)
        value, vector = _iterate(matrix, (low + high) / 2, start, vectors)
        near = 64 * CLUSTER * trace
        while (not low <= value <= high or np.linalg.norm(matrix @ vector - value * vector) > near / 4) and high - low > CLUSTER * trace:
            halve()
            value, vector = _iterate(matrix, (low + high) / 2, start, vectors)
        if value <= ZERO * trace:
            break
        certified &= count(value - near) >= k > count(value + near)
        values.append(value)
        vectors = np.vstack([vectors, vector])
    return Spectrum(np.array(values), vectors, trace, bool(certified))


def _iterate(matrix: np.ndarray, shift: float, start: np.ndarray, found: np.ndarray) -> tuple[float, np.ndarray]:
    """Rayleigh quotient iteration after two steps of inverse iteration at ``shift``, orthogonal to ``found``."""
    identity, scale = np.eye(len(matrix)), np.abs(matrix).max()

    def unit(x: np.ndarray) -> np.ndarray:
        for _ in range(2):
            x = x - found.T @ (found @ x)
            x = x / np.linalg.norm(x)
        return x

    def solved(shift: float, x: np.ndarray) -> np.ndarray:
        while True:
            try:
                y = np.linalg.solve(matrix - shift * identity, x)
                if np.isfinite(y).all():
                    return y
            except np.linalg.LinAlgError:
                pass
            shift += 4 * np.finfo(float).eps * scale

    x = unit(start)
    for _ in range(2):
        x = unit(solved(shift, x))
    value, least = float(x @ matrix @ x), np.inf
    for _ in range(50):
        residual = np.linalg.norm(matrix @ x - value * x)
        if residual >= least / 2 and least < 1e-8 * scale:
            break
        best, least = (value, x), residual
        x = unit(solved(value, x))
        value = float(x @ matrix @ x)
    return best


def _lattice(vectors: np.ndarray, scale: int, shift: int) -> np.ndarray:
    """floor(scale * c) + shift as longs, at most LARGEST."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(vectors * float(scale)), -LARGEST, LARGEST).astype(np.int64) + shift


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: as longs where squares and their sums fit, as Python integers otherwise."""
    if not x.size:
        return np.zeros(x.shape, np.int64)
    most = n * (max(int(x.max()), -int(x.min())) + 1) + max(map(abs, sums))
    if most * most * x.shape[1] < 1 << 63:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _partial_sums(scale: int, shift: int) -> Callable:
    """(dims, place, n, high, low) of a partition: the sum of x at a place is high * 2^32 + low; place -1 has the rows alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for places, matrix in matrices(batch.column(0)):
                x = _lattice(matrix, scale, shift)
                n, high, low = held.get(d := x.shape[1], (0, 0, 0))
                held[d] = n + len(places), high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0)
        for d, (n, high, low) in held.items():
            columns = [np.full(d + 1, d), np.arange(-1, d), np.r_[n, np.zeros(d, np.int64)], np.r_[0, high], np.r_[0, low]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["dims", "place", "n", "high", "low"])
    return run


def _partial_products(fitted: dict[int, tuple[int, list[int]]], scale: int, shift: int) -> Callable:
    """(dims, i, j, s) of a partition: the sum of products of centred components, for i <= j."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, matrix in matrices(batch.column(0)):
                d = matrix.shape[1]
                n, sums = fitted[d]
                y = (_deviations(_lattice(matrix, scale, shift), n, sums) / n).astype(float)
                held[d] = held.get(d, 0) + y.T @ y
        for d, gram in held.items():
            i, j = np.triu_indices(d)
            for at in range(0, len(i), 1 << 16):
                part = slice(at, at + (1 << 16))
                columns = [np.full(len(i[part]), d), i[part], j[part]]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(gram[i[part], j[part]])], ["dims", "i", "j", "s"])
    return run


def _solve(counts: dict[int, int], components: int) -> Callable:
    def run(products: pd.DataFrame) -> pd.DataFrame:
        d = int(products["dims"].iloc[0])
        i, j, s = (products[c].to_numpy() for c in ("i", "j", "s"))
        matrix = np.zeros((d, d))
        matrix[i, j] = matrix[j, i] = s / counts[d]
        return pd.DataFrame({"dims": [d], "model": [pickle.dumps(leading(matrix, components))]})
    return run


def _project(fitted: dict[int, tuple[int, list[int]]], models: dict[int, Spectrum], scale: int, shift: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, matrix in matrices(batch.column(1)):
                d = matrix.shape[1]
                n, sums = fitted[d]
                model, deviations = models[d], _deviations(_lattice(matrix, scale, shift), n, sums)
                total = (deviations * deviations).sum(1) if d else np.zeros(len(places), np.int64)
                white = ((deviations / n).astype(float) @ model.vectors.T) / np.sqrt(model.values)
                k = white.shape[1]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(places)), pa.array(np.full(len(places), d), pa.int32()),
                    pa.array([int(t) if t < 1 << 63 else None for t in total], pa.int64()), pa.array(total.astype(float)),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(places) + 1) * k, pa.int32()), pa.array(white.ravel()))],
                    ["vec_id", "dims", "deviation", "deviation_double", "white"])
    return run


def _bins(lengths: list[int]) -> Iterator[list[int]]:
    held: list[int] = []
    for d in sorted(lengths):
        if held and sum(held) + d > DIMENSIONS:
            yield held
            held = []
        held.append(d)
    if held:
        yield held


def whiten(vectors: DataFrame, components: int = 8, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, deviation_double, certified), a row for each vector and component.

    Components c become longs x = floor(scale * c) + shift. The covariance is
    that of all vectors that take part, centred before multiplying, divisor n.
    Components are its leading unit eigenvectors, numbered from 1 by falling
    eigenvalue, found by spectrum slicing (``leading``) and the same for all
    rows; ``certified`` tells that inertia counts confirm every number.
    ``whitened`` is x - S/n projected on the component over the root of its
    eigenvalue; ``identity_error`` is measured on those values, over all rows.

    Vectors that are null or hold null or non-finite components take no part;
    ids may be null or repeated, equal rows are given each. Vectors of each
    length are a fit of their own. A component beyond +-2^62 / scale counts as
    that bound. ``deviation`` is exact, and null where it does not fit a long
    (``deviation_double`` has it then). Eigenvalues below ZERO of the trace are
    no components, so constant or empty vectors, or fewer than two distinct
    ones, give no rows; nor does an empty table. Other columns are not read.

    The table is read three times: for sums, for products of centred
    components (each task sends its d * (d + 1) / 2 sums, added up by place),
    and to project. The driver gets sums and eigenvectors only. Lengths are
    fitted together up to DIMENSIONS in all, so what is broadcast is bounded.
    """
    rows = sound(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"))
    sums = rows.select("embedding").mapInArrow(_partial_sums(scale, shift), "dims long, place long, n long, high long, low long")
    dec = lambda c: F.sum(F.col(c).cast("decimal(20,0)"))
    totals = materialize(sums.groupBy("dims", "place").agg(F.sum("n").alias("n"), dec("high").alias("high"), dec("low").alias("low")), "sums")
    lengths = [r.dims for r in totals.filter("place = -1").select("dims").collect()]
    parts = [_fit_lengths(rows, totals, dims, len(lengths) == len(dims), components, scale, shift) for dims in _bins(lengths)]
    found = parts[0] if parts else _fit_lengths(rows.limit(0), totals.limit(0), [], True, components, scale, shift)
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def _fit_lengths(rows: DataFrame, totals: DataFrame, dims: list[int], whole: bool, components: int, scale: int, shift: int) -> DataFrame:
    spark = rows.sparkSession
    counts: dict[int, int] = {}
    sums: dict[int, list[int]] = {d: [0] * d for d in dims}
    for r in (totals if whole else totals.filter(F.col("dims").isin(dims))).collect():  # at most 2 * DIMENSIONS rows
        if r.place < 0:
            counts[r.dims] = r.n
        else:
            sums[r.dims][r.place] = (int(r.high) << 32) + int(r.low)
    fitted = {d: (counts[d], sums[d]) for d in dims}
    own = rows if whole else rows.filter(F.size("embedding").isin(dims))
    products = own.select("embedding").mapInArrow(_partial_products(fitted, scale, shift), "dims long, i long, j long, s double")
    summed = products.groupBy("dims", "i", "j").agg(F.sum("s").alias("s"))
    models = {d: Spectrum(np.zeros(0), np.zeros((0, d)), 0.0, True) for d in dims}
    models |= {r.dims: pickle.loads(r.model) for r in summed.groupBy("dims").applyInPandas(_solve(counts, components), "dims long, model binary").collect()}
    white = materialize(own.mapInArrow(_project(fitted, models, scale, shift), "vec_id long, dims int, deviation long, deviation_double double, white array<double>"), "white")
    error = _identity_error(white, components)
    facts = spark.createDataFrame([(d, counts[d], [float(v / m.trace) for v in m.values], m.certified) for d, m in models.items()], "dims int, n long, shares array<double>, certified boolean")
    placed = white.select("vec_id", "dims", "deviation", "deviation_double", F.posexplode("white").alias("place", "whitened")).join(F.broadcast(facts), "dims")
    return placed.select(
        "vec_id", (F.col("place") + 1).cast("int").alias("component"), "n", "deviation", "whitened", F.get("shares", F.col("place")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"), "deviation_double", "certified")


def _identity_error(white: DataFrame, components: int) -> float | None:
    """The largest absolute entry of the covariance of ``white`` less the identity, over all lengths of vectors."""
    at = lambda i: F.get("white", F.lit(i))
    pairs = [(i, j) for i in range(components) for j in range(i + 1)]
    means = [F.avg(at(i)).alias(f"m{i}") for i in range(components)]
    products = [F.avg(at(i) * at(j)).alias(f"p{i}_{j}") for i, j in pairs]
    entry = [F.abs(F.col(f"p{i}_{j}") - F.col(f"m{i}") * F.col(f"m{j}") - F.lit(float(i == j))) for i, j in pairs]
    by_length = white.groupBy("dims").agg(*means, *products)
    return by_length.agg(F.max(F.array_max(F.array(*entry)))).first()[0]
