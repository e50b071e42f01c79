"""Embedding whitening by mixed-precision refinement.

Vectors become whole numbers, so that counts, sums and covariances are exact:

    1. one pass adds up the number of vectors and each dimension's sum;
    2. another one centres every vector at the rounded mean and adds up the products of its entries, in whole
       numbers; what rounding the mean left is taken off exactly on the driver, from the sums;
    3. eigenvectors of the covariance in single precision are corrected by the matrix-multiplication iteration of
       Ogita and Aishima in extended precision, each round doubling the digits that are right. Eigenvalues nearer
       to one another than a round can tell apart are a cluster: the covariance less the cluster's mean, projected
       on its vectors, is solved by itself and turns them, so that later rounds see its differences;
    4. a third pass projects the vectors and adds up the covariance of the result, and the last one returns it.

A task adds up its vectors in a matrix; the entries of the tasks' matrices, one row each, are added in Spark. The
driver holds matrices of dimensions x dimensions, whatever the number of vectors.

Defined results: a vector that is null or holds a null, NaN or infinite entry takes no part and has no rows. Rows
that repeat an id, or have none, are vectors of their own. Vectors of different lengths count as if the shorter went
on with zeros; where all are empty there are no components and so no rows. A component without variance (an
eigenvalue of no more than `FLAT` of their sum) can't be whitened: its `whitened` is null and it is left out of
`identity_error`, which is 0 where no component is left. `explained` is null where no vector differs from another.
Entries of 2^46 and more are an error, as are sums of more than 38 digits. An empty table gives no rows. Columns that
are not named to be kept are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

# How entries become whole numbers.
SCALE, OFFSET = 64.0, 1_000_000
COMPONENTS = 32
FLAT = 2.0**-50
ROUNDS = 30
CHUNK = 4096  # vectors worked on together
LIMB = 20  # bits; sums of CHUNK products of two limbs are exact in a double
CELLS = "cell long, total decimal(38,0)"


# Refinement


def _clusters(values: np.ndarray, blur: float) -> list[np.ndarray]:
    """Groups of eigenvalues of which each is within `blur` of the next one."""
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order]) > blur) + 1
    return [group for group in np.split(order, cuts) if len(group) > 1]


def _turned(matrix: np.ndarray, vectors: np.ndarray, values: np.ndarray, group: np.ndarray) -> np.ndarray:
    """A cluster's vectors turned into eigenvectors of the matrix less the cluster's mean, projected on them."""
    own = vectors[:, group]
    small = own.T @ (matrix @ own) - values[group].mean() * (own.T @ own)
    small = (small + small.T) / 2
    largest = np.abs(small).max()
    if not largest:
        return own
    _, turn = np.linalg.eigh((small / largest).astype(np.float64))
    return own @ turn.astype(own.dtype)


def refined(matrix: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns), by falling eigenvalue, of a symmetric matrix, from approximate
    vectors. Works in the precision of the matrix, such as ``np.longdouble``."""
    vectors = start.astype(matrix.dtype)
    unit = np.eye(len(matrix), dtype=matrix.dtype)
    norm = lambda m: np.sqrt((m * m).sum())
    moved = np.inf
    for _ in range(ROUNDS):
        lost = unit - vectors.T @ vectors
        image = vectors.T @ (matrix @ vectors)
        values = np.diag(image) / (1 - np.diag(lost))
        blur = 2 * (norm(image - np.diag(values)) + norm(matrix) * norm(lost))
        gap = values[None, :] - values[:, None]
        near = np.abs(gap) <= blur
        change = np.where(near, lost / 2, (image + values[None, :] * lost) / np.where(near, 1, gap))
        vectors = vectors + vectors @ change
        before, moved = moved, float(np.abs(change).max(initial=0))
        for group in _clusters(values, blur):
            vectors[:, group] = _turned(matrix, vectors, values, group)
        if moved < 1e-9 and moved >= before / 4:
            break  # the digits of this precision are used up
    for _ in range(2):  # what rounding cost in the last round, over gaps that are near
        vectors = vectors + vectors @ (unit - vectors.T @ vectors) / 2
    values = (vectors * (matrix @ vectors)).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def eigenvectors(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of a symmetric matrix of ``np.longdouble``, from a single-precision start. The
    entry of largest magnitude of each vector is positive."""
    largest = np.abs(matrix).max(initial=0)
    if not largest:
        return np.zeros(len(matrix), matrix.dtype), np.eye(len(matrix), dtype=matrix.dtype)
    scaled = matrix / largest
    _, start = np.linalg.eigh(scaled.astype(np.float32))
    values, vectors = refined(scaled, start)
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(matrix))])
    return values * largest, vectors * sign


# Whole numbers


def entries(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a column of vectors: which take part, their lengths, and floor(64 c) of their entries one after another."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    wrong = np.r_[0, np.cumsum(~np.isfinite(values))]
    ends = np.cumsum(lengths)
    usable = (wrong[ends] == wrong[ends - lengths]) & column.is_valid().to_numpy(zero_copy_only=False)
    values = np.floor(values[np.repeat(usable, lengths)] * SCALE)
    if len(values) and np.abs(values).max() >= 2.0**52:
        raise ValueError("an entry of 2^46 or more")
    return usable, lengths[usable], values.astype(np.int64)


def rows_of(lengths: np.ndarray, values: np.ndarray, width: int) -> np.ndarray:
    """The vectors as whole numbers, shorter ones filled with those of zeros."""
    out = np.full((len(lengths), width), OFFSET)
    out[np.arange(width) < lengths[:, None]] = values + OFFSET
    return out


def exact_products(rows: np.ndarray) -> np.ndarray:
    """The sums of products of whole numbers, as Python's."""
    limbs, rest = [], rows
    while rest.any() or not limbs:
        low = ((rest + (1 << LIMB - 1)) & (1 << LIMB) - 1) - (1 << LIMB - 1)
        limbs.append(low.astype(np.float64))
        rest = (rest - low) >> LIMB
    total = np.zeros((rows.shape[1], rows.shape[1]), object)
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs):
            total += (a.T @ b).astype(np.int64).astype(object) * (1 << LIMB * (i + j))
    return total


def deviations(rows: np.ndarray, n: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n x - S of each entry as doubles, and the exact sum of their squares for each row."""
    if n * (int(np.abs(rows).max(initial=0)) + 1) < 1 << 62:
        apart = n * rows - sums.astype(np.int64)
        if int(np.abs(apart).max(initial=0)) ** 2 * max(rows.shape[1], 1) < 1 << 62:
            return apart.astype(np.float64), (apart * apart).sum(axis=1)
    apart = n * rows.astype(object) - sums
    return apart.astype(np.float64), (apart * apart).sum(axis=1)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, CHUNK):
            yield batch.slice(begin, CHUNK)


def _cells(totals: dict[int, int]) -> pa.RecordBatch:
    return pa.record_batch({
        "cell": pa.array(totals.keys(), pa.int64()), "total": pa.array([Decimal(int(t)) for t in totals.values()], pa.decimal128(38, 0))})


def _added(rows: DataFrame, run, kinds: str = CELLS) -> dict:
    """The cells that the tasks return, added up: as many as a matrix has, whatever the number of tasks."""
    return {r["cell"]: r["total"] for r in rows.mapInArrow(run, kinds).groupBy("cell").agg(F.sum("total").alias("total")).collect()}


# The fit


@dataclass(frozen=True)
class Fit:
    n: int
    sums: np.ndarray  # of whole numbers, exact
    values: np.ndarray  # the components' eigenvalues
    vectors: np.ndarray  # and their vectors as columns
    trace: float

    @property
    def scales(self) -> np.ndarray:
        """What projections are divided by; NaN for components without variance."""
        flat = ~(self.values > FLAT * self.trace)
        return np.sqrt(np.where(flat, np.nan, self.values))

    def whitened(self, apart: np.ndarray) -> np.ndarray:
        return (apart / self.n) @ self.vectors / self.scales


def _upper(width: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(width)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """The components of a table with a column `v` of vectors; None if no vector takes part."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(0, object)
        for batch in _chunks(batches):
            _, lengths, values = entries(batch.column(batch.schema.get_field_index("v")))
            width = int(lengths.max(initial=0))
            rows = rows_of(lengths, values, width) - OFFSET
            n += len(rows)
            sums = np.concatenate([sums, np.zeros(max(0, width - len(sums)), object)])
            sums[:width] += rows.sum(axis=0) if np.abs(rows).max(initial=0) < 1 << 50 else rows.astype(object).sum(axis=0)
        yield _cells({-1: n, **dict(enumerate(sums))})

    totals = _added(vectors.select("v"), counted)
    n = int(totals.pop(-1, 0))
    if not n:
        return None
    sums = np.array([int(totals[d]) + n * OFFSET for d in range(len(totals))], object)
    width = len(sums)
    centre = np.array([round(2 * s + n) // (2 * n) for s in sums], np.int64)
    upper = _upper(width)

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width), object)
        for batch in _chunks(batches):
            _, lengths, values = entries(batch.column(0))
            total += exact_products(rows_of(lengths, values, width) - centre)
        yield _cells(dict(enumerate(total[upper])))

    products = _added(vectors.select("v"), multiplied)
    left = sums - n * centre.astype(object)  # what the rounded mean left of each sum
    matrix = np.zeros((width, width), np.longdouble)
    for cell, (i, j) in enumerate(zip(*upper)):
        matrix[i, j] = matrix[j, i] = np.longdouble(n * int(products[cell]) - left[i] * left[j])
    matrix /= np.longdouble(n) * np.longdouble(n)
    values, found = eigenvectors(matrix)
    return Fit(n, sums, values[:components].astype(np.float64), found[:, :components].astype(np.float64), float(np.trace(matrix)))


def identity_error(vectors: DataFrame, found: Fit) -> float:
    """The largest entry, in magnitude, of the covariance of the whitened vectors less the identity."""
    live = np.flatnonzero(np.isfinite(found.scales))
    upper, width = _upper(len(live)), len(found.sums)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(len(live)), np.zeros((len(live), len(live)))
        for batch in _chunks(batches):
            _, lengths, values = entries(batch.column(0))
            rows = found.whitened(deviations(rows_of(lengths, values, width), found.n, found.sums)[0])[:, live]
            sums += rows.sum(axis=0)
            products += rows.T @ rows
        flat = np.r_[products[upper], sums]
        yield pa.record_batch({"cell": pa.array(np.arange(len(flat)), pa.int64()), "total": pa.array(flat)})

    totals = _added(vectors.select("v"), added, "cell long, total double")
    mean = np.array([totals[len(upper[0]) + d] for d in range(len(live))]) / found.n
    error = np.array([totals[cell] for cell in range(len(upper[0]))]) / found.n - mean[upper[0]] * mean[upper[1]] - (upper[0] == upper[1])
    return float(np.abs(error).max(initial=0))


def whitened(vectors: DataFrame, vector: str = "embedding", keep: Sequence[str] = ("vec_id",), components: int = COMPONENTS) -> DataFrame:
    """A row for each vector that takes part and component: the kept columns, component (from 1), n, deviation
    (the sum of squares of n x - S, as a decimal), whitened, explained, identity_error."""
    keep = list(keep)
    rows = vectors.select(*keep, F.col(vector).cast("array<double>").alias("_v"))
    only = rows.select(F.col("_v").alias("v"))
    found = fit(only, components)
    named = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    kinds = f"{named}, _deviation decimal(38,0), _whitened array<double>" if keep else "_deviation decimal(38,0), _whitened array<double>"
    if found is None:
        return _unfolded(vectors.sparkSession.createDataFrame([], kinds), keep, 0, [], 0.0)
    width = len(found.sums)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches):
            usable, lengths, values = entries(batch.column(batch.num_columns - 1))
            apart, squares = deviations(rows_of(lengths, values, width), found.n, found.sums)
            out = found.whitened(apart)
            flat = pa.array(out.ravel(), mask=np.isnan(out.ravel()))
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * out.shape[1], pa.int32()), flat)
            exact = pa.array([Decimal(int(s)) for s in squares], pa.decimal128(38, 0))
            chosen = batch.filter(pa.array(usable))
            yield pa.RecordBatch.from_arrays([*chosen.columns[:-1], exact, listed], names=[*keep, "_deviation", "_whitened"])

    shares = [float(v / found.trace) if found.trace else None for v in found.values]
    return _unfolded(rows.mapInArrow(projected, kinds), keep, found.n, shares, identity_error(only, found))


def _unfolded(rows: DataFrame, keep: list[str], n: int, shares: list[float | None], error: float) -> DataFrame:
    each = rows.select(*keep, "_deviation", F.posexplode("_whitened").alias("_at", "_value"))
    explained: Column = F.element_at(F.array(*[F.lit(s).cast("double") for s in shares]), F.col("_at") + 1) if shares else F.lit(None).cast("double")
    return each.select(
        *keep, (F.col("_at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), F.col("_deviation").alias("deviation"),
        F.col("_value").alias("whitened"), explained.alias("explained"), F.lit(error).alias("identity_error"))
