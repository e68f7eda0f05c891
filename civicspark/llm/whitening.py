"""Operator 13: embedding whitening. Leading eigenpairs by spectrum slicing and Rayleigh quotient iteration.

Vectors become integer vectors x = floor(256 * c). Spark makes the list of distinct ones and their sums, and
then sums the products of centred entries over it; what reaches the driver has the size of the dimension
squared, whatever the table. There the number of negative pivots of an LDLᵀ factorisation of V - s*I tells
how many eigenvalues are below s. Halving by these counts isolates each leading eigenvalue, Rayleigh quotient
iteration converges to it from inside its interval, and counts on both sides of the result certify its
number. A last pass over the distinct vectors measures the covariance of what was whitened.

Edge cases: rows whose vector is null, or holds an entry that is null, not finite or too large for a long
after scaling, are dropped; so are vectors whose length is not the commonest one (of equally common lengths
the larger). Null and repeated ids stay, repeated vectors count once in the fit. Components whose eigenvalue
is 0 to working precision have no whitened value and are left out, so a table with one distinct vector, with
empty vectors only, or without rows gives no rows. Equal eigenvalues get orthogonal components in any
rotation. A ``deviation`` too large for a long is null. Extra columns are dropped, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.llm.common import ensure_checkpoint_dir, removed, table

SCALE = 256.0
LONG = float(1 << 63)
ROWS_AT_ONCE = 4096


def inertia(matrix: np.ndarray) -> int:
    """How many eigenvalues of a symmetric matrix are negative: pivots of LDLᵀ with blocks of one or two rows.

    Of each step the larger choice of Bunch and Parlett decides: the largest diagonal entry is the pivot unless
    the largest other entry is much larger, whose two rows then make a block (one negative, one positive value).
    """
    a = np.array(matrix, np.float64)
    negative, bound = 0, (1 + np.sqrt(17)) / 8
    while (n := len(a)) > 0:
        diagonal = np.abs(np.diagonal(a))
        p = int(diagonal.argmax())
        rest = np.abs(a)
        np.fill_diagonal(rest, 0.0)
        i, j = divmod(int(rest.argmax()), n)
        if diagonal[p] == 0 and rest[i, j] == 0:
            break
        if diagonal[p] >= bound * rest[i, j]:
            keep = np.arange(n) != p
            column = a[keep, p]
            negative += int(a[p, p] < 0)
            a = a[np.ix_(keep, keep)] - np.outer(column, column / a[p, p])
        else:
            pair, keep = [i, j], (np.arange(n) != i) & (np.arange(n) != j)
            block, columns = a[np.ix_(pair, pair)], a[np.ix_(keep, pair)]
            negative += 1
            a = a[np.ix_(keep, keep)] - columns @ np.linalg.solve(block, columns.T)
        a = (a + a.T) / 2
    return negative


def above(v: np.ndarray, s: float) -> int:
    """How many eigenvalues of v are over s (those within rounding of s may fall on either side)."""
    return len(v) - inertia(v - s * np.eye(len(v)))


def leading(v: np.ndarray, most: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors in columns) of the ``most`` largest positive eigenvalues, falling.

    Raises where the counts on both sides of a value don't give its number.
    """
    d = len(v)
    size = float(np.abs(v).sum(axis=1).max(initial=0.0))  # no eigenvalue is over it
    if not size:
        return np.empty(0), np.empty((d, 0))
    rounding = 4 * d * np.finfo(np.float64).eps * size
    positive = above(v, rounding)
    values: list[float] = []
    vectors = np.empty((d, 0))
    for number in range(1, min(most, positive) + 1):
        # over low are at least ``number`` eigenvalues, over high fewer
        low, high, over_low, over_high, found = rounding, size + rounding, positive, 0, None
        while found is None and high - low > rounding:
            middle = (low + high) / 2
            n = above(v, middle)
            low, high, over_low, over_high = (middle, high, n, over_high) if n >= number else (low, middle, over_low, n)
            if over_low - over_high == 1:
                found = _iterated(v, low, high, vectors)
        value, vector = found or _nearest(v, low, high, vectors)
        if not (above(v, value - 2 * rounding) >= number > above(v, value + 2 * rounding)):
            raise ArithmeticError(f"eigenvalue {number} is not certified")
        values.append(value)
        vectors = np.column_stack([vectors, vector])
    return np.array(values), vectors


def _start(d: int, before: np.ndarray) -> np.ndarray:
    y = np.cos(np.arange(1, d + 1) ** 2.0)  # any vector that no eigenvector is likely to be orthogonal to
    return _outside(y, before)


def _outside(y: np.ndarray, before: np.ndarray) -> np.ndarray:
    """A unit vector orthogonal to those found before; twice, so that rounding leaves nothing."""
    for _ in range(2):
        y = y - before @ (before.T @ y)
        y = y / np.linalg.norm(y)
    return y


def _step(v: np.ndarray, shift: float, y: np.ndarray) -> np.ndarray | None:
    """One step of inverse iteration; a shift that is an eigenvalue to the last digit is moved by rounding."""
    moved = np.finfo(np.float64).eps * float(np.abs(v).max())
    for s in (shift, shift + moved, shift - moved):
        try:
            out = np.linalg.solve(v - s * np.eye(len(v)), y)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(out).all() and (length := np.linalg.norm(out)) > 0:
            return out / length
    return None


def _iterated(v: np.ndarray, low: float, high: float, before: np.ndarray) -> tuple[float, np.ndarray] | None:
    """Rayleigh quotient iteration from the interval's middle; nothing if it leaves the interval or doesn't settle."""
    y, shift = _start(len(v), before), (low + high) / 2
    for _ in range(2):  # two steps with a fixed shift, then the quotient
        y = _step(v, shift, y)
        if y is None:
            return None
        y = _outside(y, before)
    least = np.inf
    for _ in range(12):
        shift = float(y @ v @ y)
        residual = float(np.linalg.norm(v @ y - shift * y))
        if not low <= shift <= high:
            return None
        if residual >= least / 2:  # as small as it gets
            break
        least, best = residual, (shift, y)
        moved = _step(v, shift, y)
        if moved is None:
            break
        y = _outside(moved, before)
    return best if least <= 64 * len(v) * np.finfo(np.float64).eps * max(abs(high), abs(low)) else None


def _nearest(v: np.ndarray, low: float, high: float, before: np.ndarray) -> tuple[float, np.ndarray]:
    """For eigenvalues that no counts can tell apart: inverse iteration orthogonal to the vectors found before."""
    y = _start(len(v), before)
    for _ in range(4):
        moved = _step(v, (low + high) / 2, y)
        y = y if moved is None else _outside(moved, before)
    return float(y @ v @ y), y


@dataclass(frozen=True)
class Whitening:
    """The fit: distinct vectors, their sums, components in columns, eigenvalues, the trace and what whitening misses."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float


def scaled(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, x array<bigint>) of the usable rows; x = floor(256 * entry)."""
    inside = lambda c: c.isNotNull() & (F.abs(c.cast("double") * SCALE) < LONG)  # noqa: E731  false for NaN and infinities, and null entries
    usable = rows.select(id_col, F.col(vector).alias("c")).where(F.col("c").isNotNull() & F.forall("c", lambda c: F.coalesce(inside(c) & ~F.isnan(c.cast("double")), F.lit(False))))
    x = usable.select(id_col, F.transform("c", lambda c: F.floor(c.cast("double") * SCALE)).alias("x"))
    lengths = x.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return x.where(F.size("x") == (lengths[0]["d"] if lengths else 0))


def matrices(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    """The list column ``x`` in blocks of rows."""
    for batch in batches:
        flat = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        for at in range(0, len(flat), ROWS_AT_ONCE):
            yield flat[at : at + ROWS_AT_ONCE]


def _summed(x: DataFrame, d: int, centre: np.ndarray, components: np.ndarray) -> np.ndarray:
    """Sum over all rows of the products of y's entries, y = (x - centre) @ components; each task sends one sum a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = components.shape[1]
        total = np.zeros((k, k))
        for rows in matrices(batches, d):
            y = (rows - centre) @ components
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(total.ravel())], ["cell", "total"])

    k = components.shape[1]
    cells = x.select("x").mapInArrow(run, "cell long, total double").groupBy("cell").agg(F.sum("total").alias("total")).collect()
    out = np.zeros(k * k)
    for r in cells:
        out[r["cell"]] = r["total"]
    return out.reshape(k, k)


def fit_whitening(x: DataFrame, most: int = 4) -> Whitening:
    """Fit over the distinct vectors of ``scaled`` rows. The list of them is written once to the shared folder and removed after."""
    spark = x.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/whitening-{uuid.uuid4().hex}"
    x.select("x").distinct().write.parquet(path)
    once = spark.read.parquet(path)
    sums = once.select(F.posexplode("x").alias("at", "x")).groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("total"), F.count("x").alias("n")).orderBy("at").collect()
    n, d = (sums[0]["n"] if sums else 0), len(sums)
    total = [int(r["total"]) for r in sums]
    mean = np.array([t / n for t in total], np.float64)
    values, components, trace, error = np.empty(0), np.empty((d, 0)), 0.0, 0.0
    if n:
        v = _summed(once, d, mean, np.eye(d)) / n
        trace = float(np.trace(v))
        values, components = leading((v + v.T) / 2, most)
        if len(values):
            made = _summed(once, d, mean, components / np.sqrt(values)) / n
            error = float(np.abs(made - np.eye(len(values))).max())
    removed(spark, path)
    return Whitening(n, np.array(total, object), components, values, trace, error)


def deviations(rows: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Exact sums of (n*x - S)² by rows; in machine integers where they fit, else in Python's."""
    reach = n * float(np.abs(rows).max(initial=0)) + max((abs(s) for s in sums), default=0)
    if reach * reach * max(1, len(sums)) < LONG / 4:
        off = rows * n - sums.astype(np.int64)
        return (off * off).sum(axis=1).tolist()
    each = ((rows.astype(object) * n - sums) ** 2).sum(axis=1)
    return [int(e) if e < 1 << 63 else None for e in each]


def whitened(x: DataFrame, fit: Whitening, id_col: str = "vec_id") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each row of ``x`` and component."""
    k, d = len(fit.values), len(fit.sums)
    explained = fit.values / fit.trace if k else fit.values
    mean = np.array([s / fit.n for s in fit.sums], np.float64) if fit.n else np.empty(0)
    turned = fit.components / np.sqrt(fit.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows if k else 0, ROWS_AT_ONCE):
                piece = batch.slice(at, ROWS_AT_ONCE)
                rows = piece.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                m = len(rows)
                ids = piece.column(0).take(pa.array(np.repeat(np.arange(m), k)))
                far = pa.array(deviations(rows, fit.n, fit.sums), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, fit.n, np.int64)),
                        far,
                        pa.array(((rows - mean) @ turned).ravel()),
                        pa.array(np.tile(explained, m)),
                        pa.array(np.full(m * k, fit.identity_error)),
                    ],
                    [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return x.mapInArrow(run, f"{id_col} {x.dtypes[0][1]}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to four whitened components of every usable row of ``embeddings``."""
    x = scaled(table(spark, sf_dir, "embeddings"))
    return whitened(x, fit_whitening(x))
