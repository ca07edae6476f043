"""Whitening of embeddings: a centred scatter summed up by tasks, cyclic Jacobi rotations on the driver, one matrix sent out.

The fit list has each distinct rounded vector once. Its size and sums come first, then the scatter of what is left when the
mean is taken off; each task sends one number for each two dimensions. The driver rotates that matrix, as large as the square
of the dimensions, until nothing is left beside the diagonal in proportion to it, so that small eigenvalues come out as exact
as large ones. The matrix of the first components goes to all tasks, and rows are whitened where they are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import expose, forget, stored

COMPONENTS = 4
STEPS = 256.0
#: Entries beyond are rounded to it; what is smaller is exact.
LIMIT = float(1 << 62)
#: Dimensions at most: the driver holds a few matrices of their square.
DIMENSIONS = 4096
_WIDTHS = (np.int8, np.int16, np.int32, np.int64)


def dense(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Which rows have a vector of finite entries, these rows as longs, shorter ones filled up with 0, and the longest's length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    at = np.repeat(np.arange(len(sizes)), sizes)
    valid[at[~np.isfinite(values)]] = False
    width = int(sizes[valid].max(initial=0))
    out, use = np.zeros((len(sizes), width)), valid[at]
    place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    with np.errstate(over="ignore"):
        out[at[use], place[use]] = values[use] * STEPS
    return valid, np.floor(np.clip(out[valid], -LIMIT, LIMIT)).astype(np.int64), width


def pack(x: np.ndarray) -> list[bytes]:
    """Each row in bytes, one way only: without the zeros at its end, in the least width that holds it."""
    n, d = x.shape
    last = np.where((x != 0).any(axis=1), d - (x[:, ::-1] != 0).argmax(axis=1), 0) if d else np.zeros(n, np.int64)
    low, high = x.min(axis=1, initial=0), x.max(axis=1, initial=0)
    width = sum(((low < np.iinfo(w).min) | (high > np.iinfo(w).max)).astype(np.int64) for w in _WIDTHS[:-1])
    own = [x.astype(w) for w in _WIDTHS[: int(width.max(initial=0)) + 1]]
    return [bytes((w,)) + own[w][i, :k].tobytes() for i, (w, k) in enumerate(zip(width.tolist(), last.tolist(), strict=True))]


def unpack(rows: list[bytes], dimensions: int) -> np.ndarray:
    out = np.zeros((len(rows), dimensions), np.int64)
    for i, r in enumerate(rows):
        v = np.frombuffer(r, _WIDTHS[r[0]], offset=1)
        out[i, : len(v)] = v
    return out


def jacobi(matrix: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors, in columns, of a positive semidefinite matrix.

    A sweep turns each two rows once, in rounds of disjoint pairs as at a round table, so that a round is a few vector
    operations. A pair is left alone once its entry vanishes beside the root of its diagonal ones; it ends with a sweep that
    turns none. A vector's largest entry is positive; equal eigenvalues stay in the order of their rows.
    """
    a = np.array(matrix, np.float64)
    n = len(a)
    vectors, seats = np.eye(n), list(range(n + n % 2))
    least = np.finfo(np.float64).eps
    floor = least * least * max(np.trace(a), 0.0)  # entries that small are 0 beside the matrix
    for _ in range(sweeps):
        turned = False
        for _ in range(len(seats) - 1):
            half = len(seats) // 2
            pairs = [(min(i, j), max(i, j)) for i, j in zip(seats[:half], seats[: half - 1 : -1], strict=True) if max(i, j) < n]
            seats = [seats[0], seats[-1], *seats[1:-1]]
            if not pairs:
                continue
            p, q = np.array(pairs).T
            off, x, y = a[p, q], a[p, p], a[q, q]
            open_ = np.abs(off) > np.maximum(least * np.sqrt(np.abs(x * y)), floor)
            if not open_.any():
                continue
            turned = True
            p, q, off, x, y = p[open_], q[open_], off[open_], x[open_], y[open_]
            theta = (y - x) / (2 * off)
            t = np.where(theta < 0, -1.0, 1.0) / (np.abs(theta) + np.hypot(theta, 1.0))
            c = 1 / np.hypot(t, 1.0)
            s = t * c
            a[p], a[q] = c[:, None] * a[p] - s[:, None] * a[q], s[:, None] * a[p] + c[:, None] * a[q]
            a[:, p], a[:, q] = c * a[:, p] - s * a[:, q], s * a[:, p] + c * a[:, q]
            vectors[:, p], vectors[:, q] = c * vectors[:, p] - s * vectors[:, q], s * vectors[:, p] + c * vectors[:, q]
            a[p, q] = a[q, p] = 0.0
            a[p, p], a[q, q] = x - t * off, y + t * off
        if not turned:
            break
    values = np.diagonal(a).copy()
    by = np.argsort(-values, kind="stable")
    vectors = vectors[:, by] / np.linalg.norm(vectors[:, by], axis=0)
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(n)]) if n else np.ones(0)
    return values[by], vectors * signs


def _numbers(totals: np.ndarray, first: int = 0) -> pa.RecordBatch:
    """One row (i, j, v) for each number of a matrix; only those on and above the diagonal of a square one."""
    i, j = np.triu_indices(len(totals)) if totals.ndim == 2 else (np.arange(len(totals)), np.full(len(totals), -1))
    return pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(totals[i, j] if totals.ndim == 2 else totals)], names=["i", "j", "v"])


def _packed(vector_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            _, x, width = dense(b.column(vector_col))
            rows = sorted(set(pack(x)))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array([width] * len(rows), pa.int32())], names=["x", "width"])

    return run


def fit_list(df: DataFrame, vector_col: str = "embedding") -> tuple[DataFrame, int, int]:
    """The distinct rounded vectors, packed and stored, how many they are, and the dimensions. Equal ones of a batch and of a task meet before they are shuffled."""
    own = df.select(vector_col).mapInArrow(_packed(vector_col), "x binary, width int")
    fit = stored(own.groupBy("x").agg(F.max("width").alias("width")))
    n, d = fit.agg(F.count(F.lit(1)), F.coalesce(F.max("width"), F.lit(0))).first()
    if d > DIMENSIONS:
        raise ValueError(f"vectors of {d} entries; at most {DIMENSIONS} are whitened")
    return fit.select("x"), int(n), int(d)


def _sums(fit: DataFrame, d: int) -> list[int]:
    """The sums of all dimensions, exact: of the upper and lower 32 bits apart, added up by Spark as decimals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros(d, np.int64), np.zeros(d, np.int64)
        for b in batches:
            x = unpack(b.column("x").to_pylist(), d)
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(high), pa.array(low)], names=["i", "high", "low"])

    wide = "decimal(38,0)"
    rows = fit.mapInArrow(run, "i int, high long, low long").groupBy("i").agg(F.sum(F.col("high").cast(wide)).alias("high"), F.sum(F.col("low").cast(wide)).alias("low")).collect()
    sums = [0] * d
    for r in rows:
        sums[r.i] = (int(r.high) << 32) + int(r.low)
    return sums


def _products(fit: DataFrame, d: int, mean: np.ndarray, onto: np.ndarray | None = None) -> np.ndarray:
    """The sum of products of each two dimensions of the vectors without their mean, or of these projected on columns."""
    k = d if onto is None else onto.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for b in batches:
            x = unpack(b.column("x").to_pylist(), d) - mean
            z = x if onto is None else x @ onto
            total += z.T @ z
        yield _numbers(total)

    out = np.zeros((k, k))
    for r in fit.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r.i, r.j] = out[r.j, r.i] = r.v
    return out


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sum of (n * x - S)^2 of each row, exact; null where no long holds it."""
    reach = n * max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) + max(map(abs, sums), default=0)
    if reach * reach * max(1, x.shape[1]) < 1 << 63:
        off = n * x - np.array(sums, np.int64)
        return (off * off).sum(axis=1).tolist()
    off = n * x.astype(object) - np.array(sums, object)
    return [int(v) if v < 1 << 63 else None for v in (off * off).sum(axis=1)]


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per row of df and component: id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, or holds null or something not finite, are left out. A shorter vector counts as filled up with
    0; an empty one is all 0. Repeated rows and ids are rows of their own, but one entry of the fit list. There are no more
    components than dimensions. A component without variance (below what doubles tell from 0) has whitened null and no part
    in identity_error; where no component has any, explained and identity_error are null. Without a usable row the result is empty.
    """
    spark = expose(df.sparkSession)
    schema = T.StructType([df.schema[id_col], *T._parse_datatype_string("component int, n long, deviation long, whitened double, explained double, identity_error double").fields])
    df = df.select(id_col, vector_col)
    fit, n, d = fit_list(df, vector_col)
    if not n or not d:
        return spark.createDataFrame([], schema)
    sums = _sums(fit, d)
    mean = np.array([s / n for s in sums])
    values, vectors = jacobi(_products(fit, d, mean) / n)
    k, trace = min(components, d), float(values.sum())
    some = values[:k] > max(values[0], 0.0) * d * np.finfo(np.float64).eps
    matrix = vectors[:, :k][:, some] / np.sqrt(values[:k][some])
    error = float(np.abs(_products(fit, d, mean, matrix) / n - np.eye(int(some.sum()))).max()) if some.any() else None
    explained = [float(v / trace) if trace > 0 else None for v in values[:k]]
    sent = spark.sparkContext.broadcast((matrix, mean))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        matrix, mean = sent.value
        for b in batches:
            valid, x, width = dense(b.column(vector_col))
            x = np.pad(x, ((0, 0), (0, d - width)))
            z = np.full((len(x), k), np.nan)
            z[:, some] = (x - mean) @ matrix
            ids = b.column(id_col).filter(pa.array(valid)).take(pa.array(np.repeat(np.arange(len(x)), k)))
            deviation = pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k)))
            white = pa.array(z.reshape(-1), mask=np.tile(~some, len(x)))
            columns = [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array([n] * (k * len(x)), pa.int64()), deviation, white, pa.array(explained * len(x), pa.float64()), pa.array([error] * (k * len(x)), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return df.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(expose(spark).read.parquet(f"{sf_dir}/embeddings.parquet"))
