"""Embedding whitening by a tiled covariance.

Vectors become integers on a fixed grid, so that counts, sums and products are exact in any order. One pass
gives the count and the sums per dimension. A second pass cuts each block of rows into blocks of
TILE dimensions, centred on the mean; pairs of blocks are tile keys: a shuffle by row block brings
the column blocks of a pair together, each pair is multiplied, and products are summed per tile. The assembled
matrix, of the size of the dimensions alone, is decomposed by the driver, and a last pass projects the rows.

Centring takes the mean rounded to an integer before multiplying, so products stay small integers, whose sums are the same
whatever the order of tasks; what rounding left, half a unit at most, is taken off the sums.

Scale: a row block is ROWS rows, so no key grows with the data; what is shuffled is the vectors once, in the narrowest
integers that hold them; tiles meet after a sum in each task. The driver holds dims x dims numbers, and MAX_DIMS bounds them.

Defined results: rows whose vector is null, is empty or holds a null, NaN or infinite entry are dropped, as are, with vectors of several lengths,
those of another length than the most frequent (the longest of equals); entries beyond 2^42 count as 2^42; a null or repeated id is a row like others;
a component whose eigenvalue is zero, as with one row or equal rows, has null for its projection; where all are, ``explained`` and ``identity_error`` are null;
a deviation that a long can't hold is null; empty tables give empty results; other columns are kept by ``whiten`` and not read by the report.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, prepare, stash, tasks, tidy

#: Dimensions of a block, rows of a block, components of a report, most dimensions.
TILE, ROWS, COMPONENTS, MAX_DIMS = 32, 4096, 8, 8192
SCALE, SHIFT, FAR = 1024, 100_000, 1 << 52
_LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Whitening:
    """A fitted transform: rows, exact sums per dimension, eigenvalues falling, unit eigenvectors as columns, and the trace."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def dims(self) -> int:
        return len(self.sums)

    @property
    def positive(self) -> np.ndarray:
        """Which eigenvalues differ from zero by more than rounding."""
        return self.values > self.dims * np.finfo(float).eps * max(self.values[0], 0) if self.dims else np.zeros(0, bool)

    def project(self, x: np.ndarray, k: int) -> np.ndarray:
        """Rows of grid integers on the first k components, each of unit variance; zero for components without variance."""
        mean = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        scale = np.divide(1, np.sqrt(np.abs(self.values[:k])), where=self.positive[:k], out=np.zeros(k))
        return ((x - mean) - rest) @ (self.vectors[:, :k] * scale)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Per row the exact sum over dimensions of (n x - sum)^2."""
        far = max(int(np.abs(x).max(initial=0)) * self.n, *(abs(s) for s in self.sums))
        if 2 * far < 1 << 62:
            y = x * self.n - np.array(self.sums, np.int64)
            if int(np.abs(y).max(initial=0)) ** 2 * self.dims <= _LONG:
                return (y * y).sum(1).tolist()
        y = x.astype(object) * self.n - np.array(self.sums, object)
        return [s if s <= _LONG else None for s in (y * y).sum(1).tolist()]


def grid(column: pa.Array, dims: int | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """The vectors of a list column as integers: for each length (or only ``dims``) the rows and their matrix. Rows that are null, empty or not finite throughout are in none."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten().cast(pa.float64())
    values = flat.fill_null(np.nan).to_numpy(zero_copy_only=False)
    begins = np.cumsum(sizes) - sizes
    good = sizes > 0
    good[np.repeat(np.arange(len(sizes)), sizes)[~np.isfinite(values)]] = False
    out = []
    for size in np.unique(sizes[good]).tolist() if dims is None else [dims]:
        rows = np.flatnonzero(good & (sizes == size))
        x = values[begins[rows][:, None] + np.arange(size)]
        out.append((rows, np.clip(np.floor(x * SCALE), -FAR, FAR).astype(np.int64) + SHIFT))
    return out


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vector) to (size, dim, n, total): one row per dimension and task."""
    n: dict[int, int] = {}
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for rows, x in grid(b.column(0)):
            if len(rows):
                size = x.shape[1]
                wide = np.abs(x).max() * len(x) >= 1 << 62
                n[size] = n.get(size, 0) + len(rows)
                total[size] = total.get(size, 0) + (x.astype(object) if wide else x).sum(0).astype(object)
    for size in n:
        yield pa.record_batch([pa.array([size] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array([n[size]] * size, pa.int64()), pa.array([str(t) for t in total[size]])], ["size", "dim", "n", "total"])


def _narrow(y: np.ndarray) -> np.ndarray:
    most = int(np.abs(y).max(initial=0))
    return y.astype(next(t for t, top in ((np.int16, 1 << 15), (np.int32, 1 << 31), (np.int64, 1 << 63)) if most < top))


def _blocks(dims: int, mean: np.ndarray, tile: int, rows: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vector) to (row_block, block, width, data): the centred columns of a block of dimensions over a block of rows."""
    part, count, rest = TaskContext.get().partitionId(), 0, np.zeros((0, dims), np.int64)

    def cut(y: np.ndarray, row_block: int) -> pa.RecordBatch:
        pieces = [_narrow(y[:, k : k + tile]) for k in range(0, dims, tile)]
        n = len(pieces)
        return pa.record_batch([pa.array([row_block] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([p.dtype.itemsize for p in pieces], pa.int32()), pa.array([p.tobytes() for p in pieces], pa.binary())], ["row_block", "block", "width", "data"])

    for b in batches:
        rest = np.concatenate([rest, *(x - mean for _, x in grid(b.column(0), dims))])
        while len(rest) >= rows:
            yield cut(rest[:rows], (part << 33) + count)
            rest, count = rest[rows:], count + 1
    if len(rest):
        yield cut(rest, (part << 33) + count)


def _products(dims: int, tile: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(left, right, left width, left data, right width, right data) to (left, right, place, value): sums of products of a tile's pairs, one tile a task and key."""
    sums: dict[tuple[int, int], np.ndarray] = {}

    def matrix(block: int, width: int, data: bytes) -> np.ndarray:
        return np.frombuffer(data, f"<i{width}").reshape(-1, min(tile, dims - block * tile)).astype(float)

    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            key = row[:2]
            sums[key] = sums.get(key, 0) + matrix(row[0], row[2], row[3]).T @ matrix(row[1], row[4], row[5])
    for (left, right), m in sums.items():
        n = m.size
        yield pa.record_batch([pa.array([left] * n, pa.int32()), pa.array([right] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(m.ravel())], ["left", "right", "place", "value"])


def covariance(vectors: DataFrame, n: int, sums: list[int], tile: int = TILE, rows: int = ROWS) -> np.ndarray:
    """The covariance, divisor n, of a single column of vectors of len(sums) dimensions on the grid."""
    dims, spark = len(sums), vectors.sparkSession
    mean = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    blocks = vectors.mapInArrow(tidy(partial(_blocks, dims, mean, tile, rows)), "row_block long, block int, width int, data binary")
    width = tasks(spark, n, 32 * rows)
    blocks = blocks.repartition(width, "row_block")
    a = blocks.select("row_block", F.col("block").alias("left"), F.col("width").alias("lw"), F.col("data").alias("ld"))
    b = blocks.select("row_block", F.col("block").alias("right"), F.col("width").alias("rw"), F.col("data").alias("rd"))
    pairs = a.join(b.hint("merge"), "row_block").where("left <= right").select("left", "right", "lw", "ld", "rw", "rd")
    tiles = pairs.mapInArrow(tidy(partial(_products, dims, tile)), "left int, right int, place int, value double").groupBy("left", "right", "place").agg(F.sum("value").alias("value"))
    out = np.zeros((dims, dims))
    for t in tiles.toLocalIterator():
        wide = min(tile, dims - t.right * tile)
        i, j = t.left * tile + t.place // wide, t.right * tile + t.place % wide
        out[i, j] = out[j, i] = t.value
    off = np.array([(s - n * int(m)) / n for s, m in zip(sums, mean)])
    return out / n - np.outer(off, off)


def fit(vectors: DataFrame, tile: int = TILE, rows: int = ROWS) -> Whitening | None:
    """The whitening of a single column of vectors; None where no row has a usable one."""
    sums = stash(vectors.mapInArrow(tidy(_sums), "size int, dim int, n long, total string").groupBy("size", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")))
    most = sums.groupBy("size").agg(F.max("n").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    if most is None:
        return None
    if most["size"] > MAX_DIMS:
        raise ValueError(f"vectors of {most['size']} dimensions; the driver decomposes {MAX_DIMS} at most")
    total = [int(r.total) for r in sums.where(F.col("size") == most["size"]).orderBy("dim").collect()]
    v = covariance(vectors, most.n, total, tile, rows)
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    signs = np.sign(axes[np.abs(axes).argmax(0), np.arange(len(values))])
    return Whitening(most.n, tuple(total), values.copy(), axes * signs, float(np.trace(v)))


def whiten(rows: DataFrame, model: Whitening, vec_col: str = "embedding", components: int | None = None, out_col: str = "whitened") -> DataFrame:
    """All columns of the rows that the model can take, and their projections as an array; null entries for components without variance."""
    prepare(rows.sparkSession)
    plain, at = numbered(rows)
    k, n = min(components or model.dims, model.dims), len(plain.columns)
    given = plain.withColumn("vec", F.col(at[vec_col]).cast("array<double>"))
    gone = np.flatnonzero(~model.positive[:k])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ((found, x),) = grid(b.column(n), model.dims)
            z = model.project(x, k)
            flat = pa.array(z.ravel(), mask=np.isin(np.arange(z.size) % k, gone)) if k else pa.array([], pa.float64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * k, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(found)) for c in b.columns[:n]), lists], [*b.schema.names[:n], "z"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields), "z array<double>"])
    out = given.mapInArrow(tidy(run), schema)
    return out.select(*(F.col(c).alias(name) for name, c in at.items() if name != out_col), F.col("z").alias(out_col))


def _moments(model: Whitening, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vector) to (i, j, value): sums of products of projections, with one more column of ones."""
    total = np.zeros((k + 1, k + 1))
    for b in batches:
        ((_, x),) = grid(b.column(0), model.dims)
        z = np.concatenate([model.project(x, k), np.ones((len(x), 1))], 1)
        total += z.T @ z
    i, j = np.divmod(np.arange(total.size), k + 1)
    yield pa.record_batch([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], ["i", "j", "value"])


def identity_error(vectors: DataFrame, model: Whitening, components: int) -> float | None:
    """The largest entry, by size, of the projections' covariance over the rows minus the identity; of components with variance."""
    k = min(components, model.dims)
    sums = np.zeros((k + 1, k + 1))
    for r in vectors.mapInArrow(tidy(partial(_moments, model, k)), "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect():
        sums[r.i, r.j] = r.value
    mean = sums[:k, k] / model.n
    off = np.abs(sums[:k, :k] / model.n - np.outer(mean, mean) - np.eye(k))[np.ix_(model.positive[:k], model.positive[:k])]
    return float(off.max()) if off.size else None


def whitening_report(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS, tile: int = TILE) -> DataFrame:
    """Per row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = prepare(rows.sparkSession)
    vectors = rows.select(F.col(vec_col).cast("array<double>").alias("vec"))
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(vectors, tile)
    if model is None:
        return spark.createDataFrame([], schema)
    k, error = min(components, model.dims), identity_error(vectors, model, components)
    share = [float(e / model.trace) if up else (0.0 if model.trace > 0 else None) for e, up in zip(model.values[:k], model.positive[:k])]
    gone = np.flatnonzero(~model.positive[:k])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ((found, x),) = grid(b.column(1), model.dims)
            m, z = len(found), model.project(x, k)
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.record_batch(
                [
                    b.column(0).take(pa.array(found)).take(each), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, model.n), pa.int64()),
                    pa.array(model.deviations(x) if m else [], pa.int64()).take(each), pa.array(z.ravel(), mask=np.isin(np.arange(z.size) % k, gone)), pa.array(share * m, pa.float64()), pa.array([error] * (m * k), pa.float64()),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec")).mapInArrow(tidy(run), schema)
