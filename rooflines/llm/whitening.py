"""Embedding whitening by blockwise QR and a bidiagonal qd solver.

Vectors are set on a grid of whole numbers, so that their sums are exact on any cluster. A pass adds up each dimension.
A second pass centres the rows and reduces each block to the triangle R of its QR factorisation, stacked on the
task's triangle so far; the tasks' triangles are folded by groups of FAN until one is left. R'R is the centred rows'
cross product, which is never formed: R is made bidiagonal, dqds finds its singular values and twisted factorisations
their vectors (bidiagonal.py). That is one matrix as wide as a vector, whatever the number of rows. A last pass projects
the rows; before it, another one measures how far the covariance of the whitened rows is from the identity: each block
is centred by its own mean before multiplying, and blocks are merged by the means' differences, folded like the R's.

Defined cases: a vector that is null, empty, or holds null or non-finite entries is dropped; so is one of another length
than the most frequent (the shorter of equals); scaled entries beyond 2^52 in size are held there; null ids and rows that are the same
are rows like others; components whose variance is nothing but rounding (n times 2^-52 of the total at most, as with
one row, equal rows or constant dimensions) can't be whitened and have no rows; a deviation beyond a long is null; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bidiagonal import EPS, right_singular
from .common import read, tidy

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Rows in a block of the factorisation, and triangles folded by one task.
BLOCK, FAN = 2048, 32
LIMIT = 2.0**52


def gridded(vectors: DataFrame, column: str, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """vec_id and x, whole numbers: floor(scale * entry) + offset; of the vectors that can be."""
    v = F.col(column)
    bad = lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))
    on_grid = lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(LIMIT)), F.lit(-LIMIT))).cast("long") + offset
    whole = vectors.where(v.isNotNull() & (F.size(v) > 0)).where(~F.exists(v, bad))
    return whole.select(F.col("vec_id"), F.transform(v, on_grid).alias("x"))


@dataclass(frozen=True)
class Whitening:
    """n rows, sums S by dimension, components as columns, their variances, the whole variance."""

    n: int
    sums: tuple[int, ...]
    directions: np.ndarray
    variances: np.ndarray
    total: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exactly."""
        if self.n * float(max(np.abs(x).max(initial=0), 1)) < 2.0**62:
            return self.n * x - np.array(self.sums, dtype=np.int64)
        return self.n * x.astype(object) - np.array(self.sums, dtype=object)

    def whiten(self, centred: np.ndarray) -> np.ndarray:
        return (centred.astype(float) / self.n) @ (self.directions / np.sqrt(self.variances))


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch["x"].flatten().to_numpy().reshape(-1, width)


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    rows = max(1, min(BLOCK, 2**21 // width))
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            part = batch.slice(i, rows)
            yield part, _matrix(part, width)


def _packed(numbers: np.ndarray, slot: int = 0) -> pa.RecordBatch:
    return pa.record_batch([pa.array([slot], pa.int64()), pa.array([np.ascontiguousarray(numbers, dtype=float).tobytes()])], ["slot", "made"])


def folded(parts: DataFrame, merge: Callable[[list[np.ndarray]], np.ndarray], tasks: int) -> np.ndarray | None:
    """One array from the tasks' arrays (column made), merged by FAN at a time until few enough are left for the last merge."""

    def together(key: tuple, table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_packed(merge([np.frombuffer(b.as_py()) for b in table["made"]]), key[0].as_py())])

    numbered = parts.select(F.spark_partition_id().cast("long").alias("slot"), "made")
    while tasks > FAN:
        tasks = -(-tasks // FAN)
        numbered = numbered.groupBy(F.pmod("slot", F.lit(tasks)).alias("of")).applyInArrow(together, "slot long, made binary")
    left = [np.frombuffer(bytes(r.made)) for r in numbered.select("made").collect()]
    return merge(left) if left else None


def _triangle(rows: np.ndarray, width: int) -> np.ndarray:
    """Square, upper triangular."""
    r = np.linalg.qr(rows, "r")
    return np.vstack([r, np.zeros((width - len(r), width))]) if len(r) < width else r


def _merge_triangles(width: int, parts: list[np.ndarray]) -> np.ndarray:
    r = np.zeros((width, width))
    for p in parts:
        r = _triangle(np.vstack([r, p.reshape(width, width)]), width)
    return r.reshape(-1)


def _merge_moments(width: int, parts: list[np.ndarray]) -> np.ndarray:
    """Each part: a count, means, centred products."""
    n, mean, products = 0.0, np.zeros(width), np.zeros((width, width))
    for p in parts:
        m, other, more = p[0], p[1 : width + 1], p[width + 1 :].reshape(width, width)
        apart, n = other - mean, n + m
        mean = mean + apart * (m / n)
        products = products + more + np.outer(apart, apart) * (m * (n - m) / n)
    return np.concatenate([[n], mean, products.reshape(-1)])


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """rows: x, whole numbers, of one length. None if there are no rows."""
    counts = rows.select(F.posexplode("x").alias("dim", "v")).groupBy("dim").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("s"), F.count("*").alias("n")).orderBy("dim").collect()  # a row for each dimension
    if not counts:
        return None
    n, sums, width = counts[0].n, tuple(int(r.s) for r in counts), len(counts)
    base = Whitening(n, sums, np.zeros((width, 0)), np.zeros(0), 0.0)

    @tidy
    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for _, x in _blocks(batches, width):
            block = base.centred(x).astype(float) / n
            r = _triangle(block if r is None else np.vstack([r, block]), width)
        if r is not None:
            yield _packed(r)

    made = rows.select("x").mapInArrow(reduced, "slot long, made binary")
    r = folded(made, partial(_merge_triangles, width), rows.rdd.getNumPartitions()).reshape(width, width)
    squares, directions = right_singular(r, min(components, width))
    total = float((r * r).sum())
    real = squares > n * EPS * total
    return Whitening(n, sums, directions[:, real], squares[real] / n, total / n)


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest entry, in size, of the whitened rows' covariance less the identity."""
    width, k = len(model.sums), model.directions.shape[1]
    if not k:
        return 0.0

    @tidy
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far = None
        for _, x in _blocks(batches, width):
            w = model.whiten(model.centred(x))
            mean = w.mean(axis=0)
            apart = w - mean
            new = np.concatenate([[len(w)], mean, (apart.T @ apart).reshape(-1)])
            so_far = new if so_far is None else _merge_moments(k, [so_far, new])
        if so_far is not None:
            yield _packed(so_far)

    made = rows.select("x").mapInArrow(moments, "slot long, made binary")
    found = folded(made, partial(_merge_moments, k), rows.rdd.getNumPartitions())
    return float(np.abs(found[k + 1 :].reshape(k, k) / found[0] - np.eye(k)).max())


def _deviations(centred: np.ndarray) -> list[int | None]:
    """Sums of squares, exactly; None beyond a long."""
    if centred.dtype != object and centred.shape[1] * float(np.abs(centred).max(initial=0)) ** 2 < 2.0**62:
        return (centred * centred).sum(axis=1).tolist()
    found = (sum(int(c) ** 2 for c in row) for row in centred)
    return [s if s < 2**63 else None for s in found]


def whitened(rows: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, deviation, whitened (an entry for each component) of each row."""
    width, k = len(model.sums), model.directions.shape[1]

    @tidy
    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, width):
            c = model.centred(x)
            w = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) * k + 1, max(k, 1), dtype=np.int32) if k else np.zeros(len(x) + 1, dtype=np.int32)), pa.array(model.whiten(c).reshape(-1)))
            yield pa.record_batch([part["vec_id"], pa.array(_deviations(c), pa.int64()), w], ["vec_id", "deviation", "whitened"])

    kind = dict(rows.dtypes)["vec_id"]
    return rows.select("vec_id", "x").mapInArrow(projected, f"vec_id {kind}, deviation long, whitened array<double>")


def of_one_length(rows: DataFrame) -> DataFrame:
    """The rows whose x has the most frequent length, the shorter of equals."""
    lengths = rows.groupBy(F.size("x").alias("length")).count().orderBy(F.desc("count"), "length").limit(1).collect()
    return rows.where(F.size("x") == (lengths[0]["length"] if lengths else 0))


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitening_report(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each vector and component: what it is worth in it, and how good the whitening is."""
    rows = of_one_length(gridded(vectors, column))
    model = fit(rows, components)
    if model is None or not len(model.variances):
        return vectors.sparkSession.createDataFrame([], OUT)
    error = identity_error(rows, model)
    shares = F.array(*(F.lit(float(v / model.total)) for v in model.variances))
    each = whitened(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return each.select(
        "vec_id", (F.col("place") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("place")).alias("explained"), F.lit(error).alias("identity_error")
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening_report(read(spark, sf_dir, "embeddings"))
