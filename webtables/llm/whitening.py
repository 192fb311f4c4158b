"""Embedding whitening by shifted CholeskyQR (operator 12).

The centred rows Y are made orthogonal in passes: each pass adds up the Gram matrix of the
rows as they are, factors it (shifted by a multiple of the rounding error, so that the
factor exists for nearly dependent columns too) and the next pass solves the triangular
system row by row. The factors multiply to the R of Y = QR, so the singular values and right
vectors of R are those of Y. Rows stay where they are; a pass sends one d x d matrix a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, ready

COMPONENTS, PASSES = 8, 3
#: Fixed point of the vectors: floor(SCALE * entry) + OFFSET.
SCALE, OFFSET = 1024, 100_000
#: Rows that a task works on at a time.
STEP = 8192


def fit_rows(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, x) of the rows that take part, ``x`` the entries in fixed point.

    Left out: vectors that are null, empty, or hold a null, a non-finite entry or one too
    large for a long; and vectors of another length than most (on a tie the longest)."""
    v = vectors.select(vectors[id_col].alias("id"), vectors[vector_col].cast("array<double>").alias("v"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float(2**42)))
    v = v.where(F.col("v").isNotNull() & F.coalesce(fine, F.lit(False)) & (F.size("v") > 0))
    d = v.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    v = v.where(F.size("v") == (d["d"] if d else 0))
    return v.select("id", F.transform("v", lambda c: F.floor(c * SCALE) + OFFSET).alias("x"))


def _parts(b: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for at in range(0, b.num_rows, STEP):
        part = b.slice(at, STEP)
        flat = part.column(1).flatten().to_numpy(zero_copy_only=False)
        yield part.column(0), flat.reshape(part.num_rows, -1)


def _added(rows: DataFrame, work, width: int, kind: str) -> np.ndarray:
    """The sum over all rows of the matrices that ``work`` makes of a part's x; each task
    adds up its own, and Spark the tasks' matrix rows."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for _, x in _parts(b):
                m = work(x)
                total = m if total is None else total + m
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(list(total), pa.list_(pa.from_numpy_dtype(total.dtype)))], names=["i", "row"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, row in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                row = row.values.to_numpy(zero_copy_only=False)
                sums[i] = sums[i] + row if i in sums else row
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.from_numpy_dtype(next(iter(sums.values())).dtype)))], names=["i", "row"])

    schema = f"i int, row array<{kind}>"
    sums = rows.mapInArrow(task, schema).repartition(partitions(rows.sparkSession), "i").mapInArrow(add, schema)
    got = sorted((r["i"], r["row"]) for r in sums.collect())  # d rows of d numbers
    return np.array([row for _, row in got], np.int64 if kind == "long" else float).reshape(len(got), width)


@dataclass
class Whitening:
    """What scoring needs: the number of fitted rows, the entries' sums, the unit
    components (rows, by falling eigenvalue), their eigenvalues, the trace of the covariance
    and the largest entry of the whitened rows' covariance minus the identity."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.n * x - self.sums) / self.n  # the numerator is exact

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components.T / np.sqrt(self.values)


def shifted_cholesky(gram: np.ndarray, n: int) -> np.ndarray:
    """An upper triangular R with R'R = gram + s: s is the least of no shift and rising
    multiples of the rounding error of ``n`` rows for which the factor exists."""
    d = len(gram)
    unit = np.finfo(float).eps / 2 * max(float(np.trace(gram)), np.finfo(float).tiny)
    shift = 11 * (n * d + d * (d + 1)) * unit
    for s in (0.0, min(shift, 1e-11 * float(np.trace(gram))), 1e-9 * float(np.trace(gram)) or 1.0):
        try:
            r = np.linalg.cholesky(gram + s * np.eye(d)).T
        except np.linalg.LinAlgError:
            continue
        if s or np.diag(r).min() > 1e-7 * np.diag(r).max():
            return r
    raise np.linalg.LinAlgError("not a Gram matrix")


def fit(rows: DataFrame, components: int = COMPONENTS, passes: int = PASSES) -> Whitening | None:
    """Fit on all of ``rows`` (id, x). Components whose eigenvalue is zero to rounding are
    left out, so there may be fewer; None for an empty table."""
    spark = ready(rows.sparkSession)
    first = rows.select(F.size("x").alias("d")).first()
    if first is None:
        return None
    d = first["d"]
    both = _added(rows, lambda x: np.vstack([x.sum(0), np.full(d, len(x))]), d, "long")
    model = Whitening(int(both[1, 0]), both[0], np.zeros((0, d)), np.zeros(0), 0.0)
    r = np.eye(d)
    factors: list[np.ndarray] = []
    trace = 0.0
    for _ in range(passes):
        sent = spark.sparkContext.broadcast((model, factors))

        def gram(x: np.ndarray, sent=sent) -> np.ndarray:
            m, factors = sent.value
            y = m.centred(x)
            for f in factors:
                y = np.linalg.solve(f.T, y.T).T  # y f^-1; f is triangular
            return y.T @ y

        g = _added(rows, gram, d, "double")
        if not factors:
            trace = float(np.trace(g)) / model.n
            if trace == 0:
                return model  # all rows are equal
        f = shifted_cholesky(g, model.n)
        factors = [*factors, f]
        r = f @ r
    _, s, v = np.linalg.svd(r)
    values = s**2 / model.n
    rank = int((values > values[0] * 1e-11).sum())
    model.trace, model.values, model.components = trace, values[: min(components, rank)], v[: min(components, rank)]
    k = len(model.values)
    sent = spark.sparkContext.broadcast(model)

    def moments(x: np.ndarray) -> np.ndarray:
        w = sent.value.whiten(x)
        return np.vstack([w.T @ w, w.sum(0)])

    m = _added(rows, moments, k, "double")
    mean = m[k] / model.n
    model.identity_error = float(np.abs(m[:k] / model.n - np.outer(mean, mean) - np.eye(k)).max())
    return model


def transform(rows: DataFrame, model: Whitening, id_col: str = "vec_id") -> DataFrame:
    """A row for each row of ``rows`` and component: id_col, component (from 1), n,
    deviation (sum over dimensions of (n x - S)^2, exact; null beyond a long), whitened,
    explained, identity_error."""
    spark = ready(rows.sparkSession)
    sent = spark.sparkContext.broadcast(model)
    id_type = rows.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        k = len(m.values)
        for b in batches:
            for ids, x in _parts(b):
                w = m.whiten(x)
                off = m.n * x - m.sums
                if float(np.abs(off).max(initial=0)) ** 2 * off.shape[1] < 2**62:
                    deviation = pa.array((off * off).sum(1))
                else:
                    exact = [sum(c * c for c in row) for row in off.tolist()]
                    deviation = pa.array([e if e < 2**63 else None for e in exact], pa.int64())
                rows_ = pa.array(np.repeat(np.arange(len(x)), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(rows_), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(rows_), m.n, np.int64)),
                        deviation.take(rows_), pa.array(w.ravel()), pa.array(np.tile(m.values / m.trace if k else m.values, len(x))), pa.array(np.full(len(rows_), m.identity_error)),
                    ],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    schema = f"id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return rows.mapInArrow(work, schema).withColumnRenamed("id", id_col)


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Fit on all usable vectors (see :func:`fit_rows`) and whiten them (:func:`transform`).

    Repeated rows, also under one id, count each; rows with a null id take part. Fewer
    components than asked come where the vectors span fewer dimensions, none where all are
    equal. Other columns are not read. An empty table gives no rows."""
    spark = ready(vectors.sparkSession)
    rows = fit_rows(vectors, id_col, vector_col)
    model = fit(rows, components)
    if model is None or not len(model.values):
        id_type = vectors.schema[id_col].dataType.simpleString()
        return spark.createDataFrame([], f"{id_col} {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return transform(rows, model, id_col)
