"""Nearest neighbours by an adaptive dimension scan over probed lists (operator 6).

Vectors are scaled and given one more coordinate, so that the largest inner product is
the least distance, then turned by a random rotation and assigned to the nearest of a
set of centroids. A query is sent to its nearest lists. There its distances grow column
block by column block, and after each block a hypothesis test drops the candidates whose
partial distance, spread evenly over a random rotation's dimensions, puts them beyond
the k-th best. What is left is ranked by the exact measure on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, ready

#: Rows that the centroids are fitted on at most, and centroids at most.
SAMPLE_ROWS, MOST_LISTS = 20_000, 4096
#: Rows of the sample that bounds queries; lists with more rows than BLOCK_ROWS are
#: searched in blocks; pairs of a query and a row that a task tests at a time.
BOUND_ROWS, BLOCK_ROWS, PAIRS = 8192, 32_768, 1 << 20
#: The share of the lists that a query probes, and the lists it probes at least. Set for
#: vectors that fill all their dimensions evenly, the hardest case; clustered ones need less.
PROBED, LEAST_PROBED = 0.6, 8
#: Columns of a block, and the test's width in standard errors.
COLUMNS, WIDTH = 16, 3.0
#: Queries of a list that a task searches for at most, about.
QUERY_ROWS = 32_768
#: Share of the pairs left below which a block is computed for those alone.
SPARSE = 0.2


@dataclass
class Index:
    """What every task needs: a rotation, the largest norm, centroids, the bounding sample
    (ids and rotated vectors), and list sizes."""

    rotation: np.ndarray
    scale: float
    centroids: np.ndarray
    ids: np.ndarray | None = None
    sample: np.ndarray | None = None
    sizes: np.ndarray | None = None

    def turned(self, x: np.ndarray, query: bool) -> np.ndarray:
        x = x / self.scale
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))
        return np.c_[x, more] @ self.rotation

    def bounds(self, q: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """At least each query's k-th least distance, which is its k-th least in the sample,
        and the lists that hold those k, so that as many are found."""
        d = (self.sample**2).sum(1) - 2 * q @ self.sample.T + (q * q).sum(1)[:, None]
        d[ids[:, None] == self.ids] = np.inf
        if d.shape[1] <= k:
            return np.full(len(q), np.inf), np.zeros((len(q), 0), np.int64)
        best = np.argpartition(d, k - 1, axis=1)[:, :k]
        return np.take_along_axis(d, best, 1).max(1) * (1 + 1e-9) + 1e-9, self.distances(self.sample).argmin(1)[best]

    def distances(self, x: np.ndarray) -> np.ndarray:
        return (self.centroids**2).sum(1) - 2 * x @ self.centroids.T


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        at = np.concatenate([((c**2).sum(1) - 2 * part @ c.T).argmin(1) for part in np.array_split(x, 1 + len(x) // 4096)])
        n = np.bincount(at, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)])
    return c


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the vectors that take part: an id, no null or non-finite component, not
    zero, and as many components as most vectors have."""
    v = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists("v", lambda x: x != 0))
    usual = v.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1)
    d = usual.first()
    return v.where(F.size("v") == (d["d"] if d else 0))


def _matrix(col: pa.Array) -> np.ndarray:
    flat = (col if isinstance(col, pa.Array) else col.combine_chunks()).flatten().to_numpy()
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 0))


def build(rows: DataFrame, seed: int = 11) -> Index | None:
    """Fit rotation and centroids on a bounded sample of ``rows`` (id, v)."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("m"), F.max(F.size("v")).alias("d")).first()
    if not total["n"]:
        return None
    rng = np.random.default_rng(seed)
    rotation, _ = np.linalg.qr(rng.standard_normal((total["d"] + 1, total["d"] + 1)))
    index = Index(rotation, float(total["m"]) * (1 + 1e-9), np.zeros((1, total["d"] + 1)))
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("id", "v").toArrow()
    sample = index.turned(_matrix(chosen["v"]), False)
    index.ids, index.sample = chosen["id"].to_numpy()[:BOUND_ROWS], sample[:BOUND_ROWS]
    lists = int(min(MOST_LISTS, max(1, total["n"] ** 0.5 / 2.5), max(1, len(sample) // 8)))
    index.centroids = _kmeans(sample, lists, rng)
    return index


def share(at: int, dims: int, width: float) -> float:
    """The most of a vector's squared length that its first ``at`` of ``dims`` columns hold,
    after a random rotation, but for ``width`` standard errors: the share is beta
    distributed with mean p = at / dims and variance 2 p (1 - p) / (dims + 2)."""
    p = at / dims
    return 1.0 if at >= dims else min(1.0, p + width * (2 * p * (1 - p) / (dims + 2)) ** 0.5)


def scan(x: np.ndarray, q: np.ndarray, bound: np.ndarray, width: float = WIDTH, columns: int = COLUMNS) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) pairs whose squared distance no test put beyond the query's ``bound``.

    Distances grow by column blocks. After each, a pair is abandoned if its partial distance
    is more than a pair within the bound would show (see :func:`share`). While many are left
    a block is one matrix product, later it is computed for the pairs that are left."""
    dims = x.shape[1]
    part, left = np.zeros((len(q), len(x))), np.ones((len(q), len(x)), bool)
    asked = rows = None
    at = 0
    while at < dims:
        to = min(at + columns, dims)
        a, b = x[:, at:to], q[:, at:to]
        most = bound * (share(to, dims, width) * (1 + 1e-9)) + 1e-9
        if asked is None:
            part += (b * b).sum(1)[:, None] - 2 * b @ a.T + (a * a).sum(1)
            left &= part <= most[:, None]
            if np.count_nonzero(left) < SPARSE * left.size:
                asked, rows = np.nonzero(left)
                part = part[asked, rows]
        else:
            part += ((a[rows] - b[asked]) ** 2).sum(1)
            keep = part <= most[asked]
            asked, rows, part = asked[keep], rows[keep], part[keep]
        at = to
    return np.nonzero(left) if asked is None else (asked, rows)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", probed: float = PROBED) -> DataFrame:
    """The ``k`` rows of ``vectors`` nearest to each query by largest inner product:
    query_id, rank (from 1), the row's id, score (double, on the original vectors).

    A query's own row (same id) is no candidate. Ties go to the smaller id; repeated rows
    of ``vectors`` count each, repeated query ids ask once (with the least vector). With fewer than ``k`` candidates all come. Vectors (and queries) that are
    null, zero, of another length than most, or that hold a null or non-finite component,
    and rows with a null id, take no part. Other columns are not read. Empty tables give
    no rows. Approximate: lists that are not probed, and candidates that a test drops."""
    spark = ready(vectors.sparkSession)
    schema = f"query_id long, rank int, {id_col} long, score double"
    rows = usable(vectors, id_col, vector_col)
    index = build(rows)
    if index is None:
        return spark.createDataFrame([], schema)
    width = len(index.rotation) - 1
    asked = queries.select(queries[id_col].cast("long").alias("id"), queries[vector_col].cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    asked = asked.where(F.col("id").isNotNull() & F.coalesce((F.size("v") == width) & fine & F.exists("v", lambda x: x != 0), F.lit(False)))
    asked = asked.groupBy("id").agg(F.min("v").alias("v"))
    sent = spark.sparkContext.broadcast(index)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = sent.value.turned(_matrix(b.column(1)), False)
                at = np.concatenate([sent.value.distances(p).argmin(1) for p in np.array_split(x, 1 + len(x) // 1024)])
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *b.columns], names=["list", "id", "v"])

    listed = rows.select("id", "v").mapInArrow(assign, "list int, id long, v array<double>")
    listed = cut(listed)
    sizes = np.zeros(len(index.centroids), np.int64)
    for r in listed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect():  # a row for each centroid
        sizes[r["list"]] = r["n"]
    index.sizes = sizes
    told = spark.sparkContext.broadcast(index)
    blocks = F.lit(1) + F.element_at(F.lit((sizes // BLOCK_ROWS).tolist()), F.col("list") + 1) if sizes.max() >= BLOCK_ROWS else F.lit(1)
    dealt = listed.withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    # a task meets a bounded part of the queries too
    turns = 1 + int(asked.agg(F.count(F.lit(1)).alias("n")).first()["n"] * probed) // QUERY_ROWS
    dealt = dealt.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = told.value
        most = max(LEAST_PROBED, int(np.ceil(probed * len(ix.sizes))))
        for b in batches:
            if not b.num_rows:
                continue
            turned = ix.turned(_matrix(b.column(1)), True)
            ids = b.column(0).to_numpy()
            parts = [ix.bounds(turned[i : i + 128], ids[i : i + 128], k) for i in range(0, len(ids), 128)]
            bound, holding = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = ix.distances(turned).argsort(1, kind="stable")
            near = ix.sizes[order].cumsum(1)
            n = np.maximum(most, (near < 2 * k + 1).sum(1) + 1)  # lists with enough rows
            row, at, blk = [], [], []
            for i, m in enumerate(np.minimum(n, len(ix.sizes)).tolist()):
                for j in {*order[i, :m].tolist(), *holding[i].tolist()}:
                    blocks = 1 + int(ix.sizes[j]) // BLOCK_ROWS
                    row += [i] * blocks
                    at += [j] * blocks
                    blk += range(blocks)
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(blk, pa.int32()), b.column(0).take(take), pa.array(bound).take(take), b.column(1).take(take)], names=["list", "block", "id", "bound", "v"])

    sent_queries = asked.mapInArrow(probe, "list int, block int, id long, bound double, v array<double>")
    sent_queries = sent_queries.withColumn("turn", F.pmod(F.xxhash64("id"), F.lit(turns)).cast("int"))

    def look(data: pa.Table, ask: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)])
        if len(data) and len(ask):
            raw, ids = _matrix(data["v"]), data["id"].to_numpy()
            x = told.value.turned(raw, False)
            wants, asks, bound = _matrix(ask["v"]), ask["id"].to_numpy(), ask["bound"].to_numpy()
            turned = told.value.turned(wants, True)
            step = max(1, PAIRS // len(x))
            for at in range(0, len(asks), step):
                q, row = scan(x, turned[at : at + step], bound[at : at + step])
                q += at
                other = ids[row] != asks[q]
                q, row = q[other], row[other]
                s = np.concatenate([np.zeros(0), *((raw[row[i : i + PAIRS]] * wants[q[i : i + PAIRS]]).sum(1) for i in range(0, len(q), PAIRS))])
                order = np.lexsort((ids[row], -s, q))
                q, row, s = q[order], row[order], s[order]
                nth = np.arange(len(q)) - np.searchsorted(q, q)
                for k_th, v in enumerate((asks[q], ids[row], s)):
                    out[k_th].append(v[nth < k])
        return pa.table([pa.array(np.concatenate(v)) for v in out], names=["query_id", "vec", "score"])

    found = dealt.groupBy("list", "block", "turn").cogroup(sent_queries.groupBy("list", "block", "turn")).applyInArrow(look, "query_id long, vec long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", F.col("vec").alias(id_col), "score")
