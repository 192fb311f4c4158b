"""Exact dedup by content sort (operator 1).

Rows are range-partitioned by sampled splitters over their normalised bytes and
sorted inside each partition (Spark's external sort), so equal texts lie next to
each other; neighbours are then compared in full. The splitters are taken over
(first bytes, digest, length, id): their size is bounded however long the texts
are, and a text that a third of all rows share is cut into many partitions. The
runs that touch an end of a partition, two each at most, are put together after.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, cut, partitions, ready, text_or_empty

#: Characters of the normalised text that a splitter holds.
HEAD = 64


def normalised(text) -> F.Column:
    """The text without the characters of ``[\\x20\\x09-\\x0D]`` (null: empty)."""
    return F.regexp_replace(text_or_empty(text), BLANKS + "+", "")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the runs of equal neighbours of one sorted partition.

    A run's rows come out when it has ended; only ids and lengths are held.
    ``edge_text`` is set in the first row of the runs at the partition's ends."""
    part, run, last = TaskContext.get().partitionId(), 0, None
    held: list[tuple] = []  # (id, chars, digest) arrays of the open run

    def out(ids, chars, digest, runs, keep, size, pos, text):
        n = len(ids)
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(np.full(n, part, np.int32)), pa.array(runs), pa.array(pos), pa.array(size), keep, chars, digest, text],
            names=["id", "part", "run", "pos", "size", "keep", "chars", "digest", "edge_text"],
        )

    def close(parts, run, edge):
        ids, chars, digest = (pa.concat_arrays([p[k] for p in parts]) for k in range(3))
        n = len(ids)
        text = pa.array([last if edge else None] + [None] * (n - 1), pa.string())
        return out(ids, chars, digest, np.full(n, run, np.int64), ids.take(pa.array(np.zeros(n, np.int64))), np.full(n, n, np.int64), np.arange(n, dtype=np.int64), text)

    for b in batches:
        if not b.num_rows:
            continue
        ids, chars, digest, norm = (b.column(k) for k in range(4))
        n = b.num_rows
        new = np.ones(n, bool)
        new[1:] = pc.not_equal(norm.slice(1), norm.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        new[0] = last is None or norm[0].as_py() != last
        starts = np.flatnonzero(new)
        if not len(starts):
            held.append((ids, chars, digest))
            continue
        if held or starts[0]:
            if starts[0]:
                held.append((ids.slice(0, starts[0]), chars.slice(0, starts[0]), digest.slice(0, starts[0])))
            yield close(held, run, run == 0)
            run, held = run + 1, []
        if len(starts) > 1:  # runs that begin and end here
            at, to = int(starts[0]), int(starts[-1])
            sizes = np.diff(starts)
            first = np.repeat(starts[:-1], sizes)
            text = pa.nulls(to - at, pa.string())
            if run == 0:  # the partition's first run
                text = pa.array([norm[at].as_py()] + [None] * (to - at - 1), pa.string())
            yield out(ids.slice(at, to - at), chars.slice(at, to - at), digest.slice(at, to - at), run + np.repeat(np.arange(len(sizes)), sizes), ids.take(pa.array(first)), np.repeat(sizes, sizes), np.arange(at, to) - first, text)
            run += len(sizes)
        to = int(starts[-1])
        held, last = [(ids.slice(to), chars.slice(to), digest.slice(to))], norm[to].as_py()
    if held:
        yield close(held, run, True)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting ``[\\x20\\x09-\\x0D]``; a null
    text is empty, and empty texts are equal to each other. The row with the most
    code points in the original text stays, then the smallest id (a null id comes
    last). Repeated rows (same id and text) are rows of their own: one of them
    stays. Other columns of ``docs`` are not read. An empty table gives no rows."""
    spark = ready(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    text = docs[text_col]
    rows = docs.select(docs[id_col].alias("id"), F.length(text_or_empty(text)).cast("long").alias("chars"), normalised(text).alias("norm"))
    rows = rows.select("id", "chars", F.sha2("norm", 256).alias("digest"), "norm")
    order = [F.substring("norm", 1, HEAD), F.col("digest")]
    rank = [F.desc("chars"), F.asc_nulls_last("id")]
    dealt = rows.repartitionByRange(partitions(spark), *order, *rank).sortWithinPartitions(*order, "norm", *rank)
    runs = cut(dealt.mapInArrow(_runs, f"id {id_type}, part int, run long, pos long, size long, keep {id_type}, chars long, digest string, edge_text string"))

    # at most two runs of each partition meet here, one row each
    ends = runs.where("edge_text IS NOT NULL")
    best = F.struct((-F.col("chars")).alias("c"), F.col("id").isNull().alias("n"), F.col("id").alias("id"), F.col("part").alias("p"))
    whole = ends.groupBy("edge_text").agg(F.min(best).alias("best"), F.sum("size").alias("whole"))
    whole = ends.select("edge_text", "part", "run").join(whole, "edge_text").select(
        "part", "run", F.col("best.id").alias("best_id"), (F.col("best.p") == F.col("part")).alias("holds"), "whole"
    )
    found = F.col("whole").isNotNull()
    return runs.join(whole, ["part", "run"], "left").select(
        F.col("id").alias(id_col),
        F.when(found, F.col("best_id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("whole", "size").alias("group_size"),
        ((F.col("pos") == 0) & F.coalesce("holds", F.lit(True))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_duplicates` keeps, with all their columns."""
    key = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))
    kept = exact_duplicates(docs, id_col, text_col).where("kept").select(key(F.col(id_col)).alias("key"), F.col("text_sha256").alias("own"))
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        key(docs[id_col]).alias("key"),
        F.sha2(normalised(docs[text_col]), 256).alias("own"),
        F.length(text_or_empty(docs[text_col])).alias("chars"),
    )
    # repeated rows (one id, equal texts) are told apart by nothing: the longest stays
    order = Window.partitionBy("key", "own").orderBy(F.desc("chars"))
    both = rows.join(kept, ["key", "own"]).withColumn("nth", F.row_number().over(order))
    return both.where("nth = 1").select("row.*")
