"""Toxicity by FTRL-proximal logistic regression on word n-grams and skip-grams (operator 3).

Features are hashed: single words, neighbouring pairs, and pairs with one or two words
between them, each once a document. Training is online with a rate for each coordinate;
the L1 term leaves few weights that are not zero, so the model is a small broadcast and
scoring is one narrow pass over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, slices
from .words import PUNCTUATION, Words, mix

BITS = 22
#: Distances of the two words of a pair.
GAPS = (1, 2, 3)
#: Labelled rows that the model is fitted on at most (those with the least hashed ids).
TRAINING_ROWS = 16_384
#: Rows of the training set that a feature has to occur in.
LEAST_ROWS = 3
EPOCHS = 4


def hashed_grams(col: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text) of every word and pair of words of a column of texts, with repeats."""
    words = Words(col, lower=True, blank=PUNCTUATION)
    h, doc = words.hashes(), words.doc()
    shift = np.uint64(64 - bits)
    features, of = [h >> shift], [doc]
    for gap in GAPS:
        same = doc[gap:] == doc[:-gap]
        with np.errstate(over="ignore"):
            pair = mix(h[:-gap] * np.uint64(2 * gap + 3) + h[gap:])
        features.append((pair >> shift)[same])
        of.append(doc[gap:][same])
    return np.concatenate(features).astype(np.int32), np.concatenate(of)


@dataclass
class Model:
    """The weights that are not zero; ``prior`` holds when nothing could be learnt."""

    bias: float
    features: np.ndarray
    weights: np.ndarray


def fit_ftrl(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, alpha: float = 0.5, beta: float = 1.0, l1: float = 8.0, l2: float = 0.1, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """FTRL-proximal on rows of distinct features; labels 0 or 1."""
    if not len(labels) or labels.min() == labels.max():
        p = min(max(float(labels.mean()) if len(labels) else 0.0, 0.01), 0.99)
        return Model(float(np.log(p / (1 - p))), np.zeros(0, np.int32), np.zeros(0, np.float32))
    often = np.zeros(1 << bits, np.int32)
    for f in rows:
        often[f] += 1
    used = np.flatnonzero(often >= LEAST_ROWS)
    place = np.full(1 << bits, -1, np.int32)
    place[used] = np.arange(len(used))
    rows = [(x := place[f])[x >= 0] for f in rows]
    z, n = np.zeros(len(used)), np.zeros(len(used))
    zb = nb = 0.0
    order, rng = np.arange(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        for k in order:
            f = rows[k]
            zf, nf = z[f], n[f]
            root = np.sqrt(nf)
            w = -np.sign(zf) * np.maximum(np.abs(zf) - l1, 0) / ((beta + root) / alpha + l2)
            rate_b = alpha / (beta + nb**0.5)
            p = 1 / (1 + np.exp(-min(max(w.sum() - zb * rate_b, -35), 35)))
            g = p - labels[k]
            z[f] = zf + g - (np.sqrt(nf + g * g) - root) / alpha * w
            n[f] = nf + g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / alpha * (-zb * rate_b)
            nb += g * g
    w = -np.sign(z) * np.maximum(np.abs(z) - l1, 0) / ((beta + np.sqrt(n)) / alpha + l2)
    kept = np.flatnonzero(w)
    return Model(float(-zb * alpha / (beta + nb**0.5)), used[kept].astype(np.int32), w[kept].astype(np.float32))


def held_out(id_col) -> F.Column:
    """Rows whose crc32 of the id as text leaves 2 modulo 4 are never learnt from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _lowered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].alias("id"), F.lower(docs[text_col].cast("string")).alias("text"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = TRAINING_ROWS) -> Model:
    """Fit on at most ``most`` labelled documents outside the held-out part. Null labels
    and ids are left out; an id with several labels counts once, as toxic if any says so."""
    ready(docs.sparkSession)
    known = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    known = known.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(most)
    texts = _lowered(docs, id_col, text_col).join(F.broadcast(chosen), "id").select("id", "text", "y")  # ``most`` rows

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            f, of = hashed_grams(b.column(1))
            both = np.unique(of.astype(np.int64) << 32 | f)
            ends = np.searchsorted(both >> 32, np.arange(b.num_rows + 1))
            data = (both & 0xFFFFFFFF).astype("<i4").tobytes()
            parts = [data[4 * a : 4 * z] for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(2), pa.array(parts, pa.binary())], names=["id", "y", "f"])

    rows = texts.mapInArrow(gather, "id string, y int, f binary").toArrow().sort_by("id")
    sparse = [np.frombuffer(x.as_buffer(), "<i4") for x in rows["f"]]
    return fit_ftrl(sparse, rows["y"].to_numpy().astype(float))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """id_col, held_out, score (0 to 1), predicted, from each row's whole text.

    A null or empty text, or one without words, has the score of the bias alone. Rows
    with a null id are scored like any other, repeated rows each; other columns are not
    read. An empty table gives no rows."""
    spark = ready(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        table = np.zeros(1 << BITS, np.float32)
        table[m.features] = m.weights
        for b in slices(batches, "text"):
            f, of = hashed_grams(b.column(1))
            hit = np.flatnonzero(table[f])
            both = np.unique(of[hit].astype(np.int64) << 32 | f[hit])  # each feature once a document
            total = np.bincount(both >> 32, table[both & 0xFFFFFFFF].astype(float), minlength=b.num_rows) + m.bias
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], names=["id", "score"])

    scored = _lowered(docs, id_col, text_col).mapInArrow(run, f"id {id_type}, score double")
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on ``labels.toxic`` and score every row of ``docs``."""
    return score(docs, train(docs, labels, id_col, text_col), id_col, text_col)
