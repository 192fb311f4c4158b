"""Quality by co-training of a text view and a metadata view (operator 2).

The text view sees a document's words and their shapes; the metadata view sees what a
page index holds: language, source, length, lines and the make-up of its characters.
Each view's classifier labels the unlabelled documents it is surest of for the other,
round after round. Both are then calibrated on labelled rows that neither has learnt
from, and a logistic regression on the two calibrated scores combines them.

Fitting uses bounded samples (LABELLED and UNLABELLED rows, chosen by hashed ids);
scoring is one narrow pass over every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, slices
from .toxicity import held_out
from .words import Words, _powers, mix

#: Rows that the classifiers are fitted on at most, and unlabelled rows they may label.
LABELLED, UNLABELLED = 4000, 4000
ROUNDS = 5
#: Pseudo-labels that a view hands on in a round at most, and the least confidence.
HANDED, CONFIDENT = 200, 0.95
#: Hashed dimensions of words and of word shapes; the last text dimension counts repeats.
WORD_BITS, SHAPE_BITS = 10, 9
TEXT_DIMS = (1 << WORD_BITS) + (1 << SHAPE_BITS) + 1
LANG_DIMS, SOURCE_DIMS, MEASURES = 16, 64, 9
META_DIMS = LANG_DIMS + SOURCE_DIMS + MEASURES
#: Text bytes that a step works on at a time: the views hold some arrays a byte.
STEP = 512 << 10
#: Score from which a document is kept.
KEEP = 0.4

_CLASS = np.array([1 if 65 <= b <= 90 else 2 if 97 <= b <= 122 else 3 if 48 <= b <= 57 else 4 if b >= 128 else 16 + b for b in range(256)], np.uint64)
_SHAPE_BASE = np.uint64(0xC2B2AE3D27D4EB4F)
_UPPER, _DIGIT, _OTHER, _LINE, _BLANK = ((_CLASS == 1), (_CLASS == 3), (_CLASS == 4), np.arange(256) == 10, np.isin(np.arange(256), [32, 9, 10, 11, 12, 13]))
_SYMBOL = (_CLASS > 15) & ~_BLANK


def _shapes(words: Words) -> np.ndarray:
    """A hash of each word's shape: its runs of capitals, small letters, digits, other
    letters and single signs."""
    kind = _CLASS[words.data]
    new = np.ones(len(kind), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[words.start] = True
    nth = np.cumsum(new)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(kind) + 1, np.uint64)
        np.cumsum(np.where(new, mix(kind) * _powers(_SHAPE_BASE, len(kind) + 1)[nth], np.uint64(0)), out=sums[1:])
        inverse = np.uint64(pow(int(_SHAPE_BASE), -1, 1 << 64))
        h = (sums[words.end] - sums[words.start]) * _powers(inverse, len(kind) + 1)[nth[words.start]]
    return mix(h)


def text_view(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, dimension, value): the shares of a text's words in each hashed dimension."""
    words = Words(col)
    h, doc = words.hashes(), words.doc()
    n = np.maximum(np.diff(words.first), 1)
    again = np.flatnonzero((h[1:] == h[:-1]) & (doc[1:] == doc[:-1])) + 1
    dim = np.concatenate([(h >> np.uint64(64 - WORD_BITS)).astype(np.int64), (1 << WORD_BITS) + (_shapes(words) >> np.uint64(64 - SHAPE_BITS)).astype(np.int64), np.full(len(again), TEXT_DIMS - 1)])
    both, counts = np.unique(np.concatenate([doc, doc, doc[again]]) * TEXT_DIMS + dim, return_counts=True)
    of = both // TEXT_DIMS
    return of, both % TEXT_DIMS, np.sqrt(counts / n[of])


def meta_view(col: pa.Array, lang: pa.Array, source: pa.Array) -> np.ndarray:
    """A row per document: hashed language and source, and measures of its make-up."""
    words = Words(col)
    size = pa.compute.binary_length(col.fill_null("")).to_numpy().astype(np.int64)
    off = np.r_[0, np.cumsum(size)]
    sums = lambda mask: np.diff(np.r_[0, np.cumsum(mask[words.data])][off])
    out = np.zeros((len(col), META_DIMS), np.float32)
    rows = np.arange(len(col))
    for value, dims, at in ((lang, LANG_DIMS, 0), (source, SOURCE_DIMS, LANG_DIMS)):
        w = Words(value)
        one = np.zeros(len(col), np.uint64)
        some = np.diff(w.first) > 0
        one[some] = w.hashes()[w.first[:-1][some]]
        out[rows, at + (one % np.uint64(dims)).astype(int)] = 1
    total, n_words = np.maximum(size, 1), np.diff(words.first)
    lines = sums(_LINE) + 1
    measures = [np.log1p(size) / 10, np.log1p(lines) / 5, np.log1p(size / lines) / 8, np.log1p(size / np.maximum(n_words, 1)) / 3, 4 * sums(_UPPER) / total, 4 * sums(_DIGIT) / total, sums(_OTHER) / total, 4 * sums(_SYMBOL) / total, 2 * sums(_BLANK) / total]
    out[:, LANG_DIMS + SOURCE_DIMS :] = np.stack(measures, 1)
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-4, steps: int = 300, rate: float = 0.5) -> np.ndarray:
    """Weights and bias of a logistic regression (full gradients, Adam)."""
    w = np.zeros(x.shape[1] + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w[:-1].astype(x.dtype) + w[-1], -30, 30)))
        e = (p - y).astype(x.dtype)
        g = np.r_[x.T @ e / len(y), e.mean()] + l2 * np.r_[w[:-1], 0]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8) * min(1.0, 30 / t)
    return w


def logit(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


@dataclass
class Model:
    """Weights of both views and of their combination; None: nothing could be learnt."""

    text: np.ndarray | None
    meta: np.ndarray | None
    both: np.ndarray | None
    rounds: list[tuple[int, int]]


def cotrain(text: np.ndarray, meta: np.ndarray, y: np.ndarray, free_text: np.ndarray, free_meta: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Fit both views on labelled rows, exchange confident labels for the free rows over
    ``rounds``, then calibrate and combine on a fourth of the labelled rows, set aside."""
    if not len(y) or y.min() == y.max():
        return Model(None, None, None, [])
    aside = np.arange(len(y)) % 4 == 3
    if not (0 < y[aside].sum() < aside.sum()) or not (0 < y[~aside].sum() < (~aside).sum()):
        aside = np.zeros(len(y), bool)  # too few rows to set any aside
    held = aside if aside.any() else ~aside
    views, free = [text, meta], [free_text, free_meta]
    told = [np.full(len(free_text), -1), np.full(len(free_text), -1)]  # labels that each view was handed
    log = []
    for nth in range(rounds + 1):
        fitted = []
        for v in (0, 1):
            some = told[v] >= 0
            fitted.append(fit_logistic(np.concatenate([views[v][~aside], free[v][some]]), np.concatenate([y[~aside], told[v][some]])))
        if nth == rounds or not len(free_text):
            break
        for v in (0, 1):
            p = 1 / (1 + np.exp(-logit(free[v], fitted[v])))
            for label, sure, share in ((1, p, y.mean()), (0, 1 - p, 1 - y.mean())):
                open_rows = np.flatnonzero((told[1 - v] < 0) & (sure >= CONFIDENT))
                best = open_rows[np.argsort(-sure[open_rows], kind="stable")][: max(1, int(HANDED * share))]
                told[1 - v][best] = label
        log.append((int((told[0] >= 0).sum()), int((told[1] >= 0).sum())))
    scores = []
    for v in (0, 1):  # Platt scaling of each view
        z = logit(views[v], fitted[v])[held]
        a, b = fit_logistic(z[:, None] / 4, y[held])
        fitted[v] = np.r_[fitted[v][:-1] * a / 4, fitted[v][-1] * a / 4 + b]
        scores.append(logit(views[v], fitted[v])[held])
    both = fit_logistic(np.stack(scores, 1) / 4, y[held], l2=1e-2)
    return Model(fitted[0], fitted[1], np.r_[both[:-1] / 4, both[-1]], log)


def _columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text, lang, source; a table without lang or source has nulls there."""
    extra = [docs[c].cast("string").alias(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("lang", "source")]
    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"), *extra)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", labelled: int = LABELLED, unlabelled: int = UNLABELLED, rounds: int = ROUNDS) -> Model:
    """Fit on at most ``labelled`` and ``unlabelled`` documents. Null labels and ids are
    left out; an id with several labels counts once, with the lowest. Rows whose crc32
    of the id leaves 2 modulo 4 are never learnt from, so accuracy can be measured there."""
    ready(docs.sparkSession)
    rows = _columns(docs, id_col, text_col)
    known = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL").groupBy("id").agg(F.min("y").alias("y"))
    chosen = known.where(~held_out(F.col("id"))).orderBy(F.xxhash64("id"), "id").limit(labelled)
    free = rows.select("id").where("id IS NOT NULL").distinct().where(~held_out(F.col("id"))).join(known, "id", "left_anti")
    free = free.orderBy(F.xxhash64("id"), "id").limit(unlabelled).withColumn("y", F.lit(-1))
    sample = rows.join(F.broadcast(chosen.union(free)), "id")  # at most labelled + unlabelled ids

    def views(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", STEP):
            of, dim, value = text_view(b.column(1))
            ends = np.searchsorted(of, np.arange(b.num_rows + 1))
            meta = meta_view(*(b.column(k) for k in (1, 2, 3)))
            cut = list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
            parts = lambda x, cut=cut: pa.array([x[a:z].tobytes() for a, z in cut], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(4), parts(dim.astype("<u2")), parts(value.astype("<f4")), pa.array([r.tobytes() for r in meta], pa.binary())], names=["id", "y", "dim", "value", "meta"])

    got = sample.select("id", "text", "lang", "source", "y").mapInArrow(views, "id string, y int, dim binary, value binary, meta binary").toArrow().sort_by("id")
    text = np.zeros((len(got), TEXT_DIMS), np.float32)
    for k, (d, v) in enumerate(zip(got["dim"], got["value"], strict=True)):
        text[k, np.frombuffer(d.as_buffer(), "<u2")] = np.frombuffer(v.as_buffer(), "<f4")
    meta = np.stack([np.frombuffer(r.as_buffer(), np.float32) for r in got["meta"]]) if len(got) else np.zeros((0, META_DIMS), np.float32)
    y = got["y"].to_numpy()
    mixed = np.random.default_rng(5).permutation(len(y))  # ids may follow the data's order
    text, meta, y = text[mixed], meta[mixed], y[mixed]
    k = y >= 0
    return cotrain(text[k], meta[k], y[k].astype(np.float32), text[~k], meta[~k], rounds)


def _scores(m: Model, text: pa.Array, lang: pa.Array, source: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The text view's, the metadata view's and the combined score of each row."""
    n = len(text)
    if m.both is None:
        return np.ones(n), np.ones(n), np.ones(n)
    of, dim, value = text_view(text)
    x = np.bincount(of, value * m.text[dim], minlength=n) + m.text[-1]
    z = logit(meta_view(text, lang, source), m.meta)
    return tuple(1 / (1 + np.exp(-np.clip(s, -35, 35))) for s in (x, z, x * m.both[0] + z * m.both[1] + m.both[2]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """id_col, text_score, meta_score, score (probability of good quality), kept.

    Every row's whole text is scored; a null text is empty. A null language or source is
    a value of its own. Rows with a null id are scored, repeated rows each; other columns
    are not read. Where nothing could be learnt (no labels, or of one kind only) all
    scores are 1 and every row is kept. An empty table gives no rows."""
    spark = ready(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)  # a few thousand weights
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", STEP):
            a, c, s = _scores(sent.value, *(b.column(k) for k in (1, 2, 3)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.asarray(v, float)) for v in (a, c, s))], names=["id", "text_score", "meta_score", "score"])

    scored = _columns(docs, id_col, text_col).mapInArrow(run, f"id {id_type}, text_score double, meta_score double, score double")
    return scored.withColumnRenamed("id", id_col).withColumn("kept", F.col("score") >= keep)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on ``labels.quality`` and score every row of ``docs``."""
    return score(docs, train(docs, labels, id_col, text_col), id_col, text_col)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """The rows of ``docs`` scored ``keep`` or more, with all their columns.

    Each row is judged by its own text, in the pass that reads it, so rows with a null or
    repeated id need no join to find their verdict."""
    model = train(docs, labels, id_col, text_col)
    spark = ready(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)
    names = docs.columns
    at = [names.index(c) if c in names else None for c in (text_col, "lang", "source")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col, STEP):
            cols = [pa.nulls(b.num_rows, pa.string()) if k is None else b.column(k).cast(pa.string()) for k in at]
            yield b.filter(pa.array(_scores(sent.value, *cols)[2] >= keep))

    return docs.mapInArrow(run, docs.schema)
