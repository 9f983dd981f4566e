"""Document quality from a linear-chain conditional random field over lines.

Each line has shares of character classes, lengths and repeats as features, with those of the lines
before and after it. The field labels lines good or bad. It learns from labelled documents: their
lines take the document's label; then lines of bad documents that a first fit finds good become
good, except for the worst one, and the field is fitted again. A document's score is the mean of
its lines' marginals of `good`, weighted by length, mapped to a probability by a logistic curve
that is fitted on the same sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from tessera.llm import crf
from tessera.llm.labelled import labelled_sample
from tessera.llm.shared import sized
from tessera.llm.text import SPACE, blocks, span_hashes, utf8, words

# classes of bytes: lower, upper, digit, space, sentence marks, other marks by kind, beyond ASCII
_CLASS = np.full(256, 6, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[np.flatnonzero(SPACE)] = 3
for _mark in ".,;:?'\"()-":
    _CLASS[ord(_mark)] = 4
for _mark in "!|":
    _CLASS[ord(_mark)] = 5
_CLASS[0xC0:] = 7
_CLASS[0x80:0xC0] = 8
_CLASSES = 9


def line_features(data: np.ndarray, offsets: np.ndarray):
    """Features of each line, first line and number of lines of each text, and lengths in characters."""
    breaks = np.flatnonzero(data == 10) + 1
    n = len(offsets) - 1
    per = np.bincount(np.searchsorted(offsets, breaks - 1, "right") - 1, minlength=n) + 1 if len(breaks) else np.ones(n, np.int64)
    first = np.r_[0, np.cumsum(per)]
    edges = np.empty(first[-1] + 1, np.int64)
    edges[first[:-1]], edges[-1] = offsets[:-1], offsets[-1]
    inner = np.ones(len(edges), bool)
    inner[first] = False
    edges[inner] = breaks
    m = first[-1]
    line = np.repeat(np.arange(m), np.diff(edges))
    counts = np.bincount(line * _CLASSES + _CLASS[data], minlength=m * _CLASSES).reshape(m, _CLASSES).astype(float)
    chars = counts.sum(1) - counts[:, 8]
    start, end, own = words(data, edges)
    h = span_hashes(data, start, end)
    number = np.bincount(own, minlength=m)
    same = np.bincount(own[1:][(h[1:] == h[:-1]) & (own[1:] == own[:-1])], minlength=m)
    tail = data[end - 1]
    odd_end = np.bincount(own[np.isin(_CLASS[tail], (5, 6))], minlength=m)
    whole = np.maximum(chars, 1)
    w = np.maximum(number, 1)
    parts = [
        counts[:, :8] / whole[:, None],
        np.stack(
            [
                np.log1p(chars) / 6,
                np.log1p(number) / 5,
                np.minimum((chars - counts[:, 3]) / w, 30) / 10,
                same / w,
                odd_end / w,
                counts[:, 1] / np.maximum(counts[:, 0] + counts[:, 1] + counts[:, 7], 1),
                (chars == 0).astype(float),
                np.ones(m),
            ],
            1,
        ),
    ]
    own_x = np.concatenate(parts, 1)
    before, after = np.zeros_like(own_x), np.zeros_like(own_x)
    before[1:], after[:-1] = own_x[:-1], own_x[1:]
    before[first[:-1]] = 0
    after[first[1:] - 1] = 0
    return np.concatenate([own_x, before, after], 1), first[:-1], per, chars + 1


def document_scores(params: np.ndarray, move: np.ndarray, x, first, per, chars) -> np.ndarray:
    """Length-weighted mean of the marginals of label 1."""
    _, prob, _ = crf.marginals(x @ params, first, per, move)
    return np.add.reduceat(prob[:, 1] * chars, first) / np.add.reduceat(chars, first)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))[:, None]


def fit_lines(texts: list[str], labels: list[int], steps: int = 60):
    """Parameters, moves and curve of a sample of labelled documents (none: every score is a half)."""
    if not texts:
        x = line_features(np.empty(0, np.uint8), np.zeros(2, np.int64))[0]
        return np.zeros((x.shape[1], 2)), np.zeros((2, 2)), np.zeros(2)
    data, offsets = utf8(pa.array(texts, pa.large_string()))
    # in blocks, so that the arrays by byte stay small
    parts = [line_features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in blocks(offsets)]
    x, per, chars = (np.concatenate([p[k] for p in parts]) for k in (0, 2, 3))
    first = np.r_[0, np.cumsum(per)[:-1]]
    y_doc = np.array(labels)
    y = np.repeat(y_doc, per)
    go = lambda y, steps: crf.fit(lambda p: x @ p, lambda r: x.T @ r, np.zeros((x.shape[1], 2)), 2, y, first, per, steps, 1e-4, rate=0.2)
    # lines alone first: which lines of bad documents look like those of good ones?
    weight = np.where(y == 1, (y == 0).mean() + 0.05, (y == 1).mean() + 0.05)
    alone = crf.logistic(x, y.astype(float), weight=weight)
    good = crf.sigmoid(np.c_[x, np.ones(len(x))] @ alone)
    worst = np.minimum.reduceat(good, first)
    y = np.where((y == 0) & (good > 0.5) & (good > np.repeat(worst, per)), 1, y)
    params, move = go(y, steps)
    curve = crf.logistic(_logit(document_scores(params, move, x, first, per, chars)), y_doc.astype(float))
    return params, move, curve


def line_quality(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", fit_rows: int = 2500, cut: float = 0.3, carry: bool = False) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of `docs`, repeated rows included.

    With `carry` also text, and row, a struct of all other columns of `docs`.

    score is the probability of label 1; null and empty texts are one empty line and are scored as
    such. Fitted on at most `fit_rows` labelled rows outside the fold `held_out`, which may use the
    id only (null: in the training fold); without any, each score is 0.5. Texts are read whole.
    """
    sized(docs.sparkSession)
    model = fit_lines(*labelled_sample(docs, labels, label, held_out, fit_rows, id_col, text_col))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        params, move, curve = shared.value
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for lo, hi in blocks(offsets):
                base = offsets[lo]
                raw = document_scores(params, move, *line_features(data[base : offsets[hi]], offsets[lo : hi + 1] - base))
                score = crf.sigmoid(_logit(raw)[:, 0] * curve[0] + curve[1])
                own = [batch.column(k).slice(lo, hi - lo) for k in (0, 1, *(range(2, batch.num_columns) if carry else ()))]
                yield pa.RecordBatch.from_arrays([*own[:2], pa.array(score), pa.array((score >= cut).astype(np.int32)), *own[2:]], schema.names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"), *([F.struct(*(c for c in docs.columns if c != text_col)).alias("row")] if carry else []))
    schema = StructType([StructField("doc_id", LongType()), StructField("held_out", BooleanType()), StructField("score", DoubleType()), StructField("predicted", IntegerType()), *(f for f in rows.schema if carry and f.name in ("text", "row"))])
    return rows.mapInArrow(run, schema)
