"""Quality classifier by positive-unlabelled learning.

Trusted good documents are the positives, arbitrary documents the unlabelled ones. With the share of good documents among
all (the class prior) the risk of a classifier can be written without negatives; its part that stands for the negatives
is kept from falling below zero (non-negative risk estimate), which stops it from overfitting.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, held_out, mix64, pieces, span_hashes, text_bytes, translated, word_spans, words_table, whole_row

WORDS = words_table("visible", lower=False)
_CLASSES = np.zeros(256, np.int64)
for _i, _set in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r", b"\n",
                           b".,;:?'\"-", b"!", b"|", b"#$%&*+/<=>@[\\]^_`{}~()", bytes(range(128, 256)))):
    _CLASSES[list(_set)] = _i
N_CLASSES = 10
NAMES = ["log_bytes", *(f"share_{i}" for i in range(N_CLASSES)), "log_words", "word_length", "distinct", "distinct_root",
         "repeats_last", "shouted", "ends_odd", "distinct_lines", "words_per_line"]


def features(data: np.ndarray, offsets: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """Rows of figures on whole texts: what characters they are made of, and how words and lines repeat."""
    return np.concatenate([_piece(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                           for a, b in pieces(offsets, step)] or [np.zeros((0, len(NAMES)))])


def _piece(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    whole = np.maximum(sizes, 1)
    shares = np.stack([np.bincount(_CLASSES[data[offsets[i]:offsets[i + 1]]], minlength=N_CLASSES) for i in range(n)]) / whole[:, None]
    starts, ends, rows = word_spans(translated(data, WORDS), offsets)
    count = np.bincount(rows, minlength=n)
    words = np.maximum(count, 1)
    hashes = span_hashes(data, starts, ends)
    distinct = np.bincount(rows[_firsts(hashes, rows)], minlength=n)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    kinds = _CLASSES[data]
    shouted = np.zeros(len(starts), bool)
    odd = np.zeros(len(starts), bool)
    if len(starts):
        lower = np.concatenate(([0], np.cumsum(kinds == 0)))
        upper = np.concatenate(([0], np.cumsum(kinds == 1)))
        shouted = (lower[ends] == lower[starts]) & (upper[ends] - upper[starts] > 1)
        odd = np.isin(kinds[ends - 1], (6, 7, 8))
    blank = np.full(len(data), 0x61, np.uint8)
    blank[data == 10] = 0x20
    line_starts, line_ends, line_rows = word_spans(blank, offsets)
    lines = np.maximum(np.bincount(line_rows, minlength=n), 1)
    line_hashes = span_hashes(data, line_starts, line_ends)
    distinct_lines = np.bincount(line_rows[_firsts(line_hashes, line_rows)], minlength=n)

    def share(flags: np.ndarray) -> np.ndarray:
        return np.bincount(rows, weights=flags, minlength=n) / words

    return np.column_stack((
        np.log1p(sizes), shares, np.log1p(count), np.bincount(rows, weights=ends - starts, minlength=n) / words,
        distinct / words, distinct / np.sqrt(words), share(again), share(shouted), share(odd), distinct_lines / lines,
        np.log1p(count / lines)))


def _firsts(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.unique(mix64(hashes ^ mix64(rows.astype(np.uint64) + np.uint64(77))), return_index=True)[1]


@dataclass
class Model:
    """A linear score over figures cut into ranges."""

    borders: np.ndarray  # figures x borders
    weights: np.ndarray

    def encode(self, x: np.ndarray) -> np.ndarray:
        """For every figure and border whether it lies above, and a constant."""
        above = (x[:, :, None] > self.borders[None, :, :]).reshape(len(x), -1)
        return np.concatenate((above, np.ones((len(x), 1))), 1).astype(np.float32)

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.encode(x) @ self.weights)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 250, rate: float = 0.05,
        decay: float = 1e-4, ranges: int = 12) -> Model:
    """Minimise the non-negative unbiased risk with logistic loss; full batches, so the result is repeatable."""
    both = np.concatenate((positive, unlabelled))
    borders = np.quantile(both, np.linspace(0, 1, ranges + 1)[:-1], axis=0).T
    # Rare junk sits in the tails of a figure, so these get borders of their own.
    tails = np.quantile(both, [0.01, 0.02, 0.04, 0.96, 0.98, 0.99], axis=0).T
    model = Model(np.sort(np.concatenate((borders, tails), 1), 1), np.zeros(1))
    p, u = model.encode(positive), model.encode(unlabelled)
    w = np.zeros(p.shape[1], np.float32)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        gp, gu = p @ w, u @ w
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        good = -prior * (p.T @ sigmoid(-gp)) / len(p)
        bad = (u.T @ sigmoid(gu)) / len(u) - prior * (p.T @ sigmoid(gp)) / len(p)
        # Where the negatives' risk falls below zero, it is raised again instead of being lowered further.
        grad = (good + bad if negative >= 0 else -bad) + decay * w
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        w = (w - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    model.weights = w
    return model


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", id_name: str = "doc_id", text_name: str = "text",
          fold: tuple[int, int] | None = (4, 2), positives: int = 3000, unlabelled: int = 6000) -> Model:
    """Fit on at most ``positives`` trusted documents and ``unlabelled`` others, those of the smallest id hashes.

    Rows of the fold ``(modulus, remainder)`` are not learnt from at all. The class prior is the share of label 1 among
    all labelled rows outside the fold. Without any positive every document scores the prior.
    """
    ids = labels.select(F.col(id_name).cast("long").alias("doc_id"), F.col(label).alias("label")).filter("doc_id IS NOT NULL")
    texts = docs.select(F.col(id_name).cast("long").alias("doc_id"), text_bytes(text_name).alias("text")).filter("doc_id IS NOT NULL")
    if fold:
        ids, texts = ids.filter(~held_out("doc_id", *fold)), texts.filter(~held_out("doc_id", *fold))
    counts = {r[0]: r[1] for r in ids.filter("label IN (0, 1)").groupBy("label").count().collect()}
    total = sum(counts.values())
    prior = min(0.98, max(0.02, counts.get(1, 0) / total)) if total else 0.5
    trusted = ids.filter("label = 1").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(positives)
    others = texts.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(unlabelled)
    chosen = trusted.withColumn("kind", F.lit(1)).unionByName(others.withColumn("kind", F.lit(0)))
    rows = texts.join(F.broadcast(chosen.groupBy("doc_id").agg(F.max("kind").alias("good"), F.min("kind").alias("any"))), "doc_id")
    names = ["good", "any"]

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = buffers(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names),
                                              pa.array(list(features(data, offsets)), pa.list_(pa.float64()))],
                                             names=[*names, "x"])

    found = rows.select("text", *names).mapInArrow(figures, "good int, any int, x array<double>").collect()
    x = np.array([r.x for r in found]).reshape(-1, len(NAMES))
    good, some = np.array([r.good == 1 for r in found], bool), np.array([r.any == 0 for r in found], bool)
    if not good.any() or not some.any():
        return Model(np.zeros((len(NAMES), 1)), np.append(np.zeros(len(NAMES)), np.log(prior / (1 - prior))))
    return fit(x[good], x[some], prior)


def score(docs: DataFrame, model: Model, columns: list[str], text_name: str = "text") -> DataFrame:
    """``columns`` of ``docs`` under their names in a struct ``doc``, and the ``score`` of every row."""
    rows = docs.select(whole_row(docs, columns).alias("doc"), text_bytes(text_name).alias("text"))
    schema = rows.select("doc").schema.add("score", "double")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = buffers(batch.column("text"))
            values = model.score(features(data, offsets))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(values.astype(np.float64))], names=["doc", "score"])

    return rows.mapInArrow(judge, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, fold: tuple[int, int] = (4, 2),
             id_name: str = "doc_id", text_name: str = "text", **options) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Null and empty texts are scored as texts without any characters. Rows without an id are scored and not learnt from.
    Repeated rows are scored alike. Labels other than 0 and 1, nulls among them, are no labels. Without labels all
    documents score the prior; an empty table gives an empty table. Only ids, texts and the label are read.
    """
    model = learn(docs, labels, id_name=id_name, text_name=text_name, fold=fold, **options)
    found = score(docs.select(F.col(id_name).alias("doc_id"), F.col(text_name).alias("text")), model, ["doc_id"])
    return found.select("doc.doc_id", held_out("doc.doc_id", *fold).alias("held_out"), "score",
                        (F.col("score") >= threshold).cast("int").alias("predicted"))
