"""Toxicity classifier: subword embeddings, averaged into a linear softmax, trained together.

A text is the bag of the character n-grams of its words (with the blanks around them). Every n-gram has a vector; their
mean over the text goes into a softmax. Misspelt words share most of their n-grams with the right ones. As the model is
linear in the mean, scoring needs only one number per n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, held_out, text_bytes, translated, words_table

WORDS = words_table("alnum")
SIZES = (3, 4, 5, 6)
#: n-grams are hashed into this many buckets (a power of 2).
BUCKET_BITS = 18


def ngrams(data: np.ndarray) -> Iterator[np.ndarray]:
    """Bucket of every n-gram of the words of a text (blanks only at its ends), one array per size."""
    clean = np.concatenate(([np.uint8(0x20)], translated(data, WORDS), [np.uint8(0x20)]))
    blank = clean == 0x20
    if len(clean) > 1:  # one blank between words, whatever stood there
        keep = np.concatenate(([True], ~(blank[1:] & blank[:-1])))
        clean, blank = clean[keep], blank[keep]
    code, inner = clean.astype(np.uint64), np.zeros(len(clean), bool)
    for n in range(2, max(SIZES) + 1):
        m = len(clean) - n + 1
        if m <= 0:
            return
        code = code[:m] | clean[n - 1:].astype(np.uint64) << np.uint64(8 * (n - 1))
        inner = inner[:m] | blank[n - 2:n - 2 + m] if n > 2 else inner[:m]
        if n in SIZES:
            yield ((code[~inner] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


@dataclass
class Model:
    """What an n-gram adds to the difference of the two classes' logits, and their difference without any."""

    value: np.ndarray
    bias: float

    def score(self, data: np.ndarray, offsets: np.ndarray, step: int = 1 << 20) -> np.ndarray:
        out = np.zeros(len(offsets) - 1)
        for i in range(len(out)):
            total, count = 0.0, 0
            for a in range(int(offsets[i]), int(offsets[i + 1]), step):
                # A piece of a very long text starts a few bytes early, so that words across the border count.
                begin = max(int(offsets[i]), a - max(SIZES))
                for grams in ngrams(data[begin:min(a + step, int(offsets[i + 1]))]):
                    total += float(self.value[grams].sum(dtype=np.float64))
                    count += len(grams)
            out[i] = total / max(count, 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit(texts: list[bytes], toxic: np.ndarray, share: float, dim: int = 8, chosen: int = 6000, steps: int = 150,
        rate: float = 0.05, decay: float = 1e-3, seed: int = 7) -> Model:
    """Train vectors and softmax together by full-batch gradient steps.

    Up to ``chosen`` n-grams that speak most surely for toxicity (by their log odds over the standard error) get vectors of
    their own; all others stay at zero, but count in the mean. ``share`` is the share of toxic documents outside the sample, to which the bias is set.
    """
    bags = []
    for text in texts:
        grams = [*ngrams(np.frombuffer(text, np.uint8))]
        all_ = np.concatenate(grams) if grams else np.zeros(0, np.int64)
        bags.append((*np.unique(all_, return_counts=True), max(1, len(all_))))
    size, n, k = 1 << BUCKET_BITS, len(texts), int(toxic.sum())
    seen = np.zeros((2, size))
    for (grams, _, _), t in zip(bags, toxic.astype(int)):
        seen[t, grams] += 1
    odds = np.log((seen[1] + 0.5) / (k + 1)) - np.log((seen[0] + 0.5) / (n - k + 1))
    strength = odds / np.sqrt(1 / (seen[1] + 0.5) + 1 / (seen[0] + 0.5)) * (seen[1] > 1)
    best = np.argsort(-strength, kind="stable")[:chosen]
    best = np.sort(best[strength[best] > 1.5])
    place = np.full(size, -1)
    place[best] = np.arange(len(best))
    x = np.zeros((n, len(best)), np.float32)
    for i, (grams, counts, total) in enumerate(bags):
        at = place[grams]
        x[i, at[at >= 0]] = counts[at >= 0] / total
    scale = 1 / np.maximum(np.sqrt((x**2).sum(axis=0) / n), 1e-6)
    scale = np.minimum(scale, 2000).astype(np.float32)
    x *= scale
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.01, (len(best), dim)).astype(np.float32)
    soft = rng.normal(0, 0.3, (dim, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    y = np.eye(2, dtype=np.float32)[toxic.astype(int)]
    weight = np.where(toxic, 0.5 / max(k, 1), 0.5 / max(n - k, 1)).astype(np.float32)[:, None]
    params = [table, soft, bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        mean = x @ params[0]
        logits = mean @ params[1] + params[2]
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        d = (p - y) * weight
        grads = [x.T @ (d @ params[1].T) + decay * params[0], mean.T @ d, d.sum(axis=0)]
        for i, g in enumerate(grads):
            first[i], second[i] = 0.9 * first[i] + 0.1 * g, 0.999 * second[i] + 0.001 * g * g
            params[i] = params[i] - rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    apart = params[1][:, 1] - params[1][:, 0]
    value = np.zeros(size, np.float32)
    value[best] = (params[0] @ apart) * scale
    return Model(value, float(params[2][1] - params[2][0]) + float(np.log(share / (1 - share))))


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_name: str = "doc_id", text_name: str = "text",
          fold: tuple[int, int] | None = (3, 1), sample: int = 1500, longest: int = 1 << 15) -> Model:
    """Fit on at most ``sample`` documents of either label: those of the smallest id hashes, of texts up to ``longest`` bytes.

    Rows of the fold ``(modulus, remainder)`` are not learnt from. The share of toxic documents is that of all other
    labelled rows. Without labels of both kinds every document scores that share (0.5 without any).
    """
    ids = labels.select(F.col(id_name).cast("long").alias("doc_id"), F.col(label).alias("label"))
    ids = ids.filter("doc_id IS NOT NULL AND label IN (0, 1)").dropDuplicates(["doc_id"])
    if fold:
        ids = ids.filter(~held_out("doc_id", *fold))
    counts = {r[0]: r[1] for r in ids.groupBy("label").count().collect()}
    total = sum(counts.values())
    share = min(0.98, max(0.02, counts.get(1, 0) / total)) if total else 0.5
    if len(counts) < 2:
        return Model(np.zeros(1 << BUCKET_BITS, np.float32), float(np.log(share / (1 - share))))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = ids.filter("label = 1").orderBy(*order).limit(sample).unionByName(
        ids.filter("label = 0").orderBy(*order).limit(sample))
    texts = docs.select(F.col(id_name).cast("long").alias("doc_id"), text_bytes(text_name).alias("text"))
    rows = texts.filter(F.length("text") <= longest).join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    found = sorted((r.doc_id, r.label, bytes(r.text)) for r in rows.toLocalIterator())
    toxic = np.array([r[1] == 1 for r in found], bool)
    if not toxic.any() or toxic.all():
        return Model(np.zeros(1 << BUCKET_BITS, np.float32), float(np.log(share / (1 - share))))
    return fit([r[2] for r in found], toxic, share)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, fold: tuple[int, int] = (3, 1),
             id_name: str = "doc_id", text_name: str = "text", **options) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Null texts, empty ones and those without words score as a bag without n-grams: the share of toxic documents.
    Rows without an id are scored and not learnt from; repeated rows score alike, and of a repeated label one counts.
    Labels other than 0 and 1 are none. An empty table gives an empty table. Only ids, texts and the label are read.
    """
    model = docs.sparkSession.sparkContext.broadcast(
        learn(docs, labels, id_name=id_name, text_name=text_name, fold=fold, **options))
    rows = docs.select(F.col(id_name).cast("long").alias("doc_id"), text_bytes(text_name).alias("text"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = buffers(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.value.score(data, offsets))],
                                             names=["doc_id", "score"])

    return rows.mapInArrow(judge, "doc_id long, score double").select(
        "doc_id", held_out("doc_id", *fold).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))
