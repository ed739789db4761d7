"""Quality classifier: logistic regression over hashed word n-grams, fitted by follow-the-regularised-leader updates.

Features of a text: its words and word pairs, and the same for word shapes (letter case, digits, length, the marks at the
end, whether the word repeats the one before). Each n-gram is hashed to one of 2^18 numbers; a feature's value is its share
among the text's n-grams of that kind, so a score does not depend on length. A score is the sparse dot product, through
the logistic function. doc_id, lang, source and labels are never features.

Learning takes at most ``SAMPLE`` labelled rows of either class, the first in an order by hash, weighted back to the class
frequencies of all usable labels. Their features are made where the texts are; the updates, which are sequential, run
in one task over these bounded rows. Scoring reads every whole text, in place, without a shuffle; the model that goes
to the tasks has a fixed size of 2 MB.

Defined results: a NULL text counts as empty, and an empty text gets the score of the bias alone; a NULL doc_id is not held
out and not learned from; several labels of one document count as their majority, a tie as 1; without labels of both
classes every score is the share of label 1 (0.5 without any label).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkaudit.llm.common import Rolling, bounded, first_by_hash, joined, mix, runs, texts_of, word_spans

DIMENSION_BITS = 18
SAMPLE = 3_000
THRESHOLD = 0.7
#: Follow-the-regularised-leader: learning rate, its offset, and the two penalties.
ALPHA, OFFSET, L1, L2 = 0.3, 1.0, 1e-4, 1e-4
EPOCHS = 3
SCALE = 8.0
KINDS = 4

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CHARS = np.arange(256)
_UPPER = (_CHARS >= 65) & (_CHARS < 91)
_SMALL = (_CHARS >= 97) & (_CHARS < 123) | (_CHARS >= 128)
_DIGIT = (_CHARS >= 48) & (_CHARS < 58)
_PLAIN = _UPPER | _SMALL | _DIGIT


def ngrams(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each kind of n-gram: the feature number and the text of each occurrence, and the number of occurrences by text."""
    data, doc_ends = joined(texts)
    starts, ends, doc = word_spans(data, doc_ends)
    if not len(starts):
        return
    word = Rolling(_LOWER[data])
    words = word.slices(starts, ends)
    last = np.where(_PLAIN[data], np.arange(1, len(data) + 1), 0)
    np.maximum.accumulate(last, out=last)
    tail = word.slices(np.maximum(starts, last[ends - 1]), ends)

    def inside(kind):
        total = np.concatenate([[0], np.cumsum(kind[data], dtype=np.int64)])
        return total[ends] - total[starts]

    upper, small, digits, size = inside(_UPPER), inside(_SMALL), inside(_DIGIT), ends - starts
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
    shape = (
        (upper > 0) + 2 * (small > 0) + 4 * (digits > 0) + 8 * (upper > 1) + 16 * again
        + 32 * np.minimum(np.log2(size).astype(np.int64), 7)
    ).astype(np.uint64)
    with np.errstate(over="ignore"):
        shapes = mix(tail + shape * np.uint64(0x9E3779B97F4A7C15))
        pair = doc[1:] == doc[:-1]
        for kind, (single, step) in enumerate(((words, 0), (words, 1), (shapes, 0), (shapes, 1))):
            if step:
                key, of = (single[:-1] * np.uint64(3) + single[1:])[pair], doc[1:][pair]
            else:
                key, of = single, doc
            at = (mix(key + np.uint64(kind * 0x51ED27)) >> np.uint64(64 - DIMENSION_BITS)).astype(np.int64)
            yield at, of, np.bincount(of, minlength=len(texts))


def features(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sparse rows: the sorted feature numbers and their values."""
    parts: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in texts]
    for at, of, total in ngrams(texts):
        # texts come in order, so each one's occurrences are together
        for i, (j, n) in enumerate(zip(np.cumsum(total) - total, total, strict=True)):
            if n:
                number, count = np.unique(at[j : j + n], return_counts=True)
                parts[i].append((number, count * (SCALE / n)))
    rows = []
    for row in parts:
        number, where = np.unique(np.concatenate([n for n, _ in row] or [np.empty(0, np.int64)]), return_inverse=True)
        rows.append((number, np.bincount(where, np.concatenate([v for _, v in row] or [np.empty(0)]), len(number))))
    return rows


def dot(texts: list[bytes], weights: np.ndarray, bias: float) -> np.ndarray:
    """The sparse dot products of many texts at once."""
    out = np.full(len(texts), bias)
    for i, j in runs([len(t) for t in texts]):
        for at, of, total in ngrams(texts[i:j]):
            out[i:j] += np.bincount(of, weights[at], j - i) * SCALE / np.maximum(total, 1)
    return out


def follow_leader(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """FTRL-proximal over the rows in their order, several epochs; the last feature is the bias."""
    size = (1 << DIMENSION_BITS) + 1
    z, n = np.zeros(size), np.zeros(size)

    def leader(at):
        s = z[at]
        w = -(s - np.sign(s) * L1) / ((OFFSET + np.sqrt(n[at])) / ALPHA + L2)
        w[np.abs(s) <= L1] = 0
        return w

    rows = [(np.append(a, size - 1), np.append(v, 1.0)) for a, v in rows]
    for _ in range(EPOCHS):
        for (at, value), y, c in zip(rows, labels, weight, strict=True):
            w = leader(at)
            p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
            g = c * (p - y) * value
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    all_weights = leader(np.arange(size))
    return all_weights[:-1], float(all_weights[-1])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Weights and bias from ``labels`` (doc_id, quality) of rows that are not held out."""
    usable = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
        .groupBy("doc_id")
        .agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
        .where(~held_out(F.col("doc_id")))
    )
    here = usable.join(docs.select("doc_id").where("doc_id is not null").distinct(), "doc_id", "left_semi")
    found = {r["label"]: r["n"] for r in here.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(found) < 2:
        share = min(max(float(next(iter(found), 0.5)), 1e-6), 1 - 1e-6)
        return np.zeros(1 << DIMENSION_BITS), float(np.log(share / (1 - share)))
    order = (F.xxhash64(F.lit("quality"), "doc_id"), "doc_id")
    picked = [first_by_hash(here.where(F.col("label") == k), order[0], found[k], sample) for k in (0, 1)]
    weight = {k: found[k] / sum(found.values()) / min(found[k], sample) * sum(min(n, sample) for n in found.values()) for k in found}
    # at most 2 * sample narrow rows
    chosen = F.broadcast(picked[0].union(picked[1]))
    texts = bounded(docs).select("doc_id", F.col("text").cast("string").alias("text")).join(chosen, "doc_id").select("doc_id", "label", "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch)
            rows = []
            for i, j in runs([len(t) for t in texts]):
                rows += features(texts[i:j])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array([a.astype(np.int32).tobytes() for a, _ in rows], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in rows], pa.binary())],
                ["doc_id", "label", "numbers", "shares"],
            )

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, y = [], []
        for batch in batches:
            for label, a, v in zip(batch.column("label").to_pylist(), batch.column("numbers").to_pylist(), batch.column("shares").to_pylist(), strict=True):
                rows.append((np.frombuffer(a, np.int32), np.frombuffer(v, np.float32)))
                y.append(label)
        w, b = follow_leader(rows, np.array(y, float), np.array([weight[k] for k in y]))
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([b])], ["weights", "bias"])

    made = texts.mapInArrow(extract, "doc_id bigint, label int, numbers binary, shares binary")
    model = made.repartition(1).sortWithinPartitions(*order).mapInArrow(fit, "weights binary, bias double").first()
    return np.frombuffer(model["weights"]), model["bias"]


def scores(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """``docs`` with ``__score`` added, its rows where they are."""
    weights, bias = model
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    columns = docs.columns

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = 1 / (1 + np.exp(-dot(texts_of(batch), sent.value, bias)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*columns, "__score"])

    return bounded(docs).mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField("__score", T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs`` (doc_id, text)."""
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = scores(narrow, learn(narrow, labels, sample)).withColumnRenamed("__score", "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` without the rows that the classifier rejects. All columns stay."""
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return scores(docs, learn(narrow, labels, sample)).where(F.col("__score") >= THRESHOLD).drop("__score")
