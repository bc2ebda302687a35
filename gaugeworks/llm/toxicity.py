"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text becomes the set of its distinct lower-cased byte n-grams (3 to 5 bytes, hashed to
2**18 buckets). Counts of texts that hold a bucket, by label, are taken over *all* labelled
training texts and give each bucket its log-count ratio. A logistic regression on the present
buckets' ratios is fitted on a bounded sample of the training texts, as many of either label.

Defined cases. A null text is an empty one; an empty text gets the score of the intercept.
Rows without a label, or with a null id, are scored and never learned from; of several labels
of one id the largest counts. Repeated rows are scored alike. Without training rows of both
labels every score is the share of toxic ones (0 without any). Further columns of the
documents are kept; the added ones replace columns of their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from gaugeworks.llm.common import held_out, joined, table
from gaugeworks.session import written

BITS = 18
NGRAMS = (3, 4, 5)
BLOCK = 1 << 12
#: Training texts of each label that the regression is fitted on; the ratios use all.
FIT_ROWS = 2000
#: Texts whose features are worked on at once in the fit.
FIT_PART = 100
SMOOTHING = 1.0
RIDGE = 1e-3
ROUNDS = 80


def buckets(text: str, seen: np.ndarray) -> np.ndarray:
    """Distinct buckets of a text; `seen` is scratch of one int32 per bucket."""
    b = np.frombuffer(f" {text.lower()} ".encode(), np.uint8).astype(np.uint32)
    out, h = [], b
    for n in range(2, NGRAMS[-1] + 1):
        h = h[:-1] * np.uint32(0x01000193) + b[n - 1 :]
        if n in NGRAMS:
            out.append((h * np.uint32(0x9E3779B1) + np.uint32(n)) * np.uint32(0x85EBCA6B) >> np.uint32(32 - BITS))
    h = np.concatenate(out).astype(np.int64)
    order = np.arange(len(h), dtype=np.int32)
    seen[h] = order
    return h[seen[h] == order]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, n = np.zeros(1 << BITS, np.int32), np.zeros((2, 1 << BITS), np.int64)
    texts = np.zeros(2, np.int64)
    for batch in batches:
        for text, label in zip(batch["text"], batch["toxic"]):
            n[label.as_py()][buckets(text.as_py() or "", seen)] += 1
            texts[label.as_py()] += 1
    for label in (0, 1):
        if texts[label]:
            blocks = n[label].reshape(-1, BLOCK)
            yield pa.RecordBatch.from_pydict(
                {
                    "toxic": pa.array([label] * (len(blocks) + 1), pa.int32()),
                    "block": pa.array([*range(len(blocks)), -1], pa.int32()),
                    "n": pa.array([*map(list, blocks), [texts[label]]], pa.list_(pa.int64())),
                }
            )


def _summed(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = 0
    for batch in batches:
        n = batch["n"]
        total = total + n.flatten().to_numpy().reshape(len(n), -1).sum(axis=0)
    yield pa.RecordBatch.from_pydict(
        {
            "toxic": pa.array([key[0].as_py()], pa.int32()),
            "block": pa.array([key[1].as_py()], pa.int32()),
            "n": pa.array([total], pa.list_(pa.int64())),
        }
    )


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(1 << BITS, np.int32)
    for batch in batches:
        rows = [buckets(x.as_py() or "", seen).astype(np.int32).tobytes() for x in batch["text"]]
        yield pa.RecordBatch.from_pydict({"toxic": batch["toxic"], "buckets": pa.array(rows, pa.binary())})


def _regression(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights by bucket and an intercept, by Adam on the whole sample, some texts at a time."""
    if not rows:
        return np.zeros_like(ratio), 0.0
    parts = [range(a, min(a + FIT_PART, len(rows))) for a in range(0, len(rows), FIT_PART)]
    w, b = np.ones(len(ratio), np.float32) * 0.1, 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, ROUNDS + 1):
        g, gb = RIDGE * w, 0.0
        for part in parts:
            at = np.concatenate([rows[i] for i in part])
            sizes = np.array([len(rows[i]) for i in part])
            r = ratio[at]
            z = np.add.reduceat(w[at] * r, np.cumsum(sizes) - sizes) + b
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[part.start : part.stop]
            error = (error / len(rows)).astype(np.float32)
            g += np.bincount(at, np.repeat(error, sizes) * r, len(w)).astype(np.float32)
            gb += float(error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        a, c = 1 - 0.9**t, 1 - 0.99**t
        w -= 0.05 * (m / a) / (np.sqrt(v / c) + 1e-8)
        b -= 0.05 * (mb / a) / ((vb / c) ** 0.5 + 1e-8)
    return w * ratio, b


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[np.ndarray, float]:
    """(weights by bucket, intercept) learned from docs (doc_id, text) and labels (doc_id, toxic)."""
    known = written(
        labels.where("doc_id is not null and toxic in (0, 1)")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .join(docs.select("doc_id"), "doc_id", "left_semi"),  # the sample is drawn from labels with a document
        "toxic-labels",
    )
    told = joined(docs.select("doc_id", "text"), known, ["doc_id"], "inner")
    counts = told.select("text", "toxic").mapInArrow(_counts, "toxic int, block int, n array<bigint>")
    sums = counts.groupBy("toxic", "block").applyInArrow(_summed, "toxic int, block int, n array<bigint>")
    n, texts = np.zeros((2, 1 << BITS)), np.zeros(2)
    for row in sums.collect():  # 2 x 2**18 counts at most, whatever the corpus
        if row.block < 0:
            texts[row.toxic] = row.n[0]
        else:
            n[row.toxic, row.block * BLOCK : (row.block + 1) * BLOCK] = row.n
    if not texts.all():
        share = min(max(texts[1] / max(texts.sum(), 1), 1e-6), 1 - 1e-6)
        return np.zeros(1 << BITS, np.float32), float(np.log(share / (1 - share)))
    share = (n + SMOOTHING) / (texts[:, None] + 2 * SMOOTHING)
    ratio = np.log(share[1] / share[0]).astype(np.float32)
    picked = written(
        known.where("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).union(
            known.where("toxic = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
        ),
        "toxic-sample",
    )
    features = (
        joined(docs.select("doc_id", "text"), picked, ["doc_id"], "inner")
        .select("text", "toxic")
        .mapInArrow(_features, "toxic int, buckets binary")
    )
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def fitted(sample: pa.Table) -> pa.Table:
        # Views of what has arrived, in an order that does not depend on how it did.
        told = [(y.as_py(), np.frombuffer(x.as_buffer(), np.int32)) for x, y in zip(sample["buckets"], sample["toxic"])]
        told.sort(key=lambda row: (row[0], xxhash.xxh3_128_digest(row[1])))
        rows, labels = [x for _, x in told], np.array([y for y, _ in told], np.float32)
        kept = [i for i, x in enumerate(rows) if len(x)]
        weights, intercept = _regression([rows[i] for i in kept], labels[kept], shared.value)
        # From the sample's share of either label to that of all training texts.
        took = np.bincount(labels.astype(int), minlength=2)
        intercept += float(np.log(texts[1] / texts[0]) - np.log(took[1] / took[0]))
        return pa.table({"weights": [weights.astype(np.float32).tobytes()], "intercept": [intercept]})

    # fit_rows texts of either label at most, in one task.
    features = features.withColumn("sample", F.lit(0))
    model = features.groupBy("sample").applyInArrow(fitted, "weights binary, intercept double").first()
    return np.frombuffer(model.weights, np.float32), model.intercept


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """docs plus score (double, 0 to 1) and predicted (int, 1 from 0.5)."""
    docs = docs.select([c for c in docs.columns if c.lower() not in ("score", "predicted")])
    names = docs.columns
    weights, intercept = docs.sparkSession.sparkContext.broadcast(model[0]), model[1]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, seen = weights.value, np.zeros(1 << BITS, np.int32)
        for batch in batches:
            z = [intercept + float(w[buckets(x.as_py() or "", seen)].sum(dtype=np.float64)) for x in batch["text"]]
            p = 1 / (1 + np.exp(-np.clip(np.array(z), -500, 500)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(p, pa.float64()), pa.array(p >= 0.5).cast(pa.int32())],
                names=[*names, "score", "predicted"],
            )

    added = [StructField("score", DoubleType()), StructField("predicted", IntegerType())]
    return docs.mapInArrow(scored, StructType([*docs.schema.fields, *added]))


def toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    return score(docs, train(docs, labels, fit_rows))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic, with the columns they came with."""
    names = docs.columns
    return toxicity(docs, table(spark, sf_dir, "labels")).where("predicted = 0").select(names)
