"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the presence of hashed n-grams of 3 to 6 characters in the whole text. Over all
training rows the documents of either label are counted for each n-gram; the ratio of the smoothed
shares, as a logarithm, scales the feature. The ``FEATURES`` n-grams whose shares differ most
(by their standard error) are kept, and logistic regression with an L2 penalty is fitted on them.
Ratios and regression are fitted on at most ``MAX_ROWS`` labelled rows, those of least hash.

Cases: a null or empty text has the features of its ends only, and scores as the intercept says.
Rows without doc_id are scored; they are never trained on. A doc_id with several labels counts as
toxic if one is. Without training rows of both labels every score is the share of toxic ones (0
for none). Repeated rows score alike. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundlens.llm.grams import distinct_pairs, gram_buckets

SIZES = (3, 4, 5, 6)
BITS = 20
FEATURES = 2048
MAX_ROWS = 20_000
THRESHOLD = 0.3


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class ToxicityModel:
    """``feature`` maps a bucket to a feature or -1; ``weights`` hold ratio times coefficient."""

    def __init__(self, feature: np.ndarray, weights: np.ndarray, intercept: float):
        self.feature, self.weights, self.intercept = feature, weights, intercept

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), self.intercept)
        for lo, n, row, f in present(texts, self.feature):
            out[lo : lo + n] += np.bincount(row, self.weights[f], n)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def present(texts: list[str | None], feature: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for lo, n, row, bucket in gram_buckets(texts, SIZES, BITS):
        f = feature[bucket]
        hit = f >= 0
        yield lo, n, *distinct_pairs(row[hit], f[hit].astype(np.int64), BITS)


def _chosen_grams(train: DataFrame, clean: float, toxic: float) -> DataFrame:
    """(bucket, ratio) of the ``FEATURES`` n-grams whose shares differ most, over all rows (toxic, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            label_of = batch.column(0).to_numpy()
            for lo, n, row, bucket in gram_buckets(batch.column(1).to_pylist(), SIZES, BITS):
                row, bucket = distinct_pairs(row, bucket, BITS)
                label = label_of[lo : lo + n][row]
                for y in (0, 1):
                    total[y] += np.bincount(bucket[label == y], minlength=1 << BITS)
        at = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[0][at]), pa.array(total[1][at])], ["bucket", "clean", "toxic"])

    # At most one row for each bucket, whatever the rows of the table; a single document counts as none.
    counts = train.mapInArrow(count, "bucket int, clean long, toxic long").groupBy("bucket").agg(*(F.when(F.sum(c) > 1, F.sum(c)).otherwise(0).cast("double").alias(c) for c in ("clean", "toxic")))
    pooled = (F.col("clean") + F.col("toxic")) / (clean + toxic)
    spread = F.sqrt(pooled * (1 - pooled) * (1 / clean + 1 / toxic) + 1e-9)
    z = F.abs(F.col("toxic") / toxic - F.col("clean") / clean) / spread
    ratio = F.log((F.col("toxic") + 1) / (toxic + 2)) - F.log((F.col("clean") + 1) / (clean + 2))
    return counts.where("clean + toxic > 0").select("bucket", ratio.alias("ratio"), z.alias("z")).orderBy(F.desc("z"), "bucket").limit(FEATURES)


def _logistic(rows: np.ndarray, cols: np.ndarray, scale: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 400) -> tuple[np.ndarray, float]:
    """Coefficients of scaled presence features by accelerated gradient descent."""
    n, k = len(y), len(scale)
    value = scale[cols]
    norms = np.bincount(rows, value * value, n) + 1
    step = 4 / norms.mean()
    w, b = np.zeros(k), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    fast_w, fast_b = w.copy(), b
    for t in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, fast_w[cols] * value, n) + fast_b, -30, 30)))
        error = (p - y) / n
        new_w = fast_w - step * (np.bincount(cols, error[rows] * value, k) + penalty * fast_w)
        new_b = fast_b - step * error.sum()
        m = t / (t + 3)
        fast_w, fast_b = new_w + m * (new_w - w), new_b + m * (new_b - b)
        w, b = new_w, new_b
    return w, b


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Learns from rows of ``docs`` that have a label and aren't held out."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # MAX_ROWS rows of 12 bytes at most: small enough to broadcast at any size of the tables.
    known = F.broadcast(known.orderBy(F.xxhash64("doc_id", F.lit("fit")), "doc_id").limit(MAX_ROWS))
    train = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(known, "doc_id").select("toxic", "text")
    sums = docs.select("doc_id").join(known, "doc_id").groupBy("toxic").count().collect()
    totals = np.zeros(2)
    for r in sums:
        totals[1 if r.toxic else 0] += r["count"]
    share = totals[1] / max(totals.sum(), 1)
    none = np.full(1 << BITS, -1, np.int16)
    if not totals.all():
        return ToxicityModel(none, np.zeros(1), 30.0 if share else -30.0)

    best = _chosen_grams(train, *map(float, totals)).collect()
    feature = none.copy()
    feature[[r.bucket for r in best]] = np.arange(len(best))
    scale = np.array([r.ratio for r in best])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(0).to_numpy()
            out = []
            for _, n, row, f in present(batch.column(1).to_pylist(), feature):
                cuts = np.searchsorted(row, np.arange(n + 1))
                out += [f[a:b].astype(np.int16).tobytes() for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(toxic), pa.array(out, pa.binary())], ["y", "f"])

    fitted = train.mapInArrow(encode, "y int, f binary").toPandas().sort_values(["y", "f"])
    lists = [np.frombuffer(x, np.int16).astype(np.int64) for x in fitted["f"]]
    rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    cols = np.concatenate(lists) if lists else np.zeros(0, np.int64)
    y = (fitted["y"].to_numpy() > 0).astype(float)
    if not 0 < y.sum() < len(y):
        return ToxicityModel(none, np.zeros(1), float(np.log(share / (1 - share))))
    w, b = _logistic(rows, cols, scale, y)
    return ToxicityModel(feature, w * scale, b)


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = shared.value.scores(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
