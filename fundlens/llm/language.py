"""Language ID by string kernels: blended-spectrum presence kernel, Nyström landmarks, ridge.

Two texts compare by the share of n-grams of 1 to 3 characters both have:
``k(s, t) = |grams(s) & grams(t)| / sqrt(|grams(s)| |grams(t)|)``, over hashed n-grams. Landmarks
are training texts, as many of each language; a text's kernel values to them, whitened by the
landmarks' own kernel matrix, are its Nyström features, and one ridge regression for each language
against the rest is solved in closed form. For scoring, the landmarks' presence matrix, the
whitening and the coefficients are one matrix, with which batches of presence vectors are multiplied.

The rows of each language are counted over all training rows. The classifier is fitted on rows taken
by a hash of doc_id: about ``MAX_ROWS`` in proportion to the languages, and of a language that would
get fewer than ``LEAST_ROWS`` about that many, or all it has. So no language drops out, whatever its
share, and the rows to fit are bounded by ``MAX_ROWS`` and the number of languages.

Cases: a null text, or one without a letter (Unicode category L), is ``und`` with score 0; so is every text if there is
nothing to learn from. A language is any non-null lang of the training rows, those with a text and
not held out. Rows without doc_id are scored but not learned from. Repeated rows score alike. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundlens.llm.grams import distinct_pairs, gram_buckets
from fundlens.llm.toxicity import held_out

SIZES = (1, 2, 3)
BITS = 14
MAX_ROWS = 4096
LANDMARKS = 48  # of each language
LEAST_ROWS = 2 * LANDMARKS  # of each language, on average; under 48 in one of a million samples
RIDGE = 1e-2


class LanguageModel:
    def __init__(self, languages: list[str], matrix: np.ndarray):
        self.languages, self.matrix = languages, matrix.astype(np.float32)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        best, score = ["und"] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return best, score
        for lo, n, row, bucket in gram_buckets(texts, SIZES, BITS):
            row, bucket = distinct_pairs(row, bucket, BITS)
            for a in range(0, n, 128):
                b = min(n, a + 128)
                here = slice(*np.searchsorted(row, (a, b)))
                x = np.zeros((b - a, 1 << BITS), np.float32)
                x[row[here] - a, bucket[here]] = 1
                raw = (x @ self.matrix) / np.sqrt(np.maximum(x.sum(1), 1))[:, None]
                e = np.exp(4 * (raw - raw.max(1, keepdims=True)))
                p = e / e.sum(1, keepdims=True)
                top = p.argmax(1)
                for i in range(b - a):
                    text = texts[lo + a + i]
                    if text and any(map(str.isalpha, text)):  # Unicode category L
                        best[lo + a + i] = self.languages[top[i]]
                        score[lo + a + i] = p[i, top[i]]
        return best, score


def fit_rows(train: DataFrame) -> DataFrame:
    """The rows of ``train`` to fit on, by language."""
    place = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 40))
    counts = train.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("least")).collect()
    share = MAX_ROWS / max(sum(r.n for r in counts), 1)
    # The row of least hash is always among them, should copies of one doc_id be all that a language has.
    limits = [(r.lang, max(r.least + 1, int(min(1.0, max(share, LEAST_ROWS / r.n)) * (1 << 40)))) for r in counts]
    limit = train.sparkSession.createDataFrame(limits, "lang string, __limit long")
    return train.join(F.broadcast(limit), "lang").where(place < F.col("__limit"))


def fit_language(docs: DataFrame) -> LanguageModel:
    train = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sample = fit_rows(train)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, n, row, bucket in gram_buckets(batch.column(1).to_pylist(), SIZES, BITS):
                row, bucket = distinct_pairs(row, bucket, BITS)
                cuts = np.searchsorted(row, np.arange(n + 1))
                out += [bucket[a:b].astype(np.int16).tobytes() for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), batch.column(2)], ["lang", "grams", "h"])

    rows = sample.select("lang", "text", F.xxhash64("doc_id", F.lit("order")).alias("h")).mapInArrow(encode, "lang string, grams binary, h long").toPandas()
    rows = rows.sort_values(["h", "lang", "grams"]).reset_index(drop=True)
    languages = sorted(rows["lang"].unique())
    if not languages:
        return LanguageModel([], np.zeros((1 << BITS, 0)))

    def presence(grams) -> np.ndarray:
        x = np.zeros((len(grams), 1 << BITS), np.float32)
        for i, g in enumerate(grams):
            x[i, np.frombuffer(g, np.int16)] = 1
        return x / np.sqrt(np.maximum(x.sum(1), 1))[:, None]

    marks = np.concatenate([np.flatnonzero((rows["lang"] == name).to_numpy())[:LANDMARKS] for name in languages])
    landmarks = presence(rows["grams"].iloc[marks])
    values, vectors = np.linalg.eigh((landmarks @ landmarks.T).astype(np.float64))
    whiten = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
    # Summed over blocks of rows: memory grows with the landmarks only.
    gram = RIDGE * len(rows) * np.eye(len(marks)) / len(marks)
    target = np.zeros((len(marks), len(languages)))
    for i in range(0, len(rows), 256):
        features = (presence(rows["grams"].iloc[i : i + 256]) @ landmarks.T).astype(np.float64) @ whiten
        gram += features.T @ features
        target += features.T @ np.where(rows["lang"].to_numpy()[i : i + 256, None] == np.array(languages)[None, :], 1.0, -1.0)
    return LanguageModel(languages, landmarks.T.astype(np.float64) @ (whiten @ np.linalg.solve(gram, target)))


def predict_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, score = shared.value.predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(best, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")
