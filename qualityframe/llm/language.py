"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained by follow-the-regularised-leader with elastic-net penalties on a bounded sample,
calibrated by a temperature; document frequencies come from all labelled training rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import checkpointed, small_side, table

#: Hashed features; n-gram lengths.
BITS = 15
SIZE = 1 << BITS
NGRAMS = (1, 2, 3)
#: Labelled rows per language that the fit uses (the bound of the sample), and the share held back for the temperature.
SAMPLE_PER_LANGUAGE = 1000
CALIBRATION_SHARE = 0.2
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
UNKNOWN = "und"

_LETTERS: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _LETTERS


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Counts of the hashed n-grams of the whole text, lower-cased, other characters as single spaces.

    None if the text is null or has no letter.
    """
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[codes]
    if not letter.any():
        return None
    codes = np.where(letter, codes, 32)
    codes = codes[letter | np.append(True, letter[:-1])]  # one space for a run of other characters
    codes = np.concatenate([[32], codes, [32]]).astype(np.uint32)
    counts = np.zeros(SIZE, np.int64)
    key = np.zeros(len(codes), np.uint32)
    for n in range(1, max(NGRAMS) + 1):
        if n > len(codes):
            break
        key = key[: len(codes) - n + 1] * np.uint32(0x9E3779B1) + codes[n - 1:]
        if n in NGRAMS:
            mixed = (key ^ (key >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * n)
            counts += np.bincount(mixed >> np.uint32(32 - BITS), minlength=SIZE)
    return counts


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # features x languages
    bias: np.ndarray
    temperature: float

    def vector(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(counts)
        value = np.log1p(counts[at]) * self.idf[at]
        return at, value / max(float(np.sqrt((value * value).sum())), 1e-12)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        at, value = self.vector(counts)
        return value @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = ngram_counts(text) if self.languages else None
        if counts is None:
            return UNKNOWN, 0.0
        p = softmax(self.scores(counts) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max())
    return e / e.sum()


def document_frequencies(train: DataFrame, text: str = "text") -> np.ndarray:
    """Documents of ``train`` that hold each hashed n-gram; the last entry counts the documents.

    Every task adds up its own rows, Spark sums the tasks' counts by feature; what reaches the
    driver has a fixed size.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(SIZE + 1, np.int64)
        for batch in batches:
            for t in batch.column(0):
                counts = ngram_counts(t.as_py())
                if counts is not None:
                    held[:SIZE] += counts > 0
                    held[SIZE] += 1
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], ["feature", "n"])

    total = train.select(text).mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    out = np.zeros(SIZE + 1, np.int64)
    for row in total.collect():
        out[row["feature"]] = row["n"]
    return out


def training_sample(train: DataFrame, per_language: int, lang: str, text: str, ident: str) -> DataFrame:
    """(lang, ident, text): up to ``per_language`` rows of every language, however many there are, by a seeded hash.

    Rows that share an id are one place in the order and come together.
    """
    slim = train.select(F.col(lang).alias("lang"), F.col(ident).cast("string").alias("ident"))
    order = F.xxhash64(F.lit(29), F.coalesce("ident", F.lit("")))
    sizes = small_side(checkpointed(slim.groupBy("lang").count()))
    # a share of the hash range that holds twice the rows needed leaves little to sort
    share = F.least(F.lit(1.0), F.lit(2.0 * per_language) / F.col("count"))
    picked = slim.join(sizes, "lang").withColumn("h", order)
    picked = picked.filter((F.pmod("h", F.lit(1_000_000)) / F.lit(1e6)) < share)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "ident"))
    picked = checkpointed(picked.withColumn("rank", rank).filter(F.col("rank") <= per_language).select("ident").distinct())
    rows = train.select(F.col(lang).alias("lang"), F.col(ident).cast("string").alias("own"), F.col(text).alias("text"))
    rows = rows.join(small_side(picked), F.col("own").eqNullSafe(F.col("ident")))
    return rows.select("lang", "ident", "text")


def sample_vectors(sample: DataFrame, model: LanguageModel) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(lang, features, values) of a ``training_sample``, in a fixed order; texts without a letter are passed over.

    The tasks make the sparse vectors, and only those reach the driver, as Arrow columns: their size is
    bounded by the sample, not by the length of its texts.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, features, values = [], [], []
            for k, t in enumerate(batch.column("text")):
                counts = ngram_counts(t.as_py())
                if counts is not None:
                    at, value = model.vector(counts)
                    keep.append(k)
                    features.append(at.astype(np.int32))
                    values.append(value)
            part = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [part.column("lang"), part.column("ident"), part.column("digest"), pa.array(features, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))],
                ["lang", "ident", "digest", "features", "value"],
            )

    told = sample.withColumn("digest", F.md5("text")).mapInArrow(run, "lang string, ident string, digest string, features array<int>, value array<double>")
    got = told.orderBy("lang", "ident", "digest").select("lang", "features", "value").toArrow()
    return [
        (y, np.asarray(at.values), np.asarray(value.values)) for y, at, value in zip(got.column("lang").to_pylist(), got.column("features"), got.column("value"))
    ]


def fit(
    train: DataFrame, lang: str = "lang", text: str = "text", ident: str = "doc_id",
    per_language: int = SAMPLE_PER_LANGUAGE, seed: int = 11,
) -> LanguageModel:
    """A model from rows with text and language (others are passed over; none at all: an empty model)."""
    train = train.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    df = document_frequencies(train, text)
    idf = np.log((1 + df[SIZE]) / (1 + df[:SIZE])) + 1
    model = LanguageModel([], idf, np.zeros((SIZE, 0)), np.zeros(0), 1.0)
    sample = sample_vectors(training_sample(train, per_language, lang, text, ident), model)
    languages = sorted({y for y, _, _ in sample})
    if not languages:
        return model
    order = np.random.default_rng(seed).permutation(len(sample))
    rows = [(languages.index(sample[k][0]), *sample[k][1:]) for k in order]
    back = max(1, int(len(rows) * CALIBRATION_SHARE)) if len(rows) > len(languages) * 5 else 0
    held, used = rows[:back], rows[back:]
    weights, bias = ftrl(used, len(languages))
    temperature = calibrate([(y, v @ weights[at] + bias) for y, at, v in held])
    return LanguageModel(languages, idf, weights, bias, temperature)


def ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], k: int, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal: per-coordinate rates, L1 keeps weights at exactly 0 until their gradients add up."""
    z, n = np.zeros((SIZE + 1, k)), np.zeros((SIZE + 1, k))

    def weights(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2))

    for _ in range(epochs):
        for y, at, value in rows:
            at, value = np.append(at, SIZE), np.append(value, 1.0)  # the last feature is the bias
            w = weights(z[at], n[at])
            error = softmax(value @ w)
            error[y] -= 1.0
            g = np.outer(value, error)
            rate = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - rate * w
            n[at] += g * g
    w = weights(z, n)
    return w[:SIZE], w[SIZE]


def calibrate(held: list[tuple[int, np.ndarray]]) -> float:
    """The temperature of least log loss on rows that the fit has not seen, by golden-section search."""
    if not held:
        return 1.0
    y = np.array([r[0] for r in held])
    s = np.stack([r[1] for r in held])

    def loss(log_t: float) -> float:
        x = s / np.exp(log_t)
        x = x - x.max(1, keepdims=True)
        return float((np.log(np.exp(x).sum(1)) - x[np.arange(len(y)), y]).mean())

    lo, hi, g = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def predict(df: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` and ``score`` (columns of these names are replaced).

    Null text, and text without a letter, gets "und" with score 0; so does all text under an
    empty model. Equal scores go to the language first in order. Only the text is read, whole also if it is
    very long. Repeated rows are alike, an empty table gives an empty one.
    """
    names = [c for c in df.columns if c not in ("lang_pred", "score")]
    df = df.select(names)
    schema = StructType([*df.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(model)  # fixed size: features x languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [shared.value.predict(t.as_py()) for t in batch.column(text)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                [*names, "lang_pred", "score"],
            )

    return df.mapInArrow(run, schema)


def op10_ftrl_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    model = fit(docs.filter(~held_out))
    out = predict(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")
