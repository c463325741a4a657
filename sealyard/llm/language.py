"""Language identification by sparse multinomial logistic regression on character n-grams.

A text's features are its lower-case one- to three-character n-grams, hashed, weighted by log term frequency
times inverse document frequency, scaled to length one. Weights are learned with follow-the-regularised-
leader updates under an elastic-net penalty; a temperature fitted on rows set aside makes the winner's
probability a calibrated score.

Every row gets one result row. NULL and empty texts and texts without a letter are ``und`` with score 0, as is
everything when there is no labelled row to learn from. Texts of any length are read whole, in slices. Equal
scores go to the language that sorts first. Equal rows get equal results; columns of the input named like a
result are replaced by it.
"""

from __future__ import annotations

import dataclasses
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sealyard.llm.common import add_columns, crc_of, in_batches, table

#: Hash bits of the feature space.
BITS = 14
#: Labelled rows of each language that the classifier is fitted on, at most. Document frequencies come from all
#: training rows.
SAMPLE = 500
#: Score below which the pipeline does not trust a language.
LEAST_SCORE = 0.4
UNKNOWN = "und"
_SLICE = 1 << 20
_LETTER = re.compile(r"[^\W\d_]")


@dataclasses.dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # features x languages
    bias: np.ndarray
    temperature: float


def counts_of(text: str) -> np.ndarray:
    """How often each hashed n-gram occurs."""
    total = np.zeros(1 << BITS, np.int64)
    lower = text.lower()
    for at in range(0, len(lower), _SLICE):
        before = ("  " + lower[max(0, at - 2) : at])[-2:]
        codes = np.frombuffer((before + lower[at : at + _SLICE]).encode("utf-32-le", "surrogatepass"), np.uint32)
        a, b, c = codes[:-2], codes[1:-1], codes[2:]
        one = c * np.uint32(0x9E3779B1) + np.uint32(1)
        two = one + b * np.uint32(0x85EBCA77) + np.uint32(1)
        three = two + a * np.uint32(0xC2B2AE3D) + np.uint32(1)
        for grams in (one, two, three):
            mixed = (grams ^ (grams >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            total += np.bincount(mixed >> np.uint32(32 - BITS), minlength=1 << BITS)
    return total


def vector_of(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices and weights of a text's features."""
    at = np.flatnonzero(counts)
    weights = (1.0 + np.log(counts[at])) * idf[at]
    return at, weights / max(np.sqrt((weights * weights).sum()), 1e-12)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(
    rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = 4,
    alpha: float = 1.0, beta: float = 1.0, l1: float = 0.05, l2: float = 0.05,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by follow-the-regularised-leader over the rows, in their order."""
    size = (1 << BITS) + 1  # the last feature is the bias, always 1
    z, n = np.zeros((size, classes)), np.zeros((size, classes))

    def weights(at: np.ndarray) -> np.ndarray:
        lazy = -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(z[at]) > l1, lazy, 0.0)

    for _ in range(epochs):
        for at, x, label in rows:
            at, x = np.append(at, size - 1), np.append(x, 1.0)
            w = weights(at)
            p = _softmax(x @ w)
            p[label] -= 1.0
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(size))
    return w[:-1].astype(np.float32), w[-1]


def calibrate(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, from a fixed grid."""
    grid = np.exp(np.linspace(np.log(0.02), np.log(10.0), 120))
    at = np.arange(len(labels))
    losses = [-np.log(np.maximum(_softmax(logits / t)[at, labels], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(losses))])


def is_training(key: Column) -> Column:
    """Documents that may be learned from."""
    return crc_of(key) % 4 != 2


def fit_language(df: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of ``doc_id``, ``text``, ``lang``, from training documents with a language.

    Document frequencies cover all of them, summed over tasks. The classifier sees at most ``sample`` rows of each
    language, whatever its share, those with the smallest hash of id and text, equal rows once; only their features,
    bounded by the hash space, reach the driver.
    """
    known = df.select("doc_id", "text", "lang").where(
        is_training(F.col("doc_id")) & F.col("text").isNotNull() & F.col("lang").isNotNull()
    )

    def frequencies(batches):
        import pyarrow as pa

        seen, rows = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen += counts_of(text) > 0
                rows += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([*range(1 << BITS), -1], pa.int32()), pa.array([*seen.tolist(), rows], pa.int64())], names=["feature", "n"]
        )

    df_rows = (
        in_batches(known.select("text"), frequencies, "feature int, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    )
    found = {r.feature: r.n for r in df_rows}
    rows = found.pop(-1, 0)
    present = np.zeros(1 << BITS)
    present[list(found)] = list(found.values())
    idf = np.log((1.0 + rows) / (1.0 + present)) + 1.0

    # A language's rows below a bound of the hash are a few more than wanted, so none is sorted as a whole.
    marked = known.withColumn("_hash", F.xxhash64("doc_id", "text"))
    wanted = F.lit(float(2 * sample + 64)) / F.approx_count_distinct("_hash", 0.02)
    low = F.lit(float(-(2**63)))
    bounds = marked.groupBy("lang").agg((low + F.least(wanted, F.lit(1.0)) * F.lit(2.0**64)).alias("_bound"))
    # A row a language: what the model has a column of weights for.
    few = marked.join(F.broadcast(bounds), "lang").where(F.col("_hash") <= F.col("_bound"))
    order = Window.partitionBy("lang").orderBy("_hash", "doc_id")
    chosen = few.dropDuplicates(["lang", "doc_id", "_hash"]).withColumn("_row", F.row_number().over(order)).where(F.col("_row") <= sample)

    def sparse():
        def compute(texts):
            counts = [counts_of(t) for t in texts]
            at = [np.flatnonzero(c) for c in counts]
            return [a.astype(np.int32).tobytes() for a in at], [c[a].astype(np.int32).tobytes() for c, a in zip(counts, at, strict=True)]

        return compute

    picked = add_columns(chosen, ["text"], "at binary, n binary", sparse).select("doc_id", "lang", "at", "n").collect()
    picked.sort(key=lambda r: (hash_order(r.doc_id), r.lang, bytes(r.at)))
    languages = sorted({r.lang for r in picked})
    if not languages:
        return Model([], idf, np.zeros((1 << BITS, 0), np.float32), np.zeros(0), 1.0)
    data = []
    for r in picked:
        counts = np.zeros(1 << BITS, np.int64)
        counts[np.frombuffer(r.at, np.int32)] = np.frombuffer(r.n, np.int32)
        data.append((*vector_of(counts, idf), languages.index(r.lang)))
    # Every fifth row sets the temperature of a model that has not seen it; the model used has seen all.
    aside = data[::5]
    w, bias = train([d for i, d in enumerate(data) if i % 5], len(languages))
    logits = np.array([x @ w[at] + bias for at, x, _ in aside])
    temperature = calibrate(logits, np.array([y for *_, y in aside]))
    w, bias = train(data, len(languages))
    return Model(languages, idf, w, bias, temperature)


def hash_order(key: int) -> int:
    """A fixed order of ids that has nothing to do with their values."""
    return (int(key) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF


def predict_language(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` and ``score``."""

    def predictor():
        def predict(value: str | None) -> tuple[str, float]:
            if not value or not model.languages or not _LETTER.search(value):
                return UNKNOWN, 0.0
            at, x = vector_of(counts_of(value), model.idf)
            p = _softmax((x @ model.weights[at] + model.bias) / model.temperature)
            best = int(p.argmax())
            return model.languages[best], float(p[best])

        def compute(values):
            found = [predict(v) for v in values]
            return [f[0] for f in found], [f[1] for f in found]

        return compute

    return add_columns(df, [text], "lang_pred string, score double", predictor)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = fit_language(documents)
    held = F.coalesce(crc_of(F.col("doc_id")) % 4 == 2, F.lit(False)).alias("held_out")
    return predict_language(documents.select("doc_id", "text"), model).select("doc_id", held, "lang_pred", "score")


QUERIES = {"op9_language_id": op9_language_id}
