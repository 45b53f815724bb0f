"""Language identification by error-correcting output codes.

Each language has a codeword of bits; one binary classifier over hashed byte n-grams (1 to 3) predicts each bit. A
text goes to the language whose codeword has the least loss summed over the bits, each bit weighted by how well its
classifier did on the training rows it had not seen (leave-one-out). A small lead over the next codeword flags the
text as ambiguous.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .scratch import release, small_batches
from .textkeys import slices

#: The classifiers are fitted on about this many labelled rows at most, spread evenly over the languages; the task
#: that fits them has this size whatever the input.
MAX_TRAINING_ROWS = 2000
FEATURES = 4096
RIDGE = 0.05
SHARPNESS = 6.0
_LETTER = regex.compile(r"\p{L}")

_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def features(column: pa.Array) -> np.ndarray:
    """A row of unit length per text: log counts of hashed n-grams of letters, everything else counting as a space."""
    parts = []
    for s in slices(column):
        rows, data = s.hi - s.lo, _FOLD[s.data].astype(np.uint32)
        row = np.repeat(np.arange(rows), np.diff(s.bounds)) * FEATURES
        counts = np.zeros(rows * FEATURES)
        code = np.zeros(len(data), dtype=np.uint32)
        for n in (1, 2, 3):
            m = len(data) - n + 1
            if m <= 0:
                break
            code = code[:m] | (data[n - 1 :] << np.uint32(8 * (n - 1)))
            inside = (row[:m] == row[n - 1 :]) & (code != np.uint32(0x202020 & ((1 << 8 * n) - 1)))
            slot = ((code * np.uint32(2654435769) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(20)).astype(np.int64)
            counts += np.bincount((row[:m] + slot)[inside], minlength=rows * FEATURES)
        x = np.log1p(counts.reshape(rows, FEATURES)).astype(np.float32)
        parts.append(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9))
    return np.concatenate(parts) if parts else np.zeros((0, FEATURES), np.float32)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """``n`` rows of -1 and 1: of many random codes, one of greatest least distance between rows; no constant bit."""
    bits = max(15, 4 * int(np.ceil(np.log2(max(n, 2)))) + 3)
    rng, best, most = np.random.default_rng(seed), None, -1
    for _ in range(400 if n <= 64 else 20):
        code = rng.choice([-1.0, 1.0], size=(n, bits))
        if n > 1:
            code[0, np.abs(code.sum(0)) == n] *= -1
            apart = (bits - code @ code.T) / 2
            np.fill_diagonal(apart, bits)
            if apart.min() > most:
                best, most = code, apart.min()
        else:
            best = code
    return best


class Model:
    """``x`` holds the training rows in half precision; the fit takes it in blocks and keeps three square matrices of
    single precision at most, which a task has room for beside its executor."""

    def __init__(self, languages: list[str], x: np.ndarray, labels: np.ndarray):
        self.languages, self.code = languages, codewords(max(1, len(languages)))
        n, y = len(x), self.code[labels].astype(np.float32)
        blocks = [slice(i, i + 256) for i in range(0, n, 256)]
        gram = np.empty((n, n), dtype=np.float32)
        for i in blocks:
            rows = x[i].astype(np.float32)
            for j in blocks:
                gram[i, j] = rows @ x[j].astype(np.float32).T
        gram += 1.0
        gram.flat[:: n + 1] += RIDGE
        lower = np.linalg.cholesky(gram)
        del gram
        inverse = np.linalg.inv(lower)
        del lower
        dual = inverse.T @ (inverse @ y)
        left_out = y - dual / np.einsum("ij,ij->j", inverse, inverse)[:, None]
        del inverse
        right = ((left_out * y) > 0).mean(0).clip(0.5, 1 - 0.5 / (n + 1))
        self.bit_weight = np.log(right / (1 - right)) + 1e-6
        self.bit_weight /= self.bit_weight.sum()
        self.weights, self.offset = sum(x[i].astype(np.float32).T @ dual[i] for i in blocks), dual.sum(0)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its share of the softmax of negative losses, and the lead over the next."""
        margins = x @ self.weights + self.offset
        loss = np.logaddexp(0, -SHARPNESS * margins[:, None, :] * self.code[None]) @ self.bit_weight
        share = np.exp(-(loss - loss.min(1, keepdims=True)) * SHARPNESS / 2)
        share /= share.sum(1, keepdims=True)
        best = share.argmax(1)
        ordered = np.sort(share, axis=1)
        lead = ordered[:, -1] - (ordered[:, -2] if share.shape[1] > 1 else 0)
        return best, share[np.arange(len(best)), best], lead


def fit(labelled: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> Model | None:
    """A model from ``labelled(doc_id, text, lang)``; None if no row has both a language and a letter.

    Rows enter by a hash of their id, at a rate that gives each language the same quota, or all its rows if fewer; of
    no language more than twice the quota.
    """
    spark = labelled.sparkSession
    small_batches(spark, 256)
    usable = labelled.where("lang is not null and text is not null").where(F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()}
    if not counts:
        return None
    languages = sorted(counts)
    quota = max(1, max_rows // len(languages))
    rate = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(min(1.0, quota / counts[lang])))])
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    picked = usable.where(draw < F.try_element_at(rate, F.col("lang"))).select("text", "lang", draw.alias("draw"))
    first = Window.partitionBy("lang").orderBy("draw", F.xxhash64("text"))  # about a quota of rows each; many rows of one id share a draw
    picked = picked.withColumn("place", F.row_number().over(first)).where(F.col("place") <= 2 * quota).select("text", "lang")

    def vectors(batches):
        for batch in batches:
            x = features(batch.column(0)).astype(np.float16)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), batch.column(1)], names=["x", "lang"])

    def train(batches):
        if sample := [row for batch in batches for row in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist())]:
            sample.sort()  # the order of rows must not depend on the shuffle
            x = np.frombuffer(b"".join(r for _, r in sample), dtype=np.float16).reshape(len(sample), FEATURES)
            labels = np.array([languages.index(lang) for lang, _ in sample])
            del sample
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Model(languages, x, labels))], pa.binary())], names=["model"])
            del x
            release()

    # the sample is bounded, so one task fits it; the driver only receives the weights
    fitted = picked.mapInArrow(vectors, "x binary, lang string").repartition(1).mapInArrow(train, "model binary").collect()
    return pickle.loads(fitted[0]["model"]) if fitted else None


def classify(docs: DataFrame, model: Model | None, min_lead: float = 0.15) -> DataFrame:
    """``(doc_id, lang_pred, score, ambiguous)`` for every row of ``docs(doc_id, text)``.

    Texts that are null, empty or without a letter, and all texts if there is no model, give ``und`` with score 0,
    not ambiguous. Only the text is used. Rows of null or repeated doc_id are classified like any other.
    """
    spark = docs.sparkSession
    small_batches(spark, 256)
    shared = spark.sparkContext.broadcast(model)
    found = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("ambiguous", BooleanType())])

    def run(batches):
        model = shared.value
        for batch in batches:
            n = batch.num_rows
            letters = np.array([t is not None and _LETTER.search(t) is not None for t in batch.column(1).to_pylist()], dtype=bool)
            names, score, unsure = np.full(n, "und", dtype=object), np.zeros(n), np.zeros(n, dtype=bool)
            if model is not None and letters.any():
                best, share, lead = model.predict(features(batch.column(1)))
                names[letters] = np.array(model.languages, dtype=object)[best][letters]
                score[letters], unsure[letters] = share[letters].clip(0, 1), lead[letters] < min_lead
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(unsure)], names=["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, found)


def held_out() -> Column:
    """Whether a document is held out: crc32 of its id as text, mod 3, is 1 (never for a null id)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
