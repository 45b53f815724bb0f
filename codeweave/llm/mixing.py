"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted, in tokens, into cells of source, language and topic. The cells' token weights are raked to the
target marginals of each in turn until they agree, then spread over the token budget: a document's probability is its
cell's weight over its cell's tokens, with cells that would need more than all of their tokens held at 1 and the rest
raised to keep the budget. Documents are drawn by a hash of their id against that probability.

Topics are the clusters that k-means finds in hashed term weights, less the mean of the document's language, so that
they tell subjects apart and not languages. Means and clusters are fitted on all rows, in passes of Spark; every row is
assigned, and counts, marginals and probabilities cover all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .scratch import Scratch, quoted, small_batches
from .textkeys import Slice, mix as scrambled, slices

TOPICS = 8
DIMENSIONS = ("source", "lang", "topic")
#: Terms are words of MIN_BYTES or more, hashed into so many weights.
TERMS, MIN_BYTES = 256, 4
#: Term weights are whole numbers of this part of 1 while topics are fitted, until no centre moves further than MOVED.
UNIT, MOVED = float(1 << 20), 1e-3
#: Raking ends when no marginal is off its target by more than this share of all tokens, or after MAX_ROUNDS.
TOLERANCE, MAX_ROUNDS = 1e-4, 40


def term_weights(s: Slice) -> np.ndarray:
    """A row of unit length per text of a slice: log counts of its hashed terms."""
    rows = s.hi - s.lo
    long = s.ends - s.starts >= MIN_BYTES
    slot = s.doc_of()[long] * TERMS + (s.hashes[long] >> np.uint64(56)).astype(np.int64)
    x = np.log1p(np.bincount(slot, minlength=rows * TERMS).reshape(rows, TERMS)).astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Which centre each row is nearest to."""
    return ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)


@dataclass
class Topics:
    """Mean term weights by language, ``(lang, mean)``, and the clusters' centres."""

    means: DataFrame
    centres: np.ndarray


def _grouped(sums: DataFrame, key: str) -> DataFrame:
    """``(key, n, sums)`` of the partial sums of all tasks."""
    one = sums.select(key, "n", F.posexplode("sums").alias("i", "s")).groupBy(key, "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    return one.groupBy(key).agg(F.first("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda p: p["s"]).alias("sums"))


def _language_means(vectors: DataFrame) -> DataFrame:
    def run(batches):
        held = {}

        def given():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([n for n, _ in held.values()], pa.int64()), pa.array([s.tolist() for _, s in held.values()], pa.list_(pa.int64()))], names=["lang", "n", "sums"])

        for batch in batches:
            x, langs = _rows(batch.column(1)), np.array(batch.column(0).to_pylist())
            for lang in np.unique(langs):
                of = x[langs == lang]
                n, total = held.get(lang, (0, 0))
                held[lang] = n + len(of), total + of.sum(0, dtype=np.int64)
            if len(held) > 1024:
                yield given()
                held.clear()
        if held:
            yield given()

    means = _grouped(vectors.select("lang", "x").mapInArrow(run, "lang string, n bigint, sums array<bigint>"), "lang")
    return means.select("lang", F.transform("sums", lambda t: (t / F.col("n") / UNIT).cast("float")).alias("mean"))


def _rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(-1, TERMS)


def _farthest(vectors: DataFrame, centres: np.ndarray) -> np.ndarray | None:
    """A row drawn by the square of its distance to the nearest of the centres (all alike, if there are none): the first
    of a race in which each row runs for a time that its text's hash gives, divided by that square."""

    def run(batches):
        best = None
        for batch in batches:
            x, h = _rows(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
            far = (((x / UNIT)[:, None] - centres[None]) ** 2).sum(2).min(1) if len(centres) else np.ones(len(x))
            luck = (scrambled(h.astype(np.uint64) + np.uint64(len(centres))) >> np.uint64(11)).astype(np.float64) + 0.5
            time = np.where(far > 1e-9, -np.log(luck / 2.0**53) / np.maximum(far, 1e-9), np.inf)
            i = int(time.argmin()) if len(time) else -1
            if i >= 0 and np.isfinite(time[i]) and (best is None or (time[i], x[i].tobytes()) < best):
                best = float(time[i]), x[i].tobytes()
        if best is not None:
            yield pa.RecordBatch.from_arrays([pa.array([best[0]]), pa.array([best[1]], pa.binary())], names=["time", "x"])

    won = vectors.select("x", "h").mapInArrow(run, "time double, x binary").agg(F.min(F.struct("time", "x")).alias("w")).first()["w"]
    return None if won is None else np.frombuffer(won["x"], np.int32) / UNIT


def k_means(vectors: DataFrame, k: int, rounds: int = 15) -> np.ndarray:
    """``k`` centres (or as many as there are different rows) of ``vectors(x, h)``, started far apart. Each round passes
    over all rows, in tasks; the driver receives the sums of each cluster. Sums are of whole numbers, so that their
    order doesn't matter."""
    centres = np.zeros((0, TERMS))
    while len(centres) < k and (row := _farthest(vectors, centres)) is not None:
        centres = np.concatenate([centres, row[None]])
    if not len(centres):
        return np.zeros((1, TERMS))
    for _ in range(rounds):
        at = centres

        def run(batches):
            n, total = np.zeros(len(at), np.int64), np.zeros((len(at), TERMS), np.int64)  # noqa: B023
            for batch in batches:
                x = _rows(batch.column(0))
                cluster = nearest(x / UNIT, at)  # noqa: B023
                for i in np.unique(cluster):
                    of = x[cluster == i]
                    n[i] += len(of)
                    total[i] += of.sum(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n), pa.array(total.tolist(), pa.list_(pa.int64()))], names=["topic", "n", "sums"])

        centres = at.copy()
        for r in _grouped(vectors.select("x").mapInArrow(run, "topic int, n bigint, sums array<bigint>"), "topic").where("n > 0").collect():
            centres[r["topic"]] = np.array(r["sums"]) / r["n"] / UNIT
        if np.abs(centres - at).max() < MOVED:
            break
    return centres


def fit_topics(docs: DataFrame, scratch: Scratch, topics: int = TOPICS) -> Topics:
    """Topics of all of ``docs(text, lang)``. Term weights are written once and read in each round."""
    small_batches(docs.sparkSession, 512)
    texts = docs.where("text is not null").select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("h"))

    def run(batches):
        for batch in batches:
            for s in slices(batch.column(1)):
                part = slice(s.lo, s.hi)
                x = np.rint(term_weights(s) * UNIT).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], pa.array([r.tobytes() for r in x], pa.binary()), batch.column(2)[part]], names=["lang", "x", "h"])

    def less_mean(batches):
        for batch in batches:
            x = _rows(batch.column(0)) - np.rint(np.stack(batch.column(2).to_numpy(zero_copy_only=False)) * UNIT).astype(np.int32) if batch.num_rows else _rows(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), batch.column(1)], names=["x", "h"])

    weights = scratch.cut(texts.mapInArrow(run, "lang string, x binary, h bigint"))
    means = scratch.cut(_language_means(weights))
    vectors = scratch.cut(weights.join(means, "lang").select("x", "h", "mean").mapInArrow(less_mean, "x binary, h bigint"))
    scratch.drop(weights)
    centres = k_means(vectors, topics)
    scratch.drop(vectors)
    return Topics(means, centres)


def profile(docs: DataFrame, topics: Topics, keep: list[str]) -> DataFrame:
    """``(keep, source, lang, n_tokens, topic, draw)`` for every row; null source or lang is an empty string.

    ``keep`` is a struct of those columns. draw is a hash of the id, or of the text where that is null, in [0, 1).
    """
    small_batches(docs.sparkSession, 512)
    centres = topics.centres
    drawn = F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text")), F.lit(42)), F.lit(1 << 40)) / float(1 << 40)
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    inputs = docs.select(F.struct(F.struct(*quoted(keep)).alias("keep"), plain("source").alias("source"), plain("lang").alias("lang"), drawn.alias("draw")).alias("key"), plain("text").alias("text"))
    # a language whose texts are all null has no mean
    inputs = inputs.join(topics.means.withColumnRenamed("lang", "lang_"), F.col("key.lang") == F.col("lang_"), "left").drop("lang_")
    schema = StructType([inputs.schema["key"], StructField("n_tokens", LongType()), StructField("topic", IntegerType())])

    def run(batches):
        for batch in batches:
            means = batch.column(2).to_pylist()
            for s in slices(batch.column(1)):
                mean = np.array([m or [0.0] * TERMS for m in means[s.lo : s.hi]], np.float64).reshape(-1, TERMS)
                topic = nearest(term_weights(s) - mean, centres)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.lo, s.hi - s.lo), pa.array(np.diff(s.first).astype(np.int64)), pa.array(topic.astype(np.int32))], names=["key", "n_tokens", "topic"])

    out = inputs.mapInArrow(run, schema)
    return out.select("key.keep", "key.source", "key.lang", "n_tokens", "topic", "key.draw")


def tempered(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """``(dimension, target)``: shares of the tokens, flattened by ``power`` (1 as they are, 0 equal)."""
    raised = cells.groupBy(dimension).agg(F.sum("tokens").alias("t")).where("t > 0").select(dimension, F.pow(F.col("t"), F.lit(power)).alias("r"))
    whole = raised.agg(F.sum("r")).first()[0] or 1.0
    return raised.select(dimension, (F.col("r") / whole).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], scratch: Scratch, max_rounds: int = MAX_ROUNDS, tolerance: float = TOLERANCE) -> tuple[DataFrame, float]:
    """``cells`` (a row per combination, with ``tokens``) with ``weight``, whose marginals meet the targets, and the
    greatest difference of a marginal from its target that is left.

    Weights start as token shares; cells without tokens are left out. Marginals are grouped sums, so cells of one value
    never meet in one task. Each round is written to shared storage, and rounds end at ``tolerance``.
    """
    cells = cells.where("tokens > 0")
    for dimension, target in targets.items():
        cells = cells.join(target.withColumnRenamed("target", f"target_{dimension}"), dimension)
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    cells = scratch.cut(cells.withColumn("weight", F.col("tokens") / float(total)))
    for _ in range(max_rounds):
        before = cells
        for dimension in targets:
            have = cells.groupBy(dimension).agg(F.sum("weight").alias("have_"))
            cells = cells.join(have, dimension).withColumn("weight", F.col("weight") * F.col(f"target_{dimension}") / F.col("have_")).drop("have_")
        cells = scratch.cut(cells)
        scratch.drop(before)
        off = residual(cells, list(targets))
        if off <= tolerance:
            break
    return cells, residual(cells, list(targets))


def residual(cells: DataFrame, dimensions: list[str]) -> float:
    """The greatest difference of a marginal of ``weight`` from its target; 0 for an empty table."""
    off = None
    for d in dimensions:
        one = cells.groupBy(d).agg(F.abs(F.sum("weight") - F.first(f"target_{d}")).alias("off")).select("off")
        off = one if off is None else off.unionByName(one)
    return off.agg(F.max("off")).first()[0] or 0.0


def calibrate(cells: DataFrame, budget: float, scratch: Scratch, rounds: int = 8) -> DataFrame:
    """``cells`` with ``prob``: the chance of each of its documents, so that the expected tokens meet the budget share.

    Cells that need more tokens than they have are held at 1; the others share what is left, until no more is held.
    """
    wanted = float(cells.agg(F.sum("tokens")).first()[0] or 0) * budget
    cells = cells.withColumn("prob", F.lit(0.0))
    held = -1
    for _ in range(rounds):
        full = F.col("prob") >= 1.0
        n, used, weight = cells.agg(F.count_if(full), F.sum(F.when(full, F.col("tokens")).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if n == held:
            break
        rate = max(0.0, wanted - float(used or 0)) / weight if weight else 0.0
        before, held = cells, n
        cells = scratch.cut(cells.withColumn("prob", F.when(full, 1.0).otherwise(F.least(F.lit(1.0), F.lit(rate) * F.col("weight") / F.col("tokens")))))
        scratch.drop(before)
    return cells


def mixed(docs: DataFrame, keep: list[str], budget: float = 0.5, powers: dict[str, float] | None = None) -> DataFrame:
    """``profile`` of ``docs`` with ``weight``, ``prob``, ``residual`` and ``sampled``."""
    powers = powers or {"source": 0.7, "lang": 0.5, "topic": 0.5}
    scratch = Scratch(docs.sparkSession)
    topics = fit_topics(docs, scratch)
    counts = profile(docs, topics, ["doc_id"])
    cells = scratch.cut(counts.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")))
    raked, off = rake(cells, {d: tempered(cells, d, powers[d]) for d in DIMENSIONS}, scratch)
    probs = calibrate(raked, budget, scratch).select(*DIMENSIONS, "weight", "prob")
    out = profile(docs, topics, keep).join(probs, list(DIMENSIONS), "left")
    prob = F.when(F.col("n_tokens") > 0, F.coalesce("prob", F.lit(0.0))).otherwise(0.0)
    return out.withColumn("weight", F.coalesce("weight", F.lit(0.0))).withColumn("prob", prob).withColumn("residual", F.lit(off)).withColumn("sampled", F.col("draw") < prob)


def mix(docs: DataFrame, budget: float = 0.5, powers: dict[str, float] | None = None) -> DataFrame:
    """One row per row of ``docs(doc_id, text, source, lang)``: doc_id, source, lang, topic, n_tokens, weight, prob,
    residual, sampled.

    Targets are the token shares of sources, languages and topics raised to ``powers`` (0.7, 0.5 and 0.5); residual is
    the greatest difference of a marginal from its target that raking left. A row without words has probability 0 and
    is not sampled. Null source or lang is a value of its own (shown as an empty string). A row of null doc_id is drawn
    by its text. Repeated rows count and are drawn alike. Other columns are ignored; an empty table gives none.
    """
    out = mixed(docs, ["doc_id"], budget, powers)
    return out.select("keep.doc_id", "source", "lang", "topic", "n_tokens", "weight", "prob", "residual", "sampled")


def sample(docs: DataFrame, budget: float = 0.5, powers: dict[str, float] | None = None) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``mix`` samples. Every row follows its own draw, whatever
    other rows share its id."""
    return mixed(docs, docs.columns, budget, powers).where("sampled").select("keep.*")
