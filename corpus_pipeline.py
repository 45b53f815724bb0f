"""A training-corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweave.llm import bpe_automaton, language_id, minhash_dedup, mixing, pii
from codeweave.llm.queries import tokenizer_path
from codeweave.llm.scratch import MAX_BROADCAST_IDS, Scratch, quoted, shared_dir


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id is in ``dropped``; rows of null doc_id stay. The ids are broadcast up
    to MAX_BROADCAST_IDS, beyond that the join shuffles."""
    dropped = Scratch(docs.sparkSession).cut(dropped.distinct())
    ids = F.broadcast(dropped) if dropped.count() <= MAX_BROADCAST_IDS else dropped
    return docs.join(ids, "doc_id", "left_anti").select(*quoted(docs.columns))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those between two languages; lang becomes the predicted language.

    Learns from the same rows as query op4. A row is judged by its text, so repeated ids are judged one by one; null
    and empty texts go. Columns of any further names stay as they are. An empty table stays empty.
    """
    model = language_id.fit(docs.where(~language_id.held_out()))
    judged = language_id.classify(docs.select(F.struct(*quoted(docs.columns)).alias("doc_id"), "text"), model)
    kept = judged.where("lang_pred <> 'und' and not ambiguous")
    return kept.select(*[F.col("lang_pred" if c == "lang" else f"doc_id.{q}").alias(c) for c, q in zip(docs.columns, quoted(docs.columns))])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near copies (shingles of five words, similarity 0.8), one row of it.

    Rows of null doc_id stay, and so do texts without words, each repeated id once. An empty table stays empty."""
    scratch = Scratch(spark)
    found = scratch.cut(minhash_dedup.near_duplicates(docs, shingle=5, similarity_pct=80))
    kept = _without(docs, found.where("not kept").select("doc_id"))
    repeated = scratch.cut(found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id"))
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*quoted(docs.columns))
    return _without(kept, repeated).unionByName(once)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every personal-data span by its kind and renews n_chars; no document goes, null and repeated ones included."""
    return pii.mask(docs, pii.find(docs))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents by probabilities raked to source, language and topic targets. Every row follows its own draw,
    one of null doc_id by its text; rows without words are not sampled."""
    return mixing.sample(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the text decoded from them; a null text counts as
    empty, repeated rows give repeated results."""
    return bpe_automaton.encode_and_decode(docs, tokenizer_path(), keep_ids=True)


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("PII", mask_personal_data),
    ("mixing to target weights", mix_to_targets),
    ("BPE encoding and decoding", tokenize),
]

#: SQL cannot express the stages; the tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to ``documents``; each result is written to shared storage and read as the next stage's docs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
