"""Span columns shared by the text scans: one result row per input row, base spans joined with the added ones."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spans as ``start, kind's place in the listed order, end``: sorted so, they are in the result's order.
SPAN_TYPE = "array<struct<start:bigint,place:int,stop:bigint>>"
ARROW_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("place", pa.int32()), ("stop", pa.int64())]))


def text_key(text: str) -> str:
    """Identifies a whole text, as Spark's ``md5`` does; with the id it names a row, equal rows alike."""
    return hashlib.md5(text.encode()).hexdigest()


def as_structs(found: list[tuple[int, int, int]]) -> list[dict]:
    return [{"start": a, "place": k, "stop": b} for a, k, b in found]


def digest(found: list[tuple[int, int, int]], kinds: tuple[str, ...]) -> str:
    return hashlib.sha256(",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in found).encode()).hexdigest()


def joined(spans: str, kinds: tuple[str, ...]) -> Column:
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["place"]), s["start"], s["stop"])), ",")


def with_added(base: DataFrame, added: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """``base`` with ``spans``: its own (column ``base``) and those of ``added(doc_id, text_key, start, place, stop)``."""
    span = F.struct("start", "place", "stop")
    extra = added.groupBy("doc_id", "text_key").agg(F.collect_set(span).alias("extra"), F.count("*").alias("n")).select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "extra")
    out = base.join(extra, base.doc_id.eqNullSafe(F.col("d")) & (base.text_key == F.col("k")), "left")
    every = F.array_sort(F.concat("base", F.coalesce("extra", F.expr(f"cast(array() as {SPAN_TYPE})"))))
    return out.withColumn("all_spans", every).withColumn("spans", joined("all_spans", kinds)).withColumn("n_added", F.size("all_spans") - F.size("base"))
