"""Incremental indexing as a stream: new source files arrive, only files whose fingerprint changed are written.

The index is append-only: each micro-batch writes its changed rows to a folder of its own (``batch=N``, replaced when
the batch is run again), and ``latest`` takes the newest row of each path. No batch rewrites what others wrote.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import changed_files, indexable

KEY = ("workspace_id", "relative_path")
SCHEMA = "workspace_id string, relative_path string, language_id string, content_hash string, parse_status string, batch bigint"


def latest(spark: SparkSession, target: str, before: int | None = None) -> DataFrame:
    """The newest row of each path, of batches before ``before`` if given; empty if nothing was written yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], SCHEMA)
    rows = spark.read.option("recursiveFileLookup", "true").schema(SCHEMA).parquet(target)
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    return rows.groupBy(*KEY).agg(F.max_by(F.struct("language_id", "content_hash", "parse_status", "batch"), "batch").alias("r")).select(*KEY, "r.*")


def index_stream(arriving: DataFrame, target: str, checkpoint: str, as_files: Callable[[DataFrame], DataFrame] = lambda df: df):
    """Starts the stream; ``as_files`` makes ``source_files`` rows of a micro-batch. Ends when all input is read.

    ``target`` and ``checkpoint`` belong together: batches are numbered by the checkpoint.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        seen = indexable(as_files(batch))
        stored = latest(batch.sparkSession, target, before=batch_id).withColumn("is_deleted", F.lit(False))
        changed = changed_files(seen, stored).select(*KEY).distinct()
        fresh = seen.join(changed, list(KEY), "left_semi").select(*KEY, "language_id", "content_hash", "parse_status", F.lit(batch_id).cast("long").alias("batch"))
        fresh.write.mode("overwrite").parquet(f"{target}/batch-{batch_id}")

    return arriving.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
