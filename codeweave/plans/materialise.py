"""Cuts a plan by writing a Parquet table into the folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in shared storage. Where none is configured, a local run (tests) gets a temporary one; on a cluster
    that is an error, since no local folder is seen by all executors."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="codeweave-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


#: Tables whose files are larger than this are not broadcast on the strength of their size on disk.
BROADCAST_BYTES = 256 * 1024


def join_by_rows(spark: SparkSession) -> None:
    """Joins are planned by how many bytes rows have, not by how small their files are: names derived from keys compress
    to a hundredth and are exploded later, and a broadcast table stands whole in the driver. What a shuffle has counted
    as small is still broadcast, up to the limit that was set."""
    static, adaptive = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    limit = spark.conf.get(static)
    number, unit = re.fullmatch(r"(-?\d+)([kmgt]?)b?", limit.strip().lower()).groups()
    if int(number) * 1024 ** " kmgt".index(unit or " ") <= BROADCAST_BYTES:
        return
    if spark.conf.get(adaptive, None) is None:
        spark.conf.set(adaptive, limit)
    spark.conf.set(static, str(BROADCAST_BYTES))


_written: list[tuple[SparkSession, str]] = []


@atexit.register
def _remove_all() -> None:
    """Tables go with the application; the session may be gone by then, and the folder is the cluster's to clear."""
    for spark, path in _written:
        context = getattr(spark, "_sc", None)
        if getattr(context, "_jsc", None) is not None:
            try:
                at = context._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
            except Exception:  # noqa: BLE001, S112
                continue


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a table in shared storage: computed once, however often it is read, and safe from lost executors."""
    join_by_rows(df.sparkSession)
    path = shared_folder(df.sparkSession, "evidence")
    _written.append((df.sparkSession, path))
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
