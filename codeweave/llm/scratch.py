"""Shared-storage materialisation for iterative jobs.

Lineage is cut by writing a Parquet table into the folder that the cluster names in
``spark.checkpoint.dir``; every executor and the driver can read it again after a loss.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Ids are broadcast for a semi or anti join only up to this many (8 bytes each); beyond it the join shuffles.
MAX_BROADCAST_IDS = 1_000_000

_written: list[tuple[object, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where none is configured, a local run (tests) gets a temporary one; on a cluster
    that is an error, since no local folder is seen by all executors."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="codeweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
        hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit; the folder is the cluster's to clear
        pass


@atexit.register
def _remove_all() -> None:
    for spark, path in _written:
        if getattr(getattr(spark, "_sc", None), "_jsc", None) is not None:
            _remove(spark, path)


class Scratch:
    """Tables of one operator call. ``cut`` writes and rereads, ``drop`` deletes one that nothing reads any more."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: list[tuple[DataFrame, str]] = []

    def cut(self, df: DataFrame) -> DataFrame:
        path = f"{shared_dir(self.spark)}/codeweave-{uuid.uuid4().hex}"
        _written.append((self.spark, path))
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((out, path))
        return out

    def counted(self, df: DataFrame, *signed: str) -> tuple:
        """``cut``, its number of rows and, of the columns ``signed``, a sum that tells tables apart; found while writing."""
        seen = Observation()
        sign = F.sum(F.xxhash64(*signed).bitwiseAND(F.lit((1 << 40) - 1))) if signed else F.count(F.lit(1))
        out = self.cut(df.observe(seen, F.count(F.lit(1)).alias("n"), sign.alias("s")))
        return (out, seen.get["n"], seen.get["s"]) if signed else (out, seen.get["n"])

    def drop(self, *tables: DataFrame) -> None:
        for path in [p for t, p in self.tables if any(t is x for x in tables)]:
            _remove(self.spark, path)
            _written.remove((self.spark, path))
        self.tables = [(t, p) for t, p in self.tables if not any(t is x for x in tables)]

    def collect_garbage(self) -> None:
        """Lets Spark delete the shuffle files and plans of rounds that are over; else they stay until the driver happens
        to need memory."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def quoted(columns: list[str]) -> list[str]:
    """Column names as expressions, whatever characters they have."""
    return ["`" + c.replace("`", "``") + "`" for c in columns]


def keep_ids(docs: DataFrame, ids: DataFrame, n_ids: int, id_col: str = "doc_id", how: str = "left_semi") -> DataFrame:
    """Rows of ``docs`` whose id is (``left_semi``) or is not (``left_anti``) in ``ids``.

    The ids are broadcast if there are at most MAX_BROADCAST_IDS, so that texts need not be shuffled; otherwise
    the join is left to the planner. Both ways give the same rows.
    """
    right = F.broadcast(ids) if n_ids <= MAX_BROADCAST_IDS else ids
    return docs.join(right, id_col, how)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bounds what one Arrow batch of texts holds in a Python worker, and gives the workers this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    ship(spark)


def release() -> None:
    """Gives memory that a Python worker no longer uses back to the system; workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def ship(spark: SparkSession) -> None:
    """Sends this package's modules to the executors, once per Spark application."""
    context = spark.sparkContext
    if getattr(context, "_codeweave_shipped", False):
        return
    here = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="codeweave-")) / f"codeweave_{uuid.uuid4().hex[:8]}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        z.write(here.parent / "__init__.py", "codeweave/__init__.py")
        for module in sorted(here.glob("*.py")):
            z.write(module, f"codeweave/llm/{module.name}")
    context.addPyFile(str(archive))
    context._codeweave_shipped = True
