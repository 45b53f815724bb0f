"""Source files of a folder tree, listed level by level as Spark jobs; what is left out is neither listed nor opened."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.materialise import cut
from .files import EXCLUDED_DIRECTORIES, mark_skipped

ENTRY = "relative_path string, is_folder boolean, size_bytes long, last_write timestamp"
#: Read files are handed on in batches of about this many bytes.
BATCH_BYTES = 16 << 20


def _entries(system: fs.FileSystem, base: str, folder: str) -> list[tuple]:
    """A folder's files and folders, without excluded folders; none if it can't be read or is gone."""
    try:
        found = system.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/")))
    except OSError:
        return []
    out = []
    for info in found:
        path = f"{folder}/{info.base_name}" if folder else info.base_name
        if info.type == fs.FileType.Directory and info.base_name.lower() not in EXCLUDED_DIRECTORIES:
            out.append((path, True, None, None))
        elif info.type == fs.FileType.File:
            out.append((path, False, info.size, info.mtime))
    return out


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """``(relative_path, size_bytes, last_write)`` of every file below ``root``, an absolute path or a URI.

    Each round lists all folders of one level, a table of its own, so neither paths nor folders pass through the driver.
    Excluded folders are not entered, at any depth and in any case; unreadable ones give nothing. An empty or missing
    root gives no rows. The names of one folder pass through one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                rows = _entries(system, base, folder)
                names, folders, sizes, times = zip(*rows, strict=True) if rows else ([], [], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(folders, pa.bool_()), pa.array(sizes, pa.int64()), pa.array(times, pa.timestamp("us", tz="UTC"))], names=["relative_path", "is_folder", "size_bytes", "last_write"])

    folders, levels = spark.range(1).select(F.lit("").alias("relative_path")), []
    while True:
        level = cut(folders.mapInArrow(run, ENTRY))
        levels.append(level.where("not is_folder"))
        folders = level.where("is_folder").select("relative_path")
        if folders.isEmpty():
            return reduce(DataFrame.unionByName, levels).drop("is_folder")
        folders = folders.repartition("relative_path")  # a folder's children are spread over tasks


def scan_tree(spark: SparkSession, root: str, workspace_id: str, opened: Accumulator | None = None) -> DataFrame:
    """``source_files`` rows of a tree, with ``skipped``. Oversized and generated files are rows without
    content and are not opened; ``opened`` counts those that are (a task that runs again counts again).

    Texts are read as UTF-8 without a byte-order mark, other bytes replaced. A file that is gone when it is read gives
    no row, one that can't be read a null content.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            at, texts, held = [], [], 0
            for i, path in enumerate(batch.column(0).to_pylist()):
                if opened is not None:
                    opened.add(1)
                try:
                    with system.open_input_stream(f"{base}/{path}") as f:
                        texts.append(f.read().decode("utf-8-sig", errors="replace"))
                except FileNotFoundError:
                    continue
                except OSError:
                    texts.append(None)
                at.append(i)
                held += len(texts[-1] or "")
                if held >= BATCH_BYTES:
                    yield _with_content(batch, at, texts)
                    at, texts, held = [], [], 0
            yield _with_content(batch, at, texts)

    files = mark_skipped(list_tree(spark, root))
    read = files.where("not skipped").drop("skipped").repartition("relative_path").mapInArrow(run, ENTRY.replace("is_folder boolean, ", "") + ", content string")
    rows = read.withColumn("skipped", F.lit(False)).unionByName(files.where("skipped").withColumn("content", F.lit(None).cast("string")))
    return rows.select(F.lit(workspace_id).alias("workspace_id"), "relative_path", "content", "size_bytes", "last_write", "skipped")


def _with_content(batch: pa.RecordBatch, at: list[int], texts: list[str | None]) -> pa.RecordBatch:
    rows = batch.take(pa.array(at, pa.int64()))
    return pa.RecordBatch.from_arrays([*rows.columns, pa.array(texts, pa.string())], names=[*rows.schema.names, "content"])


def write_tree(files: DataFrame, root: str) -> int:
    """Writes ``files(relative_path, content)`` below ``root``, each by the task that holds it; how many there were.
    A task that runs again writes the same files again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                target = f"{base}/{path}"
                system.create_dir(target.rpartition("/")[0], recursive=True)
                with system.open_output_stream(target) as f:
                    f.write((content or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return files.select("relative_path", "content").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
