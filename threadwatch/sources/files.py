"""Files of a landed corpus tree: listing, dealing by bytes, and one pass over their contents.

Spark's file index silently skips names that start with ``_`` (and video ids may), so
folders are listed and files are read without it, through ``pyarrow.fs`` in the tasks.
"""

from __future__ import annotations

import csv
import io
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadwatch.session import cut_lineage, ship_package

#: bytes that a task reads, about; a longer file stands alone
TASK_BYTES = 64 << 20
#: what opening a file costs, in bytes read
OPEN_BYTES = 1 << 18
LISTED = "path string, size long, is_dir boolean"
ROWS = 4096


def place_of(path: str):
    """(file system, path within it, what to put before such a path)."""
    from pyarrow import fs
    if path.startswith("file:") or "://" not in path:
        local = "/" + path[len("file:"):].lstrip("/") if path.startswith("file:") else path
        return fs.LocalFileSystem(), local, "file:"
    system, inner = fs.FileSystem.from_uri(path)
    return system, inner, path[:path.index("://") + 3]


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs
    for batch in batches:
        for folder in batch.column("dir").to_pylist():
            system, inner, lead = place_of(folder)
            infos = system.get_file_info(fs.FileSelector(inner, recursive=False, allow_not_found=True))
            for a in range(0, len(infos), ROWS):
                part = infos[a:a + ROWS]
                yield pa.RecordBatch.from_arrays([
                    pa.array([lead + i.path for i in part], pa.string()), pa.array([i.size or 0 for i in part], pa.int64()),
                    pa.array([i.type == fs.FileType.Directory for i in part])], names=["path", "size", "is_dir"])


def list_files(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """(path, size) of every file under ``root`` whose name ends with ``suffix``, whatever it starts with.

    The tree is listed level by level: the folders of a level are spread over the tasks, and
    neither folders nor files pass through the driver.  One folder is one call of the store;
    a missing ``root`` has no files.
    """
    ship_package(spark)
    folders = spark.createDataFrame([(root.rstrip("/"),)], "dir string")
    found = None
    while True:
        level = cut_lineage(folders.repartition(4 * spark.sparkContext.defaultParallelism, "dir").mapInArrow(_list, LISTED))
        files = level.filter(~F.col("is_dir") & F.col("path").endswith(suffix)).select("path", "size")
        found = files if found is None else found.union(files)
        folders = level.filter("is_dir").select(F.col("path").alias("dir"))
        if folders.isEmpty():
            return found


def dealt(files: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """``files(path, size)`` in partitions of about ``task_bytes`` each, by size and not by number.

    Files fall into groups by a hash of the path; a group's running total of bytes cuts it
    into bins, and every bin is a partition key.
    """
    cost = F.col("size") + OPEN_BYTES
    total = files.agg(F.sum(cost).alias("b")).first().b or 0
    bins = max(1, -(-total // task_bytes))
    running = F.sum(cost).over(Window.partitionBy("group").orderBy("path").rowsBetween(Window.unboundedPreceding, -1))
    binned = files.withColumn("group", F.pmod(F.xxhash64("path"), F.lit(max(1, bins // 16)))) \
        .withColumn("bin", F.floor(F.coalesce(running, F.lit(0)) / task_bytes))
    return binned.repartition(max(4 * bins, files.sparkSession.sparkContext.defaultParallelism), "group", "bin").select("path", "size")


def parsed_schema(fields: list[str]) -> str:
    return ("path string, row_no long, " + ", ".join(f"`{c}` string" for c in fields)
            + ", extra array<string>, n_rows long, n_columns int, n_ragged long, status string")


def _parse(fields: list[str]):
    width = len(fields)
    names = ["path", "row_no", *fields, "extra", "n_rows", "n_columns", "n_ragged", "status"]

    def batch_of(path: str, first: int, rows: list[list], extra: list[list | None]) -> pa.RecordBatch:
        n = len(rows)
        columns = [pa.array([r[i] for r in rows], pa.string()) for i in range(width)]
        return pa.RecordBatch.from_arrays([
            pa.array([path] * n, pa.string()), pa.array(range(first, first + n), pa.int64()), *columns,
            pa.array(extra, pa.list_(pa.string())), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()),
            pa.nulls(n, pa.string())], names=names)

    def report(path: str, n_rows: int, n_columns: int, n_ragged: int, status: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array([path], pa.string()), pa.array([-1], pa.int64()), *[pa.nulls(1, pa.string())] * width,
            pa.nulls(1, pa.list_(pa.string())), pa.array([n_rows], pa.int64()), pa.array([n_columns], pa.int32()),
            pa.array([n_ragged], pa.int64()), pa.array([status], pa.string())], names=names)

    def one(path: str) -> Iterator[pa.RecordBatch]:
        n_rows = n_columns = n_ragged = 0
        status = "empty"
        try:
            system, inner, _ = place_of(path)
            with system.open_input_stream(inner) as raw, \
                    io.TextIOWrapper(io.BufferedReader(raw), encoding="utf-8-sig", newline="") as text:
                records = csv.reader(text, strict=True)
                header = next((r for r in records if r), None)
                if header is not None:
                    status, n_columns = "ok", len(header)
                    at = [header.index(c) if c in header else None for c in fields]
                    known = {i for i in at if i is not None}
                    rows, extra = [], []
                    for record in records:
                        if not record:
                            continue
                        if len(record) != n_columns:
                            n_ragged += 1
                        rows.append([record[i] or None if i is not None and i < len(record) else None for i in at])
                        more = [v for i, v in enumerate(record) if i >= n_columns and i not in known]
                        extra.append(more or None)
                        if len(rows) == ROWS:
                            yield batch_of(path, n_rows, rows, extra)
                            n_rows += ROWS
                            rows, extra = [], []
                    if rows:
                        yield batch_of(path, n_rows, rows, extra)
                        n_rows += len(rows)
        except (OSError, csv.Error, UnicodeDecodeError):  # a bad file is reported, not fatal
            n_rows = n_columns = n_ragged = 0
            status = "error"
        yield report(path, n_rows, n_columns, n_ragged, status)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(sys.maxsize)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                yield from one(path)

    return parse


def read_csv_files(spark: SparkSession, root: str, fields: list[str], *, task_bytes: int = TASK_BYTES) -> tuple[DataFrame, DataFrame]:
    """``(rows, files)`` of every ``*.csv`` under ``root``, each file read and parsed once.

    ``rows`` has ``fields`` as text (empty: null; a column the header lacks: null), ``extra``
    (values beyond the header's columns, else null), ``path`` and ``row_no`` (from 0, blank
    lines not counted).  ``files`` has path, n_rows, n_columns, n_ragged (rows with more or
    fewer values than the header) and status: ``ok``, ``empty`` (no header) or ``error``
    (unreadable, not UTF-8 or broken quoting; such a file gives no rows).

    A file is streamed, so its size does not bound memory.  Both results come from one stored
    table.
    """
    ship_package(spark)
    paths = dealt(list_files(spark, root, ".csv"), task_bytes).select("path")
    parsed = cut_lineage(paths.mapInArrow(_parse(fields), parsed_schema(fields)))
    files = parsed.filter("row_no < 0").select("path", "n_rows", "n_columns", "n_ragged", "status")
    rows = parsed.filter("row_no >= 0").select("path", "row_no", *fields, "extra")
    broken = files.filter("status = 'error'").select("path")  # the rows before the place where the file breaks
    return rows.join(broken, "path", "left_anti"), files
