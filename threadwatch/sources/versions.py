"""Versioned tables in a folder, with a commit that only one of several writers can win.

``root/data-<random>/`` holds the rows of a version, ``root/_versions/<number>`` its folder's
name.  A version exists once its number does: the number's file is written aside and then put
in place by a rename (a hard link on a local disk) that fails if the number is taken.  A run
says on which version its rows are based; if another run has committed since, it gets
``Conflict`` and starts again from what is current.  Folders of lost or failed runs are never
read.  The store must have exclusive renames (HDFS has; plain object stores need a lock).
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FOLDER = "_versions"


class Conflict(RuntimeError):
    """Another run has committed the version that this one was to become."""


def _store(spark: SparkSession, root: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(root)
    return jvm, place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[int]:
    """The committed versions, ascending; none for a missing folder."""
    jvm, place, fs = _store(spark, root)
    folder = jvm.org.apache.hadoop.fs.Path(place, FOLDER)
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n) for n in names if n.isdigit())


def folder_of(spark: SparkSession, root: str, version: int) -> str:
    """The folder that holds the rows of a committed ``version``."""
    jvm, place, fs = _store(spark, root)
    f = fs.open(jvm.org.apache.hadoop.fs.Path(place, f"{FOLDER}/{version:012d}"))
    try:
        name = jvm.org.apache.commons.io.IOUtils.toString(f, "UTF-8")
    finally:
        f.close()
    return f"{root.rstrip('/')}/{name}"


def current(spark: SparkSession, root: str) -> tuple[int, str | None]:
    """(version, folder) to read; (0, None) when nothing was committed."""
    found = versions(spark, root)
    return (found[-1], folder_of(spark, root, found[-1])) if found else (0, None)


def _claim(spark: SparkSession, root: str, version: int, name: str) -> bool:
    """Put ``version`` in place, pointing to ``name``; False if it is taken.  Content and name appear at once."""
    jvm, place, fs = _store(spark, root)
    path = jvm.org.apache.hadoop.fs.Path
    aside = path(place, f"{FOLDER}/.{uuid.uuid4().hex}")
    target = path(place, f"{FOLDER}/{version:012d}")
    out = fs.create(aside, False)
    out.write(bytearray(name.encode()))
    out.close()
    try:
        if fs.getScheme() == "file":
            os.link(aside.toUri().getPath(), target.toUri().getPath())
            return True
        return bool(fs.rename(aside, target))
    except FileExistsError:
        return False
    finally:
        fs.delete(aside, False)


def publish(spark: SparkSession, root: str, base: int, write: Callable[[str], None]) -> int:
    """``write(folder)`` a new version on top of version ``base`` and commit it; returns its number.

    Raises ``Conflict`` (and removes what was written) if ``base`` is no longer current.
    """
    jvm, place, fs = _store(spark, root)
    name = f"data-{uuid.uuid4().hex}"
    data = jvm.org.apache.hadoop.fs.Path(place, name)
    try:
        write(f"{root.rstrip('/')}/{name}")
        if current(spark, root)[0] != base or not _claim(spark, root, base + 1, name):
            raise Conflict(f"{root}: version {base + 1} was committed by another run")
    except BaseException:
        fs.delete(data, True)
        raise
    return base + 1


def publish_table(df: DataFrame, root: str, base: int, partition_cols: tuple[str, ...] = ()) -> int:
    """``publish`` of the rows of ``df`` as Parquet, in folders by ``partition_cols``."""
    return publish(df.sparkSession, root, base, lambda folder: df.write.partitionBy(*partition_cols).parquet(folder))


def read_table(spark: SparkSession, root: str, schema: str) -> tuple[int, DataFrame]:
    """(version, rows) of what is current; version 0 has no rows, of ``schema``."""
    version, folder = current(spark, root)
    return version, spark.createDataFrame([], schema) if folder is None else spark.read.parquet(folder)
