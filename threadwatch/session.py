"""Session helpers: a tuned local session for tests and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str = "local[8]", shuffle_partitions: int = 8,
                app_name: str = "threadwatch") -> SparkSession:
    """Session used by tests and bench; cluster jobs bring their own session."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.worker.reuse", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession | None = None) -> None:
    """Make ``threadwatch`` importable in the Python workers (``addPyFile`` of a zip).

    Operators that run Python on executors (pandas UDFs, ``mapInPandas``,
    ``applyInPandas``) call this; it runs once per application.
    """
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    base = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="threadwatch-pkg-"), "threadwatch.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, base))
    sc.addPyFile(out)
    _SHIPPED.add(sc.applicationId)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` is read from the session.  Only a local-mode
    session without one (tests) gets a fresh scratch folder; a cluster
    session without a shared folder is an error rather than a silent
    machine-local fallback.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="threadwatch-ckpt-"))
    return sc.getCheckpointDir()


#: bytes after which a batch of long texts goes to Python
ARROW_BATCH_BYTES = 4 << 20


@contextmanager
def small_arrow_batches(spark: SparkSession, max_bytes: int = ARROW_BATCH_BYTES) -> Iterator[None]:
    """Jobs run inside hand rows to Python in batches of about ``max_bytes``; else only their number of rows is bounded."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(max_bytes))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut_lineage(df: DataFrame, partition_cols: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder, in folders by ``partition_cols``, and read it back.

    Survives lost executors, like a reliable checkpoint, but compressed and with the
    statistics of what was written: those of a checkpoint multiply from join to join.
    The table goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_cols).parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)
