"""Sinks.  Parquet partitioned by newspaper and kind is the main store;
CSV / JSON exports are the same table written by ``partitionBy``.  ``export_files`` writes
the per-video CSV files, also those without rows, and commits them as one version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadwatch.sources import versions

FILE = ["newspaper", "file_id"]


def write_table(df: DataFrame, path: str, partition_cols: tuple[str, ...] = ("newspaper", "kind"),
                mode: str = "errorifexists") -> None:
    cols = [c for c in partition_cols if c in df.columns]
    df.write.mode(mode).partitionBy(*cols).parquet(path)


def export_csv(df: DataFrame, path: str, partition_cols: tuple[str, ...] = ("newspaper",),
               mode: str = "errorifexists") -> None:
    """CSV with a header per part; quoted multi-line text survives (escape = quote)."""
    cols = [c for c in partition_cols if c in df.columns]
    df.write.mode(mode).partitionBy(*cols).option("header", True).option("escape", '"').csv(path)


def export_json(df: DataFrame, path: str, partition_cols: tuple[str, ...] = ("newspaper",),
                mode: str = "errorifexists") -> None:
    cols = [c for c in partition_cols if c in df.columns]
    df.write.mode(mode).partitionBy(*cols).json(path)


def _csv_field(value: Column) -> Column:
    """``value`` as a CSV field: quoted if it holds a comma, a quote or a line break; nothing for null."""
    quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(value.isNull(), "").when(value.rlike('[",\\r\\n]'), quoted).otherwise(value)


def csv_lines(rows: DataFrame, files: DataFrame, columns: list[str], *, label: str = "label", order: str = "row_no") -> DataFrame:
    """The lines of one CSV file per row of ``files``: ``(newspaper, file_id, line_no, line)``, the header as line 0.

    ``rows(newspaper, file_id, <order>, ..)`` are the files' rows; ``files(newspaper, file_id)`` may
    hold the ``header`` of each (an array of names; null or missing: ``columns``).  ``label`` is put last,
    whether the header has it or not, so that a file with an empty header gets ``label`` alone.
    Columns that ``rows`` lacks are empty.  A file without rows has its header only; rows of a
    file that ``files`` lacks are not written.  Equal places are told apart by the whole row.
    """
    own = F.col("header") if "header" in files.columns else F.lit(None).cast("array<string>")
    names = F.coalesce(own, F.array(*[F.lit(c) for c in columns]).cast("array<string>"))
    heads = files.select(*FILE, F.concat(F.filter(names, lambda c: c != label), F.array(F.lit(label))).alias("_names")).distinct()
    header = heads.select(*FILE, F.lit(0).cast("bigint").alias("line_no"),
                          F.array_join(F.transform("_names", _csv_field), ",").alias("line"))
    held = [c for c in rows.columns if c not in FILE and c != order]
    values = F.map_from_arrays(F.array(*[F.lit(c) for c in held]), F.array(*[F.col(f"`{c}`").cast("string") for c in held]))
    data = rows.select(*FILE, F.col(order).cast("bigint").alias("_no"), values.alias("_values")).join(heads, FILE)
    line = F.array_join(F.transform("_names", lambda c: _csv_field(F.element_at("_values", c))), ",")
    return header.unionByName(data.select(*FILE, (F.col("_no") + 1).alias("line_no"), line.alias("line")))


def export_files(lines: DataFrame, root: str, base: int = 0) -> int:
    """Write ``csv_lines`` as ``newspaper=../file_id=../part-*`` and commit them as the version after ``base``.

    A file's parts, one after the other by name, are the file: a video of any size spreads over
    tasks, in the order of its lines, and only its first part has the header.
    """
    order = [*FILE, "line_no", "line"]
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = lines.repartitionByRange(n, *order).sortWithinPartitions(*order).select(*FILE, F.col("line").alias("value"))
    return versions.publish(lines.sparkSession, root, base,
                            lambda folder: placed.write.partitionBy(*FILE).text(folder))
