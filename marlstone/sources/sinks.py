"""Sinks: pages that are appended once, notes that are replaced by document, states that are replaced
whole (K1, K2, K4, K5). All write through Spark, so a task that fails or runs twice leaves nothing behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators.notes import missing_pages


def _files(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def append_pages(pages: DataFrame, path: str) -> None:
    """K1: appends the pages (doc_id, page, ...) that ``path`` lacks, so a run that was cut off goes on."""
    spark = pages.sparkSession
    files, folder = _files(spark, path)
    if files.exists(folder):
        pages = missing_pages(pages, spark.read.schema(pages.schema).parquet(path))
    pages.write.mode("append").parquet(path)


def replace_notes(notes: DataFrame, path: str, *, by: str = "doc_id") -> None:
    """K2: writes notes in place of all former ones of the documents that they are of; others stay."""
    notes.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def write_state(rows: DataFrame, path: str) -> int:
    """K4: rows as JSON in a version of their own below ``path``, which counts when it is complete;
    then former versions go. Returns its number. One writer at a time."""
    spark = rows.sparkSession
    number = max(_versions(spark, path), default=0) + 1
    rows.write.mode("overwrite").json(f"{path}/version={number}")
    files, _ = _files(spark, path)
    for old in _versions(spark, path, complete=False):
        if old < number:
            files.delete(_files(spark, f"{path}/version={old}")[1], True)
    return number


def read_state(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The last complete version that ``write_state`` wrote; None if there is none."""
    found = _versions(spark, path)
    return spark.read.schema(schema).json(f"{path}/version={max(found)}") if found else None


def _versions(spark: SparkSession, path: str, complete: bool = True) -> list[int]:
    files, folder = _files(spark, path)
    if not files.exists(folder):
        return []
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    numbers = [int(n.removeprefix("version=")) for n in names if n.startswith("version=")]
    return [n for n in numbers if not complete or files.exists(_files(spark, f"{path}/version={n}/_SUCCESS")[1])]


def diary(events: DataFrame) -> DataFrame:
    """K5: ``run_id, line``: events (run_id, event_id, ts, fact, alive) as lines of JSON, with the
    silence before each, in seconds."""
    from marlstone.streaming.supervision import silences

    return silences(events).select("run_id", F.to_json(F.struct("event_id", F.unix_micros("ts").alias("ts_us"), "fact", "silence_s")).alias("line"))
