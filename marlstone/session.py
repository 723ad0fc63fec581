"""Session settings and the few facts about the cluster that operators ask for."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", *, shuffle_partitions: int = 8, app: str = "marlstone", memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks. On a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, by which salts are sized."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


_made: list[str] = []


def _own_folder(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir``. Only on one machine, as in tests, a temporary folder may
    take its place; on a cluster executors would not share it, so that is an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="marlstone-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder, so that later steps neither
    compute it again nor lose it with an executor."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(_own_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a written table, below the one that driver and executors share."""
    _made.append(f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again: like ``checkpointed``, but
    compressed, and read by column. The folder stays until ``release``."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def release(spark: SparkSession) -> int:
    """Deletes all folders that ``shared_folder`` has made so far, when the results that read them
    were written elsewhere; returns their number. Checkpoints go by Spark's own cleaner
    (``spark.cleaner.referenceTracking.cleanCheckpoints``)."""
    jvm, folders = spark._jvm, list(_made)
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _made.remove(folder)
    return len(folders)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables below ``sf_dir``, through Spark's own reader.

    Python workers of this session also look for packages where this one lies.
    """
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if here not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [here, known]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
