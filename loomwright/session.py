"""Session helpers: settings every plan relies on, and durable cuts of a lineage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own session."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("loomwright").config(map=SETTINGS)
    return builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions)).config("spark.driver.memory", memory).getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: the session's setting, or a temporary folder if a local session names none."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="loomwright-checkpoint-")
    sc.setCheckpointDir(configured)
    return configured


_written: list[str] = []


def durable(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder now, as Parquet, and return a DataFrame that reads it back.

    Used where a result feeds several branches or an iteration: losing an executor later costs a re-read, not a
    recomputation, every branch sees the same rows and reads only its columns, and the optimiser knows the size.
    The files stay until `release` or the end of the Python process, since the caller's DataFrame may still read them.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_release_last, spark)
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, since: int = 0) -> None:
    """Remove the tables that durable has written, or all but the first `since` of them (see `written`).

    DataFrames that read them can't be used any more: call it when a query's result has been stored or collected.
    """
    gone, _written[since:] = _written[since:], []
    if gone and spark.sparkContext._jsc is not None:
        jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in gone:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(hadoop).delete(place, True)


def _release_last(spark: SparkSession) -> None:
    """release, when the process ends; a session that is gone by then leaves its tables to the folder's owner."""
    try:
        release(spark)
    except Exception:
        _written.clear()


def written() -> int:
    """How many tables durable holds now: a mark to release back to."""
    return len(_written)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give this package's code to all Python workers, once an application.

    The driver serves the archive to every executor, also to those that start later; no data goes this way.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="loomwright-code-"), "loomwright_code.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)
