"""Session helpers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="metricmart-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    root = Path(__file__).resolve().parent
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(folder, "metricmart"), "zip", root.parent, root.name))
    _shipped.add(app)


def folder(spark: SparkSession) -> str:
    """A new folder's path in the shared folder (spark.checkpoint.dir). Only a local session without one makes its own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="metricmart-"))
        at = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{at.rstrip('/')}/stage-{uuid.uuid4().hex}"


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the jobs within are given up at each job's end."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stage(df: DataFrame) -> DataFrame:
    """Writes a stage's table to the shared folder and reads it again, so that what follows may use it many times.

    Its files are far smaller than its rows in memory, and Spark goes by the files: joins of two tables that grow with the
    input have the hint ``merge``, or one of them would be collected by the driver and broadcast."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
