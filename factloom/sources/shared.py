"""The folder that driver and executors share, and results that are kept there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a temporary folder, if all tasks run in the driver's process, else an error."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not found and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="factloom-"))
    return found or sc._jsc.sc().getCheckpointDir().get()


def working_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is removed when the application ends."""
    sc = spark.sparkContext
    if sc.applicationId not in _made:
        own = f"{shared_dir(spark)}/factloom-{uuid.uuid4().hex}"
        path = sc._jvm.org.apache.hadoop.fs.Path(own)
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _made[sc.applicationId] = own
    return f"{_made[sc.applicationId]}/{name}-{uuid.uuid4().hex}"


def kept(rows: DataFrame) -> DataFrame:
    """The rows, computed once and stored in the shared folder, so that several consumers (and retries) reuse them."""
    shared_dir(rows.sparkSession)
    return rows.checkpoint(eager=True)
