"""Tables written between the steps of a job, in the folder that all machines of a cluster share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The session's own folder under ``spark.checkpoint.dir``; it goes when the driver ends.

    Where that setting is absent, a temporary folder serves a ``local`` master; any other master
    is refused, as its machines would each write to their own disk.
    """
    application = spark.sparkContext.applicationId
    if application not in _FOLDERS:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not spark.sparkContext.master.split("[")[0] == "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            shared = tempfile.mkdtemp(prefix="tradewind-")
        _FOLDERS[application] = f"{shared.rstrip('/')}/tradewind-{application}"
        atexit.register(_remove, spark, _FOLDERS[application])
    return _FOLDERS[application]


def scratch_dir(spark: SparkSession) -> str:
    """The path of a new folder under the session's scratch root."""
    return f"{scratch_root(spark)}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table on shared storage: computed once, and still there if an executor goes."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, folder: str) -> None:
    context = spark.sparkContext
    if context._jsc is None or context._jsc.sc().isStopped():
        return
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
