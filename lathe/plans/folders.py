"""Where intermediate tables go."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: The temporary folder of a local session without spark.checkpoint.dir; it goes when the process ends.
LOCAL: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Where it is unset: on a cluster a folder in the warehouse, which
    is shared too, and in local mode a temporary one. The session's settings are left as they are."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if spark.sparkContext.master.split("[")[0] != "local":
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"
    if not LOCAL:
        LOCAL.append(tempfile.mkdtemp(prefix="lathe-"))
        atexit.register(shutil.rmtree, LOCAL[0], ignore_errors=True)
    return LOCAL[0]


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder: rows, their order and their partitions are the same for all that reads it."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
