"""Tables between two passes over the same rows, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's folder under ``spark.checkpoint.dir``; a temporary one where that is not set and Spark runs in one process."""
    context = spark.sparkContext
    if context.applicationId not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
        if not base:
            if not context.master.startswith("local[") and context.master != "local":
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="promptloom-")
        _ROOTS[context.applicationId] = f"{base.rstrip('/')}/tables-{context.applicationId}"
        atexit.register(remove, spark, _ROOTS[context.applicationId])
    return _ROOTS[context.applicationId]


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written and read back: what it took is not done again, and a lost executor costs no more than this table."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session has ended; the folder may stay
        pass
