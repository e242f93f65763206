"""Written intermediate tables in the folder that the driver and the executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the context's checkpoint directory. Where neither is set, a local session uses the
    machine's temporary folder; a cluster is refused, because its executors could not see what others write."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and the executors share")
    return f"file://{tempfile.gettempdir()}"


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written and read again: its lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/loomlog-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session is gone: nothing is left to do
        pass
