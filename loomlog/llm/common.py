"""What the operators of this subpackage share: table access, the shared folder, and written intermediate tables."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table ``name`` below ``sf_dir``, by Spark's own reader, so any store that Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``, or the context's checkpoint
    directory. Where neither is set, a local session gets a folder of its own; a cluster is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not current.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        found = current.get() if current.isDefined() else f"file://{tempfile.mkdtemp(prefix='loomlog-')}"
        if not current.isDefined():
            spark.sparkContext.setCheckpointDir(found)
    elif not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_scopes: list[list[str]] = []


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside go when the block ends, but those written with ``keep``; so do the shuffle files
    of what was computed inside, as soon as the driver's collector finds them unused. Nothing that the block returns may
    still read what goes."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _remove(spark, path)
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def fresh_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new path below the shared folder. What is written there goes with the block of ``temporary`` around it (``keep``:
    with the next one outside), or when the driver's process ends."""
    path = f"{shared_dir(spark)}/loomlog-{name}-{uuid.uuid4().hex}"
    scopes = _scopes[:-1] if keep else _scopes
    if scopes:
        scopes[-1].append(path)
    else:
        atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session is gone: nothing is left to do
        pass


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage ends here, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = fresh_path(spark, name, keep)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
