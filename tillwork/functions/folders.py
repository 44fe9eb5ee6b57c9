"""The folder that driver and executors share, and tables kept there."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where none is set, a temporary folder is, but only on a local master: executors elsewhere would not see it."""
    context = spark.sparkContext
    held = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not held:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        held = context.getCheckpointDir()
    return held.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Shuffle files of a finished write go at once; else they stay until the driver happens to collect its garbage, and a job of many steps holds those of all.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession):
    """Writes in this block leave no shuffle files behind. A session that sets this itself keeps its setting."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


#: Paths of the tables saved in each open block of passing, innermost last.
_PASSING: ContextVar[tuple[list[str], ...]] = ContextVar("passing", default=())


@contextmanager
def passing(spark: SparkSession):
    """Tables that are saved in this block are removed at its end, so that frames that read them must not leave it."""
    made: list[str] = []
    token = _PASSING.set((*_PASSING.get(), made))
    try:
        yield
    finally:
        _PASSING.reset(token)
        for path in made:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def saved(df: DataFrame, name: str = "bills", compression: str = "snappy", outlive: bool = False) -> DataFrame:
    """df written to the shared folder and read again, which cuts lineage. In a block of passing it goes at the end of the block, or of the one around that if it is to outlive it."""
    path = folder(df.sparkSession, name)
    blocks = _PASSING.get()[: -1 if outlive else None]
    if blocks:
        blocks[-1].append(path)
    with tidy(df.sparkSession):
        df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)
