"""Tables written to end a lineage: lost executors lose nothing, and plans stay short."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: The folder that the innermost workspace() has opened.
_OPEN: ContextVar[str | None] = ContextVar("metaloom_scratch", default=None)


def _base(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/metaloom-scratch"
    return base.rstrip("/")


def new_dir(spark: SparkSession, what: str = "step") -> str:
    """A new folder's name in spark.checkpoint.dir, or in a local folder where that is unset and the master is local."""
    return f"{_OPEN.get() or _base(spark)}/{what}-{uuid.uuid4().hex}"


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """df as a table in a new folder, read back."""
    return _written(df, new_dir(df.sparkSession))


@contextmanager
def workspace(spark: SparkSession) -> Iterator[None]:
    """What cut() writes meanwhile goes at the end; keep() writes where the outer workspace, if any, does."""
    folder = new_dir(spark, "work")
    before = _OPEN.set(folder)
    try:
        yield
    finally:
        _OPEN.reset(before)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def keep(df: DataFrame) -> DataFrame:
    """df as a table that outlives the workspace in which it is called."""
    folder = _OPEN.get()
    outer = folder.rsplit("/work-", 1)[0] if folder else _base(df.sparkSession)
    return _written(df, f"{outer}/kept-{uuid.uuid4().hex}")
