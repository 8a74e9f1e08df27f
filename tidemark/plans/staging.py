"""Where plans are cut: tables written to the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset and the master is local, a
    temporary one, which then also becomes the checkpoint directory."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        folder = context.getCheckpointDir()
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; it goes when the session ends."""
    path = f"{shared_folder(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def staged(df: DataFrame, name: str, scratch: list[str] | None = None) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read from there.

    Cuts the lineage without tying rows to one executor: a lost executor costs a read. The
    table stays for the session, or until :func:`drop` is called on the list ``scratch``, which
    gets its path, or else to the end of the :func:`scoped` block around it.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    kept = scratch if scratch is not None else _scopes()[-1] if _scopes() else None
    if kept is not None:
        kept.append(path)
    return spark.read.schema(df.schema).parquet(path)


_local = threading.local()


def _scopes() -> list[list[str]]:
    """The blocks that this thread is in."""
    if not hasattr(_local, "scopes"):
        _local.scopes = []
    return _local.scopes


@contextmanager
def scoped(spark: SparkSession) -> Iterator[None]:
    """At the end of the block, tables staged in it without a list of their own are deleted:
    what is to outlive it is staged with a list. Each thread has blocks of its own."""
    _scopes().append([])
    try:
        yield
    finally:
        drop(spark, _scopes().pop())


def drop(spark: SparkSession, scratch: list[str]) -> None:
    """Deletes staged tables that nothing will read again."""
    for path in scratch:
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
    scratch.clear()


def broadcast_if_small(df: DataFrame, rows: int, most: int = 1_000_000) -> DataFrame:
    """``df`` with a broadcast hint if ``rows``, its counted size, is at most ``most``; beyond
    that a join shuffles."""
    return F.broadcast(df) if rows <= most else df
