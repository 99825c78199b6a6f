"""Session helpers: shared scratch space and table readers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only in local mode (tests, a laptop) a folder of our own is made where it is unset.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = known.get() if known.isDefined() else None
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="velum-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/velum-{spark.sparkContext.applicationId}"


_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``materialise`` writes inside, without a list of its own, are dropped at the end."""
    tables: list[str] = []
    token = _scratch.set(tables)
    try:
        yield
    finally:
        _scratch.reset(token)
        drop_tables(spark, tables)


def materialise(df: DataFrame, name: str = "t", tables: list[str] | None = None, codec: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back; ``tables`` gets the path, for ``drop_tables``. codec: None for the session's.

    Cuts the lineage with files that all executors share, so a lost executor
    costs a re-read and not a recomputation. What is not dropped is removed by ``cleanup``.
    """
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (tables := _scratch.get() if tables is None else tables) is not None:
        tables.append(path)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that ``materialise`` has written and nobody reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    paths.clear()


def cleanup(spark: SparkSession) -> None:
    """Delete every table that ``materialise`` has written for this application."""
    drop_tables(spark, [_own_dir(spark)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt out by ``by`` over four tasks for each core.

    For narrow rows with much work on each: Spark sizes tasks by the bytes of a
    file and never splits a row group, so that a few tasks would do all of it.
    """
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *by)
