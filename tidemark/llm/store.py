"""Tables written in the shared folder to cut lineage, and files the cluster can always read back."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoint import shuffles_removed

#: Tables written in the scopes that are open, by the path of each: innermost scope last.
_scopes: ContextVar[tuple[dict[str, SparkSession], ...]] = ContextVar("scopes", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; on a local session without one (tests) a folder of our own."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not got:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        got = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(got)
    return got.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write `df` once and go on from the written table: no recomputation, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with shuffles_removed(spark):
        df.write.options(**options).parquet(path)
    if _scopes.get():
        _scopes.get()[-1][path] = spark
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scope() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables materialized within are removed at the end, but for those that are kept for the scope around:

        with scope() as keep:
            found = keep(materialize(...))
    """
    own: dict[str, SparkSession] = {}
    around = _scopes.get()
    mark = _scopes.set((*around, own))

    def keep(table: DataFrame) -> DataFrame:
        for file in _folders(table):
            for path in [p for p in own if p.rsplit("/", 1)[-1] == file.rsplit("/", 1)[-1]]:
                spark = own.pop(path)
                if around:
                    around[-1][path] = spark
        return table

    try:
        yield keep
    finally:
        _scopes.reset(mark)
        for path, spark in own.items():
            _remove(spark, path)


def broadcast_within(table: DataFrame, rows: int) -> DataFrame:
    """A written table, broadcast in joins if it has at most so many rows."""
    return F.broadcast(table) if table.count() <= rows else table


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, records: int) -> Iterator[None]:
    """Rows that Python functions get at once, for actions within: few where a row holds several long texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(records))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _folders(table: DataFrame) -> set[str]:
    return {f.rsplit("/", 1)[0] for f in table.inputFiles()}


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop(*tables: DataFrame | None) -> None:
    """Remove the files behind materialized tables that nothing reads any more."""
    for df in tables:
        for folder in _folders(df) if df is not None else ():
            _remove(df.sparkSession, folder)
