"""The shared folder of the session, and tables staged in it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None
_written: list[str] = []
#: Tables that were staged on the way to one, while ``kept_alone`` makes it.
_on_the_way: ContextVar[list[str] | None] = ContextVar("on_the_way", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, as ``spark.checkpoint.dir`` names it.

    Only on one machine is a private one made where the session has none: on a cluster executors
    can't see each other's folders, so there it is an error.
    """
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="arboris-")
        atexit.register(shutil.rmtree, _own_dir, True)
    return "file://" + _own_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which ``release`` removes."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    if (passed := _on_the_way.get()) is not None:
        passed.append(path)
    return path


#: Spark's setting by which the shuffle files of a query are removed when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: the lineage ends there,
    so a lost executor costs a reread and not the stages before. Shuffle files that led to the table are
    removed when it is written; else they would stay until the driver happens to collect its garbage."""
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def kept(df: DataFrame) -> DataFrame:
    """``df`` as a staged table. A stage that several others read is written once: plans built on
    it start from a scan instead of holding a copy of all that led to it."""
    return staged(df, "stage")


def kept_alone(make: Callable[[], DataFrame]) -> DataFrame:
    """``kept`` of what ``make`` returns; tables that were staged on the way are removed then. So ``make`` must not
    stage any that something else is built on: tables that it starts from are made before."""
    token = _on_the_way.set(passed := [])
    try:
        df = make()
    finally:
        _on_the_way.reset(token)
    table = kept(df)
    for path in passed:
        _remove(df.sparkSession, path)
        _written.remove(path)
    return table


def _remove(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> int:
    """Remove the tables that this process has staged, and say how many. DataFrames built on them can't be read after."""
    n = len(_written)
    while _written:
        _remove(spark, _written.pop())
    return n
