"""Tables kept between jobs, in the folder that driver and executors share.

The folder is the one the cluster names in ``spark.checkpoint.dir``; only where that is unset and
Spark runs in local mode (tests) a temporary folder of this machine is used.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    """URI of the shared folder."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if "dir" not in _own:
        _own["dir"] = "file://" + tempfile.mkdtemp(prefix="pointloom-")
    return _own["dir"]


def folder(spark: SparkSession, name: str) -> str:
    """URI of a folder of its own, not yet made."""
    return f"{root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def _write(df: DataFrame, at: str, options: dict[str, str] | None = None) -> DataFrame:
    df.write.options(**{"compression": "zstd", **(options or {})}).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def keep(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder (``options``: the writer's) and read it back: later jobs start from the files, not from the plan before."""
    return _write(df, folder(df.sparkSession, name), options)


@contextmanager
def shelf(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Gives a ``keep`` whose tables are deleted at the end. What is to outlive that is kept by ``keep`` itself, before."""
    made: list[str] = []

    def put(df: DataFrame, name: str) -> DataFrame:
        made.append(folder(spark, name))
        return _write(df, made[-1])

    try:
        yield put
    finally:
        for at in made:
            drop(spark, at)


def drop(spark: SparkSession, at: str) -> None:
    """Delete a folder of the shared store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
