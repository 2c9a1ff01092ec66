"""The folder that all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Only where it is unset and the master is local, as in tests, a temporary folder
    is made and set; on a cluster such a folder would not be shared, so that is an error.
    """
    path = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="kintrace-")
        spark.conf.set(CHECKPOINT_DIR, path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The result survives the loss of executors, has a short plan, and carries
    the size statistics with which Spark chooses its joins.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    for scope in _scopes:
        scope.append(path)
    return out


_scopes: list[list[str]] = []


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that ``cut`` wrote and nothing reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end what was cut within it, except the frames passed through the function it gives."""
    mine: list[str] = []
    _scopes.append(mine)

    def keep(df: DataFrame) -> DataFrame:
        out = cut(df, "kept")
        mine.remove(out._cut_path)
        return out

    try:
        yield keep
    finally:
        _scopes.remove(mine)
        for path in mine:
            discard(spark, path)
