"""What the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import kintrace
from kintrace.sources.shared import cut, discard, scratch, shared_dir  # noqa: F401

#: A word: a run of anything but the space and the five ASCII control blanks.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows and bytes of an Arrow batch at most: what a Python worker holds at once.
BATCH_ROWS, BATCH_BYTES = 1_000, 16 << 20

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, as a zip file, and keep Arrow batches small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(kintrace.__file__)
    path = os.path.join(tempfile.mkdtemp(prefix="kintrace-"), "kintrace.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def text_id(col: str = "text") -> Column:
    """Sixteen bytes that stand for a text: equal texts share them."""
    return F.substring(F.unhex(F.sha2(text_or_empty(col).cast("binary"), 256)), 1, 16)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it (case ignored)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
