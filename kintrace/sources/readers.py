"""Readers and writers: award CSV shards, JSON lines, JSON documents, reports."""

from __future__ import annotations

import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Spellings of the award columns, the first one present wins.
AWARD_COLUMNS = {
    "uei": ["recipient_uei", "awardee_or_recipient_uei"],
    "name": ["recipient_name", "awardee_or_recipient_legal"],
    "parent_uei": ["recipient_parent_uei", "ultimate_parent_uei"],
    "parent_name": ["recipient_parent_name", "ultimate_parent_legal_enti"],
    "amount": ["federal_action_obligation"],
    "start_date": ["period_of_performance_start_date"],
    "action_date": ["action_date"],
}
#: Without these a shard tells nothing about links.
REQUIRED = ("uei", "parent_uei")


def unzip_members(archive: str, folder: str) -> list[str]:
    """Unpack the CSV members of a ZIP, which Spark cannot split, to files that it can."""
    with zipfile.ZipFile(archive) as z:
        names = [n for n in z.namelist() if n.lower().endswith(".csv")]
        z.extractall(folder, names)
    return [str(Path(folder, n)) for n in names]


def resolve_columns(header: list[str], wanted: dict[str, list[str]] | None = None) -> dict[str, str]:
    """Logical name -> column of ``header``, whatever its case; names without a spelling present are left out."""
    at = {h.strip().lower(): h for h in reversed(header)}
    wanted = AWARD_COLUMNS if wanted is None else wanted
    return {k: next(at[s] for s in spellings if s in at) for k, spellings in wanted.items() if any(s in at for s in spellings)}



def read_awards(spark: SparkSession, paths: list[str], max_rows: int | None = None) -> tuple[DataFrame, list[str]]:
    """Award rows of CSV shards by logical column, and the shards skipped for lack of a required column.

    Fields may hold line ends and be of any length; short rows are read as far as
    they go and rows without an id left out; bytes that are no UTF-8 are replaced.
    """
    frames, skipped = [], []
    for path in paths:
        shard = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE").option("maxCharsPerColumn", -1).csv(path)
        found = resolve_columns(shard.columns)
        if any(k not in found for k in REQUIRED):
            skipped.append(path)
            continue
        frames.append(shard.select(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(k) for k, c in found.items()]))
    if not frames:
        return spark.createDataFrame([], T.StructType([T.StructField(k, T.StringType()) for k in AWARD_COLUMNS])), skipped
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    out = out.filter("uei is not null")
    if "amount" in out.columns:
        out = out.withColumn("amount", F.coalesce(F.col("amount").try_cast("double"), F.lit(0.0)))
    return (out.limit(max_rows) if max_rows is not None else out), skipped


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """JSON lines; blank lines give no row."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path)


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """A whole JSON document as rows."""
    return spark.read.option("multiLine", True).json(path)


def read_map(spark: SparkSession, path: str, key: str = "key", value: str = "value") -> DataFrame:
    """A JSON object as rows of key and value."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias(key, value))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def report(df: DataFrame) -> DataFrame:
    """One JSON text of a one-row frame."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("report"))


def preferred_records(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the last child-level record, or else the first seen."""
    child = F.col("recipient_level") == "C"
    rank = F.struct(child.cast("int").alias("child"), F.when(child, F.col(order)).otherwise(-F.col(order)).alias("at"))
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), rank).alias("r")).select("r.*")


def remaining(targets: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Targets that are not done yet, for a run that goes on where one stopped."""
    return targets.join(done, key, "left_anti")


def dataset_digest(df: DataFrame) -> DataFrame:
    """A digest that does not depend on the order of the rows."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    part = F.conv(F.substring(row, 1, 12), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(part).alias("digest"))
