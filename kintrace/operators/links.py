"""Parent links from award rows: counts, mode, names, attributes, dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kintrace.functions.text import visibility


def pair_counts(awards: DataFrame) -> DataFrame:
    """Rows, sum and first day of each (entity, parent); a blank parent is a candidate of its own."""
    return awards.groupBy("uei", "puei").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amt"), F.min("day").alias("first_day"))


def parent_mode(counts: DataFrame, amount_first: bool = False) -> DataFrame:
    """The winning parent of each entity: most rows, then most money, then the least id.

    ``amount_first`` swaps the first two. The rows and money of the result are
    those of the winning pair; ``parents`` counts the parents that are not blank.
    """
    keys = [F.col("n").desc(), F.col("amt").desc()]
    order = Window.partitionBy("uei").orderBy(*(reversed(keys) if amount_first else keys), F.coalesce("puei", F.lit(-1)))
    best = counts.withColumn("rn", F.row_number().over(order)).filter("rn = 1")
    parents = counts.groupBy("uei").agg(F.count("puei").alias("parents"))
    return best.join(parents, "uei").select("uei", "puei", F.col("n").alias("award_rows"), F.col("amt").alias("obligated"), "parents")


def with_names(mode: DataFrame, names: DataFrame) -> DataFrame:
    child = names.select("uei", "name")
    parent = names.select(F.col("uei").alias("puei"), F.col("name").alias("pname"))
    return mode.join(child, "uei", "left").join(parent, "puei", "left").select("uei", "name", "puei", "pname", "award_rows", "obligated", "parents")


def link_class() -> Column:
    return F.when(F.col("puei").isNull(), "blank").when(F.col("puei") == F.col("uei"), "self").otherwise("genuine")


def genuine(links: DataFrame) -> DataFrame:
    """Links to another entity with both names present, and their stratum."""
    ok = F.col("puei").isNotNull() & (F.col("puei") != F.col("uei")) & F.col("name").isNotNull() & F.col("pname").isNotNull()
    return links.filter(ok).withColumn("vis", visibility(F.col("name"), F.col("pname")))


def last_names(rows: DataFrame, key: str, name: str, order: str) -> DataFrame:
    """The last name of each key that is not blank, by an explicit order."""
    kept = rows.filter(F.trim(F.col(name)) != "")
    return kept.groupBy(key).agg(F.max_by(name, order).alias(name))


def weighted_mode(rows: DataFrame, key: str, fields: list[str], weight: str) -> DataFrame:
    """(key, field, value, w, n_values): the value of each field with most weight, the least value on ties.

    A row weighs the size of its amount, 1 where that is 0; blank values do not take part.
    """
    w = F.abs(F.coalesce(F.col(weight).cast("decimal(18,2)"), F.lit(0)))
    w = F.when(w == 0, F.lit(1)).otherwise(w).cast("decimal(18,2)")
    long = rows.select(F.col(key), w.alias("w"), *[F.nullif(F.trim(F.col(f).cast("string")), F.lit("")).alias(f) for f in fields]).unpivot([key, "w"], fields, "field", "value").filter("value is not null")
    sums = long.groupBy(key, "field", "value").agg(F.sum("w").alias("w"))
    order = Window.partitionBy(key, "field").orderBy(F.col("w").desc(), "value")
    best = sums.withColumn("rn", F.row_number().over(order)).withColumn("n_values", F.count(F.lit(1)).over(Window.partitionBy(key, "field")))
    return best.filter("rn = 1").drop("rn")
