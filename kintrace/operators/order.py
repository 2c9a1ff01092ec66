"""Places and running sums in an order, without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kintrace.sources.shared import cut


def placed(rows: DataFrame, order: list[Column], by: list[str] | None = None, sums: list[str] | None = None) -> DataFrame:
    """``rows`` with ``pos``, the place from 1 within the columns ``by``, and ``run_<c>`` for each of ``sums``, its total up to the row.

    Rows are laid out in ranges of (by, order); what the ranges before a row's own
    hold of its group is added to the place and the totals within the range, so
    that a group may be of any size. ``order`` must be total within a group.
    """
    by, sums = by or [], sums or []
    ranges = cut(rows.repartitionByRange(*[F.col(c) for c in by], *order).withColumn("part", F.spark_partition_id()), "ranges")
    own = Window.partitionBy("part", *by).orderBy(*order)
    upto = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = ranges.withColumn("pos", F.row_number().over(own).cast("long"))
    for c in sums:
        inside = inside.withColumn(f"run_{c}", F.sum(c).over(upto))
    totals = ranges.groupBy("part", *by).agg(F.count(F.lit(1)).alias("n_"), *[F.sum(c).alias(f"s_{c}") for c in sums])
    earlier = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(F.col("part").alias("part_"), *[F.col(c).alias(f"by_{c}") for c in by], *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("n_", *[f"s_{c}" for c in sums])])
    same = F.col("part") == F.col("part_")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"by_{c}"))
    out = inside.join(before, same)
    names = [F.col(c) for c in rows.columns]
    return out.select(*names, (F.col("pos") + F.col("n_")).alias("pos"), *[(F.col(f"run_{c}") + F.col(f"s_{c}")).alias(f"run_{c}") for c in sums])
