"""3. Mixing sources to target weights.

Every source gets a budget of words. A document's place in its source is a
random key hashed from its id. Ranges of that key are the buckets of a
distributed prefix sum: bucket totals are summed first, then each bucket alone
is sorted. The cut falls on the exact word of the budget; a budget above the
source's size repeats whole epochs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, documents, free_name, text_or_empty

#: Weights by the rank of a source, repeating.
WEIGHTS = (5, 2, 1)
#: A source is repeated so often at most.
MAX_EPOCHS = 3
#: Documents that one bucket of a source holds on average, at most.
BUCKET_ROWS = 20_000


def n_words(col: Column) -> Column:
    return F.regexp_count(col, F.lit(WORD)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets of sources (source, source_size): columns rank, weight, target.

    All sizes are shared by weight; no target exceeds ``max_epochs`` times its
    source, and the excess is shared again by weight until none does. Sorted by
    the ratio of that bound to the weight, the bounded sources come first, so
    prefix sums give each its share at once. There is one row per source; the
    windows run over these totals only.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sources.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", w.cast("double"))
    bound = F.col("source_size") * F.lit(float(max_epochs))
    order = Window.orderBy((bound / F.col("weight")).asc(), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    return (
        ranked.withColumn("bound", bound)
        .withColumn("total", F.sum("source_size").over(every).cast("double"))
        .withColumn("rate", (F.col("total") - F.coalesce(F.sum("bound").over(before), F.lit(0.0))) / F.sum("weight").over(after))
        # with each bounded source taken out the rate of the rest grows, with any other it falls: the greatest is that of all that are unbounded
        .withColumn("target", F.least("bound", F.max("rate").over(every) * F.col("weight")))
        .select("source", "source_size", "rank", "weight", F.greatest("target", F.lit(0.0)).alias("target"))
    )


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per input row: id, ``_source``, size, source_size, target, taken.

    ``taken`` counts the words the mix takes of the document, repeats included;
    in each source these add up to the whole part of its target. A null text has
    size 0 and is taken 0 times; null sources form one source, ordered last. Rows
    with equal ids are ordered by the digest of their text; fully equal rows
    count each. A text is never looked at beyond its count and digest.
    """
    rows = df.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        n_words(text_or_empty(text_col)).alias("size"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("key"),
        F.xxhash64(text_or_empty(text_col)).alias("tie"),
    )
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    plan = source_targets(sources, weights, max_epochs)
    return _cut(rows, sources, plan)


def _cut(rows: DataFrame, sources: DataFrame, plan: DataFrame) -> DataFrame:
    n = sources.agg(F.sum("n")).first()[0] or 0
    digits = 1
    while 16**digits * BUCKET_ROWS < n * 16:
        digits += 1
    named = F.struct(F.col("source").isNull().alias("none"), F.coalesce(F.col("source"), F.lit("")).alias("name"))
    r = rows.withColumn("s", named).withColumn("bucket", F.substring("key", 1, digits))
    of_bucket = r.groupBy("s", "bucket").agg(F.sum("size").alias("bucket_size"))
    running = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = of_bucket.withColumn("base", F.coalesce(F.sum("bucket_size").over(running), F.lit(0))).drop("bucket_size")
    # one small table: a row per source and bucket, with what each document needs of its source
    base = base.join(plan.select(named.alias("s"), "source_size", "target"), "s")
    inside = Window.partitionBy("s", "bucket").orderBy("key", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.col("base") + F.col("upto") - F.col("size")
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - start))
    return (
        r.withColumn("upto", F.sum("size").over(inside))
        .join(base, ["s", "bucket"])
        .select("doc_id", F.col("source").alias("_source"), "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"), "tie")
    )


def mixed_rows(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", size_col: str | None = "n_chars", **options) -> DataFrame:
    """The mix itself: a row of ``df`` for each time it is taken, columns as before.

    The one text a source's budget ends in is cut after its last word taken, and
    ``size_col``, if there, becomes its number of characters. Rows that are equal
    in id, source and text count as one document that is taken as often as they
    are together. Documents without words are never taken.
    """
    names = {c: free_name(df, c) for c in ("_id", "_tie", "_from", "_size", "_taken", "_copy", "_t")}
    plan = mix(df, id_col, source_col, text_col, **options).groupBy("doc_id", "tie", "_source").agg(F.max("size").alias(names["_size"]), F.sum("taken").alias(names["_taken"])).filter(F.col(names["_taken"]) > 0)
    plan = plan.withColumnRenamed("doc_id", names["_id"]).withColumnRenamed("tie", names["_tie"]).withColumnRenamed("_source", names["_from"])
    body = F.col(f"`{text_col}`")
    once = df.withColumn(names["_t"], F.xxhash64(text_or_empty(f"`{text_col}`"))).dropDuplicates([id_col, source_col, names["_t"]])
    out = once.join(plan, F.col(f"`{id_col}`").eqNullSafe(F.col(names["_id"])) & (F.col(names["_t"]) == F.col(names["_tie"])) & F.col(f"`{source_col}`").eqNullSafe(F.col(names["_from"])))
    taken, size = F.col(names["_taken"]), F.col(names["_size"])
    out = out.withColumn(names["_copy"], F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(taken / size).cast("long"))))
    words = taken - (F.col(names["_copy"]) - 1) * size
    cut = F.when(words < size, F.array_join(F.slice(F.regexp_extract_all(body, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), F.lit(1), words.cast("int")), "")).otherwise(body)
    new = {text_col: cut} | ({size_col: F.when(words < size, F.length(cut).cast("long")).otherwise(F.col(f"`{size_col}`"))} if size_col in df.columns else {})
    return out.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                  md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key
           FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
w AS (SELECT *, CAST(CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight,
             CAST(source_size AS DOUBLE) * 3.0 AS bound FROM r),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE)
                 - coalesce(sum(bound) OVER (ORDER BY bound / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (ORDER BY bound / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM w),
t AS (SELECT source, source_size, greatest(least(bound, max(rate) OVER () * weight), 0.0) AS target FROM l),
b AS (SELECT *, CAST(floor(target) AS BIGINT) AS budget,
             CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM t),
p AS (SELECT d.doc_id, d.size, b.source_size, b.target, b.budget, b.epochs,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS start
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - start)) AS BIGINT) AS taken
FROM p
"""
