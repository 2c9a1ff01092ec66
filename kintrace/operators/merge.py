"""Merging rosters, looking names up, keeping one of several rows, sampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kintrace.functions import text as T


def by_priority(sources: list[DataFrame]) -> DataFrame:
    """(uei, name, source) of rosters (uei, name), one row an id each: the first roster that has a name gives it; ``source`` counts from 1."""
    named = [s.select("uei", F.col("name").alias(f"name_{i}")) for i, s in enumerate(sources, 1)]
    both = reduce(lambda a, b: a.join(b, "uei", "full_outer"), named)
    names = [F.col(f"name_{i}") for i in range(1, len(sources) + 1)]
    source = F.coalesce(*[F.when(n.isNotNull(), F.lit(i)) for i, n in enumerate(names, 1)])
    return both.select("uei", F.coalesce(*names).alias("name"), source.alias("source")).filter("name is not null")


def ids_of_names(names: DataFrame, roster: DataFrame) -> DataFrame:
    """All (name, uei) of the roster whose name is listed; a name may stand for many ids."""
    return names.select("name").distinct().join(roster.select("name", "uei"), "name").distinct()


def tagged(lists: DataFrame, tag: str) -> DataFrame:
    """The names of (name, reasons) whose reasons hold the tag."""
    return lists.filter(F.array_contains("reasons", tag)).select("name").distinct()


def look_up(queries: DataFrame, registrants: DataFrame) -> DataFrame:
    """(uei, registrant, how): the registrant whose normal name is equal, else one with the same core tokens; the least (rank) of several."""
    sorted_core = lambda c: F.array_join(F.array_sort(T.core(c)), " ")
    r = registrants.select("registrant", "rank", T.norm(F.col("name")).alias("n"), sorted_core(F.col("name")).alias("c"))
    first = F.min_by("registrant", F.struct("rank", "registrant"))
    exact = r.groupBy("n").agg(first.alias("exact"))
    # of equal normal names only the first is indexed
    core = r.join(exact, (r.n == exact.n) & (F.col("registrant") == F.col("exact")), "left_semi").filter("c <> ''").groupBy("c").agg(first.alias("near"))
    q = queries.select("uei", T.norm(F.col("name")).alias("n"), sorted_core(F.col("name")).alias("c"))
    out = q.join(exact, "n", "left").join(core, "c", "left")
    how = F.when(F.col("exact").isNotNull(), "norm").when(F.col("near").isNotNull(), "core")
    return out.select("uei", F.coalesce("exact", "near").alias("registrant"), how.alias("how"))


def best_of(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """Of the rows of each key the one with the greatest ``order``, chosen with partial maxima before the shuffle."""
    return df.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("row")).select("row.*")


def simple_sample(df: DataFrame, key: str, k: int, seed: str) -> DataFrame:
    """``k`` rows drawn without replacement: those with the least digests of seed and key."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")).cast("binary")), key).limit(k)


def first_seen(pages: DataFrame, key: str, expected: int, least: float = 0.95) -> DataFrame:
    """One row on a source read page by page (page, place, key): rows, distinct keys, those met again, and whether at least a share of the expected keys came."""
    one = pages.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min_by("page", F.struct("page", "place")).alias("page"))
    out = one.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("n") > 1).alias("met_again"), F.coalesce(F.sum("page"), F.lit(0)).alias("first_pages"))
    return out.withColumn("complete", F.col("n_keys") >= least * expected)


def coalesced_date(start: Column, action: Column) -> Column:
    """The start date, or the action date where it is blank; null for neither."""
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(text(start), text(action)).cast("date")
