"""Candidate pairs by keys, by sorted neighbourhood and by nearest vectors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kintrace.functions.text import block_key, core, norm, phonetic_key, qgrams, zip5
from kintrace.operators.order import placed
from kintrace.sources.shared import cut

#: Keys with more members give no pairs, as part of the scheme.
MAX_BLOCK = 100


def keyed(entities: DataFrame, keys: Column, cap: int = MAX_BLOCK) -> DataFrame:
    """Distinct pairs a < b of entities that share one of the ``keys`` (an array), over keys of 2 to ``cap`` members.

    Keys are counted, with partial counts before the shuffle, and those over the
    cap dropped before the self-join, so a frequent key never meets itself.
    """
    rows = entities.select("uei", F.explode(keys).alias("key")).distinct()
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") >= 2) & (F.col("n") <= cap))
    kept = rows.join(sizes.select("key"), "key")
    a, b = kept.select("key", F.col("uei").alias("a")), kept.select("key", F.col("uei").alias("b"))
    return a.join(b, "key").filter("a < b").select("a", "b").distinct()


def _one(c: Column) -> Column:
    return F.when(c.isNotNull() & (c != ""), F.array(c)).otherwise(F.array().cast("array<string>"))


#: Scheme -> array of keys of an entity.
KEYS: dict[str, Callable[[], Column]] = {
    "token": lambda: core(F.col("name")),
    "qgram": lambda: qgrams(F.col("name")),
    "first_token": lambda: _one(block_key(F.col("name"))),
    "phonetic": lambda: _one(phonetic_key(F.col("name"))),
    "attribute": lambda: F.filter(
        F.array(
            F.when(zip5(F.col("zip")) != "", F.concat(F.lit("Z"), zip5(F.col("zip")))),
            F.when(F.col("state").isNotNull() & F.col("city").isNotNull(), F.concat_ws("|", F.lit("C"), F.col("state"), norm(F.col("city")))),
        ),
        lambda k: k.isNotNull(),
    ),
}


def by_keys(entities: DataFrame, scheme: str, cap: int = MAX_BLOCK) -> DataFrame:
    return keyed(entities, KEYS[scheme](), cap)


def positions(entities: DataFrame) -> DataFrame:
    """Entities with their place in the order of (normalised name, id), without one task for all rows."""
    return placed(entities.select("uei", norm(F.col("name")).alias("n")), [F.col("n"), F.col("uei")]).select("uei", "pos")


def sorted_neighbourhood(entities: DataFrame, window: int = 20) -> DataFrame:
    """Pairs of entities less than ``window`` places apart: an equi-join on shifted places."""
    placed = cut(positions(entities), "positions")
    near = placed.select(F.col("uei").alias("x"), F.explode(F.sequence(F.col("pos") + 1, F.col("pos") + (window - 1))).alias("pos"))
    return near.join(placed, "pos").select(F.least("x", "uei").alias("a"), F.greatest("x", "uei").alias("b")).distinct()


def nearest(vectors: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 2048) -> DataFrame:
    """(x, y, rank, score): the k nearest by dot product, ties by id; exact, block against block.

    Vectors are dealt to blocks; a task multiplies two blocks and keeps k
    candidates a row, so what is shuffled grows with rows and blocks, not with pairs.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    n = max(1, -(-rows.count() // block))
    mine = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("i", mine).withColumn("j", every)
    right = rows.withColumn("j", mine).withColumn("i", every)

    def top(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame({"x": [], "y": [], "score": []})
        sims = np.round(np.stack(x["v"]) @ np.stack(y["v"]).T, 9)
        xi, yi = x["id"].to_numpy(), y["id"].to_numpy()
        sims[xi[:, None] == yi[None, :]] = -np.inf
        least = min(k, len(yi))
        floor = -np.partition(-sims, least - 1, axis=1)[:, least - 1]
        r, c = np.nonzero((sims >= floor[:, None]) & np.isfinite(sims))  # the k best of a row and what ties with the last
        order = np.lexsort((yi[c], -sims[r, c], r))
        r, c = r[order], c[order]
        first = np.arange(len(r)) - np.searchsorted(r, r) < k
        r, c = r[first], c[first]
        return pd.DataFrame({"x": xi[r], "y": yi[c], "score": sims[r, c]})

    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(top, "x long, y long, score double")
    w = Window.partitionBy("x").orderBy(F.col("score").desc(), "y")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def symmetric(neighbours: DataFrame) -> DataFrame:
    return neighbours.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def union_of(candidates: list[DataFrame]) -> DataFrame:
    out = candidates[0]
    for c in candidates[1:]:
        out = out.union(c)
    return out.distinct()


def metrics(candidates: DataFrame, truth: DataFrame, n_entities: int) -> DataFrame:
    """Per scheme (column ``scheme``): pairs, hits, true pairs in all and by stratum; PC, PQ and RR follow from them."""
    total = truth.agg(F.count(F.lit(1)).alias("truth"), *[F.count_if(F.col("vis") == v).alias(f"truth_{v}") for v in ("identical", "visible", "invisible")])
    hit = candidates.join(truth, ["a", "b"], "left")
    out = hit.groupBy("scheme").agg(F.count(F.lit(1)).alias("pairs"), F.count("vis").alias("hits"), *[F.count_if(F.col("vis") == v).alias(f"hits_{v}") for v in ("identical", "visible", "invisible")])
    space = n_entities * (n_entities - 1) // 2
    return out.crossJoin(F.broadcast(total)).withColumn("space", F.lit(space).cast("long"))


def ratios(counts: DataFrame) -> DataFrame:
    """Pair completeness (in all and by stratum), reduction ratio and pair quality in per cent, from ``metrics``."""
    part = lambda k, n: F.round(F.coalesce(F.try_divide(100.0 * F.col(k), F.col(n)), F.lit(0.0)), 6)
    strata = [part(f"hits_{v}", f"truth_{v}").alias(f"pc_{v}") for v in ("identical", "visible", "invisible")]
    return counts.select("scheme", part("hits", "truth").alias("pc"), F.round(100.0 * (1 - F.col("pairs") / F.col("space")), 6).alias("rr"), part("hits", "pairs").alias("pq"), *strata)
