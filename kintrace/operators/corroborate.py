"""Declared children against lists of subsidiaries, with negative controls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kintrace.functions.text import core, norm
from kintrace.operators.order import placed
from kintrace.sources.shared import cut

SEED = "20260827"


def match_children(children: DataFrame, filings: DataFrame) -> DataFrame:
    """Children (uei, name, fam, vis) with ``rule``: how the filing of ``fam`` (fam, subs) names them, null if it does not.

    An equal normalised name anywhere comes first; else the first entry of the list
    with equal core tokens, or with one set inside the other and two tokens in the
    smaller. Entries meet children on a shared core token within the filing.
    """
    entries = filings.select("fam", F.posexplode("subs").alias("pos", "sub"))
    exact = entries.select("fam", norm(F.col("sub")).alias("n")).distinct().withColumn("exact", F.lit(True))
    kids = children.withColumn("n", norm(F.col("name"))).withColumn("c", core(F.col("name")))
    e = entries.withColumn("s", core(F.col("sub"))).withColumn("t", F.explode("s"))
    met = kids.select("uei", "fam", "c", F.explode("c").alias("t")).join(e, ["fam", "t"]).select("uei", "fam", "c", "pos", "s").distinct()
    same = (F.size(F.array_except("c", "s")) == 0) & (F.size(F.array_except("s", "c")) == 0)
    inside = ((F.size(F.array_except("c", "s")) == 0) | (F.size(F.array_except("s", "c")) == 0)) & (F.least(F.size("c"), F.size("s")) >= 2)
    met = met.withColumn("rule", F.when(same, "same_core_tokens").when(inside, "core_token_containment")).filter("rule is not null")
    first = met.groupBy("uei", "fam").agg(F.min_by("rule", "pos").alias("fuzzy"))
    out = kids.join(exact, ["fam", "n"], "left").join(first, ["uei", "fam"], "left")
    return out.select(*children.columns, F.when(F.col("exact"), "exact_normalised").otherwise(F.col("fuzzy")).alias("rule"))


def permuted(families: DataFrame, permutations: int) -> DataFrame:
    """(perm, fam, other): each family with the filing of another, by seeded shuffles; fixed points are left out.

    One row per family and permutation; places come from ranges of (permutation, digest).
    """
    every = F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("perm")
    fams = cut(families.select("fam"), "fams")
    a = placed(fams, [F.col("fam")]).select("fam", "pos", every)
    digest = F.md5(F.concat_ws("|", F.lit(SEED), F.col("perm").cast("string"), F.col("other").cast("string")).cast("binary"))
    b = placed(fams.select(F.col("fam").alias("other"), every).withColumn("h", digest), [F.col("h"), F.col("other")], ["perm"]).select("perm", "other", "pos")
    return a.join(b, ["perm", "pos"]).filter("fam <> other").select("perm", "fam", "other")


def next_size(families: DataFrame) -> DataFrame:
    """(fam, other): the next larger filing of (fam, n), the one before for the last."""
    at = cut(placed(families.select("n", "fam"), [F.col("n"), F.col("fam")]).select("fam", "pos"), "places")
    size = at.agg(F.max("pos").alias("last"))
    wanted = at.crossJoin(F.broadcast(size)).select("fam", F.when(F.col("pos") < F.col("last"), F.col("pos") + 1).otherwise(F.col("pos") - 1).alias("pos"))  # one row
    return wanted.join(at.select(F.col("fam").alias("other"), "pos"), "pos").select("fam", "other")


def against(children: DataFrame, filings: DataFrame, partner: DataFrame) -> DataFrame:
    """Children matched against the filing of a partner (fam, other [, perm]) of their family."""
    lent = partner.join(filings.select(F.col("fam").alias("other"), "subs"), "other")
    if "perm" not in partner.columns:
        lent = lent.withColumn("perm", F.lit(0))
    key = F.concat_ws("|", "perm", "fam")
    kids = children.join(lent.select("fam", "perm"), "fam").withColumn("true_fam", F.col("fam")).withColumn("fam", key)
    return match_children(kids, lent.select(key.alias("fam"), "subs"))


def rank_correlation(rows: DataFrame, x: str, y: str, tie: str) -> DataFrame:
    """Spearman's rho over ordinal ranks, ties in the order of ``tie``."""
    one = placed(rows.select(x, y, tie), [F.col(x), F.col(tie)]).withColumnRenamed("pos", "rx")
    return placed(one, [F.col(y), F.col(tie)]).withColumnRenamed("pos", "ry").agg(F.corr("rx", "ry").alias("rho"), F.count(F.lit(1)).alias("n"))
