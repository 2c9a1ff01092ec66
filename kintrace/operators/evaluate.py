"""Thresholds, confusion counts, average precision; clusters against families."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kintrace.functions.text import f1
from kintrace.operators.graph import connected_components
from kintrace.operators.order import placed


def candidate_thresholds(val: DataFrame) -> DataFrame:
    """Distinct scores to three decimals per scorer, every (n div 200)-th if there are more than 200."""
    w = Window.partitionBy("scorer")
    grid = val.select("scorer", F.round("score", 3).alias("thr")).distinct()
    grid = grid.withColumn("i", F.row_number().over(w.orderBy("thr")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    return grid.filter((F.col("n") <= 200) | (F.col("i") % F.floor(F.col("n") / 200) == 0)).select("scorer", "thr")


def sweep(val: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Confusion counts at each threshold. At most 399 thresholds a scorer, so they are broadcast."""
    both = val.join(F.broadcast(thresholds), "scorer")
    hit = F.col("score") >= F.col("thr")
    return both.groupBy("scorer", "thr").agg(F.count_if((F.col("label") == 1) & hit).alias("tp"), F.count_if((F.col("label") == 0) & hit).alias("fp"), F.count_if((F.col("label") == 1) & ~hit).alias("fn"))


def best_threshold(val: DataFrame) -> DataFrame:
    """(scorer, thr, f1): F1 in per cent to two decimals; the lowest threshold wins ties."""
    s = sweep(val, candidate_thresholds(val)).withColumn("f1", F.round(100 * f1(F.col("tp"), F.col("fp"), F.col("fn")), 2))
    w = Window.partitionBy("scorer").orderBy(F.col("f1").desc(), "thr")
    return s.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("scorer", "thr", "f1")


def confusion(tested: DataFrame, *by: str) -> DataFrame:
    """tp, fp, fn, tn by the columns given; ``tested`` has label and pred (0/1)."""
    cell = lambda label, pred: F.count_if((F.col("label") == label) & (F.col("pred") == pred))
    return tested.groupBy(*by).agg(cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(0, 0).alias("tn"))


def average_precision(rows: DataFrame) -> DataFrame:
    """(scorer, ap): tied scores count as one step, so the order of rows does not matter."""
    steps = rows.groupBy("scorer", "score").agg(F.sum("label").alias("p"), F.count(F.lit(1)).alias("n"))
    run = placed(steps, [F.col("score").desc()], ["scorer"], ["p", "n"]).withColumnsRenamed({"run_p": "tp", "run_n": "seen"})
    run = run.join(F.broadcast(rows.groupBy("scorer").agg(F.sum("label").alias("all_p"))), "scorer")
    return run.groupBy("scorer").agg(F.sum(F.coalesce(F.try_divide(F.col("tp") / F.col("seen") * F.col("p"), F.col("all_p")), F.lit(0.0))).alias("ap"))


def clusters(entities: DataFrame, links: DataFrame) -> DataFrame:
    """(uei, cluster): components of links (a, b); entities without links stand alone."""
    labels = connected_components(links, "a", "b")
    return entities.select("uei").join(labels, F.col("uei") == F.col("node"), "left").select("uei", F.coalesce("component", "uei").alias("cluster"))


def contingency(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """(fam, cluster, nij, ni, nj) of truth (uei, fam) and prediction (uei, cluster)."""
    nij = truth.join(pred, "uei").groupBy("fam", "cluster").agg(F.count(F.lit(1)).alias("nij"))
    ni = truth.groupBy("fam").agg(F.count(F.lit(1)).alias("ni"))
    nj = pred.groupBy("cluster").agg(F.count(F.lit(1)).alias("nj"))
    return nij.join(ni, "fam").join(nj, "cluster")


def bcubed(table: DataFrame) -> DataFrame:
    n = F.sum("nij")
    sq = F.col("nij") * F.col("nij")
    return table.agg((F.sum(sq / F.col("nj")) / n).alias("precision"), (F.sum(sq / F.col("ni")) / n).alias("recall"))


def pairwise(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """Pairs together in both, in the prediction and in the truth, from group sizes; no pair is made."""
    two = lambda c: F.coalesce(F.sum(F.expr(f"{c} * ({c} - 1) div 2")), F.lit(0))
    tp = truth.join(pred, "uei").groupBy("fam", "cluster").count().agg(two("count").alias("tp"))
    p = pred.groupBy("cluster").count().agg(two("count").alias("predicted"))
    t = truth.groupBy("fam").count().agg(two("count").alias("true"))
    return tp.crossJoin(p).crossJoin(t)


def exact_families(table: DataFrame) -> DataFrame:
    """Families whose parent's cluster is the family and nothing else."""
    return table.filter("nij = ni and nij = nj").select("fam")


def bcubed_sweep(truth: DataFrame, links: DataFrame, thresholds: list[float]) -> DataFrame:
    """(thr, precision, recall, f1) in B-cubed terms of the clusters that links (a, b, score) make at each threshold.

    The thresholds are layers of one graph, so that components are found once.
    """
    layers = F.explode(F.array(*[F.lit(i) for i in range(len(thresholds))]))
    values = F.array(*[F.lit(t) for t in thresholds])
    node = lambda c: F.struct(F.col("layer"), F.col(c).alias("uei"))
    of = links.withColumn("layer", layers).filter(F.col("score") >= F.element_at(values, F.col("layer") + 1))
    labels = connected_components(of.select(node("a").alias("a"), node("b").alias("b")), "a", "b")
    entities = truth.withColumn("layer", layers).withColumn("node", node("uei"))
    both = entities.join(labels, "node", "left").select("layer", "uei", "fam", F.coalesce("component.uei", "uei").alias("cluster"))
    nij = both.groupBy("layer", "fam", "cluster").agg(F.count(F.lit(1)).alias("nij"))
    ni = both.groupBy("layer", "fam").agg(F.count(F.lit(1)).alias("ni"))
    nj = both.groupBy("layer", "cluster").agg(F.count(F.lit(1)).alias("nj"))
    sq, n = F.col("nij") * F.col("nij"), F.sum("nij")
    out = nij.join(ni, ["layer", "fam"]).join(nj, ["layer", "cluster"]).groupBy("layer").agg((F.sum(sq / F.col("nj")) / n).alias("precision"), (F.sum(sq / F.col("ni")) / n).alias("recall"))
    f1 = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))
    return out.select(F.element_at(values, F.col("layer") + 1).alias("thr"), "precision", "recall", f1.alias("f1"))


def flags(cells: DataFrame, margin: float = 0.05) -> DataFrame:
    """Adds to confusion counts the F1 value, that of saying yes always, the lift over it, whether it is beaten by the margin, and whether nearly all is said yes to."""
    pos, n = F.col("tp") + F.col("fn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    ratio = lambda k, of: F.coalesce(F.try_divide(k, of), F.lit(0.0))
    out = cells.withColumn("f1", ratio(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))).withColumn("floor_f1", ratio(2.0 * pos, n + pos))
    out = out.withColumn("lift", F.col("f1") - F.col("floor_f1")).withColumn("beats", F.col("lift") > margin)
    return out.withColumn("degenerate", (ratio(F.col("tp"), pos) > 0.99) & (ratio(F.col("tp"), F.col("tp") + F.col("fp")) < 0.4))
