"""Audits of links, rosters and families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kintrace.functions.text import core, norm, norm_roster, strip_legal
from kintrace.operators.order import placed
from kintrace.sources.shared import cut


def examples(df: DataFrame, by: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rn") <= k).drop("rn")


def self_parents(links: DataFrame) -> DataFrame:
    """Self links by id and by name; self, blank and other parents add up to all."""
    p, u = F.col("puei"), F.col("uei")
    return links.agg(F.count(F.lit(1)).alias("n"), F.count_if(p == u).alias("by_id"), F.count_if(norm(F.col("name")) == norm(F.col("pname"))).alias("by_name"), F.count_if(p.isNull()).alias("blank"), F.count_if(p != u).alias("other"))


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """How far two derivations of the same links agree: by id, else by name, else by a shared token."""
    fold = lambda df, s: df.select("uei", F.nullif("puei", "uei").alias(f"p{s}"), F.col("pname").alias(f"n{s}"))
    j = fold(a, 1).join(fold(b, 2), "uei")
    rung = (
        F.when(F.col("p1").isNull() & F.col("p2").isNull(), "both_none").when(F.col("p1").isNull() | F.col("p2").isNull(), "one_none")
        .when(F.col("p1") == F.col("p2"), "uei").when(norm(F.col("n1")) == norm(F.col("n2")), "name")
        .when(F.arrays_overlap(core(F.col("n1"), 1), core(F.col("n2"), 1)), "token").otherwise("differ")
    )
    return j.groupBy(rung.alias("agreement")).agg(F.count(F.lit(1)).alias("n"))


def family_sizes(genuine: DataFrame) -> DataFrame:
    return genuine.groupBy(F.col("puei").alias("fam")).agg(F.count(F.lit(1)).alias("children"), F.sum("obligated").alias("obligated"))


def levels(roster: DataFrame) -> DataFrame:
    a = F.col("amount")
    return roster.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.count_if(a > 0).alias("positive"), F.count_if(a < 0).alias("negative"), F.sum(a.cast("decimal(18,2)")).alias("amount"))


def collisions(roster: DataFrame) -> DataFrame:
    """Distinct names, names of several entities, and the pairs of entities they confuse."""
    long = roster.select("uei", norm_roster(F.col("name")).alias("norm"), strip_legal(F.col("name")).alias("stripped")).unpivot("uei", ["norm", "stripped"], "kind", "value")
    n = long.groupBy("kind", "value").agg(F.count_distinct("uei").alias("n"))
    return n.groupBy("kind").agg(F.count(F.lit(1)).alias("distinct_names"), F.count_if(F.col("n") > 1).alias("shared"), F.sum(F.expr("n * (n - 1) div 2")).alias("pairs"))


def marks(roster: DataFrame, at: list[int]) -> DataFrame:
    """Share of positive money that the first entities have, at the ranks given.

    Only the largest rank's worth of rows is ranked: a limit keeps them, per
    partition first, and the total is a plain sum.
    """
    a = F.greatest(F.col("amount"), F.lit(0.0)).cast("decimal(18,2)")
    top = roster.select("uei", "amount", a.alias("a")).orderBy(F.desc("amount"), "uei").limit(max(at))
    ranked = top.withColumn("rn", F.row_number().over(Window.orderBy(F.desc("amount"), "uei")))
    total = roster.agg(F.sum(a).alias("total"), F.count(F.lit(1)).alias("n"))
    each = ranked.crossJoin(F.broadcast(total)).withColumn("mark", F.explode(F.array(*map(F.lit, at)))).filter("mark <= n and rn <= mark")
    return each.groupBy("mark").agg(F.round(F.sum("a").cast("double") / F.max("total").cast("double"), 9).alias("share"))


def top_share(amounts: DataFrame, percents: list[int], floor: bool = False) -> DataFrame:
    """Share of all of ``a`` that the first ``frac`` per cent of rows have, one row at least."""
    rows = cut(amounts.select("uei", "a"), "amounts")
    total = rows.agg(F.sum("a").alias("total"), F.count(F.lit(1)).alias("n")).withColumn("frac", F.explode(F.array(*map(F.lit, percents))))
    exact = F.floor(F.col("n") * F.col("frac") / 100) if floor else F.bround(F.col("n") * F.col("frac") / 100.0, 0)
    total = total.withColumn("k", F.greatest(F.lit(1), exact.cast("long")))
    top = placed(rows, [F.desc("a"), F.col("uei")])
    return top.join(F.broadcast(total), F.col("pos") <= F.col("k")).groupBy("frac", "k").agg(F.round(F.sum("a").cast("double") / F.max("total").cast("double"), 9).alias("share"))


def reach(genuine: DataFrame) -> DataFrame:
    """Children of each family, and those whose name shares a core token with the parent's."""
    hit = F.arrays_overlap(core(F.col("name")), core(F.col("pname")))
    return genuine.groupBy(F.col("puei").alias("fam")).agg(F.min("pname").alias("pname"), F.count(F.lit(1)).alias("children"), F.sum("obligated").alias("obligated"), F.count_if(hit).alias("reached"))


def dominant_tokens(genuine: DataFrame, least: int = 3, share: float = 0.6) -> DataFrame:
    """A token that most children share and the parent lacks, among the five most frequent, ties by the token."""
    tally = genuine.select(F.col("puei").alias("fam"), F.explode(core(F.col("name"))).alias("token")).groupBy("fam", "token").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("fam").orderBy(F.desc("n"), "token")
    five = tally.withColumn("rn", F.row_number().over(w)).filter("rn <= 5")
    ok = five.join(reach(genuine), "fam").filter((F.col("children") >= least) & (F.col("n") >= share * F.col("children")) & ~F.array_contains(core(F.col("pname")), F.col("token")))
    return ok.groupBy("fam").agg(F.min_by(F.struct("token", "n", "children"), "rn").alias("x")).select("fam", "x.token", "x.n", "x.children")


def artifacts(genuine: DataFrame, links: DataFrame, max_reach: float = 0.2, review: int = 25) -> DataFrame:
    """Families with reasons to look at them; nothing is dropped."""
    own = links.select(F.col("uei").alias("fam"), F.col("obligated").alias("parent_obligated"))
    f = reach(genuine).join(dominant_tokens(genuine).select("fam", "token"), "fam", "left").join(own, "fam", "left")
    block = F.when(F.col("token").isNotNull() & (F.col("reached") <= max_reach * F.col("children")), "block")
    reasons = F.array_compact(F.array(F.when(F.rlike("pname", F.lit(_SOVEREIGN)), "sovereign"), block, F.when(F.col("children") >= review, "large")))
    return f.select("fam", "children", "obligated", F.coalesce("parent_obligated", F.lit(0)).cast("decimal(28,2)").alias("parent_obligated"), reasons.alias("reasons")).filter(F.size("reasons") > 0)


def footprint(genuine: DataFrame, recipients: DataFrame) -> DataFrame:
    """Parents, those that receive awards themselves, and children."""
    parents = genuine.select(F.col("puei").alias("uei")).distinct()
    own = parents.join(recipients, "uei", "left_semi")
    count = lambda df, n: df.agg(F.count(F.lit(1)).alias(n))
    return count(parents, "parents").crossJoin(count(own, "transacting")).crossJoin(count(genuine.select("uei").distinct(), "children"))


def profile(genuine: DataFrame) -> DataFrame:
    """Children per family whose name shares no token with the parent's, and the pooled totals."""
    apart = ~F.arrays_overlap(core(F.col("name"), 1), core(F.col("pname"), 1))
    f = genuine.groupBy(F.col("puei").alias("fam")).agg(F.count(F.lit(1)).alias("children"), F.count_if(apart).alias("invisible"))
    total = f.agg(F.sum("children").alias("total_children"), F.sum("invisible").alias("total_invisible"))
    return f.crossJoin(F.broadcast(total))


def chain(df: DataFrame, located: Column, has_parent: Column, agrees: Column) -> DataFrame:
    """Counts of a chain of conditions, each counted among those that met the ones before."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(located).alias("located"), F.count_if(located & has_parent).alias("has_parent"), F.count_if(located & has_parent & agrees).alias("agrees"))


from kintrace.functions.text import SOVEREIGN as _SOVEREIGN  # noqa: E402
