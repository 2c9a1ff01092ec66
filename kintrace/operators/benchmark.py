"""A labelled pair set: components, leak-free splits, positives and graded negatives."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kintrace.functions.text import block_key, core, norm, visibility
from kintrace.operators.graph import connected_components
from kintrace.operators.order import placed
from kintrace.sources.shared import cut

SEED = "20260827"
SHARES = (("train", 0.6), ("val", 0.2), ("test", 0.2))
#: Splits of components of one size in a string of the fold.
CHUNK = 65536
#: Partners drawn for each child: of all parents, and of those that share a token or block key.
RANDOM_DRAWS, DRAWS = 4, 60
APART = "puei <> own and puei <> uei"


def family_components(genuine: DataFrame) -> DataFrame:
    """(fam, component): families that share an entity or a normalised name; the least family names the component."""
    node = lambda kind, c: F.concat(F.lit(kind), c)
    nodes = F.array(node("E", F.col("puei")), node("E", F.col("uei")), node("N", norm(F.col("name"))), node("N", norm(F.col("pname"))))
    edges = genuine.select(node("F", F.col("puei")).alias("f"), F.explode(nodes).alias("node"))
    parts = connected_components(edges, "f", "node").filter(F.col("node").startswith("F"))
    fams = parts.select(F.substring("node", 2, 30).cast("long").alias("fam"), F.col("component").alias("label"))
    least = fams.groupBy("label").agg(F.min("fam").alias("component"))
    return fams.join(least, "label").select("fam", "component")


def split_components(sizes: DataFrame) -> DataFrame:
    """(component, split): largest first, each to the split that lacks most in proportion to its target.

    Ties go to train, then val, then test, and components of one size follow in
    order of id. What a component gets depends on the sizes before it alone, so
    one task steps through counts per size and puts out the splits in strings of
    ``CHUNK``; components find theirs by their place within their size.
    """
    shares, chunk = [s for _, s in SHARES], CHUNK

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filled, full = [0.0] * len(shares), 0
        out: list[tuple[int, int, str]] = []
        for frame in frames:
            for size, many, total in zip(frame["size"].tolist(), frame["many"].tolist(), frame["total"].tolist()):
                wants = [s * float(total) for s in shares]
                for block in range(-(-many // chunk)):
                    picks = []
                    for _ in range(min(chunk, many - block * chunk)):
                        lacks = [(w - f) / w for w, f in zip(wants, filled)]
                        best = lacks.index(max(lacks))
                        filled[best] += size
                        picks.append(str(best))
                    out.append((size, block, "".join(picks)))
                    full += len(picks)
                    if full >= chunk:
                        yield pd.DataFrame(out, columns=["size", "block", "picks"])
                        out, full = [], 0
        yield pd.DataFrame(out, columns=["size", "block", "picks"])

    sizes = cut(sizes.select("component", "size"), "sizes")
    counts = sizes.groupBy("size").agg(F.count(F.lit(1)).alias("many"))
    total = sizes.agg(F.sum("size").alias("total"))
    ordered = counts.crossJoin(F.broadcast(total)).coalesce(1).sortWithinPartitions(F.desc("size"))
    picks = cut(ordered.mapInPandas(walk, "size long, block long, picks string"), "picks")
    at = placed(sizes, [F.col("component")], ["size"]).withColumn("at", F.col("pos") - 1)
    mine = at.withColumn("block", F.expr(f"at div {chunk}")).join(picks, ["size", "block"])
    pick = F.substring("picks", (F.col("at") % chunk + 1).cast("int"), F.lit(1)).cast("int")
    return mine.select("component", F.element_at(F.array(*[F.lit(n) for n, _ in SHARES]), pick + 1).alias("split"))


def positives(genuine: DataFrame) -> DataFrame:
    comps = family_components(genuine)
    sizes = genuine.join(comps, F.col("puei") == F.col("fam")).groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    splits = comps.join(split_components(sizes), "component")
    return genuine.join(splits, F.col("puei") == F.col("fam")).select("uei", "name", "puei", "pname", "vis", "obligated", "split")


def parents_of(pos: DataFrame) -> DataFrame:
    """(split, puei, pname): the parents of each split."""
    return pos.groupBy("split", "puei").agg(F.min("pname").alias("pname"))


def _draw(kind: str, child: Column, other: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(SEED), F.lit(kind), child.cast("string"), other.cast("string")).cast("binary"))


def _number(digest: Column, at: int) -> Column:
    """Eight hex digits of a digest as a number."""
    return F.conv(F.substring(digest, at, 8), 16, 10).cast("long")


def _take(pool: DataFrame, quotas: DataFrame, kind: str) -> DataFrame:
    """The pairs of least digest, as many as the quota of their split.

    Digests are spread evenly, so pairs are counted by the first four hex digits:
    the counts tell in which of them a split's last pair is, and only that one is ordered.
    """
    drawn = cut(pool.withColumn("h", _draw(kind, F.col("uei"), F.col("puei"))).withColumn("b", F.substring("h", 1, 4)), kind)
    upto = Window.partitionBy("split").orderBy("b")  # at most 65,536 counts a split
    counts = drawn.groupBy("split", "b").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", F.sum("n").over(upto))
    edge = counts.join(F.broadcast(quotas), "split").withColumn("rest", F.col("quota") - F.col("upto") + F.col("n"))
    edge = edge.groupBy("split").agg(F.max(F.when(F.col("rest") > 0, F.struct("b", "rest"))).alias("e")).select("split", F.col("e.b").alias("edge"), F.col("e.rest").alias("rest"))
    last = drawn.join(F.broadcast(edge), "split").filter("b = edge").withColumn("rn", F.row_number().over(Window.partitionBy("split").orderBy("h", "uei", "puei"))).filter("rn <= rest")
    rank = F.struct("h", "uei", "puei")
    bounds = cut(last.groupBy("split").agg(F.max(rank).alias("bound")), "bounds")  # a row a split
    return drawn.join(F.broadcast(bounds), "split").filter(rank <= F.col("bound")).select("split", "uei", "puei")


def _partners(child: DataFrame, parents: DataFrame, keys: Callable[[str], Column], kind: str) -> DataFrame:
    """(split, uei, puei): ``DRAWS`` times a child draws one of its keys that parents have, then one of that key's parents.

    Work grows with children and draws, whatever the number of parents of a key.
    """
    held = cut(placed(parents.select("split", "puei", F.explode(keys("pname")).alias("t")), [F.col("puei")], ["split", "t"]), "held")
    counts = held.groupBy("split", "t").agg(F.count(F.lit(1)).alias("n"))
    mine = child.select("split", "uei", "own", F.explode(keys("name")).alias("t")).join(counts, ["split", "t"])
    mine = mine.groupBy("split", "uei", "own").agg(F.array_sort(F.collect_list(F.struct("t", "n"))).alias("ts"))
    drawn = mine.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1)))).withColumn("d", _draw(kind, F.col("uei"), F.col("i")))
    drawn = drawn.withColumn("x", F.element_at("ts", (_number(F.col("d"), 1) % F.size("ts") + 1).cast("int")))
    drawn = drawn.select("split", "uei", "own", F.col("x.t").alias("t"), (_number(F.col("d"), 9) % F.col("x.n") + 1).alias("pos")).distinct()
    return drawn.join(held, ["split", "t", "pos"]).filter(APART).select("split", "uei", "puei").distinct()


def negatives(pos: DataFrame) -> DataFrame:
    """(split, uei, puei, kind): per split and kind as many as positives if draws suffice, drawn by seeded digests.

    Never a positive, never of the same family; a pair counts for the first kind
    that takes it. Partners are drawn per child, so neither a cross product nor all
    pairs of a token are made; splits with fewer than four children or parents get none.
    """
    side = cut(parents_of(pos), "parents")
    parents = placed(side, [F.col("puei")], ["split"])
    quotas = pos.groupBy("split").agg(F.count(F.lit(1)).alias("quota"), F.count_distinct("puei").alias("np")).filter("quota >= 4 and np >= 4").select("split", "quota")
    child = pos.join(F.broadcast(quotas.select("split")), "split").select("split", "uei", "name", F.col("puei").alias("own"))
    n = side.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    drawn = child.join(F.broadcast(n), "split").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(RANDOM_DRAWS - 1))))
    drawn = drawn.withColumn("pos", _number(_draw("random", F.col("uei"), F.col("i")), 1) % F.col("n") + 1)
    pool = drawn.join(parents.select("split", "pos", "puei"), ["split", "pos"]).filter(APART).select("split", "uei", "puei").distinct()
    first = _take(pool, quotas, "random")
    pool = _partners(child, side, lambda c: core(F.col(c)), "hard_string").join(first, ["split", "uei", "puei"], "left_anti")
    second = _take(pool, quotas, "hard_string")
    pool = _partners(child, side, lambda c: F.array(block_key(F.col(c))), "same_block").join(first.union(second), ["split", "uei", "puei"], "left_anti")
    third = _take(pool, quotas, "same_block")
    return first.withColumn("kind", F.lit("random")).union(second.withColumn("kind", F.lit("hard_string"))).union(third.withColumn("kind", F.lit("same_block")))


def pairs(pos: DataFrame) -> DataFrame:
    """Positives and negatives in one table."""
    none = F.lit(None)
    good = pos.select(F.col("uei").alias("left_uei"), F.col("name").alias("left_name"), F.col("puei").alias("right_uei"), F.col("pname").alias("right_name"), F.lit(1).alias("label"), none.cast("string").alias("kind"), "vis", F.col("puei").alias("family"), "split", "obligated")
    left = pos.select("uei", "name", "obligated")
    right = parents_of(pos)
    bad = negatives(pos).join(left, "uei").join(right, ["split", "puei"])
    bad = bad.select(F.col("uei").alias("left_uei"), F.col("name").alias("left_name"), F.col("puei").alias("right_uei"), F.col("pname").alias("right_name"), F.lit(0).alias("label"), "kind", visibility(F.col("name"), F.col("pname")).alias("vis"), none.cast("long").alias("family"), "split", "obligated")
    return good.unionByName(bad)


def exclusions(genuine: DataFrame, manual: DataFrame, sovereign: DataFrame, bypass: bool = False) -> DataFrame:
    """Each link with the reason it is dropped for, by a listed or else a sovereign parent; null keeps it."""
    a = manual.select(F.col("puei"), F.lit(True).alias("manual")).distinct()
    b = sovereign.select(F.col("puei"), F.lit(True).alias("sovereign")).distinct()
    reason = F.when(F.col("manual"), "manual").when(F.col("sovereign"), "sovereign")
    return genuine.join(a, "puei", "left").join(b, "puei", "left").withColumn("reason", F.lit(None).cast("string") if bypass else reason)


def check_pairs(pairs: DataFrame) -> DataFrame:
    """Violations that must all be 0: entities in two splits among positives, names in two, repeated pairs."""
    pos = pairs.filter("label = 1")
    ends = pos.select("split", F.col("left_uei").alias("e"), norm(F.col("left_name")).alias("n")).union(pos.select("split", "right_uei", norm(F.col("right_name"))))
    many = lambda c: ends.groupBy(c).agg(F.count_distinct("split").alias("s")).filter("s > 1").agg(F.count(F.lit(1)).alias("violations"))
    twice = pairs.groupBy("left_uei", "right_uei").count().filter("count > 1").agg(F.count(F.lit(1)).alias("violations"))
    out = many("e").withColumn("check", F.lit("entity_in_two_splits")).unionByName(many("n").withColumn("check", F.lit("name_in_two_splits")))
    return out.unionByName(twice.withColumn("check", F.lit("repeated_pair"))).select("check", "violations")


def conservative(pairs: DataFrame, dates: DataFrame, cutoff: str) -> DataFrame:
    """Positives first seen on or after the cutoff, or undated, and negatives whose ends both survive."""
    pos = pairs.filter("label = 1").join(dates, ["left_uei", "right_uei"], "left").filter(F.col("first_day").isNull() | (F.col("first_day") >= F.lit(cutoff).cast("date"))).drop("first_day")
    alive = pos.select(F.col("left_uei").alias("e")).union(pos.select("right_uei")).distinct()
    neg = pairs.filter("label = 0").join(alive, F.col("left_uei") == F.col("e"), "left_semi").join(alive, F.col("right_uei") == F.col("e"), "left_semi")
    return pos.unionByName(neg.select(*pos.columns))
