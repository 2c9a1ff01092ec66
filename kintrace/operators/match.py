"""Scores and features of name pairs, and a logistic model over them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kintrace.functions.text import char_ngrams, core, digits, exact_score, jaccard, norm, norm_address, zip5
from kintrace.functions.udfs import seqratio
from kintrace.sources.shared import cut

NAME_FEATURES = ["tfidf", "jaccard", "exact_name"]
ATTRIBUTE_FEATURES = ["both_have_addr", "same_address", "same_city", "same_state", "same_zip5", "same_phone", "dba_hit"]


def fit_idf(names: DataFrame, name: str = "name") -> DataFrame:
    """(g, idf) over occurrences of names: ln(n / (1 + df)) + 1."""
    n = names.count()
    grams = names.select(F.explode(F.array_distinct(char_ngrams(F.col(name)))).alias("g"))
    return grams.groupBy("g").agg((F.log(F.lit(float(max(n, 1))) / (1 + F.count(F.lit(1)))) + 1.0).alias("idf"))


def tfidf(pairs: DataFrame, idf: DataFrame, left: str = "left_name", right: str = "right_name") -> DataFrame:
    """(a, b, tfidf) for distinct name pairs: cosine of gram weights, unseen grams weigh 1.

    Weights are made once per distinct name and joined by gram; the idf table is
    joined, not collected, and Spark broadcasts it only while it is small.
    """
    both = pairs.select(F.col(left).alias("a"), F.col(right).alias("b")).distinct()
    names = both.select(F.col("a").alias("name")).union(both.select("b")).distinct()
    grams = names.select("name", F.explode(char_ngrams(F.col("name"))).alias("g")).groupBy("name", "g").agg(F.count(F.lit(1)).alias("tf"))
    w = grams.join(idf, "g", "left").select("name", "g", (F.col("tf") * F.coalesce("idf", F.lit(1.0))).alias("w"))
    size = w.groupBy("name").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    x, y = w.select(F.col("name").alias("a"), "g", F.col("w").alias("wa")), w.select(F.col("name").alias("b"), "g", F.col("w").alias("wb"))
    dots = both.join(x, "a").join(y, ["b", "g"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    out = both.join(dots, ["a", "b"], "left").join(size.select(F.col("name").alias("a"), F.col("size").alias("sa")), "a", "left").join(size.select(F.col("name").alias("b"), F.col("size").alias("sb")), "b", "left")
    return out.select("a", "b", F.round(F.coalesce(F.try_divide("dot", F.col("sa") * F.col("sb")), F.lit(0.0)), 9).alias("tfidf"))


#: Names of a block, and grams multiplied at once: a task holds two blocks of so many columns.
BLOCK, COLUMNS = 2_048, 2_048


def _compared(least: float, columns: int):
    """What a task does; it names nothing of this package, which executors need not have."""

    def spanning(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Edges to the least member of its component for the other nodes of the graph (a, b) over n nodes."""
        low = np.arange(n)
        while True:
            new = low.copy()
            np.minimum.at(new, a, low[b])
            np.minimum.at(new, b, low[a])
            new = new[new]
            if (new == low).all():
                break
            low = new
        up = np.flatnonzero(low != np.arange(n))
        return up, low[up]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """A forest over the names of two blocks whose cosine, to nine decimals, is ``least`` or more."""
        if not left.num_rows or not right.num_rows:
            none = left.column("id")[:0]
            return pa.table({"a": none, "b": none})
        sides = []
        for t in (left, right):
            grams, weights = t.column("gs").combine_chunks(), t.column("ws").combine_chunks()
            rows = np.repeat(np.arange(t.num_rows), np.diff(grams.offsets.to_numpy()))
            sides.append((rows, grams.flatten(), weights.flatten().to_numpy()))
        codes = pa.chunked_array([s[1] for s in sides]).combine_chunks().dictionary_encode()
        places = codes.indices.to_numpy()
        cut_ = len(sides[0][0])
        one, two = (sides[0][0], places[:cut_], sides[0][2]), (sides[1][0], places[cut_:], sides[1][2])
        sims = np.zeros((left.num_rows, right.num_rows))
        for at in range(0, len(codes.dictionary), columns):
            dense = []
            for (rows, cols, w), n in ((one, left.num_rows), (two, right.num_rows)):
                mine = (cols >= at) & (cols < at + columns)
                x = np.zeros((n, columns))
                x[rows[mine], cols[mine] - at] = w[mine]
                dense.append(x)
            sims += dense[0] @ dense[1].T
        i, j = np.nonzero(np.round(sims, 9) >= least)
        ids = pa.chunked_array([*left.column("id").chunks, *right.column("id").chunks])
        nodes, at = np.unique(ids.to_numpy(), return_inverse=True)
        a, b = spanning(at[i], at[left.num_rows + j], len(nodes))
        return pa.table({"a": pa.array(nodes[a], ids.type), "b": pa.array(nodes[b], ids.type)})

    return run


def cosine_forest(entities: DataFrame, idf: DataFrame, least: float) -> DataFrame:
    """(a, b): edges that join the entities (uei, name) to the components that all pairs with a tf-idf cosine of ``least`` or more make.

    Every two distinct names are compared, block against block, in double
    precision; a task puts out a forest over its two blocks, so that what is
    written grows with names and blocks, not with pairs. Weights are those of ``tfidf``.
    """
    reps = entities.filter("name is not null").groupBy("name").agg(F.min("uei").alias("id"))
    grams = reps.select("name", F.explode(char_ngrams(F.col("name"))).alias("g")).groupBy("name", "g").agg(F.count(F.lit(1)).alias("tf"))
    w = grams.join(idf, "g", "left").select("name", "g", (F.col("tf") * F.coalesce("idf", F.lit(1.0))).alias("w"))
    rows = w.groupBy("name").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"), F.collect_list(F.struct("g", "w")).alias("x")).filter("size > 0")
    rows = rows.join(reps, "name").select("name", "id", F.col("x.g").alias("gs"), F.transform("x.w", lambda v: v / F.col("size")).alias("ws"))
    rows = cut(rows, "weights")
    kind, n = entities.schema["uei"].dataType.simpleString(), max(1, -(-rows.count() // BLOCK))
    mine = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    body = rows.select("id", "gs", "ws", mine.alias("k"))
    # a block is on the left against itself and those after it
    left = body.select("id", "gs", "ws", F.col("k").alias("i"), F.explode(F.sequence("k", F.lit(n - 1))).alias("j"))
    right = body.select("id", "gs", "ws", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("i"), F.col("k").alias("j"))
    forest = cut(left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(_compared(least, COLUMNS), f"a {kind}, b {kind}"), "forest")
    same = entities.join(rows.select("name", "id"), "name").filter("uei <> id")
    return forest.union(same.select("uei", "id")).distinct()


def train_names(pairs: DataFrame) -> DataFrame:
    train = pairs.filter("split = 'train'")
    return train.select(F.col("left_name").alias("name")).union(train.select("right_name"))


def scored(pairs: DataFrame, with_ratio: bool = False) -> DataFrame:
    """Pairs with the columns exact, jaccard, tfidf and, if asked for, seqratio."""
    t = tfidf(pairs, fit_idf(train_names(pairs)))
    a, b = F.col("left_name"), F.col("right_name")
    out = pairs.withColumn("exact", exact_score(a, b)).withColumn("jaccard", F.round(jaccard(a, b), 9))
    out = out.join(t, (F.col("left_name") == t["a"]) & (F.col("right_name") == t["b"]), "left").drop("a", "b")
    return out.withColumn("seqratio", seqratio(norm(a), norm(b))) if with_ratio else out


def long_scores(scores: DataFrame, scorers: list[str]) -> DataFrame:
    """A row per pair and scorer."""
    kept = ["split", "label", "kind", "vis", "obligated"]
    return scores.select(*kept, *[F.round(s, 9).alias(s) for s in scorers]).unpivot(kept, scorers, "scorer", "score")


def attribute_features(pairs: DataFrame, attrs: DataFrame, with_similarity: bool = False) -> DataFrame:
    """Pairs with 0/1 features of the attributes of both ends; a missing attribute never agrees."""
    fields = ["address", "city", "state", "zip", "phone", "dba"]
    side = lambda s: attrs.select(F.col("uei").alias(f"{s}_uei"), *[F.col(f).cast("string").alias(f"{s}_{f}") for f in fields])
    p = pairs.join(side("left"), "left_uei", "left").join(side("right"), "right_uei", "left")
    aa, ab = norm_address(F.col("left_address")), norm_address(F.col("right_address"))
    both = (aa != "") & (ab != "")
    za, zb, pa, pb = zip5(F.col("left_zip")), zip5(F.col("right_zip")), digits(F.col("left_phone")), digits(F.col("right_phone"))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    hit = F.coalesce(F.arrays_overlap(core(F.col("left_dba")), core(F.col("right_name"))), F.lit(False)) | F.coalesce(F.arrays_overlap(core(F.col("right_dba")), core(F.col("left_name"))), F.lit(False))
    out = p.select(
        *pairs.columns, flag(both).alias("both_have_addr"), flag(both & (aa == ab)).alias("same_address"),
        flag((F.col("left_city") != "") & (norm(F.col("left_city")) == norm(F.coalesce("right_city", F.lit(""))))).alias("same_city"),
        flag((F.col("left_state") != "") & (F.col("left_state") == F.col("right_state"))).alias("same_state"),
        flag((za != "") & (za == zb)).alias("same_zip5"), flag((F.length(pa) >= 10) & (pa == pb)).alias("same_phone"), hit.cast("double").alias("dba_hit"),
        aa.alias("_aa"), ab.alias("_ab"),
    )
    if with_similarity:
        out = out.withColumn("addr_sim", F.when(F.col("both_have_addr") == 1, seqratio(F.col("_aa"), F.col("_ab"))).otherwise(0.0))
    return out.drop("_aa", "_ab")


def logistic(features: DataFrame, columns: list[str]) -> DataFrame:
    """Probabilities of a model fitted on the train split, classes weighted to balance, L2 as strong as C = 1 over summed loss."""
    train = features.filter("split = 'train'")
    counts = {r[0]: r[1] for r in train.groupBy("label").count().collect()}  # two rows
    n = sum(counts.values())
    weight = F.when(F.col("label") == 1, n / (2 * max(1, counts.get(1, 0)))).otherwise(n / (2 * max(1, counts.get(0, 0))))
    joined = VectorAssembler(inputCols=columns, outputCol="x").transform(features).withColumn("y", F.col("label").cast("double")).withColumn("w", weight)
    model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", maxIter=2000, regParam=1.0 / max(1, n), elasticNetParam=0.0, standardization=False).fit(joined.filter("split = 'train'"))
    return model.transform(joined).withColumn("probability", vector_to_array("probability")[1]).drop("x", "y", "w", "rawPrediction", "prediction")


def same(pairs: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """Pairs with ``same_<column>``: 1 where both sides have the same known value, else 0."""
    side = lambda s: values.select(F.col("uei").alias(f"{s}_uei"), F.col(column).alias(f"_{s}"))
    both = pairs.join(side("left"), "left_uei").join(side("right"), "right_uei")
    return both.withColumn(f"same_{column}", F.coalesce((F.col("_left") == F.col("_right")).cast("double"), F.lit(0.0))).drop("_left", "_right")
