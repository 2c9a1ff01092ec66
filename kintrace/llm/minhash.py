"""7. Near-duplicates of whole documents by circulant MinHash.

One permutation scatters the shingles of a document over a ring; a second one,
shifted by k places of the ring, gives signature coordinate k as the least
value over the document's places. Bands of coordinates name the candidates;
only exact Jaccard values over whole shingle sets make links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kintrace.operators.graph import connected_components

from .common import cut, documents, free_name, ship, text_id
from .shingles import bodies, groups, mix64, text_shingles

#: A pair at the threshold 0.85 shares no band with probability 8e-6.
BANDS, ROWS = 20, 5
#: Shingles handled at once, so that they stay in the processor's cache.
CHUNK = 40_000
#: Members of a bucket compared at once in the last step.
MINOR_BLOCK, BLOCK = 128, 512


def _second(x: np.ndarray) -> np.ndarray:
    """The second permutation, of the ring of 32-bit integers; in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signatures(sets: list[np.ndarray], k: int) -> np.ndarray:
    """(len(sets), k) coordinates of non-empty sets of 64-bit hashes."""
    out = np.empty((len(sets), k), "u4")
    if not sets:
        return out
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    with np.errstate(over="ignore"):
        place = (mix64(np.concatenate(sets) ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype("u4")
        work = np.empty_like(place)
        for shift in range(k):
            np.add(place, np.uint32(shift), out=work)
            out[:, shift] = np.minimum.reduceat(_second(work), starts)
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        s = signature.reshape(len(signature), bands, rows).astype("u8")
        key = np.broadcast_to(np.arange(1, bands + 1, dtype="u8"), s.shape[:2]).copy()
        for r in range(rows):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + s[:, :, r])
    return key.view("i8")


def shingle_sets(texts: list[bytes | None], size: int) -> Iterator[np.ndarray]:
    """The distinct shingles of each text."""
    for first, end in groups(texts):
        yield from map(np.unique, text_shingles(texts[first:end], size))


def _describe(size: int, bands: int, rows: int):
    names = ["id", "tid", "n_shingles", "set_key", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[int] = []
            digests: list = []
            keys: list = [None] * batch.num_rows
            chunk: list[tuple[int, np.ndarray]] = []
            held = 0

            def flush(keys=keys, chunk=chunk) -> None:
                for (at, _), k in zip(chunk, band_keys(signatures([s for _, s in chunk], bands * rows), bands, rows), strict=True):
                    keys[at] = k
                chunk.clear()

            for i, s in enumerate(shingle_sets(bodies(batch.column(2)), size)):
                counts.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                if len(s):
                    chunk.append((i, s))
                    held += len(s)
                if held >= CHUNK:
                    flush()
                    held = 0
            flush()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names)

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [s.tobytes() for s in shingle_sets(bodies(batch.column(1)), size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["id", "items"])

    return run


def _similar(a: bytes, b: bytes, percent: int) -> bool:
    x, y = np.frombuffer(a, "u8"), np.frombuffer(b, "u8")
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (p, q) whose whole sets reach the threshold."""
    both = pairs.join(sets.select(F.col("id").alias("p"), F.col("items").alias("a")), "p").join(sets.select(F.col("id").alias("q"), F.col("items").alias("b")), "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            yield batch.filter(pa.array([_similar(x.as_py(), y.as_py(), percent) for x, y in zip(a, b, strict=True)], pa.bool_())).select([0, 1])

    return both.select("p", "q", "a", "b").mapInArrow(run, pairs.select("p", "q").schema)


def _block_links(percent: int):
    """Links between the minor members of a block and the other block, one spanning edge per minor and label."""

    def run(table: pa.Table) -> pa.Table:
        ids, labels = table.column("id"), table.column("label").to_pylist()
        minor = np.array(table.column("minor").to_pylist(), bool)
        sets = [np.frombuffer(x, "u8") for x in table.column("items").to_pylist()]
        sizes = np.array([len(s) for s in sets])
        _, codes = np.unique(np.concatenate(sets), return_inverse=True)
        rows = np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(codes, kind="stable")
        rows, codes = rows[order], codes[order]
        shared = np.zeros((len(sets), len(sets)), "i4")
        starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        for s, e in zip(starts, np.r_[starts[1:], len(codes)], strict=True):
            if e - s > 1:
                who = rows[s:e]
                shared[np.ix_(who, who)] += 1
        union = sizes[:, None] + sizes[None, :] - shared
        _, name = np.unique(np.array(labels, dtype=object), return_inverse=True)
        hit = (100 * shared >= percent * union) & minor[:, None] & (name[:, None] != name[None, :])
        x, y = np.nonzero(hit)
        _, first = np.unique(x * (name.max() + 1 if len(name) else 1) + name[y], return_index=True)
        return pa.table({"p": ids.take(pa.array(x[first])), "q": ids.take(pa.array(y[first]))})

    return run


def _told(src: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    kind = src.schema["id"].dataType.simpleString()
    return cut(src.mapInArrow(_describe(size, bands, rows), f"id {kind}, tid binary, n_shingles long, set_key binary, bands array<bigint>"), "told")


def _components(src: DataFrame, told: DataFrame, percent: int, size: int) -> DataFrame:
    """(set_key, component) of every set in ``told``; the component is named by the least key reachable.

    A set takes part once, however many rows have it.
    """
    classes = cut(told.filter("set_key is not null").groupBy(F.col("set_key").alias("rep")).agg(F.min(F.struct("tid", "id")).alias("one"), F.first("bands").alias("bands")), "classes")
    keys = classes.select("rep", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("pivot")).filter("n > 1")
    members = cut(keys.join(shared, "key").select("key", "rep", "pivot"), "members")
    needed = classes.join(members.select("rep").distinct(), "rep", "left_semi").select("rep", F.col("one.id").alias("_id"), F.col("one.tid").alias("_tid"))
    texts = src.join(needed, F.col("id").eqNullSafe(F.col("_id")) & (F.col("tid") == F.col("_tid"))).dropDuplicates(["id", "tid"])
    sets = cut(texts.select("rep", "text").mapInArrow(_sets(size), "id binary, items binary"), "sets")
    alone = lambda labels: _labelled(classes, labels)

    pairs = members.filter("rep <> pivot").select(F.col("pivot").alias("p"), F.col("rep").alias("q")).distinct()
    links = cut(_verify(pairs, sets, percent), "links")
    labels = connected_components(links, "p", "q")
    for turn in range(2):
        labelled = members.select("key", "rep").join(labels, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("component", "rep").alias("label"))
        mixed = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min_by(F.struct("rep", "label"), F.xxhash64("rep", "key", F.lit(turn))).alias("pivot"), F.count(F.lit(1)).alias("n")).filter("low <> high and n > 2")
        open_members = cut(labelled.join(mixed.select("key", "pivot"), "key"), "open")
        if open_members.isEmpty():
            return alone(labels)
        if turn == 0:
            pairs = open_members.filter("label <> pivot.label").select(F.least("rep", "pivot.rep").alias("p"), F.greatest("rep", "pivot.rep").alias("q")).distinct()
            links = cut(links.union(_verify(pairs, sets, percent)), "links")
            labels = connected_components(links, "p", "q")
    # what is left: members outside a bucket's largest component against all members
    by_label = open_members.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("size"))
    placed = open_members.join(by_label, "key").select("key", "rep", "label", (F.col("label") != F.col("main")).alias("minor"), "size")
    n_minor = placed.filter("minor").groupBy("key").agg(F.count(F.lit(1)).alias("minors"))
    placed = placed.join(n_minor, "key")
    draw = F.xxhash64("rep")
    left = placed.filter("minor").select("*", F.pmod(draw, F.ceil(F.col("minors") / MINOR_BLOCK)).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), (F.ceil(F.col("size") / BLOCK) - 1).cast("int"))).alias("j"))
    right = placed.select("*", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("minors") / MINOR_BLOCK) - 1).cast("int"))).alias("i"), F.pmod(draw, F.ceil(F.col("size") / BLOCK)).cast("int").alias("j")).withColumn("minor", F.lit(False))
    blocks = left.select("key", "i", "j", "rep", "label", "minor").union(right.select("key", "i", "j", "rep", "label", "minor"))
    blocks = blocks.groupBy("key", "i", "j", "rep", "label").agg(F.max("minor").alias("minor"))
    rows_ = blocks.join(sets, F.col("rep") == F.col("id")).select("key", "i", "j", "id", "label", "minor", "items")
    found = rows_.groupBy("key", "i", "j").applyInArrow(_block_links(percent), "p binary, q binary")
    links = cut(links.union(found), "links")
    return alone(connected_components(links, "p", "q"))


def _labelled(classes: DataFrame, labels: DataFrame) -> DataFrame:
    return classes.select(F.col("rep").alias("set_key")).join(labels, F.col("set_key") == F.col("node"), "left").select("set_key", F.coalesce("component", "set_key").alias("component"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, size: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Two documents are linked when 100 * shared shingles >= percent * all shingles;
    component_id is the least id reachable over links, the row's own included. A
    null text and one without words have an empty set and are linked with nothing;
    rows with a null id keep a null component and are kept. Equal sets form a class
    that takes part once, however many rows it has. An id under several texts is a
    document of its own for each. Extra columns are not carried. An empty table
    gives no rows.

    Within a bucket all members are first compared with one pivot, then, where
    more than one component is left, with pivots drawn anew for each bucket.
    What still differs is compared in full, block by block: no link is lost to
    the size of a bucket, and no bucket is held in one task.
    """
    ship(df.sparkSession)
    src = df.select(F.col(f"`{id_col}`").alias("id"), text_id(f"`{text_col}`").alias("tid"), F.col(f"`{text_col}`").cast("string").alias("text"))
    told = _told(src, size, bands, rows)
    named = told.filter("id is not null")
    labels = _components(src.filter("id is not null"), named, percent, size)
    of_set = named.groupBy("set_key").agg(F.min("id").alias("least")).join(labels, "set_key")
    least = of_set.groupBy("component").agg(F.min("least").alias("least"))
    reps = of_set.select("set_key", "component").join(least, "component").select("set_key", "least")
    out = told.select("id", "n_shingles", "set_key").join(reps, "set_key", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("least", "id"))
    return out.select("id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, size: int = 5, bands: int = BANDS, rows: int = ROWS, keep: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """The rows of ``df``, of each group of near-duplicates one; columns as before.

    The row with the least id stays, null ids last, and of equal ids the one with
    the least digest of its text; of rows equal in both, the least by a hash of
    all columns. So a repeated row stays once, and an id under two texts stays
    with each text that is not a near-duplicate. Rows without words stay as they
    are. An empty table gives an empty table.

    The result is read from ``df`` and one table without texts, which ``keep`` writes.
    """
    ship(df.sparkSession)
    src = df.select(F.col(f"`{id_col}`").alias("id"), text_id(f"`{text_col}`").alias("tid"), F.col(f"`{text_col}`").cast("string").alias("text"))
    told = _told(src, size, bands, rows)
    labels = _components(src, told, percent, size)
    each = told.filter("set_key is not null").groupBy("id", "tid", "set_key").agg(F.count(F.lit(1)).alias("n")).join(labels, "set_key")
    best = each.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tid")).alias("best"))
    marks = each.join(best, "component").select("id", "tid", "n", (F.col("id").eqNullSafe(F.col("best.id")) & (F.col("tid") == F.col("best.tid"))).alias("stays"))
    marks = keep(marks.filter("not stays or n > 1"))
    names = [free_name(df, c) for c in ("_id", "_tid")]
    tid = free_name(df, "_text")
    docs = df.withColumn(tid, text_id(f"`{text_col}`"))
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(names[0])) & (F.col(tid) == F.col(names[1]))
    pick = [F.col("id").alias(names[0]), F.col("tid").alias(names[1])]
    columns = [F.col(f"`{c}`") for c in df.columns]
    out = docs.join(marks.select(*pick), same, "left_anti").select(*columns)
    again = marks.filter("stays")
    if again.isEmpty():
        return out
    hashed = [F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString()]
    rows_ = docs.join(again.select(*pick), same, "left_semi")
    one = rows_.groupBy(F.col(f"`{id_col}`").alias(names[0]), F.col(tid).alias(names[1])).agg(F.min_by(F.struct(*columns), F.xxhash64(*hashed)).alias(tid))
    return out.unionByName(one.select(*[F.col(tid).getField(c).alias(c) for c in df.columns]))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` by the contract of the query: links at 85 of 100 shingles; nulls and ties as ``near_duplicates`` says."""
    return near_duplicates(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")
