"""10. Exact repeats of passages by enhanced suffix arrays.

Every 200-byte string holds an anchor: its least hashed 40-byte string. Equal
strings hold equal anchors, so the suffixes that matter start at anchors whose
string occurs more than once. For each such string the text right of its
occurrences is suffix-sorted; a stack scan over the common-prefix lengths
visits the tree of intervals, and within an interval the bytes to the left are
tested for diversity, which splits it into its maximal repeat groups with all
their occurrences.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, discard, documents, free_name, ship, shared_dir, text_id, text_or_empty
from .shingles import mix64

#: Bytes of a repeat, and of the string that anchors it.
LENGTH, GRAM = 200, 40
#: Occurrences of one anchor that are sorted together; more are counted string by string.
GROUP = 500
#: Bytes hashed at once.
CHUNK = 400_000

_base = np.uint64(0x9E3779B97F4A7C15 | 1)
_byte = mix64(np.arange(1, 257, dtype="u8") * np.uint64(0xD1342543DE82EF95))
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, int(n).bit_length())
        inverse = pow(int(_base), -1, 1 << 64)
        with np.errstate(over="ignore"):
            _powers[:] = [np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(size - 1, b, "u8"))]) for b in (_base, np.uint64(inverse))]
    return _powers[0], _powers[1]


def string_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` bytes."""
    n = len(data)
    if n < size:
        return np.empty(0, "u8")
    up, down = _power_tables(n + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum(_byte[data] * up[:n])])
        return mix64((total[size:] - total[:-size]) * down[: n - size + 1])


def _sliding(x: np.ndarray, size: int, least: bool) -> np.ndarray:
    """Least (or greatest) of each run of ``size``."""
    pick, step = np.minimum if least else np.maximum, 1
    while step * 2 <= size:
        x = pick(x[:-step], x[step:])
        step *= 2
    return pick(x[: len(x) - (size - step)], x[size - step :]) if size > step else x


def anchors(texts: list[bytes], length: int, gram: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(text number, positions, hashes) of the anchors of texts of ``length`` bytes or more."""
    window = length - gram + 1
    at = 0
    while at < len(texts):
        group, held = [], 0
        while at < len(texts) and (not group or held + len(texts[at]) <= CHUNK):
            if len(texts[at]) >= length:
                group.append(at)
                held += len(texts[at])
            at += 1
        if not group:
            continue
        sizes = np.array([len(texts[i]) for i in group])
        ends = np.cumsum(sizes)
        g = string_hashes(np.frombuffer(b"".join(texts[i] for i in group), "u1"), gram)
        low = _sliding(g, window, True)
        inside = np.ones(len(low), bool)
        for e in ends[:-1]:  # strings that cross from one text into the next
            inside[max(0, e - length + 1) : e] = False
        low = np.where(inside, low, np.uint64(0))
        pad = np.zeros(window - 1, "u8")
        chosen = np.flatnonzero((_sliding(np.concatenate([pad, low, pad]), window, False) == g) & (g > 0))
        text = np.searchsorted(ends, chosen, side="right")
        cuts = np.searchsorted(text, np.arange(len(group) + 1))
        for k, i in enumerate(group):
            mine = chosen[cuts[k] : cuts[k + 1]]
            yield i, mine - (ends[k] - sizes[k]), g[mine]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as compressed bytes, less than half as many for shuffles and tables."""
    shrink = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shrink(t.as_py().encode()) for t in batch.column(1)], pa.binary())], ["tid", "packed"])


def _find_anchors(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            ids = batch.column(0)
            who, where, what = [], [], []
            for i, positions, hashes in anchors([unpack(t.as_py()) for t in batch.column(1)], length, gram):
                who.append(np.full(len(positions), i))
                where.append(positions)
                what.append(hashes)
            if who:
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.concatenate(who))), pa.array(np.concatenate(where).astype("i8")), pa.array(np.concatenate(what).view("i8"))], ["tid", "pos", "gram"])

    return run


def _segments(length: int, gram: int):
    """For rare anchors what stands around them; for frequent ones the hashes of all strings that hold them."""
    names = ["gram", "tid", "pos", "left_size", "segment"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            held = 0
            for tid, packed, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                body = unpack(packed.as_py())
                rows = found.values
                pos, grams, hot = (rows.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                wide = np.zeros(max(0, len(body) - length + 1), bool)
                for p, g, h in zip(pos.tolist(), grams.tolist(), hot.tolist(), strict=True):
                    first = max(0, p - length + gram)
                    if h:
                        wide[first : p + 1] = True
                        continue
                    for col, v in zip(out, (g, tid, p, p - first, body[first : p + length]), strict=True):
                        col.append(v)
                    held += 1
                starts = np.flatnonzero(wide)
                if len(starts):
                    keys = string_hashes(np.frombuffer(body, "u1"), length)[starts].view("i8")
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([tid] * len(starts), pa.binary()), pa.array(starts), pa.nulls(len(starts), pa.int32()), pa.nulls(len(starts), pa.binary())], names)
                if held >= 4_000:
                    yield _batch(out, names)
                    out, held = [[], [], [], [], []], 0
            if held:
                yield _batch(out, names)

    return run


def _batch(cols: list[list], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(prefix length, first, last) of the nodes of the common-prefix tree; lcp[i] is shared by entries i - 1 and i."""
    stack: list[tuple[int, int]] = []
    for i in range(1, len(lcp) + 1):
        now, first = (lcp[i] if i < len(lcp) else -1), i - 1
        while stack and stack[-1][0] > now:
            depth, first = stack.pop()
            yield depth, first, i - 1
        if now >= 0 and (not stack or stack[-1][0] < now):
            stack.append((now, first))


def maximal_repeats(left: list[bytes], right: list[bytes], length: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """Repeat groups among occurrences of one anchor: (bytes right of its start, [(occurrence, bytes left of it)]).

    ``left`` is reversed text. Within an interval of the suffix array, occurrences
    whose left texts share enough to reach ``length`` form a group.
    """
    order = sorted(range(len(right)), key=right.__getitem__)
    lcp = [0] + [common_prefix(right[a], right[b]) for a, b in zip(order, order[1:], strict=False)]
    by_left = sorted(range(len(left)), key=left.__getitem__)
    place = [0] * len(left)
    for k, i in enumerate(by_left):
        place[i] = k
    for depth, first, last in intervals(lcp):
        need = length - depth
        node = sorted(order[first : last + 1], key=place.__getitem__)
        group: list[tuple[int, int]] = []
        shared = 0
        for k, i in enumerate(node):
            after = common_prefix(left[i], left[node[k + 1]]) if k + 1 < len(node) else -1
            before, shared = shared, after
            reach = max(after, before if k else -1)
            if reach >= need:
                group.append((i, reach))
            if after < need and group:
                yield depth, group
                group = []


def _repeats(length: int):
    names = ["tid", "first", "last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple] = []

        def close() -> None:
            if len(held) > 1:
                left = [seg[:n][::-1] for _, _, _, n, seg in held]
                right = [seg[n:] for _, _, _, n, seg in held]
                for depth, group in maximal_repeats(left, right, length):
                    for i, reach in group:
                        out.append((held[i][1], held[i][2] - reach, held[i][2] + depth))
            held.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != row[0]:
                    close()
                held.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names)
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names)

    return run


def _remove(length: int, as_text: bool):
    """From (tid, packed, n, spans) what is left of each text; a text that occurs n > 1 times is repeated as a whole."""
    names = ["tid", "n_bytes", "n_removed", "n_spans", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = []
            for packed, n, spans in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3), strict=True):
                body = unpack(packed.as_py())
                if n > 1 and len(body) >= length:
                    rows.append((len(body), len(body), 1, b""))
                    continue
                if not spans.is_valid:
                    rows.append((len(body), 0, 0, body))
                    continue
                first, last = (spans.values.field(k).to_numpy() for k in range(2))
                edge = np.zeros(len(body) + 1, "i8")
                np.add.at(edge, first, 1)
                np.add.at(edge, last, -1)
                gone = np.cumsum(edge[:-1]) > 0
                runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                rows.append((len(body), int(gone.sum()), runs, np.frombuffer(body, "u1")[~gone].tobytes()))
            if as_text:
                rows = [(*r[:3], r[3].decode("utf-8", "ignore")) for r in rows]
            cols = list(zip(*rows, strict=True)) or [[], [], [], []]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string() if as_text else pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return run


def repeated_passages(df: DataFrame, text_col: str = "text", length: int = LENGTH, gram: int = GRAM, as_text: bool = False) -> DataFrame:
    """One row per distinct text: tid, n_bytes, n_removed, n_spans, kept.

    A byte is removed when some ``length``-byte string that covers it starts
    anywhere else too, in the same text or another; all strings are judged on the
    input. Equal texts count as occurrences of each other, so from ``length``
    bytes on they go as a whole. ``kept`` holds bytes or, ``as_text``, their whole
    characters. ``tid`` is ``text_id`` of the text; a null text
    counts as empty. Texts shorter than ``length`` stay as they are.

    An anchor with more than ``GROUP`` occurrences (a line in a third of all
    documents) is not gathered: the hashes of the strings that hold it are
    counted, with partial counts before the shuffle, and give the same answer.
    """
    spark = df.sparkSession
    ship(spark)
    # each distinct text once, laid out by its id so that later joins leave it where it is
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"kintrace_texts_{uuid.uuid4().hex}"
    body = df.select(text_id(text_col).alias("tid"), text_or_empty(text_col).alias("text")).mapInArrow(_pack, "tid binary, packed binary").groupBy("tid").agg(F.first("packed").alias("packed"), F.count(F.lit(1)).alias("n"))
    body.write.format("parquet").bucketBy(n, "tid").sortBy("tid").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    texts = spark.table(name)
    found = cut(texts.select("tid", "packed").mapInArrow(_find_anchors(length, gram), "tid binary, pos long, gram long"), "anchors")
    again = found.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram", (F.col("n") > GROUP).alias("hot"))
    wanted = found.join(again, "gram").groupBy("tid").agg(F.collect_list(F.struct("pos", "gram", "hot")).alias("found"))
    segments = cut(texts.join(wanted, "tid").select("tid", "packed", "found").mapInArrow(_segments(length, gram), "gram long, tid binary, pos long, left_size int, segment binary"), "segments")
    discard(spark, found._cut_path)
    rare = segments.filter("segment is not null").repartition(n, "gram").sortWithinPartitions("gram").mapInArrow(_repeats(length), "tid binary, first long, last long")
    strings = segments.filter("segment is null").select("gram", "tid", "pos")
    twice = strings.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram")
    frequent = strings.join(twice, "gram").select("tid", F.col("pos").alias("first"), (F.col("pos") + length).alias("last"))
    spans = rare.union(frequent).groupBy("tid").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    return texts.join(spans, "tid", "left").select("tid", "packed", "n", "spans").mapInArrow(_remove(length, as_text), f"tid binary, n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}")


def without_repeats(df: DataFrame, text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """The rows of ``df`` with repeats cut out of their texts; rows of which nothing is left go.

    Bytes of a character that was cut in part are dropped too. Texts that were
    null or empty stay as they are. ``size_col``, if the table has it, becomes the
    new number of characters.
    """
    tid, kept, gone = (free_name(df, c) for c in ("_tid", "_kept", "_cut"))
    done = repeated_passages(df, text_col, as_text=True).filter("n_removed > 0").select(F.col("tid").alias(tid), F.col("kept").alias(kept), F.lit(True).alias(gone))
    out = df.withColumn(tid, text_id(f"`{text_col}`")).join(done, tid, "left").filter(F.col(gone).isNull() | (F.length(kept) > 0))
    text = F.when(F.col(gone), F.col(kept)).otherwise(F.col(f"`{text_col}`"))
    cols = []
    for c in df.columns:
        if c == text_col:
            cols.append(text.alias(c))
        elif c == size_col:
            cols.append(F.when(F.col(gone), F.length(text).cast("long")).otherwise(F.col(f"`{c}`")).alias(c))
        else:
            cols.append(F.col(f"`{c}`"))
    return out.select(*cols)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    done = repeated_passages(docs).select("tid", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    return docs.select("doc_id", text_id().alias("tid")).join(done, "tid").drop("tid")
