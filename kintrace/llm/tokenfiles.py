"""5. Token-ID files: flat unsigned integers with 64-bit document offsets.

A data set is a folder of parts in ascending order of (id, text digest). A part
has ``NAME.bin``, the ids of its documents one after another, and ``NAME.idx``:
8 bytes magic, then as little-endian 64-bit integers the item size, the number
of documents, their ids, and one more offset than documents, counted in ids
from the part's first. Where a part starts in the whole comes from a prefix sum
over the parts' totals, kept in ``manifest.json``.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import PLAIN, Encoder, encoder
from .common import ship, text_or_empty

MAGIC = b"KTOKENS1"
#: Strings between blanks kept per Python worker; beyond it the memory starts anew.
MEMO_WORDS = 400_000
#: Ids written at once.
FLUSH_DOCS = 2_000


class LibraryWords(dict):
    """What stands between two blanks -> packed ids from the tokenizers library's model, asked once for each."""

    def __init__(self, shared: Encoder, dtype: str):
        self.shared, self.library, self.kind = shared, shared.library, {"<u2": "H", "<u4": "I"}[dtype]
        self.model = shared.library.model

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MEMO_WORDS:
            self.clear()
        stand_in, ids = self.shared.stand_in, array(self.kind)
        for word in self.shared.pattern.findall(piece.lower()):
            symbols = word if word.isascii() and word.isprintable() else "".join(map(stand_in.__getitem__, word.encode("utf-8")))
            ids.extend([t.id for t in self.model.tokenize(symbols)])
        made = self[piece] = ids.tobytes()
        return made

    def encode(self, text: str) -> bytes:
        """A text in which blanks may not part words as in the tokenizer's rules goes to the library whole."""
        cut = self.shared.cut
        if PLAIN.match(text) and not (cut and cut.search(text)):
            return b"".join(map(self.__getitem__, text.split()))
        return array(self.kind, self.library.encode(text, add_special_tokens=False).ids).tobytes()


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    at = urlparse(uri)
    if at.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(at.path)
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def write_tokens(df: DataFrame, folder: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2) -> list[dict]:
    """Encode whole texts and write them under ``folder``; returns the manifest's parts.

    A null text counts as empty: it has only the end id. Null ids come first and
    are stored as the least 64-bit integer. Equal ids are ordered by their
    text's digest. The folder must be one that all executors reach. A task
    writes under a name of its own attempt, so a repeated one does no harm; the
    manifest, one line a part, names those that count. A vocabulary of up to
    65,536 ids is written in 16 bits, a larger one in 32.
    """
    spark = df.sparkSession
    ship(spark)
    wide = max(encoder(path).names) > 65_535
    dtype = "<u4" if wide else "<u2"
    least = -(2**63)
    src = df.select(F.coalesce(F.col(id_col), F.lit(least)).cast("long").alias("id"), F.xxhash64(text_or_empty(text_col)).alias("tie"), text_or_empty(text_col).alias("text"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = src.repartitionByRange(n, "id", "tie").sortWithinPartitions("id", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        store, top = _open(folder)
        store.create_dir(top, recursive=True)
        words = LibraryWords(encoder(path), dtype)
        end = b"" if end_id is None else np.array([end_id], dtype).tobytes()
        ids, lengths = [], []
        with store.open_output_stream(f"{top}/{name}.bin") as out:
            for batch in batches:
                for k in range(0, batch.num_rows, FLUSH_DOCS):
                    piece = batch.slice(k, FLUSH_DOCS)
                    packed = [words.encode(t) + end for t in piece.column(2).to_pylist()]
                    out.write(b"".join(packed))
                    ids.append(piece.column(0).to_numpy())
                    lengths.append(np.fromiter(map(len, packed), "<i8", len(packed)))
        docs = np.concatenate(ids) if ids else np.empty(0, "<i8")
        item = np.dtype(dtype).itemsize
        ends = np.cumsum(np.concatenate(lengths)) // item if lengths else np.empty(0, "<i8")
        with store.open_output_stream(f"{top}/{name}.idx") as out:
            out.write(MAGIC + np.array([item, len(docs)], "<i8").tobytes() + docs.astype("<i8").tobytes() + np.concatenate([[0], ends]).astype("<i8").tobytes())
        yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "name": [name], "docs": [len(docs)], "tokens": [int(ends[-1]) if len(ends) else 0]}, schema=pa.schema([("part", pa.int32()), ("name", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]))

    found = ordered.mapInArrow(run, "part int, name string, docs long, tokens long").collect()  # a row per part
    parts, base = [], 0
    for r in sorted(found, key=lambda r: r.part):
        if r.docs:
            parts.append({"name": r.name, "docs": r.docs, "tokens": r.tokens, "start": base})
        base += r.tokens
    store, top = _open(folder)
    store.create_dir(top, recursive=True)
    with store.open_output_stream(f"{top}/manifest.json") as out:
        out.write(json.dumps({"format": MAGIC.decode(), "item": 4 if wide else 2, "parts": parts}).encode())
    return parts


class Part:
    """One part, memory-mapped where the folder is local, read otherwise."""

    def __init__(self, folder: str, name: str):
        store, top = _open(folder)

        def raw(kind: str) -> np.ndarray:
            full = f"{top}/{name}.{kind}"
            if isinstance(store, fs.LocalFileSystem):
                return np.memmap(full, "u1", "r") if os.path.getsize(full) else np.empty(0, "u1")
            with store.open_input_file(full) as f:
                return np.frombuffer(f.read(), "u1")

        index = raw("idx")
        if bytes(index[:8]) != MAGIC:
            raise ValueError(f"{name}.idx is not a token index")
        item, n = index[8:24].view("<i8")
        self.ids = index[24 : 24 + 8 * n].view("<i8")
        self.offsets = index[24 + 8 * n : 24 + 8 * (2 * n + 1)].view("<i8")
        self.tokens = raw("bin").view(f"<u{item}")

    def __len__(self) -> int:
        return len(self.ids)

    def __getitem__(self, k: int) -> np.ndarray:
        return self.tokens[self.offsets[k] : self.offsets[k + 1]]


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """A row per document of a data set: doc_id, start, n_tokens, ids_crc32, in file order within a part.

    ids_crc32 is taken over the ids as little-endian unsigned 32-bit integers.
    Null ids come back as null.
    """
    ship(spark)
    store, top = _open(folder)
    with store.open_input_stream(f"{top}/manifest.json") as f:
        parts = json.loads(f.read())["parts"]
    out = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not parts:
        return spark.createDataFrame([], out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = Part(folder, name)
                crc = [zlib.crc32(part[k].astype("<u4").tobytes()) for k in range(len(part))]
                ids = np.array(part.ids)
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=ids == -(2**63)), pa.array(base + part.offsets[:-1]), pa.array(np.diff(part.offsets)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.createDataFrame([(p["name"], p["start"]) for p in parts], "name string, start long")
    return files.repartition(len(parts)).mapInArrow(run, out)
