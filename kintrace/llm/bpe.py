"""1. BPE encoding and decoding.

An encoding is the only segmentation into tokens whose neighbours are all
compatible. So each prefix of a word has one possible last token: the token
that ends there, is compatible with the last token of the prefix before it, and
is reachable. An automaton over the vocabulary lists the tokens that end at
each position; a pair test decides on compatibility; back-pointers from the end
of the word give the ids.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, ship, text_or_empty

#: Words and pair tests kept per Python worker; beyond it the memory starts anew.
MEMO_WORDS = 150_000
MEMO_PAIRS = 200_000
#: Marks the last symbol of a word in the automaton's alphabet.
LAST = 256
#: Of these no character composes with another, each lower-cases to one of them, and blanks are what ``str.split`` takes for blanks.
PLAIN = re.compile("[\u0000-\u001b\u0020-\u022f]*\\Z")


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: symbol -> byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def plain_word_pattern() -> re.Pattern:
    """The tokenizer's word pattern over the characters below U+0300 (upper-case ones below U+0230 have lower-case ones up to there), for ``re``."""
    chars = [chr(i) for i in range(0x300)]
    kind = {c: unicodedata.category(c)[0] for c in chars}
    blank = "".join(re.escape(c) for c in chars if c.isspace() and not 0x1C <= ord(c) <= 0x1F)
    letters = "".join(c for c in chars if kind[c] == "L")
    numbers = "".join(c for c in chars if kind[c] == "N")
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{blank}{letters}{numbers}]+")


class PairTests:
    """Compatibility of neighbouring tokens under the merge ranks."""

    def __init__(self, parts: dict[int, tuple[int, int]], rank: dict[tuple[int, int], tuple[int, int]]):
        self.parts, self.rank, self.memo = parts, rank, {}
        self.symbols_of: dict[int, tuple[int, ...]] = {}

    def symbols(self, token: int) -> tuple[int, ...]:
        known = self.symbols_of.get(token)
        if known is None:
            left_right = self.parts.get(token)
            known = (token,) if left_right is None else self.symbols(left_right[0]) + self.symbols(left_right[1])
            self.symbols_of[token] = known
        return known

    def merge(self, symbols: Iterable[int]) -> list[int]:
        """Greedy merging by rank, by definition: lowest rank first, left to right."""
        now = list(symbols)
        while len(now) > 1:
            found = [self.rank[p] for p in zip(now, now[1:], strict=False) if p in self.rank]
            if not found:
                break
            best = min(found)
            left, right = self.parts[best[1]]
            out, i = [], 0
            while i < len(now):
                if i + 1 < len(now) and now[i] == left and now[i + 1] == right:
                    out.append(best[1])
                    i += 2
                else:
                    out.append(now[i])
                    i += 1
            now = out
        return now

    def __call__(self, left: int, right: int) -> bool:
        key = (left, right)
        known = self.memo.get(key)
        if known is None:
            if len(self.memo) >= MEMO_PAIRS:
                self.memo.clear()
            known = key not in self.rank and self.merge(self.symbols(left) + self.symbols(right)) == [left, right]
            self.memo[key] = known
        return known


class Pieces(dict):
    """What stands between two blanks -> packed ids of its words, remembered."""

    def __init__(self, words: Encoder):
        self.of = words

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MEMO_WORDS:
            self.clear()
        made = self[piece] = b"".join(map(self.of.__getitem__, self.of.pattern.findall(piece.lower())))
        return made


class Encoder:
    """Exact ids of whole texts for a byte-level BPE file with word ends."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.library = Tokenizer.from_file(path)
        self.names = {i: t for t, i in vocab.items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.stand_in = {b: s for s, b in byte_symbols().items()}
        to_byte = byte_symbols()

        def spelt(token: str) -> str:
            ends = bool(end) and token.endswith(end) and len(token) > len(end)
            body = token[: -len(end)] if ends else token
            codes = [to_byte[c] for c in body]
            if ends:
                codes[-1] += LAST
            return "".join(map(chr, codes))

        parts: dict[int, tuple[int, int]] = {}
        rank: dict[tuple[int, int], tuple[int, int]] = {}
        for n, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            made = vocab[left + right]
            parts.setdefault(made, (vocab[left], vocab[right]))
            rank[vocab[left], vocab[right]] = (n, made)
        self.fits = PairTests(parts, rank)
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            if self.fits.merge(self.fits.symbols(i)) == [i]:  # else no text gives this token
                word = spelt(token)
                self.automaton.add_word(word, (i, len(word)))
        self.automaton.make_automaton()
        self.pattern = plain_word_pattern()
        self.memo: dict[str, bytes] = {}
        self.pieces = Pieces(self)

    def word(self, word: str) -> list[int]:
        """Ids of one word, by the table of last tokens of its prefixes; matches come by end, the longest first."""
        codes = list(word.encode("utf-8"))
        codes[-1] += LAST
        size, fits = len(codes), self.fits
        token_at, start_at = [-1] * size, [0] * size
        for at, (token, length) in self.automaton.iter("".join(map(chr, codes))):
            if token_at[at] < 0:
                before = at - length
                if before < 0 or (token_at[before] >= 0 and fits(token_at[before], token)):
                    token_at[at], start_at[at] = token, before
        ids, at = [], size - 1
        while at >= 0:
            ids.append(token_at[at])
            at = start_at[at]
        return ids[::-1]

    def __getitem__(self, word: str) -> bytes:
        packed = self.memo.get(word)
        if packed is None:
            if len(self.memo) >= MEMO_WORDS:
                self.memo.clear()
            packed = self.memo[word] = np.array(self.word(word), "<u4").tobytes()
        return packed

    def words(self, text: str) -> list[str]:
        """Normalised words, as the tokenizer file splits them."""
        if PLAIN.match(text):
            return self.pattern.findall(text.lower())
        normal = self.library.normalizer.normalize_str(text)
        to_byte = byte_symbols()
        return [bytes(to_byte[c] for c in piece).decode("utf-8") for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.cut is None or not self.cut.search(text):
            return self._plain(text)
        return b"".join(np.array([self.special[piece]], "<u4").tobytes() if piece in self.special else self._plain(piece) for piece in self.cut.split(text) if piece)

    def _plain(self, text: str) -> bytes:
        """No word crosses a blank, so what stands between blanks is remembered as one."""
        if PLAIN.match(text):
            return b"".join(map(self.pieces.__getitem__, text.split()))
        return b"".join(map(self.__getitem__, self.words(text)))

    def decode(self, packed: bytes) -> str:
        """The file has no decoder: token strings joined by a space."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(packed, "<u4").tolist()))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a tokenizer file, built once in each Python process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def bpe_roundtrip(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "token_ids", decoded_col: str | None = "decoded", keep: list[str] | None = None) -> DataFrame:
    """Encode every whole text and decode the ids again.

    Adds ``ids_col`` (ids packed as little-endian unsigned 32-bit integers) and,
    unless ``decoded_col`` is None, the text decoded from those ids. A null text
    counts as empty and gives no ids and an empty decoded text. ``keep`` names
    the columns to carry (all by default); a clash with them gets underscores.
    ``path`` must exist on every executor. Rows, ties and repeats stay as they are.
    """
    ship(df.sparkSession)
    keep = df.columns if keep is None else keep
    kept = df.select(*[F.col(f"`{c}`") for c in keep])
    ids_col = free_name(kept, ids_col)
    body = free_name(kept, "_body")
    src = df.select(*[F.col(f"`{c}`") for c in keep], text_or_empty(f"`{text_col}`").alias(body))
    schema = kept.withColumn(ids_col, F.lit(b"")).schema
    if decoded_col is not None:
        decoded_col = free_name(kept, decoded_col)
        schema = kept.withColumn(ids_col, F.lit(b"")).withColumn(decoded_col, F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            at = batch.num_columns - 1
            ids = [enc.encode(t) for t in batch.column(at).to_pylist()]
            cols = [batch.column(i) for i in range(at)] + [pa.array(ids, pa.binary())]
            names = [*keep, ids_col]
            if decoded_col is not None:
                cols.append(pa.array(map(enc.decode, ids), pa.string()))
                names.append(decoded_col)
            yield pa.RecordBatch.from_arrays(cols, names)

    return src.mapInArrow(run, schema)


def with_id_array(df: DataFrame, ids_col: str = "token_ids", array_col: str = "ids") -> DataFrame:
    """Add packed ids as an array of longs."""
    ship(df.sparkSession)
    array_col = free_name(df, array_col)
    at = df.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(x.as_py(), "<u4").astype("i8") for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int64()))], [*batch.schema.names, array_col])

    return df.mapInArrow(run, df.withColumn(array_col, F.array().cast("array<bigint>")).schema)
