"""Hashes of words and of runs of words, for whole texts; many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash

M64 = np.uint64(0x9E3779B97F4A7C15)
#: Bytes hashed together: few enough that a chunk's arrays stay in the processor's cache.
CHUNK_BYTES = 1 << 18
#: Words of more bytes than this are hashed one by one (sums of powers are weak for long, regular strings).
LONG_WORD = 256
#: An odd number that 8 divides with the rest 3: its powers differ in their low bits.
BASE = 0x5851F42D4C957F2B


def mix64(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit integers."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, "u8")
    out[0] = 1
    return np.cumprod(out, dtype="u8")


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each byte a 64-bit number, the same for A-Z and a-z, and whether it is a blank."""
    number = mix64(np.arange(1, 257, dtype="u8") * M64)
    number[65:91] = number[97:123]
    blank = np.zeros(256, bool)
    blank[[32, *range(9, 14)]] = True
    return number, blank


NUMBER, BLANK = _tables()
POWERS, INVERSE = _powers(BASE, CHUNK_BYTES + 1), _powers(pow(BASE, -1, 1 << 64), CHUNK_BYTES + 1)


def _chunk(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, hash) of every word of at most ``CHUNK_BYTES`` bytes that begin and end between words."""
    blank = np.ones(len(data) + 2, bool)
    blank[1:-1] = BLANK[data]
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = edges[0::2], edges[1::2]
    size = ends - starts
    upto = np.zeros(len(data) + 1, "u8")
    np.cumsum(NUMBER[data] * POWERS[: len(data)], out=upto[1:])
    hashes = mix64((upto[ends] - upto[starts]) * INVERSE[starts] + size.astype("u8") * M64)
    for i in np.flatnonzero(size > LONG_WORD):
        hashes[i] = long_word(data[starts[i] : ends[i]].tobytes())
    return starts, hashes


def long_word(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word.lower())


def _runs(data: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(offset, starts, hashes) chunk by chunk; a word that fills a chunk is hashed by itself."""
    at = 0
    while at < len(data):
        end = min(at + CHUNK_BYTES, len(data))
        if end < len(data) and not BLANK[data[end]]:
            blanks = np.flatnonzero(BLANK[data[at:end]])
            if len(blanks):
                end = at + int(blanks[-1]) + 1
            else:  # a word of more than a chunk
                while end < len(data) and not BLANK[data[end : end + CHUNK_BYTES]].any():
                    end += CHUNK_BYTES
                if end < len(data):
                    end += int(np.flatnonzero(BLANK[data[end : end + CHUNK_BYTES]])[0])
                end = min(end, len(data))
                yield at, np.zeros(1, "i8"), np.array([long_word(data[at:end].tobytes())], "u8")
                at = end
                continue
        yield (at, *_chunk(data[at:end]))
        at = end


def word_hashes(texts: Sequence[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts, number of words of each text).

    A word is a run of anything but the space and the bytes 9 to 13, A-Z
    lower-cased. A null text has none.
    """
    texts = [t or b"" for t in texts]
    data = np.frombuffer(b"\n".join(texts), "u1")
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), "i8", len(texts)))
    starts, hashes = [np.empty(0, "i8")], [np.empty(0, "u8")]
    for at, s, h in _runs(data):
        starts.append(s + at)
        hashes.append(h)
    upto = np.searchsorted(np.concatenate(starts), ends, side="left")
    return np.concatenate(hashes), np.diff(upto, prepend=0)


def shingles(hashes: np.ndarray, size: int = 5) -> np.ndarray:
    """A hash for each run of ``size`` words; of fewer words, one for them all."""
    n = len(hashes)
    if n == 0:
        return hashes
    with np.errstate(over="ignore"):
        if n < size:
            out = np.array([n], "u8")
            for h in hashes:
                out = mix64(out * M64 + h)
            return out
        out = np.full(n - size + 1, size, "u8")
        for k in range(size):
            out *= M64
            out += hashes[k : n - size + 1 + k]
            out ^= out >> np.uint64(29)
        return mix64(out)


def text_shingles(texts: Sequence[bytes | None], size: int = 5) -> list[np.ndarray]:
    """``shingles`` of every text."""
    hashes, sizes = word_hashes(texts)
    ends = np.cumsum(sizes)
    runs = shingles(hashes, size) if len(hashes) >= size else hashes
    return [runs[e - n : e - size + 1] if n >= size else shingles(hashes[e - n : e], size) for n, e in zip(sizes.tolist(), ends.tolist(), strict=True)]


def bodies(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a column of strings."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def groups(texts: Sequence[bytes | None], limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``limit`` bytes together, or of one text."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        if i > first and held + len(t or b"") > limit:
            yield first, i
            first, held = i, 0
        held += len(t or b"")
    if texts:
        yield first, len(texts)
