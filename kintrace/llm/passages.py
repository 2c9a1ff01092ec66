"""8. Near-duplicate passages by compact windows.

Under one hash of its five-word shingles, all subsequences of a document that
share their least hash form a compact window: a node of the Cartesian tree over
the hashes, with the stretch in which it is the least. Windows are taken only
from stretches in which enough shingles stand in another text too. Documents
whose windows meet under one value are joined, and where the intervals of two or
more hashes agree, the passages are compared shingle by shingle.
"""

from __future__ import annotations

import gc
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kintrace.operators.graph import connected_components

from .common import WORD, cut, discard, documents, ship
from .shingles import bodies, groups, mix64, text_shingles
from .suffix import _sliding

#: Words of a shingle, and of a passage at least.
SHINGLE, WORDS = 5, 50
#: Hashes, and those that must agree: a passage at 0.8 has fewer than two of eight with probability 8e-5, an exact one never.
HASHES, AGREE = 8, 2
#: Shingles of a part in which those of several texts are told, and parts at least and at most (powers of two).
PART, PARTS = 1 << 20, (32, 1024)
SIMILARITY = 0.8
#: Lengths, in eighths of the width, at which texts that repeat themselves are compared.
LENGTHS = (8, 9, 10, 12, 16)
#: Windows compared at once where pivots leave something open.
OPEN_BLOCK, BLOCK = 128, 512
#: Shingles hashed at once; ranges of one document that are cut out of its text together.
CHUNK, RANGES = 100_000, 2_000
#: Pairs without a passage that a worker remembers, so as not to compare them in another block.
FAILED = 200_000
#: Bytes of cut-out ranges that a worker holds.
FLUSH = 4 << 20


def orders(items: np.ndarray, k: int) -> np.ndarray:
    """Hash number k of shingles, by which the least one of a stretch is found: 32 bits, above 0."""
    with np.errstate(over="ignore"):
        x = (items >> np.uint64(32)).astype("u4") ^ np.uint32(0x9E3779B9 * (k + 1) & 0xFFFFFFFF)
        x *= np.uint32(0x7FEB352D + 2 * k)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x846CA68B)
        x ^= x >> np.uint32(16)
    x |= np.uint32(1)
    return x


def cartesian(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parents' side of a Cartesian tree: for each value the nearest place before with a value as small or smaller, and the nearest after with a smaller one.

    ``values`` begins and ends with a 0, which is below all others, and has one
    between any two documents. Places jump along the answers found so far.
    """
    n = len(values)
    before, after = np.arange(-1, n - 1), np.arange(1, n + 1)
    before[0], after[-1] = 0, n - 1
    for jump, wrong in ((before, np.greater), (after, np.greater_equal)):
        todo = np.flatnonzero(wrong(values[jump], values) & (values > 0))
        while len(todo):
            jump[todo] = jump[jump[todo]]
            todo = todo[wrong(values[jump[todo]], values[todo])]
    return before, after


def compact_windows(docs: list[np.ndarray], hashes: range, width: int) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(documents, hash number, rows of (value, first, centre, last)) for all windows of ``width`` shingles or more.

    Only a least value of some stretch of ``width`` can be a centre, and the
    smaller values that end its window are such values too, so the tree is built
    over these alone.
    """
    at = 0
    while at < len(docs):
        group, held = [], 0
        while at < len(docs) and (not group or held + len(docs[at]) <= CHUNK):
            if len(docs[at]) >= width:
                group.append(at)
                held += len(docs[at])
            at += 1
        if not group:
            continue
        sizes = np.array([len(docs[i]) for i in group])
        ends = np.cumsum(sizes)
        whole = np.concatenate([docs[i] for i in group])
        inside = np.ones(len(whole) - width + 1, bool)
        for e in ends[:-1]:
            inside[max(0, e - width + 1) : e] = False
        low = np.zeros(len(inside) + 2 * (width - 1), "u4")
        for k in hashes:
            h = orders(whole, k)
            np.multiply(_sliding(h, width, True), inside, out=low[width - 1 : width - 1 + len(inside)])
            found = np.flatnonzero(_sliding(low, width, False) == h)
            doc = np.searchsorted(ends, found, side="right")
            # a 0 before each document and after the last; it stands for the document's edge
            slot = np.arange(len(found)) + doc + 1
            values = np.zeros(len(found) + len(group) + 1, "u4")
            values[slot] = h[found]
            place = np.empty(len(values), "i8")
            place[slot] = found
            before, after = cartesian(values)
            b, a, start = before[slot], after[slot], ends[doc] - sizes[doc]
            first = np.where(values[b] == 0, start, place[b] + 1)
            last = np.where(values[a] == 0, ends[doc], place[a]) - 1
            ok = last - first + 1 >= width
            name = mix64(whole[found[ok]] ^ mix64(np.array([k + 1], "u8"))).view("i8")
            yield np.array(group)[doc[ok]], k, np.stack([name, (first - start)[ok], (found - start)[ok], (last - start)[ok]], 1)


def _merged(rows: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of windows of one value that follow each other within the first one's stretch only the first, as (value, first, centre, last, last centre).

    A shingle that stands there again begins its window after the one before and
    ends with it, so the first window holds the others.
    """
    order = np.lexsort((rows[:, 2], rows[:, 0], doc))
    rows, doc = rows[order], doc[order]
    begins = np.ones(len(rows), bool)
    begins[1:] = (rows[1:, 0] != rows[:-1, 0]) | (doc[1:] != doc[:-1]) | (rows[1:, 1] != rows[:-1, 2] + 1)
    at = np.flatnonzero(begins)
    upto = rows[np.r_[at[1:], len(rows)] - 1, 2] if len(at) else rows[:, 2]
    return np.concatenate([rows[at], upto[:, None]], 1), doc[at]


def _batched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts in groups that keep their name, so that what is told of a group later finds the same texts."""
    for batch in batches:
        for first, end in groups(bodies(batch.column(1))):
            part = batch.slice(first, end - first)
            yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().bytes], pa.binary()), pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([bodies(part.column(1))], pa.list_(pa.binary()))], ["batch", "ids", "texts"])


def _coded(docs: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shingles of texts as numbers of 32 + ``bits`` bits, in order: the numbers, the places they have among all shingles, the texts they are of."""
    whole = np.concatenate(docs) >> np.uint64(32 - bits)
    text = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    room = np.uint64(32 - bits)
    if len(whole) < 1 << (32 - bits):
        both = np.sort(whole << room | np.arange(len(whole), dtype="u8"))
        place = (both & np.uint64((1 << (32 - bits)) - 1)).astype("i8")
        return both >> room, place, text[place]
    place = np.argsort(whole, kind="stable")
    return whole[place], place, text[place]


def _bounds(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each of the parts begins among numbers in order, and the last ends."""
    return np.searchsorted(keys, np.arange((1 << bits) + 1, dtype="u8") << np.uint64(32))


def _distinct_shingles(bits: int):
    """Of each group of texts and part, the distinct shingles (4 bytes each), and which of them several texts of the group have."""
    names = ["part", "batch", "items", "several"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, texts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys, _, text = _coded(text_shingles(texts, SHINGLE), bits)
                if not len(keys):
                    continue
                starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
                several = text[starts] != text[np.r_[starts[1:], len(keys)] - 1]
                keys = keys[starts]
                at = _bounds(keys, bits)
                parts = np.flatnonzero(at[1:] > at[:-1])
                low = keys.astype("u4")
                rows = [(low[at[p] : at[p + 1]].tobytes(), np.packbits(several[at[p] : at[p + 1]]).tobytes()) for p in parts]
                yield pa.RecordBatch.from_arrays([pa.array(parts.astype("i4")), pa.array([name] * len(parts), pa.binary()), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], names)

    return run


def _told_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Part by part, from rows in the order of parts: of each group which of its shingles another text has too."""
    held: list[tuple] = []

    def close() -> pa.RecordBatch:
        items = [np.frombuffer(x, "u4") for _, _, x, _ in held]
        several = [x[np.unpackbits(np.frombuffer(m, "u1"), count=len(x)).view(bool)] for x, (*_, m) in zip(items, held, strict=True)]
        whole = np.sort(np.concatenate(items))
        shared = np.unique(np.concatenate([whole[1:][whole[1:] == whole[:-1]], *several]))
        out = []
        for x in items:
            at = np.minimum(np.searchsorted(shared, x), len(shared) - 1) if len(shared) else None
            out.append(np.packbits(shared[at] == x if at is not None else np.zeros(len(x), bool)).tobytes())
        done = pa.RecordBatch.from_arrays([pa.array([x[1] for x in held], pa.binary()), pa.array([x[0] for x in held], pa.int32()), pa.array(out, pa.binary())], ["batch", "part", "shared"])
        held.clear()
        return done

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][0] != row[0]:
                yield close()
            held.append(row)
    if held:
        yield close()


def _stretches(docs: list[np.ndarray], hits: np.ndarray, again: np.ndarray, width: int, least: float) -> list[tuple[int, int, int]]:
    """(text, first, end) of what ``_feasible`` gives for each text, for all at once: ``hits`` and ``again`` say which shingles count and which stand in their text again."""
    sizes = np.array([len(d) for d in docs])
    ends = np.cumsum(sizes)
    # whole millionths, and a fall between texts that nothing after it makes up for
    up, down = int(np.ceil(round((1 - least) * 1e6, 3))), int(np.floor(round(least * 1e6, 3)))
    slot = np.arange(len(hits)) + np.repeat(np.arange(len(docs)), sizes)
    gain = np.full(len(hits) + len(docs), -(len(hits) + 1) * up)
    gain[slot] = np.where(hits, up, np.where(again, 0, -down))
    total = np.concatenate([[0], np.cumsum(gain)])
    reach = len(gain) - np.searchsorted(np.maximum.accumulate(total[::-1]), total[slot], side="left")
    good = np.flatnonzero(reach - slot >= width)
    if not len(good):
        return []
    text = np.searchsorted(ends, good, side="right")
    start = ends[text] - sizes[text]
    end = np.minimum(reach[good] - text, ends[text])
    upto = np.maximum.accumulate(end)  # ends of one text never pass the starts of the next
    new = np.flatnonzero(np.r_[True, (good[1:] > upto[:-1]) | (text[1:] != text[:-1])])
    last = np.r_[new[1:] - 1, len(good) - 1]
    return list(zip(text[new].tolist(), (good[new] - start[new]).tolist(), (upto[last] - start[new]).tolist(), strict=True))


def _windows(width: int, least: float, bits: int):
    """The windows of all hashes in the stretches of texts in which enough shingles are shared."""
    names = ["value", "id", "before", "centre", "upto", "after"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts, told in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                docs = text_shingles(texts, SHINGLE)
                keys, place, text = _coded(docs, bits)
                new = np.r_[True, keys[1:] != keys[:-1]]
                at = _bounds(keys[new], bits)
                shared = np.zeros(int(at[-1]), bool)
                for row in told:
                    p = row["part"]
                    shared[at[p] : at[p + 1]] = np.unpackbits(np.frombuffer(row["shared"], "u1"), count=int(at[p + 1] - at[p])).view(bool)
                hits, again = np.empty(len(keys), bool), np.zeros(len(keys), bool)
                hits[place] = shared[np.cumsum(new) - 1]
                again[place[1:]] = ~new[1:] & (text[1:] == text[:-1])
                found = _stretches(docs, hits, again, width, least)
                pieces = [docs[i][s:e] for i, s, e in found]
                who, rows = [], []
                for d, k, r in compact_windows(pieces, range(HASHES), width):
                    r[:, 0] = r[:, 0] * HASHES + k
                    r, d = _merged(r, d)
                    who.append(d)
                    rows.append(r)
                if not rows:
                    continue
                r, of = np.concatenate(rows), np.concatenate(who)
                begin = np.array([s for _, s, _ in found])[of]
                names_ = np.array(ids)[np.array([i for i, _, _ in found])[of]]
                cols = [r[:, 2] - r[:, 1], r[:, 2] + begin, r[:, 4] - r[:, 2], r[:, 3] - r[:, 2]]
                yield pa.RecordBatch.from_arrays([pa.array(r[:, 0]), pa.array(names_.astype("i8")), *(pa.array(c.astype("i4")) for c in cols)], names)

    return run


def _cut_out(what):
    """The ranges of texts, each as ``what`` makes of its shingles."""
    names, kinds = ["pair", "side", "items"], [pa.int64(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0
        for batch in batches:
            texts, wanted = bodies(batch.column(0)), batch.column(1)
            for begin, end in groups(texts):
                for i, items in zip(range(begin, end), text_shingles(texts[begin:end], SHINGLE), strict=True):
                    for pair, side, first, last in zip(*(wanted[i].values.field(k).to_pylist() for k in range(4)), strict=True):
                        out.append((pair, side, what(items[first : last + 1])))
                        held += len(out[-1][2])
                        if held > FLUSH:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                            out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return run


def _sketch(width: int):
    """A digest of a range (16 bytes), the least distinct shingles of a passage in it (2), and four bytes of each shingle, in their order."""

    def run(items: np.ndarray) -> bytes:
        low = 1
        if len(items) >= width:
            codes = np.unique(items, return_inverse=True)[1]
            low = min(int(_sets_of(codes, np.ones(len(codes), "u8"), 0, len(codes), width)[1].min()), 65_535)
        return hashlib.blake2b(items.tobytes(), digest_size=16).digest() + np.uint16(low).tobytes() + (items >> np.uint64(32)).astype("u4").tobytes()

    return run


def _dense(mask: np.ndarray, share: float, width: int) -> tuple[int, int] | None:
    """The longest range of ``width`` or more with that share of hits, hits at its ends."""
    total = np.concatenate([[0.0], np.cumsum(mask - share)])
    low = np.minimum.accumulate(total)
    begin = np.searchsorted(-low, -(total + 1e-9), side="left")
    length = np.arange(len(total)) - begin
    end = int(length.argmax())
    if length[end] < width:
        return None
    hits = np.flatnonzero(mask[begin[end] : end]) + begin[end]
    return (int(hits[0]), int(hits[-1]) + 1) if len(hits) and hits[-1] + 1 - hits[0] >= width else None


def _in(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the small numbers ``a`` are in ``b``."""
    table = np.zeros(int(max(a.max(initial=0), b.max(initial=0))) + 1, bool)
    table[b] = True
    return table[a]


def _first_places(codes: np.ndarray) -> np.ndarray:
    """Which of the small numbers stand there for the first time."""
    place = np.arange(len(codes))
    first = np.empty(int(codes.max(initial=0)) + 1, "i8")
    first[codes[::-1]] = place[::-1]
    return first[codes] == place


def _feasible(values: np.ndarray, hits: np.ndarray, least: float, width: int) -> list[tuple[int, int]]:
    """The stretches that ranges of ``width`` or more can cover of which hits have the share ``least``.

    Values count once in a Jaccard value: a repeated miss costs nothing here, so no passage is ruled out by repeats.
    """
    again = ~_first_places(values)
    total = np.concatenate([[0.0], np.cumsum(np.where(hits, 1 - least, np.where(again, 0.0, -least)))])
    ahead = np.maximum.accumulate(total[::-1])  # grows from the end to the start
    reach = len(values) - np.searchsorted(ahead, total[:-1] - 1e-9, side="left")
    starts = np.flatnonzero(reach - np.arange(len(values)) >= width)
    if not len(starts):
        return []
    upto = np.maximum.accumulate(reach[starts])
    cut_ = np.flatnonzero(np.r_[True, starts[1:] > upto[:-1]])
    return list(zip(starts[cut_].tolist(), upto[np.r_[cut_[1:] - 1, len(starts) - 1]].tolist(), strict=True))


def _tiles(stretches: list[tuple[int, int]], width: int) -> Iterator[tuple[int, int]]:
    """Stretches in overlapping tiles: a long passage has a short one within it."""
    for s, e in stretches:
        for at in range(s, max(s + 1, e - 2 * width), 2 * width):
            yield at, min(e, at + 4 * width)


def _sets_of(codes: np.ndarray, names: np.ndarray, lo: int, hi: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each range of ``length`` in [lo, hi) the sum of its distinct values' names, and their number."""
    part = codes[lo:hi]
    n = len(part)
    order = np.argsort(part, kind="stable")
    before = np.full(n, -1)
    same = part[order[1:]] == part[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    at = np.arange(n)
    first, last = np.maximum(before + 1, at - length + 1), at + 1
    out = []
    for value in (names[part], np.ones(n, "u8")):
        change = np.zeros(n + 1, "u8")
        np.add.at(change, first, value)
        np.subtract.at(change, last, value)
        out.append(np.cumsum(change[:-1])[: n - length + 1])
    return out[0], out[1].astype("i8")


def _candidates(codes: np.ndarray, names: np.ndarray, stretches: list[tuple[int, int]], lengths: list[int]) -> np.ndarray:
    """Rows (start, length, distinct values, set) of ranges, each set of values once."""
    rows = []
    for length in lengths:
        for lo, hi in stretches:
            if hi - lo >= length:
                key, count = _sets_of(codes, names, lo, hi, length)
                rows.append(np.stack([np.arange(lo, lo + len(key)), np.full(len(key), length), count, key.view("i8")], 1))
    if not rows:
        return np.empty((0, 4), "i8")
    made = np.concatenate(rows)
    return made[np.sort(np.unique(made[:, 3], return_index=True)[1])]


def _holds(codes: np.ndarray, rows: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of the wanted values each range holds."""
    size = int(max(codes.max(), wanted.max())) + 1
    number = np.full(size, -1)
    number[wanted] = np.arange(len(wanted))
    out = np.zeros((len(rows), len(wanted)), "f4")
    for k, (start, length) in enumerate(rows[:, :2].tolist()):
        held = number[codes[start : start + length]]
        out[k, held[held >= 0]] = 1
    return out


def _search(a: np.ndarray, b: np.ndarray, tile: tuple[int, int], seen: set[int], width: int, least: float) -> tuple[int, int, int, int] | None:
    """A range (first, end) in a tile of a, and one of b, at ``least`` or more, over ranges of ``LENGTHS``; sets of the tile that are in ``seen`` are passed over."""
    theirs = _feasible(b, _in(b, a[tile[0] : tile[1]]), least, width)
    if not theirs:
        return None
    names = mix64(np.arange(1, int(max(a.max(), b.max())) + 2, dtype="u8"))
    lengths = sorted({-(-width * k // 8) for k in LENGTHS})
    mine = _candidates(a, names, [tile], lengths)
    mine = mine[[key not in seen for key in mine[:, 3].tolist()]]
    seen.update(mine[:, 3].tolist())
    if not len(mine):
        return None
    other = _candidates(b, names, theirs, lengths)
    if not len(other):
        return None
    wanted = np.intersect1d(a[tile[0] : tile[1]], b)
    if not len(wanted):
        return None
    held = _holds(a, mine, wanted)
    best: tuple = (0,)
    for k in range(0, len(other), 2_000):
        part = other[k : k + 2_000]
        shared = held @ _holds(b, part, wanted).T
        ok = shared * (1 + least) >= least * (mine[:, 2][:, None] + part[:, 2][None]) - 1e-6
        if ok.any():
            size = np.where(ok, mine[:, 1][:, None] + part[:, 1][None], 0)
            i, j = np.unravel_index(int(size.argmax()), size.shape)
            best = max(best, (int(size[i, j]), int(mine[i, 0]), int(mine[i, 1]), int(part[j, 0]), int(part[j, 1])))
    if best[0] == 0:
        return None
    _, x, n, u, m = best
    return _grown(a, b, (x, x + n, u, u + m), least)


def _grown(a: np.ndarray, b: np.ndarray, at: tuple[int, int, int, int], least: float) -> tuple[int, int, int, int]:
    """The ranges, each end moved out by ever smaller steps while the value holds."""
    ends = list(at)
    for k, limit, sign in ((1, len(a), 1), (0, 0, -1), (3, len(b), 1), (2, 0, -1)):
        step = 1 << max(0, abs(limit - ends[k])).bit_length()
        while step:
            moved = list(ends)
            moved[k] += sign * step
            if 0 <= moved[k] <= max(limit, ends[k]) and _jaccard(a[moved[0] : moved[1]], b[moved[2] : moved[3]]) >= least:
                ends = moved
            step //= 2
    return ends[0], ends[1], ends[2], ends[3]


def _jaccard(a: np.ndarray, b: np.ndarray) -> float:
    one, two = _first_places(a), _first_places(b)
    shared = int(_in(a[one], b).sum())
    return shared / (int(one.sum()) + int(two.sum()) - shared)


def _in_order(i: np.ndarray, j: np.ndarray, n: int, m: int, width: int, least: float) -> tuple[int, int, int, int] | None:
    """The longest passage among matches (i, j) that rise in both, of n and m shingles that stand once each.

    A passage from match r to match s has s - r + 1 shared shingles, so that its
    Jaccard value reaches ``least`` where g(s) >= g(r) + a constant, g falling by
    each place passed and rising by each match.
    """
    gain = (1 + least) / least
    if len(i) * gain < 2 * width - 1e-9 or min(n, m) < width:
        return None
    g = np.arange(len(i)) * gain - i - j
    floor = np.minimum.accumulate(g)
    begin = np.searchsorted(-floor, -(g + gain - 2 + 1e-9), side="left")
    far = (i - i[begin] + 1 >= width) & (j - j[begin] + 1 >= width)
    if far.any():
        s = int(np.where(far, i - i[begin], -1).argmax())
        r = int(begin[s])
        return int(i[r]), int(i[s]) + 1, int(j[r]), int(j[s]) + 1
    # matches within less than the width on a side: the passage is filled up to it
    r = np.arange(len(i))[:, None]
    d = np.arange(min(len(i), width))[None]
    s = np.minimum(r + d, len(i) - 1)
    value = (d + 1) * gain - np.maximum(width, i[s] - i[r] + 1) - np.maximum(width, j[s] - j[r] + 1)
    value[r + d >= len(i)] = -1
    best = int(value.argmax())
    if value.flat[best] < -1e-9:
        return None
    r, s = best // d.shape[1], best // d.shape[1] + best % d.shape[1]
    x, u = min(int(i[r]), n - width), min(int(j[r]), m - width)
    return max(0, x), max(int(i[s]) + 1, max(0, x) + width), max(0, u), max(int(j[s]) + 1, max(0, u) + width)


def common_passages(a: np.ndarray, b: np.ndarray, width: int, least: float) -> Iterator[tuple[int, int, int, int, float]]:
    """(first, end) in a and in b of passages whose shingle sets have a Jaccard value of ``least`` or more.

    Where shingles stand once in a and in b and the shared ones in one order, the
    longest passages are found directly and none is missed. Else long ranges of
    many hits are tried first, and where none of them passes, all places in ranges
    of ``LENGTHS`` that hits can cover to the share ``least``, which either side of
    a passage has however its differences are split between the two.
    """
    order = np.argsort(b, kind="stable")
    ranked = b[order]
    place = np.minimum(np.searchsorted(ranked, a), len(b) - 1)
    i = np.flatnonzero(ranked[place] == a)
    j = order[place[i]]
    mine = np.sort(a)
    repeats = int((mine[1:] == mine[:-1]).sum())
    if len(i) * (1 + least) < least * 2 * max(1, min(width, len(a)) - repeats):  # no range of the width has fewer distinct values
        return
    if not repeats and (j[1:] > j[:-1]).all() and (ranked[1:] != ranked[:-1]).all():
        todo = [(0, len(i), 0, len(a), 0, len(b))]
        while todo:
            f, e, lo, hi, low, high = todo.pop()
            got = _in_order(i[f:e] - lo, j[f:e] - low, hi - lo, high - low, width, least)
            if got is None:
                continue
            x, y, u, v = got[0] + lo, got[1] + lo, got[2] + low, got[3] + low
            shared = int(min(np.searchsorted(i, y), np.searchsorted(j, v)) - max(np.searchsorted(i, x), np.searchsorted(j, u)))
            yield x, y, u, v, shared / (y - x + v - u - shared)
            todo.append((f, f + int(np.searchsorted(i[f:e], x)), lo, x, low, high))
            todo.append((f + int(np.searchsorted(i[f:e], y)), e, y, hi, low, high))
        return
    share = 2 * least / (1 + least)  # of a passage's shingles, when the other is as long
    codes = np.unique(np.concatenate([a, b]), return_inverse=True)[1]
    a, b = codes[: len(a)], codes[len(a) :]
    todo, seen = [(0, len(a))], set()
    while todo:
        lo, hi = todo.pop()
        if hi - lo < width:
            continue
        mask = _in(a[lo:hi], b)
        mine = _feasible(a[lo:hi], mask, least, width)
        if not mine:
            continue
        for wanted in (share, least, (share + 1) / 2, 1.0):  # a long loose range may hide a short close one
            found = _dense(mask, wanted, width)
            if found is None:
                continue
            x, y = lo + found[0], lo + found[1]
            other = _dense(_in(b, a[x:y]), wanted, width)
            if other is not None and (value := _jaccard(a[x:y], b[other[0] : other[1]])) >= least:
                yield x, y, *other, value
                todo += [(lo, x), (y, hi)]
                break
        else:
            done = lo
            for s, e in _tiles(mine, width):
                s, e = max(lo + s, done), lo + e
                if e - s >= width and (got := _search(a, b, (s, e), seen, width, least)):
                    yield *got, _jaccard(a[got[0] : got[1]], b[got[2] : got[3]])
                    done = got[1]


def _verify(width: int, least: float):
    names = ["p", "p_first", "p_words", "q", "q_first", "q_words", "similarity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for p, q, a0, b0, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for x, y, u, v, value in common_passages(np.frombuffer(a, "u8"), np.frombuffer(b, "u8"), width, least):
                    out.append((p, a0 + x, y - x + SHINGLE - 1, q, b0 + u, v - u + SHINGLE - 1, value))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names)

    return run


def _crowded(codes: np.ndarray, held: np.ndarray, width: int, shares: tuple[float, ...]) -> list[np.ndarray]:
    """For each share, which of the others (rows of ``held``, by code) hold it of some ``width`` codes or more; a code that stands there again and is not held costs nothing."""
    if len(codes) < width:
        return [np.zeros(len(held), bool) for _ in shares]
    has = held[:, codes]
    hits, misses = np.zeros((2, len(held), len(codes) + 1), "f4")
    np.cumsum(has, axis=1, out=hits[:, 1:])
    np.cumsum(~has & _first_places(codes), axis=1, out=misses[:, 1:])
    out = []
    for share in shares:
        total = hits * np.float32(1 - share) - misses * np.float32(share)
        out.append((total[:, width:] >= np.minimum.accumulate(total[:, :-width], axis=1) - 1e-2).any(1))
    return out


class _Ties:
    """Which labels are tied to each other."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def tie(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)


def _likely(width: int, least: float):
    """Of a block's ranges (digest, label, open, sketch), pairs of an open one and one of another label that share a passage: a forest over the labels.

    First it is told which pairs may share one. There two bytes of a shingle stand
    for it, so that more may seem shared than is, never less. Either range must
    have ``width`` places or more of which the share ``least`` is shared, and one
    of them as much as two equally long passages have: the shorter passage of a
    pair has that share. Then those whose labels no earlier pair ties are compared
    by four bytes of a shingle, those that share most first, so that no more pairs
    come out than the block has labels. Two different shingles of 100 and 100 are
    one there with probability 2e-6.
    """
    c = least / (1 + least)
    shares = (least, 2 * c)
    failed: set[tuple[bytes, bytes]] = set()  # pairs stand in several blocks

    def run(table: pa.Table) -> pa.Table:
        label, is_open = table.column("label").to_numpy(), np.array(table.column("open").to_pylist(), bool)
        sketches = table.column("sketch").to_pylist()
        lows = np.array([int.from_bytes(x[16:18], "little") for x in sketches])
        whole = [np.frombuffer(x, "u4", offset=18) for x in sketches]
        named, codes = np.unique((np.concatenate(whole) >> np.uint32(16)).astype("u2"), return_inverse=True)
        sizes = [len(x) for x in whole]
        held = np.zeros((len(sketches), len(named)), bool)
        held[np.repeat(np.arange(len(sketches)), sizes), codes] = True
        of = np.split(codes, np.cumsum(sizes)[:-1])
        mine = np.flatnonzero(is_open)
        often = held[:, held.sum(0) > 1].astype("f4")
        shared = often[mine] @ often.T
        hit = (shared >= c * (lows[mine][:, None] + lows[None]) - 1e-3) & (label[mine][:, None] != label[None])
        close = np.zeros(hit.shape, bool)
        for k in np.flatnonzero(hit.any(1)):
            others = np.flatnonzero(hit[k])
            hit[k, others], close[k, others] = _crowded(of[mine[k]], held[others], width, shares)
        for k in np.flatnonzero(hit.any(0)):
            others = np.flatnonzero(hit[:, k])
            loose, tight = _crowded(of[k], held[mine[others]], width, shares)
            hit[others, k] = loose & (tight | close[others, k])
        i, j = np.nonzero(hit)
        order = np.argsort(-shared[i, j], kind="stable")
        digests, ties = table.column("digest"), _Ties()
        names, out = [x[:16] for x in sketches], []
        for p, q in zip(mine[i[order]].tolist(), j[order].tolist(), strict=True):
            pair = min(names[p], names[q]), max(names[p], names[q])
            if ties.root(label[p]) == ties.root(label[q]) or pair in failed:
                continue
            if next(common_passages(whole[p], whole[q], width, least), None) is None:
                if len(failed) < FAILED:
                    failed.add(pair)
                continue
            ties.tie(label[p], label[q])
            out.append((p, q))
        p, q = np.array(out, "i8").reshape(-1, 2).T
        return pa.table({"p": digests.take(pa.array(p)), "q": digests.take(pa.array(q))})

    return run


#: Columns of verified pairs of passages.
NEAR = ("p", "p_first", "p_words", "q", "q_first", "q_words", "similarity")


def _islands(df: DataFrame, keys: list[str], first: str, last: str, least: int, name: str) -> DataFrame:
    """Number the groups of intervals of equal keys that hang together by ``least`` places or more."""
    ordered = Window.partitionBy(*keys).orderBy(first, last)
    reach = F.max(last).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col(first) > reach - least + 1).cast("long"), F.lit(1).cast("long"))
    return df.withColumn(name, new).withColumn(name, F.sum(name).over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def _ranges(seeds: DataFrame, width: int) -> DataFrame:
    """From pairs of windows (a, b, met), the ranges p, q, a0, a1, b0, b1 where windows of ``AGREE`` hashes meet in both documents.

    Two windows meet where they share ``width`` places or more; a passage that
    has both least hashes lies there.
    """
    swap = F.col("a.id") > F.col("b.id")
    both = seeds.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"), "met")
    one = both.select(F.col("a.id").alias("p"), F.col("b.id").alias("q"), F.col("a.first").alias("a0"), F.col("a.last").alias("a1"), F.col("b.first").alias("b0"), F.col("b.last").alias("b1"), "met")
    pair = ["p", "q"]
    one = one.groupBy(*pair, "a0", "a1", "b0", "b1").agg(F.bit_or("met").alias("met"))
    one = one.withColumn("all", F.expr("bit_or(met) over (partition by p, q)")).filter(F.bit_count("all") >= AGREE)
    one = _islands(one, pair, "a0", "a1", width, "i")
    one = _islands(one, [*pair, "i"], "b0", "b1", width, "j")
    out = one.groupBy(*pair, "i", "j").agg(F.min("a0").alias("a0"), F.max("a1").alias("a1"), F.min("b0").alias("b0"), F.max("b1").alias("b1"), F.bit_or("met").alias("met"))
    return out.filter(F.bit_count("met") >= AGREE).select("p", "q", "a0", "a1", "b0", "b1")


def _pieces(src: DataFrame, ends: DataFrame, what=np.ndarray.tobytes) -> DataFrame:
    """pair, side, items: the shingles of the ranges (id, pair, side, first, last), or what ``what`` makes of them."""
    parts = ends.groupBy("id").agg(F.ceil(F.count(F.lit(1)) / RANGES).alias("parts"))
    wanted = ends.join(parts, "id").groupBy("id", F.pmod(F.xxhash64("pair"), "parts").alias("part")).agg(F.collect_list(F.struct("pair", "side", "first", "last")).alias("wanted"))
    texts = src.join(wanted.select("id").distinct(), "id", "left_semi")
    return cut(texts.join(wanted, "id").select("text", "wanted").mapInArrow(_cut_out(what), "pair long, side int, items binary"), "pieces")


def _verified(src: DataFrame, ranges: DataFrame, width: int, least: float) -> DataFrame:
    """The passages of ``NEAR`` in the ranges p, q, a0, a1, b0, b1."""
    ranges = cut(ranges.withColumn("pair", F.monotonically_increasing_id()), "ranges")
    ends = ranges.select(F.col("p").alias("id"), "pair", F.lit(0).alias("side"), F.col("a0").alias("first"), F.col("a1").alias("last")).union(ranges.select("q", "pair", F.lit(1), "b0", "b1"))
    pieces = _pieces(src, ends)
    left = pieces.filter("side = 0").select("pair", F.col("items").alias("a"))
    right = pieces.filter("side = 1").select("pair", F.col("items").alias("b"))
    both = ranges.join(left, "pair").join(right, "pair").select("p", "q", "a0", "b0", "a", "b")
    near = cut(both.mapInArrow(_verify(width, least), "p long, p_first long, p_words long, q long, q_first long, q_words long, similarity double"), "near")
    discard(src.sparkSession, pieces._cut_path)
    discard(src.sparkSession, ranges._cut_path)
    return near


def components(near: DataFrame) -> DataFrame:
    """(node, component) of the documents that passages tie; the least id of each component names it."""
    return connected_components(near.select("p", "q").distinct(), "p", "q")


def _apart(windows: DataFrame, labels: DataFrame, group: list[str]) -> DataFrame:
    """The windows of the groups whose documents have several labels, with label, size of the group, and open: whether the label is another than most have."""
    told = windows.join(labels, F.col("id") == F.col("node"), "left").select(*windows.columns, F.coalesce("component", "id").alias("label"))
    sizes = told.groupBy(*group, "label").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.groupBy(*group).agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.min("label").alias("low"), F.max("label").alias("high"))
    return told.join(sizes.filter("low <> high").select(*group, "main"), group).withColumn("open", F.col("label") != F.col("main")).drop("main")


def _marked(windows: DataFrame, near: DataFrame, labels: DataFrame, group: list[str]) -> DataFrame:
    """The windows of the groups in which something is open: a window whose centres are not all in one run of passages, or whose document has another label than most.

    Adds label and open.
    """
    spans = near.select(F.col("p").alias("id"), F.col("p_first").alias("s"), (F.col("p_first") + F.col("p_words") - SHINGLE).alias("e"))
    spans = spans.union(near.select("q", "q_first", F.col("q_first") + F.col("q_words") - SHINGLE)).distinct()
    spans = _islands(spans, ["id"], "s", "e", 0, "i").groupBy("id", "i").agg(F.min("s").alias("s"), F.max("e").alias("e")).select(F.col("id").alias("of"), "s", "e")
    covered = (F.col("id") == F.col("of")) & (F.col("centre") >= F.col("s")) & (F.col("upto") <= F.col("e"))
    told = windows.join(spans, covered, "left").join(labels, F.col("id") == F.col("node"), "left")
    told = cut(told.select(*windows.columns, F.col("of").isNull().alias("bare"), F.coalesce("component", "id").alias("label")), "told")
    sizes = told.groupBy(*group, "label").agg(F.count(F.lit(1)).alias("n"), F.max("bare").alias("bare"))
    sizes = sizes.groupBy(*group).agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("size"), F.max("bare").alias("any"), F.min("label").alias("low"), F.max("label").alias("high"))
    sizes = sizes.filter("size > 1 and (any or low <> high)").select(*group, "main", "size")
    return told.join(sizes, group).withColumn("open", F.col("bare") | (F.col("label") != F.col("main"))).drop("bare", "main")


def _agreeing(windows: DataFrame, width: int) -> DataFrame:
    """Pairs of windows of one document under two hashes that one passage can have: x, y (their values), id, centre, first, last, open, label.

    The interval join: either centre lies in the other's window, and the windows
    share ``width`` or more within twice the width of the centres, where a
    passage over a centre has a short one over it. A window of many centres takes
    part once for each slot that has some of them.
    """
    reach = 2 * width
    of = lambda c: F.floor(F.col(c) / reach).cast("int")
    near = windows.withColumn("slot", F.explode(F.sequence(of("centre"), of("upto"))))
    near = near.withColumn("centre", F.greatest("centre", F.col("slot") * reach)).withColumn("upto", F.least("upto", F.col("slot") * reach + reach - 1))
    near = near.withColumn("first", F.greatest("first", F.col("centre") - reach)).withColumn("last", F.least("last", F.col("upto") + reach))
    a = near.select("id", "slot", *[F.col(c).alias(f"a_{c}") for c in ("value", "hash", "first", "centre", "upto", "last", "open", "label")])
    b = near.select("id", F.explode(F.array(F.col("slot") - 1, F.col("slot"), F.col("slot") + 1)).alias("slot"), *[F.col(c).alias(f"b_{c}") for c in ("value", "hash", "first", "centre", "upto", "last", "open")])
    both = a.join(b, ["id", "slot"]).filter("a_hash < b_hash and a_centre <= b_last and a_upto >= b_first and b_centre <= a_last and b_upto >= a_first")
    both = both.select(F.col("a_value").alias("x"), F.col("b_value").alias("y"), "id", F.col("a_centre").alias("centre"), F.greatest("a_first", "b_first").alias("first"), F.least("a_last", "b_last").alias("last"), (F.col("a_open") | F.col("b_open")).alias("open"), F.col("a_label").alias("label"))
    return both.filter(F.col("last") - F.col("first") + 1 >= width)


def _in_blocks(src: DataFrame, open_: DataFrame, width: int, least: float) -> DataFrame:
    """Passages of the open windows of each group (x, y) with windows of the group that have another label, block by block.

    A window is compared over all places that it shares with those of the other
    hashes: a passage of less than twice the width may hold none shorter, wherever
    its centre is. Windows of equal text take part once.
    """
    spots = open_.groupBy("id", "centre").agg(F.min("label").alias("label"), F.min("first").alias("first"), F.max("last").alias("last"))
    spots = cut(spots.withColumn("pair", F.monotonically_increasing_id()), "spots")
    sketches = _pieces(src, spots.select("id", "pair", F.lit(0).alias("side"), "first", "last"), _sketch(width)).select("pair", F.substring("items", 1, 16).alias("digest"), F.col("items").alias("sketch"))
    told = cut(spots.join(sketches, "pair").drop("pair"), "sketches")
    texts = told.groupBy("digest").agg(F.min(F.struct("id", "centre", "first", "last", "label")).alias("rep"), F.first("sketch").alias("sketch"))
    # equal texts of other labels
    equal = told.join(texts.select("digest", "rep"), "digest").filter("label <> rep.label")
    equal = equal.select(F.col("rep").alias("a"), F.struct("id", "centre", "first", "last", "label").alias("b"))

    rows = open_.join(told.select("id", "centre", "digest"), ["id", "centre"]).groupBy("x", "y", "digest").agg(F.max("open").alias("open"))
    sizes = rows.groupBy("x", "y").agg(F.sum(F.col("open").cast("long")).alias("n_open"), F.count(F.lit(1)).alias("size"), *[F.bit_xor(F.xxhash64(F.lit(k), "digest", "open")).alias(f"h{k}") for k in (1, 2)])
    # groups of the same windows are one
    sizes = sizes.filter("size > 1 and n_open > 0").groupBy("size", "n_open", "h1", "h2").agg(F.min(F.struct("x", "y")).alias("one")).select("one.x", "one.y", "n_open", "size")
    placed = cut(rows.join(sizes, ["x", "y"]), "placed")
    draw = F.xxhash64("digest")
    every = lambda n, size: F.explode(F.sequence(F.lit(0), (F.ceil(F.col(n) / size) - 1).cast("int")))
    nth = lambda n, size: F.pmod(draw, F.ceil(F.col(n) / size)).cast("int")
    left = placed.filter("open").select("x", "y", "digest", "open", nth("n_open", OPEN_BLOCK).alias("i"), every("size", BLOCK).alias("j"))
    right = placed.select("x", "y", "digest", F.lit(False).alias("open"), every("n_open", OPEN_BLOCK).alias("i"), nth("size", BLOCK).alias("j"))
    blocks = left.union(right).groupBy("x", "y", "i", "j", "digest").agg(F.max("open").alias("open"))
    blocks = blocks.join(texts.select("digest", "rep.label", "sketch"), "digest").select("x", "y", "i", "j", "digest", "label", "open", "sketch")
    pairs = blocks.groupBy("x", "y", "i", "j").applyInArrow(_likely(width, least), "p binary, q binary")
    pairs = cut(pairs.select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).distinct(), "likely")
    ends = lambda side, name: texts.select(F.col("digest").alias(side), F.col("rep").alias(name))
    both = pairs.join(ends("p", "a"), "p").join(ends("q", "b"), "q").select("a", "b").union(equal).filter("a.id <> b.id")
    swap = F.col("a.id") > F.col("b.id")
    both = both.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"))
    ranges = both.select(F.col("a.id").alias("p"), F.col("b.id").alias("q"), F.col("a.first").alias("a0"), F.col("a.last").alias("a1"), F.col("b.first").alias("b0"), F.col("b.last").alias("b1"))
    # ranges of one pair that lie over each other are one
    ranges = _islands(_islands(ranges, ["p", "q"], "a0", "a1", width, "i"), ["p", "q", "i"], "b0", "b1", width, "j")
    ranges = ranges.groupBy("p", "q", "i", "j").agg(F.min("a0").alias("a0"), F.max("a1").alias("a1"), F.min("b0").alias("b0"), F.max("b1").alias("b1")).drop("i", "j")
    return _verified(src, ranges, width, least)


def _free(spark: SparkSession, *paths: str) -> None:
    """Delete tables, and the shuffle files of plans that are gone."""
    for path in paths:
        discard(spark, path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _shared_windows(src: DataFrame, reps: DataFrame, width: int, least: float) -> DataFrame:
    """The windows whose value more than one document has: value, id, hash, first, centre, upto (the last centre), last; of equal texts only those of the representative.

    A passage at ``least`` has that share of its distinct shingles in another
    text, so only stretches that can hold such a range give windows. Shingles are
    told apart by 37 to 42 bits there, so that more may seem shared than is, never
    less.
    """
    spark = src.sparkSession
    wanted = int(reps.agg(F.sum("n")).first()[0] or 0) // PART
    bits = min(max(wanted, PARTS[0]), PARTS[1]).bit_length() - 1
    batches = cut(src.join(reps.select(F.col("p").alias("id")).distinct(), "id", "left_semi").select("id", "text").mapInArrow(_batched, "batch binary, ids array<bigint>, texts array<binary>"), "batches")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    items = batches.select("batch", "texts").mapInArrow(_distinct_shingles(bits), "part int, batch binary, items binary, several binary")
    told = cut(items.repartition(n, "part").sortWithinPartitions("part").mapInArrow(_told_shared, "batch binary, part int, shared binary"), "shared")
    del items
    _free(spark)
    each = told.groupBy("batch").agg(F.collect_list(F.struct("part", "shared")).alias("told"))
    windows = batches.join(each, "batch").select("ids", "texts", "told").mapInArrow(_windows(width, least, bits), "value long, id long, before int, centre int, upto int, after int")
    windows = cut(windows, "all-windows")
    _free(spark, batches._cut_path, told._cut_path)
    # distances are few different numbers, which the table holds in a byte or so
    twice = windows.groupBy("value").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").select("value")
    at = F.col("centre")
    kept = windows.join(twice, "value").select("value", "id", F.pmod("value", F.lit(HASHES)).cast("int").alias("hash"), (at - F.col("before")).alias("first"), "centre", (at + F.col("upto")).alias("upto"), (at + F.col("after")).alias("last"))
    kept = cut(kept, "windows")
    _free(spark, windows._cut_path)
    return kept


def near_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: float = SIMILARITY, texts_apart: bool = False) -> DataFrame:
    """Verified pairs of near-duplicate passages: p, p_first, p_words, q, q_first, q_words, similarity.

    Passages have ``words`` words or more, places count from 0 in words, and the
    Jaccard value of their five-word shingles is ``least`` or more; p <= q.
    Repeats inside one text are not looked for. A null text and one of fewer
    words have no passage; rows with a null id are left out; rows that share an
    id are texts of one document, of which the least by hash is taken or, with
    ``texts_apart``, each: places then count in one of its texts, and p = q where
    two of its own meet. Ids are cast to long. Extra columns are not carried.

    Repeats among many documents are tied to representatives: ``components`` of
    the pairs gives every document its class, and every document with a repeat is
    in some pair, but not with each of its partners. Equal texts are tied to the
    least id among them without a comparison.

    Each window is first compared with one window of its value, drawn by a hash
    of the id. Where windows of a value then lie in no passage or belong to
    different components, those that agree with others in a second hash are
    compared with one window of their two values, and what is still open with all
    windows of the two values, in blocks: none is cut or held in one task.
    """
    spark = df.sparkSession
    ship(spark)
    width = words - SHINGLE + 1
    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null")
    n_words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    digests = cut(src.select("id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), n_words.alias("n")), "digests")
    several = digests.groupBy("id").agg(F.count(F.lit(1)).alias("rows"), F.min(F.struct("h1", "h2", "n")).alias("one"))
    again = cut(several.filter("rows > 1").select("id", "one.h1", "one.h2", "one.n"), "again")
    own = None
    if texts_apart and not again.isEmpty():
        # ids of several rows: each of their texts under a key of its own
        rows = digests.join(again.select("id"), "id").distinct()
        rows = rows.withColumn("texts", F.count(F.lit(1)).over(Window.partitionBy("id")))
        own = cut(rows.select("id", "h1", "h2", "n", F.when(F.col("texts") == 1, F.col("id")).otherwise(F.xxhash64("id", "h1", "h2")).alias("key")), "own")
        digests = cut(digests.join(again, "id", "left_anti").union(own.select("key", "h1", "h2", "n")), "digests")
        mine = src.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")}).join(own, ["id", "h1", "h2"])
        src = cut(src.join(again, "id", "left_anti").union(mine.select("key", "text").dropDuplicates(["key"])), "texts")
    elif not again.isEmpty():
        # ids of several rows: one row each
        digests = cut(digests.join(again, "id", "left_anti").union(again.select("id", "h1", "h2", "n")), "digests")
        mine = src.join(again.withColumnRenamed("n", "_n"), "id")
        mine = mine.filter((F.xxhash64("text") == F.col("h1")) & (F.xxhash64(F.lit(1), "text") == F.col("h2"))).select("id", "text").dropDuplicates(["id"])
        src = cut(src.join(again, "id", "left_anti").union(mine), "texts")
    reps = digests.groupBy("h1", "h2").agg(F.min("id").alias("p"), F.min("n").alias("n"))
    copies = digests.join(reps.drop("n"), ["h1", "h2"]).filter((F.col("id") > F.col("p")) & (F.col("n") >= words)).select("p", F.col("id").alias("q"), "n")
    kept = _shared_windows(src, reps.filter(F.col("n") >= words), width, least)
    src = cut(src.join(kept.select("id").distinct(), "id", "left_semi"), "texts")
    here = F.struct("id", "centre", "first", "last")
    apart = F.col("a.id") != F.col("b.id")
    tops = kept.groupBy("value").agg(F.min_by(here, F.struct(F.xxhash64("id"), "centre")).alias("a"))
    seeds = kept.select("value", "hash", here.alias("b")).join(tops, "value").filter(apart).select("a", "b", F.expr("shiftleft(1, hash)").alias("met"))
    near = _verified(src, _ranges(seeds, width), width, least)

    pairs = _agreeing(_marked(kept, near, components(near), ["value"]), width)
    pairs = cut(pairs, "agreeing")
    tops = pairs.groupBy("x", "y").agg(F.min_by(F.struct("id", "centre", "first", "last", "open"), F.struct("open", F.xxhash64("id", F.lit(1)), "centre")).alias("a"), F.count(F.lit(1)).alias("n"), F.max("open").alias("any")).filter("n > 1 and any")
    seeds = pairs.select("x", "y", F.struct("id", "centre", "first", "last", "open").alias("b")).join(tops, ["x", "y"]).filter(apart & (F.col("a.open") | F.col("b.open")))
    near = near.union(_verified(src, _ranges(seeds.select("a", "b", F.lit(3).alias("met")), width), width, least))
    groups_ = pairs.join(tops.filter("n > 2").select("x", "y"), ["x", "y"], "left_semi").drop("open", "label")
    open_ = cut(_apart(groups_, components(near), ["x", "y"]), "open")
    discard(spark, pairs._cut_path)
    if not open_.isEmpty():
        near = near.union(_in_blocks(src, open_, width, least))
    discard(spark, kept._cut_path)
    zero = F.lit(0).cast("long")
    near = near.union(copies.select("p", zero, "n", "q", zero, "n", F.lit(1.0)))
    if own is None:
        return near
    keys = own.filter("key <> id").select("key", F.col("id").alias("of"))
    for side in ("p", "q"):
        near = near.join(keys, F.col(side) == F.col("key"), "left").withColumn(side, F.coalesce("of", side)).drop("key", "of")
    ends = [F.struct(*[F.col(f"{s}{c}").alias(f"p{c}") for c in ("", "_first", "_words")]) for s in ("p", "q")]
    near = near.select(F.least(*ends).alias("a"), F.greatest(*ends).alias("b"), "similarity")
    return near.select("a.*", *[F.col(f"b.p{c}").alias(f"q{c}") for c in ("", "_first", "_words")], "similarity")


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each end of each pair, with the component of its document: one that has no row has no near-duplicate passage."""
    found = cut(near_passages(documents(spark, sf_dir), texts_apart=True).distinct(), "passages")
    one = found.select(F.col("p").alias("doc_id"), F.col("p_first").alias("first_word"), F.col("p_words").alias("n_words"), F.col("q").alias("other_doc_id"), F.col("q_first").alias("other_first_word"), F.col("q_words").alias("other_n_words"), "similarity")
    one = one.union(found.select("q", "q_first", "q_words", "p", "p_first", "p_words", "similarity"))
    return one.join(components(found).select(F.col("node").alias("doc_id"), F.col("component").alias("component_id")), "doc_id")
