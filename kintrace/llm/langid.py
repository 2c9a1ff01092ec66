"""9. Language identification by words, with spans of mixed text.

A word's script names its candidate languages; character n-grams score it in
each. Viterbi over the words of a document, with a penalty for each switch,
labels every word; the labels' runs are the spans.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, free_name, ship, text_or_empty

#: Documents that are learned from, per language (expected number; chosen by a hash of the id).
TRAIN_DOCS = 2_000
#: N-grams kept of each language, its most frequent ones.
MAX_GRAMS = 20_000
#: Nats that a switch of language costs.
SWITCH = 14.0
#: Distinct words whose scores a Python worker keeps.
MEMO_WORDS = 150_000
#: A script's words must be so much of a language's, or the language is no candidate for it.
SCRIPT_SHARE = 0.01
UNKNOWN = "und"

#: Words from which on a text's path is found in blocks.
LONG_TEXT = 1_000
#: A blank for every code point of one byte that is no letter; none of them is a mark.
ONE_BYTE = bytes(c if unicodedata.category(chr(c))[0] == "L" else 0x20 for c in range(256))


@cache
def _letters() -> re.Pattern:
    """Runs that begin with a letter (Unicode category L) and go on with letters and the marks on them (M)."""
    kinds = {"L": [], "M": []}
    for code in range(sys.maxunicode + 1):
        found = kinds.get(unicodedata.category(chr(code))[0])
        if found is not None:
            if found and found[-1][1] == code - 1:
                found[-1][1] = code
            else:
                found.append([code, code])
    letter, mark = ("".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in kinds[k]) for k in "LM")
    return re.compile(f"[{letter}][{letter}{mark}]*")


def words_of(text: str) -> list[str]:
    """The words of a text, in lower case."""
    text = text.lower()
    try:
        return text.encode("latin-1").translate(ONE_BYTE).decode("latin-1").split()
    except UnicodeEncodeError:
        return _letters().findall(text)


#: First and last code point, script.
SCRIPTS = [
    (0x41, 0x24F, "latin"), (0x1E00, 0x1EFF, "latin"), (0x370, 0x3FF, "greek"), (0x1F00, 0x1FFF, "greek"),
    (0x400, 0x52F, "cyrillic"), (0x530, 0x58F, "armenian"), (0x590, 0x5FF, "hebrew"), (0x600, 0x77F, "arabic"),
    (0x900, 0x97F, "devanagari"), (0x980, 0x9FF, "bengali"), (0xB80, 0xBFF, "tamil"), (0xE00, 0xE7F, "thai"),
    (0x10A0, 0x10FF, "georgian"), (0x3040, 0x30FF, "kana"), (0x4E00, 0x9FFF, "han"), (0x3400, 0x4DBF, "han"), (0xAC00, 0xD7AF, "hangul"),
]


def script_of(word: str) -> str:
    code = ord(word[0])
    return next((name for low, high, name in SCRIPTS if low <= code <= high), "other")


def grams(word: str) -> list[str]:
    """Runs of two and three characters, the word's ends marked, and the word itself."""
    w = f"<{word}>"
    out = [w[i : i + 3] for i in range(len(w) - 2)] + [w[i : i + 2] for i in range(len(w) - 1)]
    if len(w) > 3:
        out.append(w)
    return out


@dataclass
class Model:
    """Log probabilities of n-grams by language, and the candidates of each script."""

    langs: list[str]
    index: dict[str, int]
    table: np.ndarray  # a row per n-gram, and one for those unseen
    scripts: dict[str, list[int]]


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text leaves 2 modulo 4; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: Counter = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = Counter(words_of(text))
            for word, n in words.items():
                seen[lang, "\t" + script_of(word)] += n
                for g in grams(word):
                    seen[lang, g] += n
        yield pa.RecordBatch.from_pydict({"lang": [k[0] for k in seen], "gram": [k[1] for k in seen], "n": pa.array(seen.values(), pa.int64())})


def learn(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", usable: Column | None = None, per_lang: int = TRAIN_DOCS) -> Model:
    """Fit a model on labelled rows, about ``per_lang`` of each language, chosen by a hash of the id.

    ``usable`` restricts the rows (by default those that are not held out). Rows
    with a null language, id or text are not learned from. What reaches the
    driver is bounded by ``MAX_GRAMS`` rows a language. Rows that share an id are
    taken or left together; equal rows count each; ties in frequency go by n-gram.
    """
    ship(df.sparkSession)
    usable = ~held_out(id_col) if usable is None else usable
    rows = df.filter(usable & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}  # a row per language
    langs = sorted(counts)
    if not langs:
        return Model([], {}, np.zeros((1, 0), "f4"), {})
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit("langid")), F.lit(1_000_000))
    take = F.lit(False)
    for lang in langs:
        take = take | ((F.col(lang_col) == lang) & (draw < int(1_000_000 * min(1.0, per_lang / counts[lang])) + 1))
    seen = rows.filter(take).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(_count, "lang string, gram string, n long")
    seen = seen.groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    seen = seen.withColumn("script", F.col("gram").startswith("\t"))
    rank = F.row_number().over(Window.partitionBy("lang", "script").orderBy(F.col("n").desc(), "gram"))
    # the most frequent of each language, with their counts in all languages
    seen = seen.withColumn("top", F.col("script") | (rank <= MAX_GRAMS))
    by_gram = seen.groupBy("gram").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"), F.max("top").alias("top"))
    kept = by_gram.filter("top").select("gram", "by").orderBy("gram").collect()
    at = {lang: i for i, lang in enumerate(langs)}
    index, table, scripts = {}, [], {}
    for r in kept:
        row = np.zeros(len(langs))
        for lang, n in r.by.items():
            row[at[lang]] = n
        if r.gram.startswith("\t"):
            scripts[r.gram[1:]] = row
        else:
            index[r.gram] = len(table)
            table.append(row)
    n = np.array(table).reshape(len(table), len(langs)) + 0.5
    log = np.log(np.vstack([n, np.full((1, len(langs)), 0.5)])) - np.log(n.sum(0))
    words = np.sum([*scripts.values()], axis=0) if scripts else np.ones(len(langs))
    near = {s: [i for i in range(len(langs)) if row[i] >= SCRIPT_SHARE * max(1.0, words[i])] for s, row in scripts.items()}
    return Model(langs, index, log.astype("f4"), near)


class Numbers(dict):
    """Numbers of words by first use; ``new`` holds those not scored yet."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


class Runs:
    """Rows of the n-grams of one length, looked up for many words at once."""

    def __init__(self, model: Model, length: int):
        mine = [g for g in model.index if len(g) == length]
        keys = self.pack(np.array([[ord(c) for c in g] for g in mine], "i8").reshape(len(mine), length).T)
        order = np.argsort(keys)
        self.keys, self.rows = keys[order], np.array([model.index[g] for g in mine], "i8")[order]
        self.rest = len(model.table) - 1

    @staticmethod
    def pack(codes: np.ndarray) -> np.ndarray:
        """21 bits hold any code point."""
        out = codes[0]
        for c in codes[1:]:
            out = out << 21 | c
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), self.rest)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rows[at], self.rest)


class Scorer:
    """Scores of words, remembered; words are numbered by first use."""

    def __init__(self, model: Model):
        self.model, self.number = model, Numbers()
        self.two, self.three = Runs(model, 2), Runs(model, 3)
        #: scripts that only some languages use, and whether the plain Latin one is known at all
        self.partial = {s: near for s, near in model.scripts.items() if near and len(near) < len(model.langs)}
        self.common = bool(model.scripts.get("latin"))
        self.scores = np.empty((1024, len(model.langs)), "f4")

    def score(self, words: list[str]) -> np.ndarray:
        """A row per word, 0 for its best language."""
        m = self.model
        out = np.add.reduceat(m.table[self.rows_of(words)], self.starts(words), axis=0)
        for script, near in self.partial.items():
            mine = [i for i, w in enumerate(words) if script_of(w) == script]
            far = np.setdiff1d(np.arange(len(m.langs)), near)
            out[np.ix_(mine, far)] = out[mine].min(1, keepdims=True) - 50.0
        if not self.common:
            out[[i for i, w in enumerate(words) if script_of(w) not in m.scripts or not m.scripts[script_of(w)]]] = 0.0
        else:
            out[[i for i, w in enumerate(words) if ord(w[0]) > 0x24F and not m.scripts.get(script_of(w))]] = 0.0
        return out - out.max(1, keepdims=True)

    @staticmethod
    def starts(words: list[str]) -> np.ndarray:
        """Where the n-grams of each word begin: a word of n characters has n of three, n + 1 of two, and itself if n > 1."""
        n = np.fromiter(map(len, words), "i8", len(words))
        many = 2 * n + 1 + (n > 1)
        return np.cumsum(many) - many

    def rows_of(self, words: list[str]) -> np.ndarray:
        """The table's rows of the ``grams`` of all words, word after word."""
        codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), "<u4").astype("i8")
        n = np.fromiter(map(len, words), "i8", len(words))
        size, starts = n + 2, self.starts(words)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size)
        left = np.repeat(size, size) - place  # characters from here to the word's end
        begin = np.repeat(starts, size) + place
        out = np.empty(int(starts[-1] + 2 * n[-1] + 1 + (n[-1] > 1)), "i8")
        three, two = np.flatnonzero(left >= 3), np.flatnonzero(left >= 2)
        out[begin[three]] = self.three.find(Runs.pack([codes[three], codes[three + 1], codes[three + 2]]))
        out[begin[two] + np.repeat(n, size)[two]] = self.two.find(Runs.pack([codes[two], codes[two + 1]]))
        whole = np.flatnonzero(n > 1)
        known, rest = self.model.index.get, self.two.rest
        out[(starts + 2 * n + 1)[whole]] = [known(f"<{words[i]}>", rest) for i in whole]
        return out

    def scores_of(self, texts: list[list[str]]) -> np.ndarray:
        """A row per word of all texts."""
        known = self.number
        if len(known) > MEMO_WORDS:
            known.clear()
        numbers = np.fromiter(map(known.__getitem__, chain.from_iterable(texts)), "i4", sum(map(len, texts)))
        new, known.new = known.new, []
        first = len(known) - len(new)
        while len(known) > len(self.scores):
            self.scores = np.concatenate([self.scores, np.empty_like(self.scores)])
        for k in range(0, len(new), 5_000):
            part = new[k : k + 5_000]
            self.scores[first + k : first + k + len(part)] = self.score(part)
        return self.scores[numbers]


def viterbi(scores: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of each word. Documents stand one after another; all advance together by one word.

    Texts of ``LONG_TEXT`` words or more are taken one by one, in blocks. Of equal
    languages the first is taken.
    """
    path = np.zeros(len(scores), "i2")
    ends = np.cumsum(sizes)
    large = sizes >= LONG_TEXT
    for k in np.flatnonzero(large):
        at = slice(int(ends[k] - sizes[k]), int(ends[k]))
        path[at] = _blocks(scores[at], penalty)
    if large.any():
        rest = ~np.repeat(large, sizes)
        path[rest] = _together(scores[rest], sizes[~large], penalty)
        return path
    return _together(scores, sizes, penalty)


def _blocks(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The path of one long text. All blocks advance together, first from every language, which links their ends, then along the path."""
    n, n_lang = scores.shape
    size = int(np.ceil(np.sqrt(n)))
    count = -(-n // size)
    # rows of zeros at the end prefer nothing
    blocks = np.zeros((count * size, n_lang))
    blocks[:n] = scores
    blocks = blocks.reshape(count, size, n_lang)
    through = np.full((count, n_lang, n_lang), -np.inf)
    through[:, np.arange(n_lang), np.arange(n_lang)] = blocks[:, 0]
    for t in range(1, size):
        through = np.maximum(through, through.max(2, keepdims=True) - penalty) + blocks[:, t][:, None]
    enter = np.zeros((count, n_lang))
    last = np.zeros((count, n_lang))
    for k in range(count):
        if k:
            enter[k] = np.maximum(last[k - 1], last[k - 1].max() - penalty)
        last[k] = (enter[k][:, None] + through[k]).max(0)
    final = np.zeros(count, "i2")
    final[-1] = last[-1].argmax()
    for k in range(count - 1, 0, -1):
        first = int((enter[k] + through[k][:, final[k]]).argmax())
        final[k - 1] = first if last[k - 1][first] >= last[k - 1].max() - penalty else last[k - 1].argmax()
    return _together(blocks.reshape(-1, n_lang), np.full(count, size), penalty, enter, final)[:n]


def _together(scores: np.ndarray, sizes: np.ndarray, penalty: float, enter: np.ndarray | None = None, leave: np.ndarray | None = None) -> np.ndarray:
    """The best paths; ``enter`` is what each language has before a document's first word, ``leave`` the language of its last one."""
    n, n_lang = scores.shape
    path = np.zeros(n, "i2")
    if n == 0:
        return path
    order = np.argsort(-sizes, kind="stable")
    starts = (np.cumsum(sizes) - sizes)[order]
    ordered = sizes[order]
    longest = int(ordered[0])
    alive = np.searchsorted(-ordered, -np.arange(longest), side="left")
    best, moved = np.zeros(n, "i2"), np.zeros((n, n_lang), bool)
    final = np.zeros(len(starts), "i2")
    state = scores[starts[: alive[0]]].astype("f8")
    if enter is not None:
        state += enter[order[: alive[0]]]
    for t in range(1, longest):
        k = alive[t]
        if k < len(state):
            final[k : len(state)] = state[k:].argmax(1)
            state = state[:k]
        at = starts[:k] + t
        top = state.argmax(1)
        jump = (state[np.arange(k), top] - penalty)[:, None]
        best[at] = top
        moved[at] = state < jump
        state = np.maximum(state, jump) + scores[at]
    final[: len(state)] = state.argmax(1)
    now = final if leave is None else leave[order].copy()
    for t in range(longest - 1, -1, -1):
        k = alive[t]
        at, here = starts[:k] + t, now[:k]
        path[at] = here
        if t:
            now[:k] = np.where(moved[at, here], best[at], here)
    return path


def detect(df: DataFrame, model: Model, text_col: str = "text", penalty: float = SWITCH, lang_col: str = "lang_pred", score_col: str = "score", spans_col: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Add the language with most letters on the best path, and its share of all letters.

    A null text and one without letters get ``und`` and score 0. ``spans_col``
    adds the runs of one language as structs (lang, first_word, words), counted
    in words (a letter and the letters and marks that follow). ``keep`` names the columns to carry, all by default;
    clashing names get underscores. A model without languages gives ``und``, an
    empty table no rows; equal texts get equal rows.
    """
    spark = df.sparkSession
    ship(spark)
    keep = df.columns if keep is None else keep
    kept = df.select(*[F.col(f"`{c}`") for c in keep])
    lang_col, score_col = free_name(kept, lang_col), free_name(kept, score_col)
    out = kept.withColumn(lang_col, F.lit("")).withColumn(score_col, F.lit(0.0))
    if spans_col:
        spans_col = free_name(out, spans_col)
        out = out.withColumn(spans_col, F.array(F.struct(F.lit("").alias("lang"), F.lit(0).cast("long").alias("first_word"), F.lit(0).cast("long").alias("words"))))
    shared = spark.sparkContext.broadcast(model)  # at most MAX_GRAMS rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        langs = shared.value.langs
        for whole in batches:
            for first in range(0, whole.num_rows, 2_000):
                batch = whole.slice(first, 2_000)
                at = batch.num_columns - 1
                texts = [words_of(t) for t in batch.column(at).to_pylist()]
                if not langs:
                    texts = [[] for _ in texts]
                sizes = np.array([len(w) for w in texts], "i8")
                path = viterbi(scorer.scores_of(texts), sizes, penalty)
                letters = np.fromiter(map(len, chain.from_iterable(texts)), "i8", int(sizes.sum()))
                doc, wide = np.repeat(np.arange(len(texts)), sizes), max(1, len(langs))
                share = np.bincount(doc * wide + path, letters, len(texts) * wide).reshape(len(texts), wide)
                total = share.sum(1)
                top = share.argmax(1)
                found = [langs[k] if n else UNKNOWN for k, n in zip(top, total, strict=True)]
                score = np.where(total > 0, share.max(1) / np.maximum(total, 1), 0.0)
                cols = [batch.column(i) for i in range(at)] + [pa.array(found), pa.array(score)]
                names = [*keep, lang_col, score_col]
                if spans_col:
                    cols.append(pa.array(_spans(path, sizes, langs), pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("words", pa.int64())]))))
                    names.append(spans_col)
                yield pa.RecordBatch.from_arrays(cols, names)

    body = free_name(kept, "_body")
    return df.select(*[F.col(f"`{c}`") for c in keep], text_or_empty(f"`{text_col}`").alias(body)).mapInArrow(run, out.schema)


def _spans(path: np.ndarray, sizes: np.ndarray, langs: list[str]) -> list[list[dict]]:
    out, base = [], 0
    for n in sizes:
        p = path[base : base + n]
        base += n
        cuts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]]) if n else np.empty(0, int)
        ends = np.r_[cuts[1:], n]
        out.append([{"lang": langs[p[c]], "first_word": int(c), "words": int(e - c)} for c, e in zip(cuts, ends, strict=False)])
    return out


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` by the contract of the query; nulls and ties as ``learn`` and ``detect`` say."""
    docs = documents(spark, sf_dir)
    found = detect(docs.select("doc_id", "text"), learn(docs), keep=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_known(df: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """The rows of ``df`` whose language is found with at least that share of the letters; columns as before."""
    found = detect(df, model, lang_col="_lang_pred", score_col="_score")
    lang, score = found.columns[-2:]
    return found.filter((F.col(lang) != UNKNOWN) & (F.col(score) >= least)).select(*[F.col(f"`{c}`") for c in df.columns])
