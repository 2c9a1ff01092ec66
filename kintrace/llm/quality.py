"""6. Quality rules as a learned decision list, with DataFrame functions only.

Statistics of labelled documents are cut at quantiles. Sequential covering
grows a conjunction of thresholds for the bad documents, prunes it on documents
it was not grown on, sets aside what it covers, and goes on. The rules come out
as one ordered conditional expression over the statistics.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, text_or_empty

#: The blanks that part words, and the symbols that are counted.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
#: Labelled documents that rules are learned from (expected number; chosen by a hash of the id).
SAMPLE = 12_000
#: Thresholds tried for each statistic.
CUTS = 24
#: Rules of a list, and conditions of a rule, at most.
MAX_RULES, MAX_CONDITIONS = 10, 3
#: A rule must be right so often on the documents it is pruned on.
LEAST_PRECISION = 0.95
#: Words up to which a word's place fits beside its window's hash in 64 bits.
PACKED_WORDS = 1 << 20

STATISTICS = ["n_words", "n_symbols", "n_dup_lines", "n_repeat_words", "symbol_share", "capital_share", "mark_share", "bar_share", "dup_line_share", "repeat_share", "mean_word"]


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def word_array(text: Column) -> Column:
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(bare) > 0, F.split(bare, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def _repeated(w: Column, size: int, entry, place, alike) -> Column:
    """Words in windows of ``size`` that occur twice or more; windows are sorted by hash and neighbours compared."""
    n = F.size(w) - (size - 1)
    entries = F.sort_array(F.transform(F.sequence(F.lit(0), n - 1), lambda i: entry(F.xxhash64(*[F.get(w, i + k) for k in range(size)]), i)))

    def same(a: Column, b: Column) -> Column:
        words = alike(a, b)
        for k in range(size):
            words = words & (F.get(w, place(a) + k) == F.get(w, place(b) + k))
        return F.coalesce(words, F.lit(False))

    def places(s: Column) -> Column:
        hit = F.filter(F.sequence(F.lit(0), n - 1), lambda j: same(F.get(s, j), F.get(s, j + 1)) | same(F.get(s, j), F.get(s, j - 1)))
        return F.sort_array(F.transform(hit, lambda j: place(F.get(s, j))))

    def covered(p: Column) -> Column:
        gaps = F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda a, b: F.when(a.isNotNull(), F.least(F.lit(size), F.coalesce(b - a, F.lit(size)))).otherwise(0))
        return F.aggregate(gaps, F.lit(0), lambda acc, x: acc + x)

    return F.when(n < 2, F.lit(0)).otherwise(_let(_let(entries, places), covered))


def repeat_words(words: Column, size: int = 3) -> Column:
    """Words of ``words`` that stand in a window of ``size`` words found twice or more, the first included."""
    low = PACKED_WORDS - 1
    packed = lambda w: _repeated(
        w, size,
        lambda h, i: h.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")),
        lambda e: e.bitwiseAND(F.lit(low)).cast("int"),
        lambda a, b: a.bitwiseAND(F.lit(~low)) == b.bitwiseAND(F.lit(~low)),
    )
    wide = lambda w: _repeated(w, size, lambda h, i: F.struct(h.alias("h"), i.alias("i")), lambda e: e["i"], lambda a, b: a["h"] == b["h"])
    return _let(words, lambda w: F.when(F.size(w) <= low, packed(w)).otherwise(wide(w)))


def statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df``'s columns ``doc_id`` and, per whole text, the counts and shares that rules are made of."""
    t = text_or_empty(text_col)
    out = df.select("doc_id", t.alias("t"))
    lines = F.filter(F.split("t", "\n"), lambda s: F.length(F.btrim(s, F.lit(BLANKS))) > 0)
    lone = F.translate("t", BLANKS, "")
    out = out.select(
        "doc_id",
        F.regexp_count("t", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_words"),
        F.length(lone).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"), F.size(x).alias("n"))).alias("l"),
        repeat_words(word_array(F.col("t"))).cast("long").alias("n_repeat_words"),
        (F.length("t") - F.length(F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).alias("capitals"),
        (F.length("t") - F.length(F.translate("t", "!", ""))).alias("marks"),
        (F.length("t") - F.length(F.translate("t", "|", ""))).alias("bars"),
    )
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", F.col("l.dup").alias("n_dup_lines"), "n_repeat_words",
        share(F.col("n_symbols"), F.col("word_chars")).alias("symbol_share"), share(F.col("capitals"), F.col("word_chars")).alias("capital_share"),
        share(F.col("marks"), F.col("n_words")).alias("mark_share"), share(F.col("bars"), F.col("n_words")).alias("bar_share"),
        share(F.col("l.dup"), F.col("l.n")).alias("dup_line_share"), share(F.col("n_repeat_words"), F.col("n_words")).alias("repeat_share"),
        share(F.col("word_chars"), F.col("n_words")).alias("mean_word"),
    )


#: A condition: (statistic, True for at least / False for below, threshold). A rule is a list of them.
Rule = list[tuple[str, bool, float]]


def _covers(rule: Rule, row: dict) -> bool:
    return all((row[s] >= cut) == above for s, above, cut in rule)


def learn_rules(rows: list[dict], statistics: list[str] = STATISTICS) -> list[Rule]:
    """Sequential covering over rows of statistics with ``bad`` (0/1) and ``grow`` (True: grown on, False: pruned on)."""
    cuts = {}
    for s in statistics:
        values = sorted({r[s] for r in rows})
        step = max(1, len(values) // CUTS)
        cuts[s] = sorted({*values[1::step], *values[-1:]})
    left, rules = rows, []
    while len(rules) < MAX_RULES:
        grow, prune = [r for r in left if r["grow"]], [r for r in left if not r["grow"]]
        rule = _grow(grow, cuts)
        if not rule:
            break
        rule = _prune(rule, prune or grow)
        hit = [r for r in (prune or grow) if _covers(rule, r)]
        if not hit or sum(r["bad"] for r in hit) < LEAST_PRECISION * len(hit):
            break
        rules.append(rule)
        left = [r for r in left if not _covers(rule, r)]
    return rules


def _grow(rows: list[dict], cuts: dict[str, list[float]]) -> Rule:
    """Conditions are added by gain of information on the bad rows covered."""
    rule: Rule = []
    covered = rows
    while len(rule) < MAX_CONDITIONS:
        bad = sum(r["bad"] for r in covered)
        if not bad or bad == len(covered):
            break
        now, best = math.log2(bad / len(covered)), (0.0, None)
        for s, thresholds in cuts.items():
            for cut in thresholds:
                n_above = p_above = 0
                for r in covered:
                    if r[s] >= cut:
                        n_above += 1
                        p_above += r["bad"]
                for above, n, p in ((True, n_above, p_above), (False, len(covered) - n_above, bad - p_above)):
                    if p:
                        gain = p * (math.log2(p / n) - now)
                        if gain > best[0] + 1e-12:
                            best = (gain, (s, above, cut))
        if best[1] is None:
            break
        rule.append(best[1])
        covered = [r for r in covered if _covers([best[1]], r)]
    return rule


def _prune(rule: Rule, rows: list[dict]) -> Rule:
    """The prefix of the rule that is worth most on rows it was not grown on."""

    def worth(r: Rule) -> float:
        hit = [x["bad"] for x in rows if _covers(r, x)]
        return (2 * sum(hit) - len(hit)) / len(hit) if hit else -1.0

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)


def verdict(rules: list[Rule]) -> Column:
    """The ordered conditional expression: false for the first rule that holds, true if none does."""
    out = None
    for rule in rules:
        cond = F.lit(True)
        for s, above, cut in rule:
            cond = cond & ((F.col(s) >= F.lit(cut)) if above else (F.col(s) < F.lit(cut)))
        out = F.when(cond, F.lit(False)) if out is None else out.when(cond, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """Rules from about ``sample`` labelled documents; that many rows of statistics at most reach the driver."""
    rows = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    n = rows.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1_000_000))
    chosen = rows.filter(draw < int(1_000_000 * min(1.0, sample / max(1, n))) + (n <= sample)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    some = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # bounded by ``sample``
    stats = statistics(some).join(F.broadcast(chosen), "doc_id")
    got = stats.select(*STATISTICS, (F.col("quality") == 0).cast("int").alias("bad"), (F.pmod(F.xxhash64("doc_id", F.lit("prune")), F.lit(3)) > 0).alias("grow")).collect()
    return learn_rules([r.asDict() for r in sorted(got)])


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rules = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    stats = statistics(docs)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"))
