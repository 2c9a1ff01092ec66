"""Name functions as column expressions: everything here stays inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no identity in a company name.
STOPWORDS = """ag america american and associates bv co companies company corp corporation enterprise
enterprises fund global gmbh group holding holdings inc incorporated industries international
intl lc limited llc llp lp ltd national nv of pa partners pc plc pte pty sa service services
solutions systems technologies technology the trust us usa worldwide""".split()

# Legal forms dropped anywhere in a roster name, as a pattern.
LEGAL_ANYWHERE = (
    r"\b(incorporated|corporation|company|limited|inc|corp|co|llc|llp|lp|ltd|plc|"
    r"pllc|pc|pa|na|sa|nv|bv|gmbh|ag|spa|srl|pty|pte|kk)\b"
)

# Legal forms dropped from the end of a registry name.
LEGAL_TRAILING = "inc incorporated llc llp lp ltd limited corp corporation co company plc gmbh sa nv ag lc pc".split()

# Words of an address that do not tell one from another.
STREET = """st street ave avenue rd road dr drive blvd boulevard ste suite fl floor n s e w north
south east west po box hwy highway pkwy parkway ln lane ct court cir circle way plaza unit""".split()

# Constructions that only a public body's name holds.
SOVEREIGN = (
    r"(?i)(\bgovernment of\b|\bgovt of\b|\brepublic of\b|\bkingdom of\b|\bstate of\b|"
    r"\bcommonwealth of\b|\bministry of\b|\bmunicipality of\b|\bprovince of\b|"
    r"^city of\b|^county of\b|\bunited states government\b)"
)

# Fragments that mark a line of a subsidiary list as no name.
LIST_NOISE = ["subsidiar", "jurisdiction", "state of", "incorporat", "exhibit", "registrant", "organization", "country", "percent", "ownership", "table of", "page ", "name of"]

Z95 = 1.96


def _words(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def toks(c: Column) -> Column:
    """All runs of a-z and 0-9 of the lower-cased text; null stays null."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def norm(c: Column) -> Column:
    return F.array_join(toks(c), " ")


def norm_compact(c: Column) -> Column:
    return F.array_join(toks(c), "")


def core(c: Column, longer_than: int = 2) -> Column:
    """Distinct tokens that are no stopword and longer than ``longer_than``."""
    return F.array_distinct(F.filter(toks(c), lambda t: (F.length(t) > longer_than) & ~F.array_contains(_words(STOPWORDS), t)))


def norm_roster(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", " "), r"\s+", " "))


def strip_legal(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(norm_roster(c), LEGAL_ANYWHERE, " "), r"\s+", " "))


def strip_trailing(c: Column) -> Column:
    return F.regexp_replace(norm(c), "(?:(?:^| )(?:" + "|".join(LEGAL_TRAILING) + "))+$", "")


def norm_address(c: Column) -> Column:
    """Tokens without street words, repeats kept; an empty text for null."""
    return F.array_join(F.filter(toks(F.coalesce(c, F.lit(""))), lambda t: ~F.array_contains(_words(STREET), t)), " ")


def digits(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\D", "")


def zip5(c: Column) -> Column:
    return F.left(digits(c), F.lit(5))


def _grams(s: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(s) - (n - 1)), lambda i: F.substring(s, i, F.lit(n)))


def qgrams(c: Column, q: int = 4) -> Column:
    """Distinct q-grams of the compact name; a shorter one is its own gram, an empty one has none."""
    s = norm_compact(c)
    return F.when(F.length(s) == 0, F.array().cast("array<string>")).when(F.length(s) < q, F.array(s)).otherwise(F.array_distinct(_grams(s, q)))


def char_ngrams(c: Column, n: int = 3) -> Column:
    """n-grams with repeats of the normalised name between two blanks on each side."""
    s = F.concat(F.lit("  "), norm(c), F.lit("  "))
    return F.when(F.length(s) < n, F.array().cast("array<string>")).otherwise(_grams(s, n))


def soundex(c: Column) -> Column:
    """Four characters; anything but letters is dropped first, and no letters give an empty code."""
    s = F.regexp_replace(F.lower(c), "[^a-z]", "")
    return F.when(F.length(s) == 0, F.lit("")).otherwise(F.soundex(s))


def block_key(c: Column) -> Column:
    """The least core token; names without one share the empty key."""
    return F.coalesce(F.array_min(core(c)), F.lit(""))


def phonetic_key(c: Column) -> Column:
    """Codes of the two least core tokens; null without core tokens."""
    two = F.slice(F.array_sort(core(c)), 1, 2)
    return F.when(F.size(two) > 0, F.array_join(F.transform(two, soundex), "|"))


def visibility(a: Column, b: Column) -> Column:
    """How much two names share: identical, visible or invisible."""
    return F.when(norm(a) == norm(b), "identical").when(F.arrays_overlap(core(a), core(b)), "visible").otherwise("invisible")


def exact_score(a: Column, b: Column) -> Column:
    return (norm(a) == norm(b)).cast("double")


def jaccard(a: Column, b: Column) -> Column:
    """Of the core sets; 0 if either is empty."""
    x, y = core(a), core(b)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(0.0)


def id_stem(c: Column) -> Column:
    return F.regexp_replace(c, "-[^-]*$", "")


def apart(a: Column, b: Column) -> Column:
    """Neither compact name holds the other, and both have characters."""
    x, y = norm_compact(a), norm_compact(b)
    return (F.length(x) > 0) & (F.length(y) > 0) & ~F.contains(x, y) & ~F.contains(y, x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def pct(k: Column, n: Column) -> Column:
    return F.coalesce(F.try_divide(100.0 * k, n), F.lit(0.0))


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """Bounds of the 95 per cent interval in per cent, clamped, 0 for no cases."""
    p = k / n
    d = 1 + Z95 * Z95 / n
    mid = (p + Z95 * Z95 / (2 * n)) / d
    half = Z95 * F.sqrt(p * (1 - p) / n + Z95 * Z95 / (4 * n * n)) / d
    low, high = 100 * F.greatest(F.lit(0.0), mid - half), 100 * F.least(F.lit(1.0), mid + half)
    return F.when(n > 0, low).otherwise(0.0), F.when(n > 0, high).otherwise(0.0)


def precision(tp: Column, fp: Column) -> Column:
    return F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))


def recall(tp: Column, fn: Column) -> Column:
    return F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """From counts, which is the harmonic mean of precision and recall."""
    return F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0))


def strip_html(c: Column) -> Column:
    out = F.regexp_replace(c, r"(?is)<(script|style).*?</\1>", " ")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>|</tr>|</p>|</div>", "\n")
    out = F.regexp_replace(out, r"(?i)</t[dh]>", "\t")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&#8217;", "'"), ("&rsquo;", "'"), ("&#38;", "&"), ("&quot;", '"')):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def list_names(html: Column) -> Column:
    """Cells of a subsidiary list that look like company names, in order."""
    cells = F.split(F.regexp_replace(strip_html(html), "[\n\r]+", "\t"), "\t")
    cells = F.transform(cells, lambda s: F.btrim(F.trim(F.regexp_replace(s, r"\s+", " ")), F.lit(" .,;:()[]|-_*")))

    def plausible(s: Column) -> Column:
        noise = F.lit(False)
        for k in LIST_NOISE:
            noise = noise | F.contains(F.lower(s), F.lit(k))
        return (F.length(s) > 3) & (F.length(s) < 120) & ~noise & F.rlike(s, F.lit("[A-Za-z]{3}")) & (F.length(F.regexp_replace(s, "[^0-9]", "")) <= F.length(s) * 0.4)

    return F.filter(cells, plausible)
