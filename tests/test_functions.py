"""Known values of the name functions and metrics."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from kintrace.functions import text as T
from kintrace.functions.udfs import seqratio


def one(spark, values, f):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    return [r[0] for r in df.select(f(F.col("s"))).collect()]


def test_tokens_and_norm(spark):
    assert one(spark, ["Blue-Sky, Inc.", "", None, "É A1"], T.norm) == ["blue sky inc", "", None, "a1"]
    assert [sorted(x) for x in one(spark, ["HOLDINGS LLC", "Ab The Blue Blue Sky"], T.core)] == [[], ["blue", "sky"]]
    assert [sorted(x) for x in one(spark, ["Ab The Blue"], lambda c: T.core(c, 1))] == [["ab", "blue"]]
    assert one(spark, ["HOLDINGS LLC", "zeta alpha"], T.block_key) == ["", "alpha"]


def test_suffixes(spark):
    assert one(spark, ["Co Master Trust Co Inc", "INC"], T.strip_trailing) == ["co master trust", ""]
    assert one(spark, ["Acme Co. of Ohio, LLC"], T.strip_legal) == ["acme of ohio"]


def test_grams_and_codes(spark):
    assert [sorted(x) for x in one(spark, ["ab c", "abcde", ""], T.qgrams)] == [["abc"], ["abcd", "bcde"], []]
    assert one(spark, ["Robert", "Tymczak", "ashcraft", "123", "honeyman"], T.soundex) == ["R163", "T522", "A261", "", "H555"]
    assert one(spark, ["12345-6789", None], T.zip5) == ["12345", ""]


def test_wilson_and_scores(spark):
    k, n = F.lit(834), F.lit(1393)
    low, high = T.wilson(k, n)
    z = T.wilson(F.lit(0), F.lit(637))
    r = spark.range(1).select(low, high, *z, T.precision(F.lit(1531), F.lit(42)), T.recall(F.lit(1531), F.lit(1212)), T.f1(F.lit(1531), F.lit(42), F.lit(1212))).first()
    assert [round(x, 2) for x in r[:4]] == [57.27, 62.41, 0.0, 0.6]
    assert [round(100 * x, 2) for x in r[4:]] == [97.33, 55.81, 70.95]


def test_seqratio(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abc ") for _ in range(rng.randrange(0, 14)))
    rows = [(word(), word()) for _ in range(300)] + [(None, "a"), ("x" * 250, "x" * 240 + "y")]
    df = spark.createDataFrame(rows, "a string, b string")
    for r in df.select("a", "b", seqratio(F.col("a"), F.col("b")).alias("s")).collect():
        assert r.s == pytest.approx(SequenceMatcher(None, r.a or "", r.b or "").ratio() if (r.a or "") != (r.b or "") else 1.0)


def test_sovereign(spark):
    got = one(spark, ["Republic Services Inc", "Kingdom of X", "The City of Y", "city of Y"], lambda c: F.rlike(c, F.lit(T.SOVEREIGN)))
    assert got == [False, True, False, True]


def test_list_names(spark):
    html = "<table><tr><td>Acme&nbsp;Holdings, LLC</td><td>Delaware</td></tr><tr><td>State of Incorporation</td><td>12345</td></tr></table><script>bad names</script>"
    assert one(spark, [html], T.list_names) == [["Acme Holdings, LLC", "Delaware"]]
