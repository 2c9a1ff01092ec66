"""Operators on small literal frames: ties, nulls, empty tables, invariants."""

import datetime
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from kintrace.operators import benchmark, blocking, corroborate, evaluate, graph, links, match
from kintrace.sources import readers
from kintrace.streaming import links as stream


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 470)] + [(999, 999)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in list(parent)}
    assert rows(graph.connected_components(spark.createDataFrame([(None, 1)], "a long, b long"), "a", "b")) == []


def test_parent_mode_ties(spark):
    data = [(1, 5, 2, 10.0), (1, 6, 2, 20.0), (1, None, 1, 99.0), (2, None, 3, 0.0), (2, 7, 3, 0.0), (3, 8, 1, 5.0), (3, 9, 2, 1.0)]
    c = spark.createDataFrame(data, "uei long, puei long, n long, amt double")
    assert rows(links.parent_mode(c).select("uei", F.coalesce("puei", F.lit(-1)), "parents")) == [(1, 6, 2), (2, -1, 1), (3, 9, 2)]
    assert rows(links.parent_mode(c, amount_first=True).select("uei", F.coalesce("puei", F.lit(-1)))) == [(1, -1), (2, -1), (3, 8)]


def test_weighted_mode(spark):
    r = spark.createDataFrame([(1, "a", 0.0), (1, "b", -3.0), (1, " ", 50.0), (2, None, 1.0)], "k long, f string, w double")
    assert [tuple(x) for x in links.weighted_mode(r, "k", ["f"], "w").select("k", "value", "n_values").collect()] == [(1, "b", 2)]


def test_split_fold(spark):
    rng = random.Random(1)
    sizes = [(i, rng.randrange(1, 40)) for i in range(200)]
    got = dict(rows(benchmark.split_components(spark.createDataFrame(sizes, "component long, size long"))))
    total = sum(s for _, s in sizes)
    target, filled = {"train": 0.6 * total, "val": 0.2 * total, "test": 0.2 * total}, dict.fromkeys(("train", "val", "test"), 0.0)
    for c, s in sorted(sizes, key=lambda x: (-x[1], x[0])):
        best = max(target, key=lambda k: (target[k] - filled[k]) / target[k])
        assert got[c] == best
        filled[best] += s


def test_block_cap_and_neighbourhood(spark):
    e = spark.createDataFrame([(i, "shared" if i < 5 else f"name{i:03d}") for i in range(40)], "uei long, name string")
    assert blocking.by_keys(e, "token", cap=4).count() == 0
    assert blocking.by_keys(e, "token", cap=5).count() == 10
    assert blocking.sorted_neighbourhood(e, 20).count() == 40 * 19 - 190


def test_average_precision_ignores_order(spark):
    data = [("s", 0.9, 1), ("s", 0.5, 0), ("s", 0.5, 1), ("s", 0.5, 1), ("s", 0.1, 0)]
    ap = [evaluate.average_precision(spark.createDataFrame(x, "scorer string, score double, label int")).first().ap for x in (data, data[::-1])]
    assert ap[0] == ap[1] == pytest.approx(1 / 3 + 3 / 4 * 2 / 3)


def test_match_rule_order(spark):
    kids = spark.createDataFrame([(1, "Blue Aerospace LLC", 1, "v"), (2, "Red", 1, "v"), (3, "Holdings LLC", 1, "v"), (4, "Green Tree Nut", 1, "v")], "uei long, name string, fam long, vis string")
    subs = spark.createDataFrame([(1, ["Blue Aerospace Group Nord", "BLUE AEROSPACE, LLC.", "Red Fox", "Nut Tree Green", "Green Tree Nut Oil"])], "fam long, subs array<string>")
    assert rows(corroborate.match_children(kids, subs).select("uei", F.coalesce("rule", F.lit("-")))) == [(1, "exact_normalised"), (2, "-"), (3, "-"), (4, "same_core_tokens")]


def test_next_size(spark):
    f = spark.createDataFrame([(1, 5), (2, 9), (3, 5)], "fam long, n int")
    assert rows(corroborate.next_size(f)) == [(1, 3), (2, 3), (3, 2)]


def test_readers(spark, tmp_path):
    body = 'Recipient_UEI,recipient_name,recipient_parent_uei,federal_action_obligation\nA,"x, ""y""\nz",P,1.5\nB\n,no,P,1\n'
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("one.csv", body)
        z.writestr("two.csv", "other\n1\n")
        z.writestr("note.txt", "-")
    paths = readers.unzip_members(str(tmp_path / "a.zip"), str(tmp_path))
    df, skipped = readers.read_awards(spark, paths)
    assert len(skipped) == 1 and skipped[0].endswith("two.csv")
    assert sorted((r.uei, r.parent_uei, r.amount) for r in df.collect()) == [("A", "P", 1.5), ("B", None, 0.0)]
    assert readers.read_awards(spark, [])[0].count() == 0
    (tmp_path / "m.json").write_text(json.dumps({"a|b": "2020-01-01"}))
    assert rows(readers.read_map(spark, str(tmp_path / "m.json"))) == [("a|b", "2020-01-01")]
    readers.write_jsonl(df.select("uei"), str(tmp_path / "out"))
    assert rows(readers.read_jsonl(spark, str(tmp_path / "out"), "uei string")) == [("A",), ("B",)]


def test_preferred_and_remaining(spark):
    r = spark.createDataFrame([("k", "P", 1), ("k", "C", 2), ("k", "C", 3), ("m", "P", 4), ("m", "R", 5)], "id string, recipient_level string, at long")
    assert rows(readers.preferred_records(r, "id", "at").select("id", "at")) == [("k", 3), ("m", 4)]
    assert rows(readers.remaining(r.select("id").distinct(), spark.createDataFrame([("m",)], "id string"), "id")) == [("k",)]


def test_digest_ignores_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "i long, s string")
    assert rows(readers.dataset_digest(a)) == rows(readers.dataset_digest(a.orderBy(F.desc("i"))))


def test_conservative_keeps_undated(spark):
    p = spark.createDataFrame([(1, 2, 1), (3, 4, 1), (5, 6, 1), (1, 6, 0), (1, 4, 0)], "left_uei long, right_uei long, label int")
    d = spark.createDataFrame([(3, 4, datetime.date(2020, 1, 1)), (5, 6, datetime.date(2023, 1, 1))], "left_uei long, right_uei long, first_day date")
    assert rows(benchmark.conservative(p, d, "2022-04-04").select("left_uei", "right_uei")) == [(1, 2), (1, 6), (5, 6)]


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, 2, 5.0, datetime.date(2020, 1, 2)), (1, 2, 6.0, datetime.date(2020, 1, 1))], "uei long, puei long, amount double, day date").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("uei long, puei long, amount double, day date").parquet(str(tmp_path / "in"))
    stream.start(stream.running_pair_counts(s), "counts", str(tmp_path / "cp")).awaitTermination()
    assert rows(spark.table("counts")) == [(1, 2, 2, 11.0, datetime.date(2020, 1, 1))]


def test_placed_counts_and_sums_within_groups(spark):
    from pyspark.sql import functions as F

    from kintrace.operators.order import placed

    data = [(g, i, (i * 7 + len(g or "")) % 11) for g in ("a", "bb", None) for i in range(0 if g == "bb" else 500)] + [("bb", 1, 5)]
    got = placed(spark.createDataFrame(data, "g string, i long, v long").repartition(7), [F.col("v").desc(), F.col("i")], ["g"], ["v"])
    want = []
    for g in ("a", "bb", None):
        total = 0
        for place, (_, i, v) in enumerate(sorted((r for r in data if r[0] == g), key=lambda r: (-r[2], r[1])), 1):
            total += v
            want.append((g, i, v, place, total))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    empty = spark.createDataFrame([], "g string, i long, v long")
    assert placed(empty, [F.col("i")], ["g"], ["v"]).columns == ["g", "i", "v", "pos", "run_v"] and placed(empty, [F.col("i")]).count() == 0


def test_split_of_many_equal_sizes_by_plain_fold(spark, monkeypatch):
    from kintrace.operators import benchmark

    monkeypatch.setattr(benchmark, "CHUNK", 16)
    sizes = [(i, 1 + (i % 3 == 0) + 40 * (i % 50 == 0)) for i in range(1, 301)]
    total = float(sum(n for _, n in sizes))
    wants, filled, want = [s * total for _, s in benchmark.SHARES], [0.0] * 3, {}
    for c, n in sorted(sizes, key=lambda r: (-r[1], r[0])):
        lacks = [(w - f) / w for w, f in zip(wants, filled)]
        best = lacks.index(max(lacks))
        filled[best] += n
        want[c] = benchmark.SHARES[best][0]
    assert dict(map(tuple, benchmark.split_components(spark.createDataFrame(sizes, "component long, size long")).collect())) == want


def test_nearest_takes_ties_by_id(spark):
    import numpy as np

    from kintrace.operators.blocking import nearest

    rng = np.random.default_rng(3)
    vectors = rng.integers(-1, 2, (60, 4)).astype(float)
    got = nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>"), k=5, block=16)
    sims = vectors @ vectors.T
    want = {(x, y, r) for x in range(60) for r, y in enumerate(sorted((y for y in range(60) if y != x), key=lambda y: (-sims[x, y], y))[:5], 1)}
    assert {(r["x"], r["y"], r["rank"]) for r in got.collect()} == want


def test_cosine_forest(spark, monkeypatch):
    """Blocks of few names and columns give the components of all pairs, none of which is written."""
    monkeypatch.setattr(match, "BLOCK", 7, raising=False)
    monkeypatch.setattr(match, "COLUMNS", 40, raising=False)
    rng = random.Random(3)
    stems = ["acme tool", "borel mining", "cobalt works", "delta foods"]
    names = [rng.choice(stems) + " " + "".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    e = spark.createDataFrame([(f"u{i:03}", n) for i, n in enumerate([*names, names[0], names[1], "zz", "zz"])] + [("null", None)], "uei string, name string")
    idf = match.fit_idf(e.filter("uei < 'u040'"))
    pairs = e.alias("x").join(e.alias("y"), F.col("x.uei") < F.col("y.uei")).selectExpr("x.uei as a", "y.uei as b", "x.name as left_name", "y.name as right_name").filter("left_name is not null and right_name is not null")
    scores = match.tfidf(pairs, idf).select(F.col("a").alias("left_name"), F.col("b").alias("right_name"), "tfidf")
    want = evaluate.clusters(e, pairs.join(scores, ["left_name", "right_name"]).filter("tfidf >= 0.6"))
    forest = match.cosine_forest(e, idf, 0.6)
    assert rows(evaluate.clusters(e, forest)) == rows(want) and 1 < want.select("cluster").distinct().count() < 60
    assert forest.count() < 8 * 64
