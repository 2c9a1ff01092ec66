"""More queries with their SQL: merging, lookups, ratios, flags and the choice of a clustering threshold."""

from __future__ import annotations

from pyspark.sql import functions as F

from kintrace.functions import text as T
from kintrace.operators import blocking, corroborate, evaluate, match, merge
from kintrace.plans import catalogue as C
from kintrace.plans import views as V
from kintrace.plans.catalogue import ORACLES, QUERIES, query  # noqa: F401
from kintrace.plans.views import sql
from kintrace.sources.shared import cut

#: Rows that the sampling query draws.
SAMPLE = 200


# --- merging and lookups ---------------------------------------------------------


@query("roster_merge", sql("""SELECT coalesce(e.uei, p.uei, r.uei) AS uei, coalesce(e.name, p.name, r.name) AS name, CASE WHEN e.name IS NOT NULL THEN 1 WHEN p.name IS NOT NULL THEN 2 ELSE 3 END AS source
   FROM (SELECT uei, upper(name) AS name FROM links WHERE name IS NOT NULL) e FULL JOIN (SELECT puei AS uei, min(pname) AS name FROM links WHERE puei IS NOT NULL AND pname IS NOT NULL GROUP BY puei) p ON p.uei = e.uei
   FULL JOIN (SELECT uei, name FROM roster) r ON r.uei = coalesce(e.uei, p.uei) WHERE coalesce(e.name, p.name, r.name) IS NOT NULL""", "links", "roster"))  # fmt: skip
def _(spark, d):
    links = cut(C.links_of(spark, d), "links")
    entities = links.filter("name is not null").select("uei", F.upper("name").alias("name"))
    parents = links.filter("puei is not null and pname is not null").groupBy(F.col("puei").alias("uei")).agg(F.min("pname").alias("name"))
    return merge.by_priority([entities, parents, V.roster(spark, d).select("uei", "name")])


_REASONS = f"SELECT pname AS name, list_filter([CASE WHEN count(*) >= 4 THEN 'large' END, CASE WHEN min(vis) = 'identical' THEN 'same_name' END, CASE WHEN max(obligated) > 1000000 THEN 'spend' END], lambda x: x IS NOT NULL) AS reasons FROM genuine GROUP BY pname"


def _flagged(spark, d):
    g = C.genuine_of(spark, d).groupBy(F.col("pname").alias("name"))
    reasons = F.array(F.when(F.count(F.lit(1)) >= 4, "large"), F.when(F.min("vis") == "identical", "same_name"), F.when(F.max("obligated") > 1000000, "spend"))
    return g.agg(F.array_compact(reasons).alias("reasons"))


@query("flagged_names", sql(f"SELECT DISTINCT name FROM ({_REASONS}) WHERE list_contains(reasons, 'spend')", "genuine"))
def _(spark, d):
    return merge.tagged(_flagged(spark, d), "spend")


@query("ids_of_flagged_names", sql(f"SELECT DISTINCT name, uei FROM ({_REASONS}) JOIN roster USING (name) WHERE list_contains(reasons, 'spend')", "genuine", "roster"))
def _(spark, d):
    return merge.ids_of_names(merge.tagged(_flagged(spark, d), "spend"), V.roster(spark, d))


_CORE = V.core("name")
_REG = f"SELECT uei AS registrant, n, c FROM (SELECT uei, {V.norm('name')} AS n, array_to_string({_CORE}, ' ') AS c, row_number() OVER (PARTITION BY {V.norm('name')} ORDER BY uei) AS rn FROM roster WHERE level = 'P') WHERE rn = 1"


@query("registrant_lookup", sql(f"""SELECT q.uei, coalesce(e.registrant, k.registrant) AS registrant, CASE WHEN e.registrant IS NOT NULL THEN 'norm' WHEN k.registrant IS NOT NULL THEN 'core' END AS how
   FROM (SELECT uei, {V.norm('name')} AS n, array_to_string({_CORE}, ' ') AS c FROM roster) q LEFT JOIN ({_REG}) e ON e.n = q.n
   LEFT JOIN (SELECT c, min(registrant) AS registrant FROM ({_REG}) WHERE c <> '' GROUP BY c) k ON k.c = q.c""", "roster"))  # fmt: skip
def _(spark, d):
    r = V.roster(spark, d)
    registrants = r.filter("level = 'P'").select(F.col("uei").alias("registrant"), F.col("uei").alias("rank"), "name")
    return merge.look_up(r, registrants)


_START = "CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderstatus = 'O' THEN ' ' ELSE concat(' ', cast(cast(o_orderdate AS DATE) AS VARCHAR{n})) END"


@query("award_dates", f"SELECT o_orderkey AS row_id, upper(trim(o_orderpriority)) AS priority, cast(coalesce(nullif(trim({_START.format(n='')}), ''), cast(cast(o_orderdate AS DATE) AS VARCHAR)) AS DATE) AS day, nullif(trim({_START.format(n='')}), '') IS NULL AS by_action FROM orders")
def _(spark, d):
    start = F.expr(_START.format(n="(10)"))
    action = F.col("o_orderdate").cast("date").cast("string")
    return V.table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), F.upper(F.trim("o_orderpriority")).alias("priority"), merge.coalesced_date(start, action).alias("day"), F.nullif(F.trim(start), F.lit("")).isNull().alias("by_action"))


@query("best_duplicate", "SELECT uei, row_id, amount FROM (SELECT o_custkey AS uei, o_orderkey AS row_id, cast(o_totalprice AS DECIMAL(18,2)) AS amount, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def _(spark, d):
    rows = V.table(spark, d, "orders").select(F.col("o_custkey").alias("uei"), F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount"))
    return merge.best_of(rows, "uei", F.col("amount"), F.col("row_id"))


@query("random_sample", f"SELECT c_custkey AS uei FROM customer ORDER BY md5('{V.SEED}|' || c_custkey), c_custkey LIMIT {SAMPLE}")
def _(spark, d):
    return merge.simple_sample(V.table(spark, d, "customer").select(F.col("c_custkey").alias("uei")), "uei", SAMPLE, V.SEED)


@query("sample_level_c", sql("SELECT uei, name, state, 'roster' AS origin, 1 AS release FROM roster WHERE level = 'C'", "roster"))
def _(spark, d):
    return V.roster(spark, d).filter("level = 'C'").select("uei", "name", "state", F.lit("roster").alias("origin"), F.lit(1).alias("release"))


@query("paged_source", "SELECT cast(sum(n) AS BIGINT) AS n_rows, count(*) AS n_keys, count(*) FILTER (n > 1) AS met_again, cast(sum(page) AS BIGINT) AS first_pages, count(*) >= 0.95 * (SELECT count(*) FROM customer) AS complete FROM (SELECT o_custkey, count(*) AS n, min(o_orderkey // 100) AS page FROM orders GROUP BY o_custkey)")
def _(spark, d):
    pages = V.table(spark, d, "orders").select("o_custkey", F.expr("o_orderkey div 100").alias("page"), F.col("o_orderkey").alias("place"))
    return merge.first_seen(pages, "o_custkey", V.table(spark, d, "customer").count())


# --- ratios and flags -------------------------------------------------------------

_PC = lambda hits, of: f"round(CASE WHEN {of} > 0 THEN 100.0 * {hits} / {of} ELSE 0 END, 6)"
_STRATA = ("identical", "visible", "invisible")


@query("blocking_ratios", C.ORACLES["blocking_metrics"].replace("SELECT scheme, count(*) AS pairs", f"SELECT scheme, {_PC('hits', 'truth')} AS pc, round(100.0 * (1 - cast(pairs AS DOUBLE) / space), 6) AS rr, {_PC('hits', 'pairs')} AS pq, " + ", ".join(f"{_PC(f'hits_{v}', f'truth_{v}')} AS pc_{v}" for v in _STRATA) + " FROM (SELECT scheme, count(*) AS pairs", 1) + ")")
def _(spark, d):
    m = C.QUERIES["blocking_metrics"](spark, d)
    return blocking.ratios(m)


def _floor(f1: str) -> str:
    return f"SELECT scorer, vis, round({f1}, 9) AS f1, round(floor_f1, 9) AS floor_f1, round({f1} - floor_f1, 9) AS lift, {f1} - floor_f1 > 0.05 AS beats, CASE WHEN tp + fn > 0 THEN cast(tp AS DOUBLE) / (tp + fn) ELSE 0 END > 0.99 AND CASE WHEN tp + fp > 0 THEN cast(tp AS DOUBLE) / (tp + fp) ELSE 0 END < 0.4 AS degenerate"


@query("baseline_flags", sql(_floor("(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END)") + f" FROM (SELECT *, CASE WHEN tp + fn > 0 THEN 2.0 * (tp + fn) / (tp + fp + fn + tn + tp + fn) ELSE 0 END AS floor_f1 FROM (SELECT scorer, vis, {C._CELLS} FROM tested GROUP BY scorer, vis))", "tested"))
def _(spark, d):
    return evaluate.flags(evaluate.confusion(C.tested_of(spark, d), "scorer", "vis")).select("scorer", "vis", *[F.round(c, 9).alias(c) for c in ("f1", "floor_f1", "lift")], "beats", "degenerate")


_LOW, _HIGH = V.wilson("hits", "n")


@query("corroboration_wilson", sql(f"SELECT vis, n, hits, round({_LOW}, 6) AS low, round({_HIGH}, 6) AS high FROM (SELECT vis, count(*) AS n, count(rule) AS hits FROM ({C._match_sql(C._KIDS)}) GROUP BY vis)", "filings"))
def _(spark, d):
    m = corroborate.match_children(*C._children(spark, d)).groupBy("vis").agg(F.count(F.lit(1)).alias("n"), F.count("rule").alias("hits"))
    low, high = T.wilson(F.col("hits"), F.col("n"))
    return m.select("vis", "n", "hits", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


_SHARES = C.ORACLES["permutation_control"].replace("SELECT perm, count(*) AS n, count(rule) AS hits FROM", "SELECT perm, 100.0 * count(rule) / count(*) AS share FROM", 1)


@query("permutation_summary", "SELECT round(avg(share), 6) AS mean, round(min(share), 6) AS least, round(max(share), 6) AS most, round(any_value(seen) - avg(share), 6) AS excess FROM (" + _SHARES + f"), (SELECT 100.0 * count(rule) / count(*) AS seen FROM ({C._match_sql(C._KIDS)}) WHERE vis = 'invisible')".replace("FROM genuine g JOIN filings f", "FROM (" + sql("SELECT * FROM genuine", "genuine") + ") g JOIN (" + sql("SELECT * FROM filings", "filings") + ") f"))
def _(spark, d):
    shares = C.QUERIES["permutation_control"](spark, d).select((100.0 * F.col("hits") / F.col("n")).alias("share"))
    seen = corroborate.match_children(*C._children(spark, d)).filter("vis = 'invisible'").agg((100.0 * F.count("rule") / F.count(F.lit(1))).alias("seen"))
    out = shares.agg(F.avg("share").alias("mean"), F.min("share").alias("least"), F.max("share").alias("most")).crossJoin(seen)  # one row each
    return out.select(*[F.round(c, 6).alias(c) for c in ("mean", "least", "most")], F.round(F.col("seen") - F.col("mean"), 6).alias("excess"))


_REGION = "(SELECT uei, n_regionkey AS country FROM roster JOIN nation ON n_nationkey = state)"


@query("same_country", sql(f"SELECT left_uei, right_uei, CASE WHEN l.country = r.country THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS same_country FROM pairs JOIN {_REGION} l ON l.uei = left_uei JOIN {_REGION} r ON r.uei = right_uei", "pairs", "roster"))
def _(spark, d):
    at = V.roster(spark, d).join(V.table(spark, d, "nation"), F.col("state") == F.col("n_nationkey")).select("uei", F.col("n_regionkey").alias("country"))
    return match.same(C.pairs_of(spark, d).select("left_uei", "right_uei"), at, "country").select("left_uei", "right_uei", "same_country")


# --- the threshold of clustering, chosen on validation ------------------------------

THRESHOLDS = [i / 20 for i in range(4, 20)]

V.view("vents", "clusters_true roster", "SELECT c.uei, min(c.fam) AS fam, any_value(r.name) AS name FROM clusters_true c JOIN roster r USING (uei) WHERE split = 'val' GROUP BY c.uei")
V.view("vw", "vents idf", f"SELECT uei, g, count(*) * coalesce(any_value(idf), 1.0) AS w FROM (SELECT uei, unnest({V.grams3('name')}) AS g FROM vents) LEFT JOIN idf USING (g) GROUP BY uei, g")
V.view("vn", "vw", "SELECT uei, sqrt(sum(w * w)) AS s FROM vw GROUP BY uei")
V.view("vlinks", "vn", f"SELECT a, b, score FROM ({C._SIMS.replace('ew x', 'vw x').replace('ew y', 'vw y').replace('en p', 'vn p').replace('en q', 'vn q')}) JOIN ({C._keys_sql(C.KEY_SQL['token'], 'vents')}) USING (a, b)")
V.view("vthr", "", "SELECT i / 20.0::DOUBLE AS thr FROM range(4, 20) t(i)")
V.view("vwalk", "vlinks vthr", "SELECT thr, uei, uei AS other FROM vents, vthr UNION SELECT w.thr, w.uei, CASE WHEN e.a = w.other THEN e.b ELSE e.a END FROM vwalk w JOIN vlinks e ON (e.a = w.other OR e.b = w.other) AND e.score >= w.thr")
V.view("vpred", "vwalk", "SELECT thr, uei, min(other) AS cluster FROM vwalk GROUP BY thr, uei")
V.view("vct", "vpred", "SELECT n.thr, cast(nij AS DOUBLE) AS nij, ni, nj FROM (SELECT thr, fam, cluster, count(*) AS nij FROM vents JOIN vpred USING (uei) GROUP BY thr, fam, cluster) n JOIN (SELECT fam, count(*) AS ni FROM vents GROUP BY fam) USING (fam) JOIN (SELECT thr, cluster, count(*) AS nj FROM vpred GROUP BY thr, cluster) j ON j.thr = n.thr AND j.cluster = n.cluster")
V.view("vsweep", "vct", "SELECT thr, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM (SELECT thr, sum(nij * nij / nj) / sum(nij) AS p, sum(nij * nij / ni) / sum(nij) AS r FROM vct GROUP BY thr)")


def _swept(spark, d):
    links = C._links(spark, d, split="val").select("a", "b", F.col("tfidf").alias("score"))
    s = evaluate.bcubed_sweep(C._truth(spark, d, "val").select("uei", "fam"), links, THRESHOLDS)
    return s.select("thr", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("cluster_threshold_sweep", sql("SELECT thr, precision, recall, f1 FROM vsweep", "vsweep"))
def _(spark, d):
    return _swept(spark, d)


@query("cluster_threshold", sql("SELECT thr, f1 FROM vsweep ORDER BY f1 DESC, thr LIMIT 1", "vsweep"))
def _(spark, d):
    return _swept(spark, d).orderBy(F.col("f1").desc(), "thr").limit(1).select("thr", "f1")
