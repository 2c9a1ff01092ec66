"""All queries of the engine with the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kintrace.functions import text as T
from kintrace.operators import audit, benchmark, blocking, corroborate, evaluate, links, match
from kintrace.plans import views as V
from kintrace.plans.views import sql
from kintrace.sources.readers import dataset_digest
from kintrace.sources.shared import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CUTOFF = "2022-04-04"
SCORERS = ["exact", "jaccard", "tfidf"]


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


_made: dict[tuple[str, str, str], DataFrame] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that many queries start from, written once per application and input."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _made:
        _made[key] = cut(make(), name)
    return _made[key]


# --- shared frames ------------------------------------------------------------


def links_of(spark: SparkSession, d: str) -> DataFrame:
    return links.with_names(links.parent_mode(links.pair_counts(V.awards(spark, d))), V.roster(spark, d))


def genuine_of(spark: SparkSession, d: str) -> DataFrame:
    return links.genuine(links_of(spark, d))


def positives_of(spark: SparkSession, d: str) -> DataFrame:
    return _once(spark, d, "positives", lambda: benchmark.positives(genuine_of(spark, d)))


def pairs_of(spark: SparkSession, d: str) -> DataFrame:
    return _once(spark, d, "pairs", lambda: benchmark.pairs(positives_of(spark, d)))


def scored_of(spark: SparkSession, d: str) -> DataFrame:
    return _once(spark, d, "scored", lambda: match.scored(pairs_of(spark, d)))


def scores_of(spark: SparkSession, d: str) -> DataFrame:
    return match.long_scores(scored_of(spark, d), SCORERS)


def tested_of(spark: SparkSession, d: str) -> DataFrame:
    rows = scores_of(spark, d)
    best = evaluate.best_threshold(rows.filter("split = 'val'"))
    return rows.filter("split = 'test'").join(F.broadcast(best), "scorer").withColumn("pred", (F.col("score") >= F.col("thr")).cast("int"))


def children_of(spark: SparkSession, d: str) -> DataFrame:
    return genuine_of(spark, d).select("uei", "name", F.col("puei").alias("fam"), "vis")


def filings_of(spark: SparkSession, d: str) -> DataFrame:
    """Per family the names of its children whose id leaves no 0 modulo 3, in order of id."""
    kids = children_of(spark, d).filter("uei % 3 <> 0")
    return kids.groupBy("fam").agg(F.transform(F.array_sort(F.collect_list(F.struct("uei", "name"))), lambda x: x["name"]).alias("subs"))


FILINGS = "SELECT puei AS fam, list(name ORDER BY uei) AS subs FROM genuine WHERE uei % 3 <> 0 GROUP BY puei"


def _joined(c: Column) -> Column:
    return F.array_join(F.array_sort(c), ",")


# --- links ----------------------------------------------------------------------


@query("link_pair_counts", sql("SELECT uei, puei, n, amt, first_day FROM pair_counts", "pair_counts"))
def _(spark, d):
    return links.pair_counts(V.awards(spark, d))


@query("resolve_parent_mode", sql("SELECT uei, puei, award_rows, obligated, parents FROM links", "links"))
def _(spark, d):
    return links.parent_mode(links.pair_counts(V.awards(spark, d)))


@query("resolve_parent_amount_first", sql("SELECT uei, puei, n AS award_rows, amt AS obligated FROM (SELECT *, row_number() OVER (PARTITION BY uei ORDER BY amt DESC, n DESC, coalesce(puei, -1)) AS rn FROM pair_counts) WHERE rn = 1", "pair_counts"))
def _(spark, d):
    return links.parent_mode(links.pair_counts(V.awards(spark, d)), amount_first=True).drop("parents")


@query("link_classification", sql("SELECT CASE WHEN puei IS NULL THEN 'blank' WHEN puei = uei THEN 'self' ELSE 'genuine' END AS kind, count(*) AS n, sum(obligated) AS obligated FROM links GROUP BY kind", "links"))
def _(spark, d):
    return links_of(spark, d).groupBy(links.link_class().alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum("obligated").alias("obligated"))


@query("conflicting_parents", sql("SELECT count(*) AS entities, count(*) FILTER (parents > 1) AS conflicting, max(parents) AS most FROM links", "links"))
def _(spark, d):
    return links_of(spark, d).agg(F.count(F.lit(1)).alias("entities"), F.count_if(F.col("parents") > 1).alias("conflicting"), F.max("parents").alias("most"))


@query("all_parents_map", sql("SELECT uei, string_agg(coalesce(cast(puei AS VARCHAR), '') || ':' || n, ',' ORDER BY coalesce(puei, -1)) AS parents FROM pair_counts GROUP BY uei", "pair_counts"))
def _(spark, d):
    parents = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce("puei", F.lit(-1)).alias("k"), F.col("n").alias("v"))))).alias("m")
    maps = links.pair_counts(V.awards(spark, d)).groupBy("uei").agg(parents)
    return maps.select("uei", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(F.when(e["key"] < 0, "").otherwise(e["key"].cast("string")), F.lit(":"), e["value"].cast("string"))), ",").alias("parents"))


@query("last_name_per_entity", "SELECT o_custkey AS uei, max_by(o_orderpriority, o_orderkey) AS name FROM orders WHERE trim(o_orderpriority) <> '' GROUP BY o_custkey")
def _(spark, d):
    return links.last_names(V.table(spark, d, "orders").select(F.col("o_custkey").alias("uei"), F.col("o_orderpriority").alias("name"), "o_orderkey"), "uei", "name", "o_orderkey")


_ATTR = """SELECT uei, field, value, sum(w) AS w FROM (
  SELECT o_custkey AS uei, CASE WHEN abs(cast(o_totalprice AS DECIMAL(18,2))) = 0 THEN 1 ELSE abs(cast(o_totalprice AS DECIMAL(18,2))) END AS w,
    unnest(['status', 'priority']) AS field, unnest([nullif(trim(o_orderstatus), ''), nullif(trim(o_orderpriority), '')]) AS value FROM orders) WHERE value IS NOT NULL GROUP BY uei, field, value"""
_MODE = f"SELECT uei, field, value, cast(w AS DECIMAL(28,2)) AS w, n_values FROM (SELECT *, row_number() OVER (PARTITION BY uei, field ORDER BY w DESC, value) AS rn, count(*) OVER (PARTITION BY uei, field) AS n_values FROM ({_ATTR})) WHERE rn = 1"


def _attribute_mode(spark, d):
    rows = V.table(spark, d, "orders").select(F.col("o_custkey").alias("uei"), F.col("o_totalprice").alias("amount"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return links.weighted_mode(rows, "uei", ["status", "priority"], "amount")


@query("attribute_weighted_mode", _MODE)
def _(spark, d):
    return _attribute_mode(spark, d).withColumn("w", F.col("w").cast("decimal(28,2)"))


@query("attribute_coverage", f"SELECT field, count(*) AS entities, count(*) FILTER (n_values > 1) AS conflicting, (SELECT count(*) FROM customer) AS population FROM ({_MODE}) GROUP BY field")
def _(spark, d):
    n = V.table(spark, d, "customer").agg(F.count(F.lit(1)).alias("population"))
    return _attribute_mode(spark, d).groupBy("field").agg(F.count(F.lit(1)).alias("entities"), F.count_if(F.col("n_values") > 1).alias("conflicting")).crossJoin(F.broadcast(n))


_FIRST = "SELECT g.uei, g.puei, c.first_day FROM genuine g LEFT JOIN pair_counts c ON c.uei = g.uei AND c.puei = g.puei"


def _first_days(spark, d):
    first = links.pair_counts(V.awards(spark, d)).select("uei", "puei", "first_day")
    return genuine_of(spark, d).select("uei", "puei").join(first, ["uei", "puei"], "left")


@query("link_earliest_date", sql(_FIRST, "genuine"))
def _(spark, d):
    return _first_days(spark, d)


@query("cutoff_exposure", sql(f"SELECT count(*) AS n, count(*) FILTER (first_day < DATE '{CUTOFF}') AS before, count(*) FILTER (first_day >= DATE '{CUTOFF}') AS since, count(*) FILTER (first_day IS NULL) AS undated FROM ({_FIRST})", "genuine"))
def _(spark, d):
    day, cutoff = F.col("first_day"), F.lit(CUTOFF).cast("date")
    return _first_days(spark, d).agg(F.count(F.lit(1)).alias("n"), F.count_if(day < cutoff).alias("before"), F.count_if(day >= cutoff).alias("since"), F.count_if(day.isNull()).alias("undated"))


@query("year_histogram", sql(f"SELECT cast(year(first_day) AS INT) AS year, count(*) AS n FROM ({_FIRST}) GROUP BY 1", "genuine"))
def _(spark, d):
    return _first_days(spark, d).groupBy(F.year("first_day").alias("year")).agg(F.count(F.lit(1)).alias("n"))


_TIER_CUT = "1996-06-01"
_TIER = f"""SELECT split, label, count(*) AS n FROM (
  SELECT p.split, p.label FROM pairs p JOIN pair_counts c ON p.label = 1 AND c.uei = p.left_uei AND c.puei = p.right_uei WHERE c.first_day IS NULL OR c.first_day >= DATE '{_TIER_CUT}'
  UNION ALL SELECT p.split, p.label FROM pairs p WHERE p.label = 0 AND p.left_uei IN (SELECT e FROM alive) AND p.right_uei IN (SELECT e FROM alive)) GROUP BY split, label"""
V.view("alive", "pairs pair_counts", f"SELECT unnest([p.left_uei, p.right_uei]) AS e FROM pairs p JOIN pair_counts c ON p.label = 1 AND c.uei = p.left_uei AND c.puei = p.right_uei WHERE c.first_day IS NULL OR c.first_day >= DATE '{_TIER_CUT}'")


@query("conservative_tier", sql(_TIER, "alive"))
def _(spark, d):
    dates = links.pair_counts(V.awards(spark, d)).filter("puei is not null").select(F.col("uei").alias("left_uei"), F.col("puei").alias("right_uei"), "first_day")
    return benchmark.conservative(pairs_of(spark, d), dates, _TIER_CUT).groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))


# --- name functions --------------------------------------------------------------


def _names(spark, d):
    return V.roster(spark, d).select("uei", "name").union(V.docnames(spark, d))


_NAMES = "(SELECT uei, name FROM roster UNION ALL SELECT uei, name FROM docnames)"

for _name, _spark, _sql in [
    ("norm_names", T.norm, V.norm("name")),
    ("norm_compact_names", T.norm_compact, V.compact("name")),
    ("core_tokens_gt2", lambda c: _joined(T.core(c)), f"array_to_string({V.core('name')}, ',')"),
    ("core_tokens_gt1", lambda c: _joined(T.core(c, 1)), f"array_to_string({V.core('name', 1)}, ',')"),
    ("qgrams4", lambda c: _joined(T.qgrams(c)), f"array_to_string(list_sort({V.qgrams('name')}), ',')"),
    ("char_ngrams3", lambda c: _joined(T.char_ngrams(c)), f"array_to_string(list_sort({V.grams3('name')}), ',')"),
    ("block_keys", T.block_key, V.block_key("name")),
    ("norm_roster_names", T.norm_roster, V.norm_roster("name")),
    ("strip_legal_suffix", T.strip_legal, V.strip_legal("name")),
    ("strip_trailing_suffix", T.strip_trailing, V.strip_trailing("name")),
    ("norm_address", T.norm_address, V.norm_address("name")),
]:
    QUERIES[_name] = lambda spark, d, f=_spark: _names(spark, d).select("uei", f(F.col("name")).alias("value"))
    ORACLES[_name] = sql(f"SELECT uei, {_sql} AS value FROM {_NAMES}", "roster", "docnames")


@query("zip5", sql("SELECT uei, substr(regexp_replace(zip || '-' || phone, '[^0-9]', '', 'g'), 1, 5) AS value FROM roster", "roster"))
def _(spark, d):
    return V.roster(spark, d).select("uei", T.zip5(F.concat("zip", F.lit("-"), "phone")).alias("value"))


@query("soundex_keys", sql(f"SELECT uei, token, {V.soundex('token')} AS code FROM (SELECT uei, unnest({V.core('name')}) AS token FROM roster)", "roster"))
def _(spark, d):
    return V.roster(spark, d).select("uei", F.explode(T.core(F.col("name"))).alias("token")).withColumn("code", T.soundex(F.col("token")))


@query("id_stems", "SELECT c_custkey AS uei, regexp_replace('A-' || c_custkey || '-C', '-[^-]*$', '') AS stem FROM customer")
def _(spark, d):
    return V.table(spark, d, "customer").select(F.col("c_custkey").alias("uei"), T.id_stem(F.concat(F.lit("A-"), F.col("c_custkey").cast("string"), F.lit("-C"))).alias("stem"))


@query("formatted_numbers", "SELECT c_custkey AS uei, CASE WHEN c_custkey * 1037 < 0 THEN '' ELSE format('{:,}', c_custkey * 1037) END AS shown FROM customer")
def _(spark, d):
    return V.table(spark, d, "customer").select(F.col("c_custkey").alias("uei"), F.format_number(F.col("c_custkey") * 1037, 0).alias("shown"))


@query("legal_names", "SELECT event_id, coalesce(json_extract_string(props, '$.page'), '') AS value FROM events")
def _(spark, d):
    return V.table(spark, d, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.page"), F.lit("")).alias("value"))


# --- strata ----------------------------------------------------------------------


@query("visibility_strata", sql("SELECT vis, count(*) AS n, sum(obligated) AS obligated FROM genuine GROUP BY vis", "genuine"))
def _(spark, d):
    return genuine_of(spark, d).groupBy("vis").agg(F.count(F.lit(1)).alias("n"), F.sum("obligated").alias("obligated"))


_low, _high = V.wilson("n", "total")


@query("visibility_rates", sql(f"SELECT vis, n, total, round({_low}, 4) AS low, round({_high}, 4) AS high FROM (SELECT vis, count(*) AS n, sum(count(*)) OVER () AS total FROM genuine GROUP BY vis)".replace("sum(count(*)) OVER ()", "cast(sum(count(*)) OVER () AS BIGINT)"), "genuine"))
def _(spark, d):
    g = genuine_of(spark, d).groupBy("vis").agg(F.count(F.lit(1)).alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy()))
    low, high = T.wilson(F.col("n"), F.col("total"))
    return g.select("vis", "n", "total", F.round(low, 4).alias("low"), F.round(high, 4).alias("high"))


@query("substring_test", sql(f"SELECT vis, count(*) AS n, count(*) FILTER ({V.compact('name')} <> '' AND {V.compact('pname')} <> '' AND NOT contains({V.compact('name')}, {V.compact('pname')}) AND NOT contains({V.compact('pname')}, {V.compact('name')})) AS apart FROM genuine GROUP BY vis", "genuine"))
def _(spark, d):
    return genuine_of(spark, d).groupBy("vis").agg(F.count(F.lit(1)).alias("n"), F.count_if(T.apart(F.col("name"), F.col("pname"))).alias("apart"))


@query("informative_links", sql("SELECT count(*) AS n, count(*) FILTER (name <> pname) AS informative FROM genuine", "genuine"))
def _(spark, d):
    return genuine_of(spark, d).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("name") != F.col("pname")).alias("informative"))


@query("name_examples", sql("SELECT vis, uei, name, pname FROM (SELECT *, row_number() OVER (PARTITION BY vis ORDER BY obligated DESC, uei) AS rn FROM genuine) WHERE rn <= 5", "genuine"))
def _(spark, d):
    return audit.examples(genuine_of(spark, d), "vis", [F.col("obligated").desc(), F.col("uei")], 5).select("vis", "uei", "name", "pname")


# --- audits ----------------------------------------------------------------------


@query("self_parent_audit", sql(f"SELECT count(*) AS n, count(*) FILTER (puei = uei) AS by_id, count(*) FILTER ({V.norm('name')} = {V.norm('pname')}) AS by_name, count(*) FILTER (puei IS NULL) AS blank, count(*) FILTER (puei <> uei) AS other FROM links", "links"))
def _(spark, d):
    return audit.self_parents(links_of(spark, d))


@query("parents_array_distribution", sql("SELECT parents AS size, count(*) AS n FROM links GROUP BY parents", "links"))
def _(spark, d):
    arrays = links.pair_counts(V.awards(spark, d)).groupBy("uei").agg(F.collect_set("puei").alias("a"))
    return arrays.groupBy(F.size("a").cast("long").alias("size")).agg(F.count(F.lit(1)).alias("n"))


@query("hierarchy_depth", sql("SELECT count(*) AS parents, count(*) FILTER (puei IN (SELECT uei FROM genuine)) AS also_children FROM (SELECT DISTINCT puei FROM genuine)", "genuine"))
def _(spark, d):
    g = genuine_of(spark, d)
    parents = g.select(F.col("puei").alias("e")).distinct()
    both = parents.intersect(g.select(F.col("uei").alias("e")))
    return parents.agg(F.count(F.lit(1)).alias("parents")).crossJoin(both.agg(F.count(F.lit(1)).alias("also_children")))


_OTHER = "SELECT uei, puei FROM (SELECT *, row_number() OVER (PARTITION BY uei ORDER BY amt DESC, n DESC, coalesce(puei, -1)) AS rn FROM pair_counts) WHERE rn = 1"


@query("source_reconciliation", sql(f"""SELECT CASE WHEN a IS NULL AND b IS NULL THEN 'both_none' WHEN a IS NULL OR b IS NULL THEN 'one_none' WHEN a = b THEN 'uei'
   WHEN {V.norm('an')} = {V.norm('bn')} THEN 'name' WHEN list_has_any({V.core('an', 1)}, {V.core('bn', 1)}) THEN 'token' ELSE 'differ' END AS agreement, count(*) AS n
   FROM (SELECT nullif(l.puei, l.uei) AS a, nullif(o.puei, o.uei) AS b, x.name AS an, y.name AS bn FROM links l JOIN ({_OTHER}) o USING (uei) LEFT JOIN roster x ON x.uei = l.puei LEFT JOIN roster y ON y.uei = o.puei) GROUP BY 1""", "links"))
def _(spark, d):
    counts = links.pair_counts(V.awards(spark, d))
    names = V.roster(spark, d)
    a = links.with_names(links.parent_mode(counts), names)
    b = links.with_names(links.parent_mode(counts, amount_first=True), names)
    return audit.agreement(a, b)


@query("family_sizes", sql("SELECT puei AS fam, count(*) AS children, sum(obligated) AS obligated FROM genuine GROUP BY puei", "genuine"))
def _(spark, d):
    return audit.family_sizes(genuine_of(spark, d))


@query("size_histogram", sql("SELECT children, count(*) AS families FROM (SELECT count(*) AS children FROM genuine GROUP BY puei) GROUP BY children", "genuine"))
def _(spark, d):
    return audit.family_sizes(genuine_of(spark, d)).groupBy("children").agg(F.count(F.lit(1)).alias("families"))


@query("largest_families", sql("SELECT puei AS fam, count(*) AS children, sum(obligated) AS obligated FROM genuine GROUP BY puei ORDER BY children DESC, obligated DESC, fam LIMIT 15", "genuine"))
def _(spark, d):
    return audit.family_sizes(genuine_of(spark, d)).orderBy(F.desc("children"), F.desc("obligated"), "fam").limit(15)


@query("roster_levels", sql("SELECT level, count(*) AS n, count(*) FILTER (amount > 0) AS positive, count(*) FILTER (amount < 0) AS negative, sum(cast(amount AS DECIMAL(18,2))) AS amount FROM roster GROUP BY level", "roster"))
def _(spark, d):
    return audit.levels(V.roster(spark, d))


@query("name_collisions", sql(f"SELECT kind, count(DISTINCT value) AS distinct_names, count(*) FILTER (n > 1) AS shared, cast(sum(n * (n - 1) // 2) AS BIGINT) AS pairs FROM (SELECT kind, value, count(DISTINCT uei) AS n FROM (SELECT 'norm' AS kind, uei, {V.norm_roster('name')} AS value FROM roster UNION ALL SELECT 'stripped', uei, {V.strip_legal('name')} FROM roster) GROUP BY kind, value) GROUP BY kind", "roster"))
def _(spark, d):
    return audit.collisions(V.roster(spark, d))


@query("duplicate_ids", "SELECT cast(coalesce(sum(n - 1), 0) AS BIGINT) AS extra_rows, count(*) AS ids FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)")
def _(spark, d):
    n = V.table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_rows"), F.count(F.lit(1)).alias("ids"))


_MONEY = "cast(greatest(amount, 0) AS DECIMAL(18,2))"


@query("spend_concentration_marks", sql(f"SELECT mark, round(cast(sum(a) FILTER (rn <= mark) AS DOUBLE) / cast(sum(a) AS DOUBLE), 9) AS share FROM (SELECT {_MONEY} AS a, row_number() OVER (ORDER BY amount DESC, uei) AS rn, count(*) OVER () AS n FROM roster), (SELECT unnest([10, 100, 1000, 10000, 50000]) AS mark) WHERE mark <= n GROUP BY mark", "roster"))
def _(spark, d):
    return audit.marks(V.roster(spark, d), [10, 100, 1000, 10000, 50000])


@query("top_share", sql("SELECT frac, k, round(cast(sum(a) FILTER (rn <= k) AS DOUBLE) / cast(sum(a) AS DOUBLE), 9) AS share FROM (SELECT *, greatest(1, cast(round_even(n * frac / 100.0, 0) AS BIGINT)) AS k FROM (SELECT abs(obligated) AS a, row_number() OVER (ORDER BY abs(obligated) DESC, uei) AS rn, count(*) OVER () AS n FROM genuine), (SELECT unnest([1, 5, 10]) AS frac)) GROUP BY frac, k", "genuine"))
def _(spark, d):
    return audit.top_share(genuine_of(spark, d).select("uei", F.abs("obligated").alias("a")), [1, 5, 10])


@query("top_share_signed", sql("SELECT frac, k, round(cast(sum(a) FILTER (rn <= k) AS DOUBLE) / cast(sum(a) AS DOUBLE), 9) AS share FROM (SELECT *, greatest(1, n * frac // 100) AS k FROM (SELECT obligated AS a, row_number() OVER (ORDER BY obligated DESC, uei) AS rn, count(*) OVER () AS n FROM genuine), (SELECT unnest([1, 10]) AS frac)) GROUP BY frac, k", "genuine"))
def _(spark, d):
    return audit.top_share(genuine_of(spark, d).select("uei", F.col("obligated").alias("a")), [1, 10], floor=True)


_TALLY = f"SELECT puei, t, count(*) AS n FROM (SELECT puei, unnest({V.core('name')}) AS t FROM genuine) GROUP BY puei, t"
_FAMS = f"SELECT puei, min(pname) AS pname, count(*) AS children, sum(obligated) AS obligated, count(*) FILTER (list_has_any({V.core('name')}, {V.core('pname')})) AS reached FROM genuine GROUP BY puei"
_DOMINANT = f"""SELECT puei AS fam, t AS token, n, children FROM (SELECT d.*, row_number() OVER (PARTITION BY puei ORDER BY n DESC, t) AS rn2 FROM (
   SELECT y.puei, y.t, y.n, f.children, f.pname, row_number() OVER (PARTITION BY y.puei ORDER BY y.n DESC, y.t) AS rn FROM ({_TALLY}) y JOIN ({_FAMS}) f USING (puei)) d
   WHERE rn <= 5 AND children >= 3 AND n >= 0.6 * children AND NOT list_contains({V.core('pname')}, t)) WHERE rn2 = 1"""


@query("dominant_token", sql(_DOMINANT, "genuine"))
def _(spark, d):
    return audit.dominant_tokens(genuine_of(spark, d))


@query("parent_reach", sql(f"SELECT puei AS fam, children, reached FROM ({_FAMS})", "genuine"))
def _(spark, d):
    return audit.reach(genuine_of(spark, d)).select("fam", "children", "reached")


_PUBLIC = "regexp_matches(n, '(\\bgovernment of\\b|\\bgovt of\\b|\\brepublic of\\b|\\bkingdom of\\b|\\bstate of\\b|\\bcommonwealth of\\b|\\bministry of\\b|\\bmunicipality of\\b|\\bprovince of\\b|^city of\\b|^county of\\b|\\bunited states government\\b)', 'i')"


@query("sovereign_flags", sql(f"SELECT uei, {_PUBLIC} AS sovereign FROM (SELECT uei, CASE WHEN uei % 11 = 0 THEN 'Republic of ' || name WHEN uei % 13 = 0 THEN 'CITY OF ' || name WHEN uei % 17 = 0 THEN 'Republic Services ' || name ELSE name END AS n FROM roster)", "roster"))
def _(spark, d):
    n = F.expr("case when uei % 11 = 0 then concat('Republic of ', name) when uei % 13 = 0 then concat('CITY OF ', name) when uei % 17 = 0 then concat('Republic Services ', name) else name end")
    return V.roster(spark, d).select("uei", F.rlike(n, F.lit(T.SOVEREIGN)).alias("sovereign"))


@query("family_artifacts", sql(f"""SELECT fam, children, obligated, parent_obligated, list_aggregate(list_filter([CASE WHEN token IS NOT NULL AND reached <= 0.2 * children THEN 'block' END, CASE WHEN children >= 4 THEN 'large' END], lambda x: x IS NOT NULL), 'string_agg', ',') AS reasons
   FROM (SELECT f.puei AS fam, f.children, f.obligated, f.reached, m.token, coalesce(l.obligated, 0) AS parent_obligated FROM ({_FAMS}) f LEFT JOIN ({_DOMINANT}) m ON m.fam = f.puei LEFT JOIN links l ON l.uei = f.puei)
   WHERE children >= 4 OR (token IS NOT NULL AND reached <= 0.2 * children)""", "genuine"))
def _(spark, d):
    return audit.artifacts(genuine_of(spark, d), links_of(spark, d), review=4).withColumn("reasons", F.array_join("reasons", ","))


@query("exclusion_cascade", sql("SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM (SELECT CASE WHEN puei % 40 = 0 THEN 'manual' WHEN puei % 28 = 0 THEN 'sovereign' END AS reason FROM genuine) GROUP BY 1", "genuine"))
def _(spark, d):
    return _excluded(spark, d).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def _excluded(spark, d):
    g = genuine_of(spark, d)
    return benchmark.exclusions(g, g.filter("puei % 40 = 0").select("puei"), g.filter("puei % 28 = 0").select("puei"))


@query("exclusion_by_stratum", sql("SELECT coalesce(reason, 'kept') AS reason, vis, count(*) AS n FROM (SELECT vis, CASE WHEN puei % 40 = 0 THEN 'manual' WHEN puei % 28 = 0 THEN 'sovereign' END AS reason FROM genuine) GROUP BY 1, 2", "genuine"))
def _(spark, d):
    return _excluded(spark, d).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason"), "vis").agg(F.count(F.lit(1)).alias("n"))


@query("population_footprint", sql("SELECT count(*) AS parents, count(*) FILTER (puei IN (SELECT uei FROM awards)) AS transacting, (SELECT count(DISTINCT uei) FROM genuine) AS children FROM (SELECT DISTINCT puei FROM genuine)", "genuine"))
def _(spark, d):
    return audit.footprint(genuine_of(spark, d), V.awards(spark, d).select("uei"))


@query("profile_families", sql(f"SELECT puei AS fam, children, invisible, total_children, total_invisible FROM (SELECT puei, count(*) AS children, count(*) FILTER (NOT list_has_any({V.core('name', 1)}, {V.core('pname', 1)})) AS invisible, cast(sum(count(*)) OVER () AS BIGINT) AS total_children, cast(sum(count(*) FILTER (NOT list_has_any({V.core('name', 1)}, {V.core('pname', 1)}))) OVER () AS BIGINT) AS total_invisible FROM genuine GROUP BY puei)", "genuine"))
def _(spark, d):
    return audit.profile(genuine_of(spark, d))


@query("conditional_chain", sql("SELECT count(*) AS n, count(*) FILTER (uei % 3 = 0) AS located, count(*) FILTER (uei % 3 = 0 AND award_rows > 2) AS has_parent, count(*) FILTER (uei % 3 = 0 AND award_rows > 2 AND vis <> 'invisible') AS agrees FROM genuine", "genuine"))
def _(spark, d):
    return audit.chain(genuine_of(spark, d), F.col("uei") % 3 == 0, F.col("award_rows") > 2, F.col("vis") != "invisible")


# --- components, splits, pairs ------------------------------------------------------


@query("family_components", sql("SELECT fam, component FROM components", "components"))
def _(spark, d):
    return benchmark.family_components(genuine_of(spark, d))


@query("component_sizes", sql("SELECT component, size FROM component_sizes", "component_sizes"))
def _(spark, d):
    g = genuine_of(spark, d)
    return g.join(benchmark.family_components(g), F.col("puei") == F.col("fam")).groupBy("component").agg(F.count(F.lit(1)).alias("size"))


@query("split_assignment", sql("SELECT fam, component, split FROM splits", "splits"))
def _(spark, d):
    g = genuine_of(spark, d)
    comps = benchmark.family_components(g)
    sizes = g.join(comps, F.col("puei") == F.col("fam")).groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return comps.join(benchmark.split_components(sizes), "component").select("fam", "component", "split")


@query("positives", sql("SELECT uei, puei, vis, split FROM positives", "positives"))
def _(spark, d):
    return positives_of(spark, d).select("uei", "puei", "vis", "split")


for _kind, _view in (("random", "neg_random"), ("hard_string", "neg_hard"), ("same_block", "neg_block")):
    QUERIES[f"negatives_{_kind}"] = lambda spark, d, k=_kind: pairs_of(spark, d).filter(F.col("kind") == k).select("split", F.col("left_uei").alias("uei"), F.col("right_uei").alias("puei"))
    ORACLES[f"negatives_{_kind}"] = sql(f"SELECT split, uei, puei FROM {_view}", _view)


@query("pairs", sql("SELECT left_uei, left_name, right_uei, right_name, label, kind, vis, family, split, obligated FROM pairs", "pairs"))
def _(spark, d):
    return pairs_of(spark, d)


@query("negative_kind_by_stratum", sql("SELECT kind, vis, count(*) AS n FROM pairs WHERE label = 0 GROUP BY kind, vis", "pairs"))
def _(spark, d):
    return pairs_of(spark, d).filter("label = 0").groupBy("kind", "vis").agg(F.count(F.lit(1)).alias("n"))


@query("test_base_rates", sql("SELECT vis, count(*) AS n, sum(label)::BIGINT AS positives, round(2.0 * sum(label) / (count(*) + sum(label)), 9) AS all_yes_f1 FROM pairs WHERE split = 'test' GROUP BY vis", "pairs"))
def _(spark, d):
    t = pairs_of(spark, d).filter("split = 'test'").groupBy("vis").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives"))
    return t.withColumn("all_yes_f1", F.round(2.0 * F.col("positives") / (F.col("n") + F.col("positives")), 9))


@query("leak_checks", "SELECT unnest(['entity_in_two_splits', 'name_in_two_splits', 'repeated_pair']) AS \"check\", cast(0 AS BIGINT) AS violations")
def _(spark, d):
    return benchmark.check_pairs(pairs_of(spark, d))


@query("dataset_digest", sql("SELECT count(*) AS n_rows, cast(sum(h) AS VARCHAR) AS digest FROM (SELECT cast('0x' || substr(sha256('{\"fam\":' || puei || ',\"uei\":' || uei || '}'), 1, 12) AS BIGINT) AS h FROM genuine)", "genuine"))
def _(spark, d):
    rows = genuine_of(spark, d).select("uei", F.col("puei").alias("fam"))
    return dataset_digest(rows).withColumn("digest", F.col("digest").cast("string"))


@query("independent_recount", sql("SELECT split, count(*) AS n, sum(label)::BIGINT AS positives, count(DISTINCT family) AS families FROM pairs GROUP BY split", "pairs"))
def _(spark, d):
    return pairs_of(spark, d).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives"), F.count_distinct("family").alias("families"))


# --- blocking --------------------------------------------------------------------


def _entities(spark, d):
    return V.roster(spark, d)


def _keys_sql(keys: str, source: str = "roster") -> str:
    return f"SELECT DISTINCT x.uei AS a, y.uei AS b FROM k x JOIN k y USING (key) JOIN (SELECT key FROM k GROUP BY key HAVING count(*) BETWEEN 2 AND 100) USING (key) WHERE x.uei < y.uei".replace("FROM k x", f"FROM (SELECT DISTINCT uei, key FROM (SELECT uei, unnest({keys}) AS key FROM {source})) x").replace("JOIN k y", f"JOIN (SELECT DISTINCT uei, key FROM (SELECT uei, unnest({keys}) AS key FROM {source})) y").replace("FROM k GROUP", f"FROM (SELECT DISTINCT uei, key FROM (SELECT uei, unnest({keys}) AS key FROM {source})) GROUP")


_PHON = f"list_transform({V.core('name')}[1:2], lambda w: {V.soundex('w')})"
KEY_SQL = {
    "token": V.core("name"),
    "qgram": V.qgrams("name"),
    "first_token": f"CASE WHEN {V.block_key('name')} <> '' THEN [{V.block_key('name')}] ELSE [] END",
    "phonetic": f"CASE WHEN len({V.core('name')}) > 0 THEN [array_to_string({_PHON}, '|')] ELSE [] END",
    "attribute": f"list_filter(['Z' || nullif(substr(regexp_replace(zip, '[^0-9]', '', 'g'), 1, 5), ''), 'C|' || state || '|' || {V.norm('city')}], lambda k: k IS NOT NULL)",
}
SORTED_SQL = f"SELECT DISTINCT least(x.uei, y.uei) AS a, greatest(x.uei, y.uei) AS b FROM p x JOIN p y ON y.pos BETWEEN x.pos + 1 AND x.pos + 19".replace("p x", "(SELECT uei, row_number() OVER (ORDER BY n, uei) AS pos FROM (SELECT uei, " + V.norm("name") + " AS n FROM roster)) x").replace("p y", "(SELECT uei, row_number() OVER (ORDER BY n, uei) AS pos FROM (SELECT uei, " + V.norm("name") + " AS n FROM roster)) y")
for _scheme in blocking.KEYS:
    QUERIES[f"block_{_scheme}"] = lambda spark, d, s=_scheme: blocking.by_keys(_entities(spark, d), s)
    ORACLES[f"block_{_scheme}"] = sql(_keys_sql(KEY_SQL[_scheme]), "roster")


@query("block_token_docs", sql(_keys_sql(KEY_SQL["token"], "docnames"), "docnames"))
def _(spark, d):
    return blocking.by_keys(V.docnames(spark, d), "token")


@query("block_sorted_neighbourhood", sql(SORTED_SQL, "roster"))
def _(spark, d):
    return blocking.sorted_neighbourhood(_entities(spark, d))


KNN_SQL = """SELECT x, y, rank FROM (SELECT x, y, row_number() OVER (PARTITION BY x ORDER BY score DESC, y) AS rank FROM (
  SELECT p.vec_id AS x, q.vec_id AS y, round(list_sum(list_transform(list_zip(p.embedding, q.embedding), lambda z: cast(z[1] AS DOUBLE) * cast(z[2] AS DOUBLE))), 9) AS score FROM embeddings p JOIN embeddings q ON p.vec_id <> q.vec_id)) WHERE rank <= 20"""


@query("block_knn", f"SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b FROM ({KNN_SQL})")
def _(spark, d):
    return blocking.symmetric(blocking.nearest(V.table(spark, d, "embeddings")))


@query("score_embedding", f"SELECT x, y, rank FROM ({KNN_SQL})")
def _(spark, d):
    return blocking.nearest(V.table(spark, d, "embeddings")).select("x", "y", F.col("rank").cast("long").alias("rank"))


_STRING = ["token", "qgram", "first_token", "phonetic"]


def _string_union(spark, d):
    e = _entities(spark, d)
    return blocking.union_of([blocking.by_keys(e, s) for s in _STRING] + [blocking.sorted_neighbourhood(e)])


_STRING_SQL = " UNION ".join([f"({_keys_sql(KEY_SQL[s])})" for s in _STRING] + [f"({SORTED_SQL})"])


@query("block_union_string", sql(f"SELECT count(*) AS pairs, cast(sum(a) AS BIGINT) AS sum_a, cast(sum(b) AS BIGINT) AS sum_b FROM ({_STRING_SQL})", "roster"))
def _(spark, d):
    return _string_union(spark, d).agg(F.count(F.lit(1)).alias("pairs"), F.sum("a").alias("sum_a"), F.sum("b").alias("sum_b"))


@query("block_union_all", sql(f"SELECT count(*) AS pairs, cast(sum(a) AS BIGINT) AS sum_a, cast(sum(b) AS BIGINT) AS sum_b FROM ({_STRING_SQL} UNION ({_keys_sql(KEY_SQL['attribute'])}))", "roster"))
def _(spark, d):
    every = blocking.union_of([_string_union(spark, d), blocking.by_keys(_entities(spark, d), "attribute")])
    return every.agg(F.count(F.lit(1)).alias("pairs"), F.sum("a").alias("sum_a"), F.sum("b").alias("sum_b"))


_TRUTH = "SELECT DISTINCT least(uei, puei) AS a, greatest(uei, puei) AS b, vis FROM genuine"
_CANDS = " UNION ALL ".join(f"SELECT '{s}' AS scheme, a, b FROM ({_keys_sql(KEY_SQL[s])})" for s in KEY_SQL) + f" UNION ALL SELECT 'sorted', a, b FROM ({SORTED_SQL})"


@query("blocking_metrics", sql(f"""SELECT scheme, count(*) AS pairs, count(vis) AS hits, count(*) FILTER (vis = 'identical') AS hits_identical, count(*) FILTER (vis = 'visible') AS hits_visible, count(*) FILTER (vis = 'invisible') AS hits_invisible,
   (SELECT count(*) FROM ({_TRUTH})) AS truth, (SELECT count(*) FROM ({_TRUTH}) WHERE vis = 'identical') AS truth_identical, (SELECT count(*) FROM ({_TRUTH}) WHERE vis = 'visible') AS truth_visible, (SELECT count(*) FROM ({_TRUTH}) WHERE vis = 'invisible') AS truth_invisible,
   (SELECT count(*) * (count(*) - 1) // 2 FROM roster) AS space FROM ({_CANDS}) LEFT JOIN ({_TRUTH}) USING (a, b) GROUP BY scheme""", "genuine"))
def _(spark, d):
    e = _entities(spark, d)
    every = [blocking.by_keys(e, s).withColumn("scheme", F.lit(s)) for s in KEY_SQL] + [blocking.sorted_neighbourhood(e).withColumn("scheme", F.lit("sorted"))]
    cands = every[0]
    for c in every[1:]:
        cands = cands.unionByName(c)
    truth = genuine_of(spark, d).select(F.least("uei", "puei").alias("a"), F.greatest("uei", "puei").alias("b"), "vis").distinct()
    return blocking.metrics(cands, truth, e.count())


# --- matching --------------------------------------------------------------------

_PAIR = "left_uei, right_uei"


@query("score_exact", sql(f"SELECT {_PAIR}, cast(exact AS DOUBLE) AS score FROM scored", "scored"))
def _(spark, d):
    return scored_of(spark, d).select("left_uei", "right_uei", F.col("exact").alias("score"))


@query("score_jaccard", sql(f"SELECT {_PAIR}, round(jaccard, 9) AS score FROM scored", "scored"))
def _(spark, d):
    return scored_of(spark, d).select("left_uei", "right_uei", F.col("jaccard").alias("score"))


@query("score_tfidf", sql(f"SELECT {_PAIR}, round(tfidf, 6) AS score FROM scored", "scored"))
def _(spark, d):
    return scored_of(spark, d).select("left_uei", "right_uei", F.round("tfidf", 6).alias("score"))


@query("score_seqratio")
def _(spark, d):
    from kintrace.functions.udfs import seqratio

    p = pairs_of(spark, d)
    return p.select("left_uei", "right_uei", seqratio(T.norm(F.col("left_name")), T.norm(F.col("right_name"))).alias("score"))


@query("best_threshold", sql("SELECT scorer, thr, f1 FROM best", "best"))
def _(spark, d):
    return evaluate.best_threshold(scores_of(spark, d).filter("split = 'val'"))


_CELLS = "count(*) FILTER (label = 1 AND pred = 1) AS tp, count(*) FILTER (label = 0 AND pred = 1) AS fp, count(*) FILTER (label = 1 AND pred = 0) AS fn, count(*) FILTER (label = 0 AND pred = 0) AS tn"


@query("evaluate_overall", sql(f"SELECT *, round(CASE WHEN tp + fp > 0 THEN cast(tp AS DOUBLE) / (tp + fp) ELSE 0 END, 9) AS precision, round(CASE WHEN tp + fn > 0 THEN cast(tp AS DOUBLE) / (tp + fn) ELSE 0 END, 9) AS recall FROM (SELECT scorer, {_CELLS} FROM tested GROUP BY scorer)", "tested"))
def _(spark, d):
    c = evaluate.confusion(tested_of(spark, d), "scorer")
    return c.withColumn("precision", F.round(T.precision(F.col("tp"), F.col("fp")), 9)).withColumn("recall", F.round(T.recall(F.col("tp"), F.col("fn")), 9))


@query("evaluate_by_visibility", sql(f"SELECT *, round(CASE WHEN tp + fn > 0 THEN 2.0 * (tp + fn) / (tp + fp + fn + tn + tp + fn) ELSE 0 END, 9) AS floor_f1 FROM (SELECT scorer, vis, {_CELLS} FROM tested GROUP BY scorer, vis)", "tested"))
def _(spark, d):
    c = evaluate.confusion(tested_of(spark, d), "scorer", "vis")
    pos, n = F.col("tp") + F.col("fn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return c.withColumn("floor_f1", F.round(F.coalesce(F.try_divide(2.0 * pos, n + pos), F.lit(0.0)), 9))


@query("fpr_by_negative_kind", sql("SELECT scorer, kind, count(*) AS n, cast(sum(pred) AS BIGINT) AS fp FROM tested WHERE label = 0 GROUP BY scorer, kind", "tested"))
def _(spark, d):
    return tested_of(spark, d).filter("label = 0").groupBy("scorer", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("pred").alias("fp"))


@query("spend_weighted_recall", sql("SELECT scorer, cast(coalesce(sum(w) FILTER (pred = 1), 0) AS DECIMAL(28,2)) AS found, cast(sum(w) AS DECIMAL(28,2)) AS total FROM (SELECT *, greatest(obligated, 0) AS w FROM tested WHERE label = 1) GROUP BY scorer", "tested"))
def _(spark, d):
    w = F.greatest(F.col("obligated"), F.lit(0)).cast("decimal(28,2)")
    return tested_of(spark, d).filter("label = 1").groupBy("scorer").agg(F.coalesce(F.sum(F.when(F.col("pred") == 1, w)), F.lit(0)).cast("decimal(28,2)").alias("found"), F.sum(w).cast("decimal(28,2)").alias("total"))


@query("average_precision", sql("""SELECT scorer, round(sum(CASE WHEN all_p > 0 THEN tp / seen * p / all_p ELSE 0 END), 6) AS ap FROM (SELECT scorer, cast(p AS DOUBLE) AS p, cast(sum(p) OVER w AS DOUBLE) AS tp, cast(sum(n) OVER w AS DOUBLE) AS seen, cast(sum(p) OVER (PARTITION BY scorer) AS DOUBLE) AS all_p
   FROM (SELECT scorer, score, sum(label) AS p, count(*) AS n FROM score_rows WHERE split = 'test' GROUP BY scorer, score) WINDOW w AS (PARTITION BY scorer ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) GROUP BY scorer""", "score_rows"))
def _(spark, d):
    return evaluate.average_precision(scores_of(spark, d).filter("split = 'test'")).select("scorer", F.round("ap", 6).alias("ap"))


@query("report_summary", sql("SELECT (SELECT scorer FROM best ORDER BY f1 DESC, scorer LIMIT 1) AS best, max(f1) AS highest, min(f1) AS lowest FROM best", "best"))
def _(spark, d):
    b = evaluate.best_threshold(scores_of(spark, d).filter("split = 'val'"))
    return b.agg(F.min(F.struct(-F.col("f1"), "scorer"))["scorer"].alias("best"), F.max("f1").alias("highest"), F.min("f1").alias("lowest"))


def _features(spark, d, similarity=False):
    return match.attribute_features(scored_of(spark, d), V.roster(spark, d), similarity)


_SIDE = f"SELECT uei, {V.norm_address('address')} AS addr, city, cast(state AS VARCHAR) AS state, substr(zip, 1, 5) AS zip, phone, dba FROM roster"
_FEAT = f"""SELECT p.left_uei, p.right_uei, p.label, p.split, p.vis, CASE WHEN l.addr <> '' AND r.addr <> '' THEN 1.0 ELSE 0.0 END AS both_have_addr, CASE WHEN l.addr <> '' AND l.addr = r.addr THEN 1.0 ELSE 0.0 END AS same_address,
  CASE WHEN {V.norm('l.city')} = {V.norm('r.city')} THEN 1.0 ELSE 0.0 END AS same_city, CASE WHEN l.state = r.state THEN 1.0 ELSE 0.0 END AS same_state, CASE WHEN l.zip = r.zip THEN 1.0 ELSE 0.0 END AS same_zip5, CASE WHEN l.phone = r.phone THEN 1.0 ELSE 0.0 END AS same_phone,
  CASE WHEN coalesce(list_has_any({V.core('l.dba')}, {V.core('p.right_name')}), false) OR coalesce(list_has_any({V.core('r.dba')}, {V.core('p.left_name')}), false) THEN 1.0 ELSE 0.0 END AS dba_hit
  FROM pairs p JOIN ({_SIDE}) l ON l.uei = p.left_uei JOIN ({_SIDE}) r ON r.uei = p.right_uei"""


@query("pair_features", sql(f"SELECT * EXCLUDE (label, split, vis) REPLACE (cast(both_have_addr AS DOUBLE) AS both_have_addr, cast(same_address AS DOUBLE) AS same_address, cast(same_city AS DOUBLE) AS same_city, cast(same_state AS DOUBLE) AS same_state, cast(same_zip5 AS DOUBLE) AS same_zip5, cast(same_phone AS DOUBLE) AS same_phone, cast(dba_hit AS DOUBLE) AS dba_hit) FROM ({_FEAT})", "pairs"))
def _(spark, d):
    return _features(spark, d).select("left_uei", "right_uei", *match.ATTRIBUTE_FEATURES)


@query("same_address_by_stratum", sql(f"SELECT vis, count(*) AS n, count(*) FILTER (same_address = 1) AS same FROM ({_FEAT}) WHERE label = 1 GROUP BY vis", "pairs"))
def _(spark, d):
    return _features(spark, d).filter("label = 1").groupBy("vis").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("same_address") == 1).alias("same"))


@query("attributed_subset", sql(f"SELECT split, count(*) AS n, count(*) FILTER (both_have_addr = 1) AS attributed FROM ({_FEAT}) GROUP BY split", "pairs"))
def _(spark, d):
    return _features(spark, d).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("both_have_addr") == 1).alias("attributed"))


@query("logreg_scores")
def _(spark, d):
    f = _features(spark, d, similarity=True).withColumnRenamed("exact", "exact_name")
    return match.logistic(f, [*match.NAME_FEATURES, *match.ATTRIBUTE_FEATURES, "addr_sim"]).filter("split = 'test'").select("left_uei", "right_uei", "label", "vis", "probability")


# --- clustering ------------------------------------------------------------------


def _truth(spark, d, split="test"):
    pos = positives_of(spark, d)
    many = pos.groupBy("puei").count().filter("count >= 2").select("puei")
    kept = pos.join(many, "puei")
    return kept.select("split", "uei", "name", F.col("puei").alias("fam")).union(kept.select("split", F.col("puei"), F.col("pname"), F.col("puei"))).filter(F.col("split") == split).groupBy("uei").agg(F.min("fam").alias("fam"), F.min("name").alias("name"))


def _links(spark, d, split="test"):
    t = _truth(spark, d, split).select("uei", "name")
    c = blocking.by_keys(t, "token")
    names = lambda s: t.select(F.col("uei").alias(s), F.col("name").alias(f"{s}_name"))
    named = c.join(names("a"), "a").join(names("b"), "b")
    idf = match.fit_idf(match.train_names(pairs_of(spark, d)))
    scores = match.tfidf(named, idf, "a_name", "b_name").select(F.col("a").alias("a_name"), F.col("b").alias("b_name"), "tfidf")
    return named.join(scores, ["a_name", "b_name"]).select("a", "b", "tfidf")


V.view("ents", "clusters_true roster", "SELECT c.uei, min(c.fam) AS fam, any_value(r.name) AS name FROM clusters_true c JOIN roster r USING (uei) WHERE split = 'test' GROUP BY c.uei")
V.view("ew", "ents idf", f"SELECT uei, g, count(*) * coalesce(any_value(idf), 1.0) AS w FROM (SELECT uei, unnest({V.grams3('name')}) AS g FROM ents) LEFT JOIN idf USING (g) GROUP BY uei, g")
V.view("en", "ew", "SELECT uei, sqrt(sum(w * w)) AS s FROM ew GROUP BY uei")
_SIMS = "SELECT x.uei AS a, y.uei AS b, round(sum(x.w * y.w) / (any_value(p.s) * any_value(q.s)), 9) AS score FROM ew x JOIN ew y ON x.g = y.g AND x.uei < y.uei JOIN en p ON p.uei = x.uei JOIN en q ON q.uei = y.uei GROUP BY x.uei, y.uei"
V.view("cl_all", "en", f"SELECT a, b FROM ({_SIMS}) WHERE score >= 0.5")
V.view("cl_blocked", "en", f"SELECT a, b FROM ({_SIMS}) JOIN ({_keys_sql(KEY_SQL['token'], 'ents')}) USING (a, b) WHERE score >= 0.45")
for _c in ("all", "blocked"):
    V.view(f"walk_{_c}", f"cl_{_c} ents", f"SELECT uei, uei AS other FROM ents UNION SELECT w.uei, CASE WHEN e.a = w.other THEN e.b ELSE e.a END FROM walk_{_c} w JOIN cl_{_c} e ON e.a = w.other OR e.b = w.other")
    V.view(f"pred_{_c}", f"walk_{_c}", f"SELECT uei, min(other) AS cluster FROM walk_{_c} GROUP BY uei")
V.view("ct", "pred_blocked ents", "SELECT n.fam, n.cluster, nij, ni, nj FROM (SELECT fam, cluster, count(*) AS nij FROM ents JOIN pred_blocked USING (uei) GROUP BY fam, cluster) n JOIN (SELECT fam, count(*) AS ni FROM ents GROUP BY fam) USING (fam) JOIN (SELECT cluster, count(*) AS nj FROM pred_blocked GROUP BY cluster) USING (cluster)")


def _pred(spark, d):
    return evaluate.clusters(_truth(spark, d), _links(spark, d).filter("tfidf >= 0.45"))


@query("cluster_blocked", sql("SELECT uei, cluster FROM pred_blocked", "pred_blocked"))
def _(spark, d):
    return _pred(spark, d)


@query("cluster_oracle", sql("SELECT uei, cluster FROM pred_all", "pred_all"))
def _(spark, d):
    t = _truth(spark, d)
    return evaluate.clusters(t, match.cosine_forest(t.select("uei", "name"), match.fit_idf(match.train_names(pairs_of(spark, d))), 0.5))


@query("bcubed", sql("SELECT round(sum(nij * nij / nj) / sum(nij), 6) AS precision, round(sum(nij * nij / ni) / sum(nij), 6) AS recall FROM (SELECT cast(nij AS DOUBLE) AS nij, ni, nj FROM ct)", "ct"))
def _(spark, d):
    return evaluate.bcubed(evaluate.contingency(_truth(spark, d), _pred(spark, d))).select(F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("pairwise_cluster", sql("SELECT (SELECT cast(sum(nij * (nij - 1) // 2) AS BIGINT) FROM ct) AS tp, (SELECT cast(sum(n * (n - 1) // 2) AS BIGINT) FROM (SELECT count(*) AS n FROM pred_blocked GROUP BY cluster)) AS predicted, (SELECT cast(sum(n * (n - 1) // 2) AS BIGINT) FROM (SELECT count(*) AS n FROM ents GROUP BY fam)) AS \"true\"", "ct"))
def _(spark, d):
    return evaluate.pairwise(_truth(spark, d), _pred(spark, d))


@query("exact_recovery", sql("SELECT fam FROM ct WHERE nij = ni AND nij = nj", "ct"))
def _(spark, d):
    return evaluate.exact_families(evaluate.contingency(_truth(spark, d), _pred(spark, d)))


# --- filings ---------------------------------------------------------------------

_HTML = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script.*?</script>|<style.*?</style>', ' ', 'gis'), '<br\s*/?>|</tr>|</p>|</div>', chr(10), 'gi'), '</t[dh]>', chr(9), 'gi'), '<[^>]+>', ' ', 'g')"""
for _e, _c in (("&nbsp;", " "), ("&amp;", "&"), ("&#8217;", "''"), ("&rsquo;", "''"), ("&#38;", "&"), ("&quot;", '"')):
    _HTML = f"replace({_HTML}, '{_e}', '{_c}')"


@query("html_text", f"SELECT page_id, {_HTML} AS value FROM pages")
def _(spark, d):
    return V.table(spark, d, "pages").select("page_id", T.strip_html(F.col("html")).alias("value"))


_CELL = r"trim(trim(regexp_replace(c, '\s+', ' ', 'g')), ' .,;:()[]|-_*')"


@query("exhibit_names", f"SELECT page_id, name FROM (SELECT page_id, {_CELL} AS name FROM (SELECT page_id, unnest(string_split_regex({_HTML}, '[\\n\\r\\t]')) AS c FROM pages)) WHERE length(name) BETWEEN 4 AND 119 AND NOT regexp_matches(lower(name), '{'|'.join(T.LIST_NOISE)}') AND regexp_matches(name, '[A-Za-z]{{3}}') AND length(regexp_replace(name, '[^0-9]', '', 'g')) <= 0.4 * length(name)")
def _(spark, d):
    return V.table(spark, d, "pages").select("page_id", F.explode(T.list_names(F.col("html"))).alias("name"))


V.view("filings", "genuine", FILINGS)


def _match_sql(kids: str) -> str:
    """Rule per row of ``kids`` (fam, uei, name, subs [, more])."""
    c, s = V.core("name"), V.core("sub")
    rule = f"CASE WHEN {c} = {s} THEN 'same_core_tokens' WHEN len({c}) > 0 AND (list_has_all({s}, {c}) OR list_has_all({c}, {s})) AND least(len({c}), len({s})) >= 2 THEN 'core_token_containment' END"
    first = f"(SELECT rule FROM (SELECT i, {rule} AS rule FROM (SELECT i, k.subs[i] AS sub, k.name AS name FROM range(1, len(k.subs) + 1) r(i)) WHERE len({s}) > 0) WHERE rule IS NOT NULL ORDER BY i LIMIT 1)"
    return f"SELECT k.*, CASE WHEN list_contains(list_transform(k.subs, lambda x: {V.norm('x')}), {V.norm('k.name')}) THEN 'exact_normalised' WHEN len({V.core('k.name')}) = 0 THEN NULL ELSE {first} END AS rule FROM ({kids}) k"


_KIDS = "SELECT g.uei, g.name, g.puei AS fam, g.vis, f.subs FROM genuine g JOIN filings f ON f.fam = g.puei"


def _children(spark, d):
    f = filings_of(spark, d)
    return children_of(spark, d).join(f.select("fam"), "fam").select("uei", "name", "fam", "vis"), f


@query("match_children", sql(f"SELECT uei, fam, rule FROM ({_match_sql(_KIDS)})", "filings"))
def _(spark, d):
    return corroborate.match_children(*_children(spark, d)).select("uei", "fam", "rule")


@query("corroboration_by_stratum", sql(f"SELECT vis, coalesce(rule, 'none') AS rule, count(*) AS n FROM ({_match_sql(_KIDS)}) GROUP BY 1, 2", "filings"))
def _(spark, d):
    m = corroborate.match_children(*_children(spark, d))
    return m.groupBy("vis", F.coalesce("rule", F.lit("none")).alias("rule")).agg(F.count(F.lit(1)).alias("n"))


_PERM = f"SELECT a.perm, a.fam, b.fam AS other FROM (SELECT perm, fam, row_number() OVER (PARTITION BY perm ORDER BY fam) AS rn FROM filings, range(1, 6) t(perm)) a JOIN (SELECT perm, fam, row_number() OVER (PARTITION BY perm ORDER BY md5('{V.SEED}|' || perm || '|' || fam), fam) AS rn FROM filings, range(1, 6) t(perm)) b USING (perm, rn) WHERE a.fam <> b.fam"


@query("permutation_control", sql("SELECT perm, count(*) AS n, count(rule) AS hits FROM (" + _match_sql(f"SELECT p.perm, g.uei, g.name, f.subs FROM ({_PERM}) p JOIN genuine g ON g.puei = p.fam AND g.vis = 'invisible' JOIN filings f ON f.fam = p.other") + ") GROUP BY perm", "filings"))
def _(spark, d):
    kids, f = _children(spark, d)
    m = corroborate.against(kids.filter("vis = 'invisible'"), f, corroborate.permuted(f.select("fam"), 5))
    return m.withColumn("perm", F.split("fam", r"\|")[0].cast("long")).groupBy("perm").agg(F.count(F.lit(1)).alias("n"), F.count("rule").alias("hits"))


_NEXT = "SELECT fam, coalesce(lead(fam) OVER (ORDER BY len(subs), fam), lag(fam) OVER (ORDER BY len(subs), fam)) AS other FROM filings"


@query("nearest_size_control", sql("SELECT count(*) AS n, count(rule) AS hits FROM (" + _match_sql(f"SELECT g.uei, g.name, f.subs FROM ({_NEXT}) p JOIN genuine g ON g.puei = p.fam AND g.vis = 'invisible' JOIN filings f ON f.fam = p.other") + ")", "filings"))
def _(spark, d):
    kids, f = _children(spark, d)
    partner = corroborate.next_size(f.select("fam", F.size("subs").alias("n")))
    return corroborate.against(kids.filter("vis = 'invisible'"), f, partner).agg(F.count(F.lit(1)).alias("n"), F.count("rule").alias("hits"))


@query("yield_spearman", sql("SELECT round(corr(rx, ry), 6) AS rho, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY size, fam) AS rx, row_number() OVER (ORDER BY share, fam) AS ry FROM (SELECT fam, any_value(len(subs)) AS size, round(count(rule) / cast(count(*) AS DOUBLE), 9) AS share FROM (" + _match_sql(_KIDS) + ") WHERE vis = 'invisible' GROUP BY fam))", "filings"))
def _(spark, d):
    kids, f = _children(spark, d)
    m = corroborate.match_children(kids, f).filter("vis = 'invisible'").groupBy("fam").agg(F.round(F.count("rule") / F.count(F.lit(1)), 9).alias("share"))
    rows = m.join(f.select("fam", F.size("subs").alias("size")), "fam")
    return corroborate.rank_correlation(rows, "size", "share", "fam").select(F.round("rho", 6).alias("rho"), "n")
