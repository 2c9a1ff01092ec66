"""Company-like views over the driver's tables, as Spark frames and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: two-character syllables that keys are spelt with.
SYLLABLES = "bacadafagahajakalamanaparasatavabocodofogohojokolomonoporosotovo"


def _word(x: str, div: str) -> str:
    part = lambda i: f"substr('{SYLLABLES}', cast(1 + 2 * ({i}) as int), 2)"
    return f"concat({part(f'({x}) % 32')}, {part(f'(({x}) {div} 32) % 32')}, {part(f'(7 * ({x}) + ({x}) {div} 1024) % 32')})"


def _sector(x: str, div: str) -> str:
    return f"concat('a', {_word(f'({x}) % 61', div)})"


def roster_columns(div: str) -> dict[str, str]:
    """Expressions over ``customer``; ``div`` is the engine's integer division."""
    k = "c_custkey"
    f = f"({k} {div} 4)"
    w, s = (lambda x: _word(x, div)), (lambda x: _sector(x, div))
    name = f"""case when {k} % 4 = 0 then concat(upper(concat({w(f)}, ' ', {s(f)})), ' HOLDINGS INC')
        when {k} % 4 = 1 and {f} % 2 = 0 then concat({w(f)}, ' ', {s(f)}, ', Holdings, Inc.')
        when {k} % 4 = 1 then concat({w(f)}, ' ', {w(f'{f} + 911')}, ' LLC')
        when {k} % 4 = 2 then concat({w(f'13 * {f} + 5')}, ' ', {s(f'7 * {k} + 3')}, ' LLC')
        when {f} % 5 = 0 then concat({w(f'17 * {k} + 3')}, ' ', {s(f'7 * {k} + 3')}, ' Services Corp')
        else concat({w(f)}, ' ', {w(f'3 * {k} + 1')}, ' CO') end"""
    return {
        "uei": k,
        "name": name,
        "amount": "c_acctbal",
        "state": "c_nationkey",
        "city": "c_mktsegment",
        "level": f"case when {k} % 4 = 0 then 'P' else 'C' end",
        "zip": f"lpad(cast(({k} * 37) % 100000 as varchar(20)), 5, '0')",
        "phone": f"lpad(cast(({k} {div} 3) * 1000003 % 10000000000 as varchar(20)), 10, '0')",
        "address": f"case when {k} % 3 = 0 then null else concat({w(k)}, ' ST') end",
        "dba": f"case when {k} % 8 = 2 then concat(upper(concat({w(f)}, ' ', {s(f)})), ' HOLDINGS INC') end",
    }


def award_columns(div: str, n: str) -> dict[str, str]:
    """Expressions over ``orders``; ``n`` is the number of customers."""
    parent = f"""case when o_orderkey % 17 = 0 then null when o_orderkey % 10 = 0 then o_custkey
        when o_orderkey % 7 = 0 then 4 * (((o_custkey + 8) % {n}) {div} 4)
        when o_custkey % 80 = 76 then o_custkey - 4 else 4 * (o_custkey {div} 4) end"""
    return {"row_id": "o_orderkey", "uei": "o_custkey", "puei": parent, "amount": "cast(o_totalprice as decimal(18,2))", "day": "cast(o_orderdate as date)"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(*[f"{e} as {c}" for c, e in roster_columns("div").items()])


def awards(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "customer").count()
    return table(spark, sf_dir, "orders").selectExpr(*[f"{e} as {c}" for c, e in award_columns("div", str(n)).items()])


def docnames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as entities named by the first six tokens of their text."""
    first = F.slice(F.filter(F.split(F.regexp_replace("text", r"\s+", " "), " "), lambda t: t != ""), 1, 6)
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("uei"), F.array_join(first, " ").alias("name"))


# --- SQL -------------------------------------------------------------------

from kintrace.functions.text import LEGAL_ANYWHERE, LEGAL_TRAILING, STOPWORDS, STREET  # noqa: E402

_list = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"


def toks(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '[a-z0-9]+')"


def norm(c: str) -> str:
    return f"array_to_string({toks(c)}, ' ')"


def compact(c: str) -> str:
    return f"array_to_string({toks(c)}, '')"


def core(c: str, longer_than: int = 2) -> str:
    return f"list_sort(list_distinct(list_filter({toks(c)}, lambda t: length(t) > {longer_than} AND NOT list_contains({_list(STOPWORDS)}, t))))"


def block_key(c: str) -> str:
    return f"coalesce({core(c)}[1], '')"


def visibility(a: str, b: str) -> str:
    return f"CASE WHEN {norm(a)} = {norm(b)} THEN 'identical' WHEN list_has_any({core(a)}, {core(b)}) THEN 'visible' ELSE 'invisible' END"


def norm_roster(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g'))"


def strip_legal(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace({norm_roster(c)}, '{LEGAL_ANYWHERE}', ' ', 'g'), '\\s+', ' ', 'g'))"


def strip_trailing(c: str) -> str:
    return f"regexp_replace({norm(c)}, '(?:(?:^| )(?:{'|'.join(LEGAL_TRAILING)}))+$', '')"


def norm_address(c: str) -> str:
    return f"array_to_string(list_filter({toks(f'coalesce({c}, {chr(39) * 2})')}, lambda t: NOT list_contains({_list(STREET)}, t)), ' ')"


def qgrams(c: str, q: int = 4) -> str:
    s = compact(c)
    return f"CASE WHEN length({s}) = 0 THEN [] WHEN length({s}) < {q} THEN [{s}] ELSE list_distinct(list_transform(range(1, length({s}) - {q - 2}), lambda i: substr({s}, i, {q}))) END"


def grams3(c: str) -> str:
    s = f"('  ' || {norm(c)} || '  ')"
    return f"list_transform(range(1, length({s}) - 1), lambda i: substr({s}, i, 3))"


def soundex(w: str) -> str:
    """Digits of the letters; h and w are transparent, vowels part equal codes."""
    code = "translate({0}, 'bfpvcgjkqsxzdtlmnraeiouyhw', '11112222222233455600000077')".format(f"regexp_replace(lower({w}), '[^a-z]', '', 'g')")
    first = f"upper(substr(regexp_replace(lower({w}), '[^a-z]', '', 'g'), 1, 1))"
    # drop 7 (h, w) but for the first letter, whose code still counts; then squeeze runs, drop the first code and the zeros
    body = f"(substr({code}, 1, 1) || replace(substr({code}, 2), '7', ''))"
    squeezed = body
    for d in "0123456":
        squeezed = f"regexp_replace({squeezed}, '{d}+', '{d}', 'g')"
    return f"CASE WHEN {first} = '' THEN '' ELSE {first} || rpad(substr(replace(substr({squeezed}, 2), '0', ''), 1, 3), 3, '0') END"


def wilson(k: str, n: str) -> tuple[str, str]:
    p = f"(cast({k} AS DOUBLE) / {n})"
    d = f"(1 + 3.8416 / {n})"
    mid, half = f"(({p} + 3.8416 / (2 * {n})) / {d})", f"(1.96 * sqrt({p} * (1 - {p}) / {n} + 3.8416 / (4 * {n} * {n})) / {d})"
    return f"CASE WHEN {n} > 0 THEN 100 * greatest(0.0, {mid} - {half}) ELSE 0.0 END", f"CASE WHEN {n} > 0 THEN 100 * least(1.0, {mid} + {half}) ELSE 0.0 END"


SEED = "20260827"
VIEWS: dict[str, tuple[list[str], str]] = {}


def view(name: str, needs: str, body: str) -> None:
    VIEWS[name] = (needs.split(), body)


view("roster", "", "SELECT " + ", ".join(f"{e} AS {c}" for c, e in roster_columns("//").items()) + " FROM customer")
view("awards", "", "SELECT " + ", ".join(f"{e} AS {c}" for c, e in award_columns("//", "(SELECT count(*) FROM customer)").items()) + " FROM orders")
view("docnames", "", r"SELECT doc_id AS uei, array_to_string(list_slice(list_filter(string_split(regexp_replace(text, '\s+', ' ', 'g'), ' '), lambda t: t <> ''), 1, 6), ' ') AS name FROM documents")
view("pair_counts", "awards", "SELECT uei, puei, count(*) AS n, sum(amount) AS amt, min(day) AS first_day FROM awards GROUP BY uei, puei")
view("links", "pair_counts roster", """SELECT r.uei, c.name, r.puei, p.name AS pname, r.n AS award_rows, r.amt AS obligated, r.parents
  FROM (SELECT *, row_number() OVER (PARTITION BY uei ORDER BY n DESC, amt DESC, coalesce(puei, -1)) AS rn, count(puei) OVER (PARTITION BY uei) AS parents FROM pair_counts) r
  LEFT JOIN roster c ON c.uei = r.uei LEFT JOIN roster p ON p.uei = r.puei WHERE rn = 1""")  # fmt: skip
view("genuine", "links", f"SELECT *, {visibility('name', 'pname')} AS vis FROM links WHERE puei IS NOT NULL AND puei <> uei AND name IS NOT NULL AND pname IS NOT NULL")
view("family_nodes", "genuine", f"SELECT DISTINCT puei AS fam, node FROM (SELECT puei, 'E' || puei AS node FROM genuine UNION ALL SELECT puei, 'E' || uei FROM genuine UNION ALL SELECT puei, 'N' || {norm('name')} FROM genuine UNION ALL SELECT puei, 'N' || {norm('pname')} FROM genuine)")
view("family_edges", "family_nodes", "SELECT DISTINCT a.fam AS a, b.fam AS b FROM family_nodes a JOIN family_nodes b USING (node)")
view("reach", "family_edges", "SELECT a AS fam, a AS other FROM family_edges UNION SELECT r.fam, e.b FROM reach r JOIN family_edges e ON e.a = r.other")
view("components", "reach", "SELECT fam, min(other) AS component FROM reach GROUP BY fam")
view("component_sizes", "components genuine", "SELECT component, count(*) AS size FROM genuine JOIN components ON puei = fam GROUP BY component")
view("ordered_components", "component_sizes", "SELECT *, row_number() OVER (ORDER BY size DESC, component) AS rn, sum(size) OVER () AS total FROM component_sizes")
view("fold", "ordered_components", """SELECT cast(0 AS BIGINT) AS rn, cast(0 AS BIGINT) AS component, '' AS split, cast(0 AS DOUBLE) AS f1, cast(0 AS DOUBLE) AS f2, cast(0 AS DOUBLE) AS f3
  UNION ALL SELECT rn, component, split, CASE WHEN split = 'train' THEN f1 + size ELSE f1 END, CASE WHEN split = 'val' THEN f2 + size ELSE f2 END, CASE WHEN split = 'test' THEN f3 + size ELSE f3 END
  FROM (SELECT o.rn, o.component, o.size, f.f1, f.f2, f.f3,
    CASE WHEN (0.6e0 * total - f.f1) / (0.6e0 * total) >= greatest((0.2e0 * total - f.f2) / (0.2e0 * total), (0.2e0 * total - f.f3) / (0.2e0 * total)) THEN 'train'
         WHEN (0.2e0 * total - f.f2) / (0.2e0 * total) >= (0.2e0 * total - f.f3) / (0.2e0 * total) THEN 'val' ELSE 'test' END AS split
    FROM fold f JOIN ordered_components o ON o.rn = f.rn + 1)""")  # fmt: skip
view("splits", "fold components", "SELECT c.fam, c.component, f.split FROM components c JOIN fold f ON f.component = c.component AND f.rn > 0")
view("positives", "genuine splits", "SELECT g.uei, g.name, g.puei, g.pname, g.vis, g.obligated, s.split FROM genuine g JOIN splits s ON s.fam = g.puei")
view("parents", "positives", "SELECT split, puei, min(pname) AS pname, row_number() OVER (PARTITION BY split ORDER BY puei) - 1 AS rk, count(*) OVER (PARTITION BY split) AS n_parents FROM positives GROUP BY split, puei")
view("quotas", "positives", "SELECT split, count(*) AS quota FROM positives GROUP BY split HAVING count(*) >= 4 AND count(DISTINCT puei) >= 4")
_draw = lambda kind, i="": f"md5('{SEED}|{kind}|' || c.uei || '|' || {i or 'p.puei'})"
view("neg_random", "parents quotas", f"""SELECT split, uei, puei, rn FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY h, uei, puei) AS rn FROM (
  SELECT c.split, c.uei, p.puei, min({_draw('random')}) AS h FROM positives c CROSS JOIN range(4) t(i) JOIN quotas USING (split)
  JOIN parents p ON p.split = c.split AND p.rk = cast('0x' || substr({_draw('random', 'i')}, 1, 8) AS BIGINT) % p.n_parents
  WHERE p.puei <> c.puei AND p.puei <> c.uei GROUP BY c.split, c.uei, p.puei)) JOIN quotas USING (split) WHERE rn <= quota""")  # fmt: skip
def _drawn(kind: str, keys) -> None:
    """Views of a child's keys that parents have and of the partners drawn by them."""
    view(f"held_{kind}", "parents", f"SELECT split, puei, t, row_number() OVER (PARTITION BY split, t ORDER BY puei) - 1 AS rk, count(*) OVER (PARTITION BY split, t) AS n FROM (SELECT split, puei, unnest({keys('pname')}) AS t FROM parents)")
    view(f"keys_{kind}", f"quotas held_{kind}", f"SELECT c.split, c.uei, c.puei, list({{'t': t, 'n': n}} ORDER BY t) AS ts FROM (SELECT split, uei, puei, unnest({keys('name')}) AS t FROM positives JOIN quotas USING (split)) c JOIN (SELECT DISTINCT split, t, n FROM held_{kind}) USING (split, t) GROUP BY c.split, c.uei, c.puei")
    view(f"drawn_{kind}", f"keys_{kind}", f"""SELECT DISTINCT c.split, c.uei, p.puei, {_draw(kind)} AS h
  FROM (SELECT *, ts[cast('0x' || substr(d, 1, 8) AS BIGINT) % len(ts) + 1] AS x FROM (SELECT c.*, {_draw(kind, 'i')} AS d FROM keys_{kind} c CROSS JOIN range(60) t(i))) c
  JOIN held_{kind} p ON p.split = c.split AND p.t = c.x.t AND p.rk = cast('0x' || substr(d, 9, 8) AS BIGINT) % c.x.n WHERE p.puei <> c.puei AND p.puei <> c.uei""")  # fmt: skip


_drawn("hard_string", core)
_drawn("same_block", lambda c: f"[{block_key(c)}]")
view("pool_hard", "drawn_hard_string neg_random", "SELECT * FROM drawn_hard_string d WHERE NOT EXISTS (SELECT 1 FROM neg_random n WHERE n.uei = d.uei AND n.puei = d.puei)")
view("neg_hard", "pool_hard", "SELECT split, uei, puei, rn FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY h, uei, puei) AS rn FROM pool_hard) JOIN quotas USING (split) WHERE rn <= quota")
view("pool_block", "drawn_same_block neg_hard", "SELECT * FROM drawn_same_block d WHERE NOT EXISTS (SELECT 1 FROM neg_random n WHERE n.uei = d.uei AND n.puei = d.puei) AND NOT EXISTS (SELECT 1 FROM neg_hard n WHERE n.uei = d.uei AND n.puei = d.puei)")
view("neg_block", "pool_block", "SELECT split, uei, puei, rn FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY h, uei, puei) AS rn FROM pool_block) JOIN quotas USING (split) WHERE rn <= quota")
view("pairs", "neg_random neg_hard neg_block", f"""SELECT uei AS left_uei, name AS left_name, puei AS right_uei, pname AS right_name, 1 AS label, cast(NULL AS VARCHAR) AS kind, vis, puei AS family, split, obligated FROM positives
  UNION ALL SELECT n.uei, c.name, n.puei, p.pname, 0, n.kind, {visibility('c.name', 'p.pname')}, NULL, n.split, c.obligated
  FROM (SELECT *, 'random' AS kind FROM neg_random UNION ALL SELECT *, 'hard_string' FROM neg_hard UNION ALL SELECT *, 'same_block' FROM neg_block) n
  JOIN positives c ON c.uei = n.uei JOIN parents p ON p.puei = n.puei AND p.split = n.split""")  # fmt: skip
view("names", "pairs", "SELECT DISTINCT name FROM (SELECT left_name AS name FROM pairs UNION ALL SELECT right_name FROM pairs)")
view("idf", "pairs", f"SELECT g, ln(cast(n AS DOUBLE) / (1 + count(*))) + 1.0 AS idf FROM (SELECT unnest(list_distinct({grams3('name')})) AS g FROM (SELECT left_name AS name FROM pairs WHERE split = 'train' UNION ALL SELECT right_name FROM pairs WHERE split = 'train')), (SELECT 2 * count(*) AS n FROM pairs WHERE split = 'train') GROUP BY g, n")
view("weights", "names idf", f"SELECT name, g, count(*) * coalesce(any_value(idf), 1.0) AS w FROM (SELECT name, unnest({grams3('name')}) AS g FROM names) LEFT JOIN idf USING (g) GROUP BY name, g")
view("norms", "weights", "SELECT name, sqrt(sum(w * w)) AS norm FROM weights GROUP BY name")
view("name_pairs", "pairs", "SELECT DISTINCT left_name AS a, right_name AS b FROM pairs")
view("tfidf", "name_pairs weights norms", "SELECT a, b, round(coalesce(dot / (x.norm * y.norm), 0.0), 9) AS score FROM (SELECT p.a, p.b, sum(u.w * v.w) AS dot FROM name_pairs p LEFT JOIN weights u ON u.name = p.a LEFT JOIN weights v ON v.name = p.b AND v.g = u.g GROUP BY p.a, p.b) LEFT JOIN norms x ON x.name = a LEFT JOIN norms y ON y.name = b")
_jac = f"CASE WHEN len({core('left_name')}) > 0 AND len({core('right_name')}) > 0 THEN cast(len(list_intersect({core('left_name')}, {core('right_name')})) AS DOUBLE) / len(list_distinct(list_concat({core('left_name')}, {core('right_name')}))) ELSE 0.0 END"
view("scored", "pairs tfidf", f"SELECT p.*, CASE WHEN {norm('left_name')} = {norm('right_name')} THEN 1.0 ELSE 0.0 END AS exact, {_jac} AS jaccard, t.score AS tfidf FROM pairs p LEFT JOIN tfidf t ON t.a = left_name AND t.b = right_name")
view("score_rows", "scored", "SELECT 'exact' AS scorer, split, label, kind, vis, obligated, round(exact, 9) AS score FROM scored UNION ALL SELECT 'jaccard', split, label, kind, vis, obligated, round(jaccard, 9) FROM scored UNION ALL SELECT 'tfidf', split, label, kind, vis, obligated, tfidf FROM scored")
view("cuts", "score_rows", "SELECT scorer, thr FROM (SELECT scorer, thr, row_number() OVER (PARTITION BY scorer ORDER BY thr) - 1 AS i, count(*) OVER (PARTITION BY scorer) AS n FROM (SELECT DISTINCT scorer, round(score, 3) AS thr FROM score_rows WHERE split = 'val')) WHERE n <= 200 OR i % (n // 200) = 0")
view("sweep", "cuts score_rows", "SELECT c.scorer, c.thr, count(*) FILTER (label = 1 AND score >= thr) AS tp, count(*) FILTER (label = 0 AND score >= thr) AS fp, count(*) FILTER (label = 1 AND score < thr) AS fn FROM cuts c JOIN score_rows s ON s.scorer = c.scorer AND s.split = 'val' GROUP BY c.scorer, c.thr")
view("best", "sweep", "SELECT scorer, thr, f1 FROM (SELECT *, row_number() OVER (PARTITION BY scorer ORDER BY f1 DESC, thr) AS rn FROM (SELECT scorer, thr, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 200.0 * tp / (2 * tp + fp + fn) ELSE 0 END, 2) AS f1 FROM sweep)) WHERE rn = 1")
view("tested", "score_rows best", "SELECT s.*, b.thr, cast(score >= thr AS INT) AS pred FROM score_rows s JOIN best b USING (scorer) WHERE split = 'test'")
view("clusters_true", "positives", "SELECT DISTINCT split, uei, puei AS fam FROM (SELECT split, uei, puei FROM positives WHERE puei IN (SELECT puei FROM positives GROUP BY puei HAVING count(*) >= 2) UNION ALL SELECT split, puei, puei FROM positives WHERE puei IN (SELECT puei FROM positives GROUP BY puei HAVING count(*) >= 2))")


def sql(body: str, *needs: str) -> str:
    """``body`` after the common table expressions it needs, in order."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in VIEWS[name][0]:
            if n != name:
                add(n)
        if name not in order:
            order.append(name)

    for n in needs:
        add(n)
    if not order:
        return body
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in order) + "\n" + body
