"""Queries: pair knowledge base and interaction check.

Orders stand for lists, parts for concepts, parts of one order for interacting pairs: graded where the order's status is O,
with templates (the smaller part's type) where it is F.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import pairs as P
from ..sources.tables import table
from .registry import query, stored

LEVELS = {"1-URGENT": "Major", "2-HIGH": "Moderate", "3-MEDIUM": "Minor"}
RULES = [(1, ["PROMO"], ["ECONOMY", "LARGE"]), (2, ["SMALL"], ["SMALL", "PROMO"])]

SQL_PAIRS = """
m AS MATERIALIZED (SELECT DISTINCT l_orderkey AS list_id, l_partkey AS p FROM lineitem),
raw AS MATERIALIZED (
  SELECT a.list_id, a.p AS a, b.p AS b, o_orderstatus AS source, p_type AS template,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'Major' WHEN '2-HIGH' THEN 'Moderate' WHEN '3-MEDIUM' THEN 'Minor' ELSE 'Unknown' END AS severity
  FROM m a JOIN m b ON a.list_id = b.list_id AND a.p < b.p JOIN orders ON o_orderkey = a.list_id JOIN part ON p_partkey = a.p WHERE o_orderstatus IN ('O', 'F')),
ranked AS (SELECT *, CASE severity WHEN 'Major' THEN 0 WHEN 'Moderate' THEN 1 WHEN 'Minor' THEN 2 ELSE 3 END AS r FROM raw),
graded AS MATERIALIZED (SELECT a, b, min_by(severity, r) AS severity FROM ranked WHERE source = 'O' GROUP BY a, b),
templates AS MATERIALIZED (SELECT DISTINCT a, b, template FROM raw WHERE source = 'F'),
severity AS MATERIALIZED (
  SELECT template, n_pairs, n_graded, round(major, 6) AS share_major,
         CASE WHEN n_graded >= 10 AND major >= 0.5 THEN 'Major' WHEN n_graded >= 10 AND minor >= 0.5 THEN 'Minor' WHEN n_graded >= 10 THEN 'Moderate'
              WHEN n_graded >= 3 AND major >= 0.75 THEN 'Major' ELSE 'Moderate' END AS derived_severity
  FROM (SELECT template, count(*) AS n_pairs, count(g.severity) AS n_graded,
               coalesce(count(*) FILTER (g.severity = 'Major') / nullif(count(g.severity), 0)::DOUBLE, 0) AS major,
               coalesce(count(*) FILTER (g.severity = 'Minor') / nullif(count(g.severity), 0)::DOUBLE, 0) AS minor
        FROM templates t LEFT JOIN (SELECT * FROM graded WHERE severity <> 'Unknown') g USING (a, b) GROUP BY template))"""
SQL_KNOWN = (
    SQL_PAIRS
    + """,
derived AS MATERIALIZED (SELECT a, b, min_by(derived_severity, CASE derived_severity WHEN 'Major' THEN 0 WHEN 'Moderate' THEN 1 ELSE 2 END) AS derived FROM templates JOIN severity USING (template) GROUP BY a, b),
known AS MATERIALIZED (
  SELECT coalesce(g.a, d.a) AS a, coalesce(g.b, d.b) AS b, CASE WHEN g.severity IN ('Major', 'Moderate', 'Minor') THEN g.severity ELSE coalesce(d.derived, 'Unknown') END AS severity,
         coalesce(g.severity, 'Unknown') = 'Unknown' AS derived, CAST((g.a IS NOT NULL)::INT + (d.a IS NOT NULL)::INT AS INTEGER) AS sources
  FROM graded g FULL JOIN derived d ON g.a = d.a AND g.b = d.b)"""
)


def raw_pairs(spark: SparkSession, d: str) -> DataFrame:
    """(list_id, a, b, source, priority, template, severity): what the base is built from, made once a session."""
    return stored(spark, d, "raw-pairs", _raw_pairs)


def _raw_pairs(spark: SparkSession, d: str) -> DataFrame:
    lists = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("list_id"), F.col("l_partkey").alias("p"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("list_id"), F.col("o_orderstatus").alias("source"), F.col("o_orderpriority").alias("priority"))
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("a"), F.col("p_type").alias("template"))
    orders = orders.filter("source in ('O', 'F')")
    level = F.coalesce(*(F.when(F.col("priority") == k, v) for k, v in LEVELS.items()), F.lit("Unknown"))
    # Lists of other orders go before they are paired.
    return P.pairs_in_lists(lists.join(orders.select("list_id"), "list_id", "left_semi"), "list_id", "p").join(orders, "list_id").join(parts, "a").withColumn("severity", level)


def graded(raw: DataFrame) -> DataFrame:
    return P.most_severe(raw.filter("source = 'O'"))


def templates(raw: DataFrame) -> DataFrame:
    return raw.filter("source = 'F'").select("a", "b", "template").distinct()


def known_pairs(raw: DataFrame) -> DataFrame:
    g, t = graded(raw), templates(raw)
    derived = t.join(P.template_severity(t, g), "template").groupBy("a", "b").agg(F.min_by("derived_severity", P.rank(F.col("derived_severity"))).alias("by_template"))
    both = g.withColumnRenamed("severity", "level").join(derived, ["a", "b"], "full_outer")
    plain = F.col("level").isin("Major", "Moderate", "Minor")
    return both.select(
        "a", "b", F.when(plain, F.col("level")).otherwise(F.coalesce("by_template", F.lit("Unknown"))).alias("severity"), (F.coalesce("level", F.lit("Unknown")) == "Unknown").alias("derived"),
        (F.col("level").isNotNull().cast("int") + F.col("by_template").isNotNull().cast("int")).alias("sources"),
    )


@query("SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem WHERE l_partkey <> l_suppkey")
def q_pair_canonical(spark, d):
    return P.canonical_pairs(table(spark, d, "lineitem"), "l_partkey", "l_suppkey")


@query(f"WITH {SQL_PAIRS} SELECT a, b, severity FROM graded")
def q_most_severe(spark, d):
    return graded(raw_pairs(spark, d))


@query(f"WITH {SQL_PAIRS} SELECT a, b, string_agg(template, '|' ORDER BY template) AS templates, count(*) AS n FROM templates GROUP BY a, b")
def q_aligned_lists(spark, d):
    t = templates(raw_pairs(spark, d))
    return t.groupBy("a", "b").agg(F.array_join(F.sort_array(F.collect_list("template")), "|").alias("templates"), F.count("*").alias("n"))


@query(f"WITH {SQL_PAIRS}, t AS (SELECT DISTINCT a, b, template, template || ' of ' || severity AS text FROM raw WHERE source = 'F') SELECT a, b, string_agg(template, '|' ORDER BY template, text) AS templates, string_agg(text, '|' ORDER BY template, text) AS descriptions FROM t GROUP BY a, b")
def q_aligned_descriptions(spark, d):
    """Templates and descriptions of each pair, distinct and in one order, so that the n-th of one list belongs to the n-th of the other."""
    rows = raw_pairs(spark, d).filter("source = 'F'").select("a", "b", "template", F.concat("template", F.lit(" of "), "severity").alias("text"))
    held = rows.groupBy("a", "b").agg(F.sort_array(F.collect_set(F.struct("template", "text"))).alias("x"))
    return held.select("a", "b", F.array_join("x.template", "|").alias("templates"), F.array_join("x.text", "|").alias("descriptions"))


@query(f"WITH {SQL_PAIRS} SELECT template, derived_severity, n_pairs, n_graded, share_major FROM severity")
def q_template_severity(spark, d):
    raw = raw_pairs(spark, d)
    return P.template_severity(templates(raw), graded(raw))


@query(f"WITH {SQL_KNOWN} SELECT a, b, severity, derived, sources FROM known")
def q_kb_interactions(spark, d):
    return known_pairs(raw_pairs(spark, d))


@query(f"WITH {SQL_PAIRS}, s AS (SELECT a, b, count(DISTINCT source) AS n, min(source) AS s FROM raw WHERE source IN ('O', 'F') GROUP BY a, b) SELECT count(*) AS pairs, count(*) FILTER (n = 2) AS both_sources, count(*) FILTER (n = 1 AND s = 'O') AS only_graded, count(*) FILTER (n = 1 AND s = 'F') AS only_template FROM s")
def q_source_overlap(spark, d):
    s = raw_pairs(spark, d).filter("source in ('O', 'F')").groupBy("a", "b").agg(F.bool_or(F.col("source") == "O").alias("o"), F.bool_or(F.col("source") == "F").alias("f"))
    return s.agg(F.count("*").alias("pairs"), F.count_if(F.expr("o and f")).alias("both_sources"), F.count_if(F.expr("o and not f")).alias("only_graded"), F.count_if(F.expr("f and not o")).alias("only_template"))


@query("SELECT l_partkey AS part, string_agg(c, '' ORDER BY c) AS codes FROM (SELECT DISTINCT l_partkey, o_orderpriority[1] AS c FROM lineitem JOIN orders ON o_orderkey = l_orderkey) GROUP BY l_partkey")
def q_sorted_concat(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy(F.col("l_partkey").alias("part")).agg(F.array_join(F.sort_array(F.collect_set(F.substring("o_orderpriority", 1, 1))), "").alias("codes"))


@query("""SELECT part, string_agg(code, '' ORDER BY code) AS codes FROM (
  SELECT l_orderkey AS part, l_linestatus AS code, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY ALL) JOIN (
  SELECT l_orderkey AS part, count(DISTINCT l_linenumber) AS total FROM lineitem GROUP BY ALL) USING (part) WHERE n = total GROUP BY part""")
def q_set_intersection(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("part"), F.col("l_linestatus").alias("code"), "l_linenumber").distinct()
    by_code = rows.groupBy("part", "code").agg(F.count("*").alias("n"))
    total = rows.select("part", "l_linenumber").distinct().groupBy("part").agg(F.count("*").alias("total"))
    return by_code.join(total, "part").filter("n = total").groupBy("part").agg(F.array_join(F.sort_array(F.collect_list("code")), "").alias("codes"))


@query(f"WITH {SQL_PAIRS} SELECT DISTINCT p FROM (SELECT a AS p FROM raw UNION SELECT b FROM raw)")
def q_endpoints(spark, d):
    raw = raw_pairs(spark, d)
    return raw.select(F.col("a").alias("p")).union(raw.select("b")).distinct()


@query("SELECT l_orderkey AS list_id, count(DISTINCT l_partkey) AS n, string_agg(DISTINCT l_partkey::VARCHAR, ',' ORDER BY l_partkey::VARCHAR) AS items FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_partkey) >= 5")
def q_collect_set_having(spark, d):
    items = F.sort_array(F.collect_set(F.col("l_partkey").cast("string")))
    found = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("list_id")).agg(items.alias("x"))
    return found.filter(F.size("x") >= 5).select("list_id", F.size("x").cast("long").alias("n"), F.array_join("x", ",").alias("items"))


@query("""SELECT 'orphan_order' AS rule, count(*) AS bad FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'orphan_part', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'duplicate_part', count(*) FROM (SELECT p_partkey FROM part GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'negative_quantity', count(*) FROM lineitem WHERE l_quantity < 0""")
def q_integrity(spark, d):
    lines, orders, parts = (table(spark, d, n) for n in ("lineitem", "orders", "part"))
    count = lambda name, df: df.agg(F.count("*").alias("bad")).select(F.lit(name).alias("rule"), "bad")
    return (
        count("orphan_order", lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"], "left_anti"))
        .union(count("orphan_part", lines.join(parts, lines["l_partkey"] == parts["p_partkey"], "left_anti")))
        .union(count("duplicate_part", parts.groupBy("p_partkey").count().filter("count > 1")))
        .union(count("negative_quantity", lines.filter("l_quantity < 0")))
    )


SQL_LISTS = "active AS (SELECT DISTINCT l_orderkey AS list_id, l_partkey AS p FROM lineitem WHERE l_linestatus = 'O')"


def active_pairs(spark, d):
    lines = table(spark, d, "lineitem").filter("l_linestatus = 'O'")
    return P.pairs_in_lists(lines.select(F.col("l_orderkey").alias("list_id"), F.col("l_partkey").alias("p")), "list_id", "p")


@query(f"WITH {SQL_LISTS} SELECT x.list_id, x.p AS a, y.p AS b FROM active x JOIN active y ON x.list_id = y.list_id AND x.p < y.p")
def q_pairs(spark, d):
    return active_pairs(spark, d)


SQL_STATUS = f"""WITH {SQL_KNOWN}, {SQL_LISTS},
covered AS (SELECT p, bool_or(source = 'O') AS o, bool_or(source = 'F') AS f FROM (SELECT a AS p, source FROM raw UNION SELECT b, source FROM raw) GROUP BY p),
pairs AS (SELECT x.list_id, x.p AS a, y.p AS b FROM active x JOIN active y ON x.list_id = y.list_id AND x.p < y.p),
checked AS MATERIALIZED (
  SELECT list_id, a, b, severity, derived,
         CASE WHEN severity IS NOT NULL THEN 'INTERACTION' WHEN (ca.o AND cb.o) OR (ca.f AND cb.f) THEN 'NO_KNOWN_INTERACTION' ELSE 'NOT_COVERED' END AS status
  FROM pairs LEFT JOIN known USING (a, b) LEFT JOIN covered ca ON ca.p = a LEFT JOIN covered cb ON cb.p = b)"""


def checked_pairs(spark, d):
    """Active pairs with their status; a pair is on record if any source has it."""
    raw = raw_pairs(spark, d)
    ends = raw.select(F.col("a").alias("item"), "source").union(raw.select("b", "source"))
    covered = ends.groupBy("item").agg(F.collect_set("source").alias("sources"))
    return P.pair_status(active_pairs(spark, d), known_pairs(raw).select("a", "b", "severity", "derived"), covered)


@query(SQL_STATUS + " SELECT list_id, a, b, severity, status FROM checked")
def q_pair_status(spark, d):
    return checked_pairs(spark, d).select("list_id", "a", "b", "severity", "status")


@query(SQL_STATUS + " SELECT status, coalesce(severity, '-') AS severity, count(*) AS n, count(DISTINCT list_id) AS lists FROM checked GROUP BY ALL")
def q_report_counts(spark, d):
    return checked_pairs(spark, d).groupBy("status", F.coalesce("severity", F.lit("-")).alias("severity")).agg(F.count("*").alias("n"), F.count_distinct("list_id").alias("lists"))


@query(SQL_STATUS + ", v AS (SELECT list_id, count(*) AS n, count(*) FILTER (status = 'INTERACTION') AS hits FROM checked GROUP BY list_id) SELECT median(n) AS median_pairs, max(n) AS max_pairs, round(sum(hits) / sum(n)::DOUBLE, 6) AS hit_share FROM v")
def q_pair_volume(spark, d):
    v = checked_pairs(spark, d).groupBy("list_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "INTERACTION").alias("hits"))
    return v.agg(F.percentile("n", F.lit(0.5)).alias("median_pairs"), F.max("n").alias("max_pairs"), F.round(F.sum("hits") / F.sum("n"), 6).alias("hit_share"))


SQL_RISK = SQL_STATUS + """,
risky AS MATERIALIZED (SELECT list_id, a, b, severity, derived,
  round(CASE severity WHEN 'Major' THEN 1.0 WHEN 'Moderate' THEN 0.6 WHEN 'Minor' THEN 0.3 ELSE 0.25 END * CASE WHEN derived THEN 0.8 ELSE 1.0 END * CASE WHEN (a + b) % 2 = 0 THEN 1.0 ELSE 0.85 END * CAST(0.9 AS DOUBLE), 3) AS risk
  FROM checked WHERE status = 'INTERACTION'),
tiered AS (SELECT *, CASE WHEN risk >= 0.7 THEN 'critical' WHEN risk >= 0.5 OR severity = 'Major' THEN 'review' ELSE 'info' END AS tier FROM risky)"""


def tiered_pairs(spark, d):
    found = checked_pairs(spark, d).filter("status = 'INTERACTION'")
    score = P.risk(F.col("severity"), F.col("derived"), F.when((F.col("a") + F.col("b")) % 2 == 0, 2).otherwise(1), F.lit(0.9))
    return found.withColumn("risk", score).withColumn("tier", P.tier(F.col("risk"), F.col("severity")))


@query(SQL_RISK + " SELECT list_id, a, b, severity, risk, tier FROM tiered")
def q_risk(spark, d):
    return tiered_pairs(spark, d).select("list_id", "a", "b", "severity", "risk", "tier")


@query(SQL_RISK + " SELECT list_id, a, b, tier, CAST(row_number() OVER (PARTITION BY list_id ORDER BY CASE tier WHEN 'critical' THEN 0 WHEN 'review' THEN 1 ELSE 2 END, risk DESC, a, b) AS INTEGER) AS place FROM tiered")
def q_findings_sorted(spark, d):
    order = F.when(F.col("tier") == "critical", 0).when(F.col("tier") == "review", 1).otherwise(2)
    w = Window.partitionBy("list_id").orderBy(order, F.col("risk").desc(), "a", "b")
    return tiered_pairs(spark, d).select("list_id", "a", "b", "tier", F.row_number().over(w).alias("place"))


@query(SQL_RISK + " SELECT list_id, count(*) FILTER (tier = 'critical') AS critical, count(*) FILTER (tier = 'review') AS review, count(*) FILTER (tier = 'info') AS info, max(risk) AS top_risk FROM tiered GROUP BY list_id")
def q_report(spark, d):
    t = tiered_pairs(spark, d)
    return t.groupBy("list_id").agg(*(F.count_if(F.col("tier") == k).alias(k) for k in ("critical", "review", "info")), F.max("risk").alias("top_risk"))


@query("SELECT l_orderkey AS list_id, p_type AS concept, count(DISTINCT l_partkey) AS n_items, string_agg(DISTINCT l_partkey::VARCHAR, '|' ORDER BY l_partkey::VARCHAR) AS items FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL HAVING count(DISTINCT l_partkey) > 1")
def q_duplicates(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return P.duplicates(rows.select(F.col("l_orderkey").alias("list_id"), F.col("p_type").alias("concept"), "l_partkey"), "list_id", "concept", "l_partkey")


def _rule_sql() -> str:
    rows = ", ".join(f"({n}, '{s}', '{t}')" for n, *sides in RULES for s, types in zip("AB", sides, strict=True) for t in types)
    return f"""WITH {SQL_LISTS}, rules(rule_no, side, kind) AS (VALUES {rows}),
members AS (SELECT DISTINCT rule_no, side, p_partkey AS item FROM rules JOIN part ON contains(p_type, kind)),
pairs AS (SELECT DISTINCT x.p AS a, y.p AS b FROM active x JOIN active y ON x.list_id = y.list_id AND x.p < y.p)
SELECT a, b, min(m.rule_no) AS rule_no FROM pairs JOIN members m ON m.item = a JOIN members n ON n.item = b AND n.rule_no = m.rule_no AND n.side <> m.side GROUP BY a, b"""


@query(_rule_sql())
def q_rule_match(spark, d):
    rules = spark.createDataFrame([(n, s, t) for n, *sides in RULES for s, types in zip("AB", sides, strict=True) for t in types], "rule_no int, side string, kind string")
    members = table(spark, d, "part").join(F.broadcast(rules), F.contains("p_type", "kind")).select("rule_no", "side", F.col("p_partkey").alias("item")).distinct()
    return P.rule_matches(active_pairs(spark, d).select("a", "b").distinct(), members)


SQL_CUT = "TIMESTAMP '1996-01-01'"


@query(f"""WITH x AS (SELECT o_custkey AS cust, l_partkey AS part, o_orderdate < {SQL_CUT} AS early, max(l_quantity) AS q FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL),
l AS (SELECT cust, part, q AS before FROM x WHERE early), r AS (SELECT cust, part, q AS after FROM x WHERE NOT early)
SELECT coalesce(l.cust, r.cust) AS cust, coalesce(l.part, r.part) AS part, before, after,
  CASE WHEN r.part IS NULL THEN 'omission' WHEN l.part IS NULL THEN 'new' WHEN before <> after THEN 'change' ELSE 'same' END AS kind,
  CAST(CASE WHEN r.part IS NULL THEN 0.5 WHEN l.part IS NULL THEN 0.1 WHEN before <> after THEN 0.4 ELSE 0.0 END AS DOUBLE) AS risk
FROM l FULL JOIN r ON l.cust = r.cust AND l.part = r.part""")
def q_reconcile(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    early = F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")
    sides = rows.groupBy(F.col("o_custkey").alias("cust"), F.col("l_partkey").alias("part"), early.alias("early")).agg(F.max("l_quantity").alias("q"))
    return P.reconcile(sides.filter("early").drop("early"), sides.filter("not early").drop("early"), ["cust", "part"], "q")


@query()
def q_components(spark, d):
    """Components of all suppliers and parts that line items link; a search in SQL is too slow on whole tables, so tests hold it against a plain one."""
    links = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") + 1000000000).alias("b"))
    return P.components(links)


@query("SELECT DISTINCT o_orderstatus AS code FROM orders")
def q_distinct_codes(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderstatus").alias("code")).distinct()


@query("SELECT o_orderkey AS id, o_custkey AS patient, o_totalprice AS total FROM orders WHERE o_orderstatus = 'O'")
def q_scan_project(spark, d):
    return table(spark, d, "orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("patient"), F.col("o_totalprice").alias("total"))


@query("SELECT count(*) AS n FROM lineitem")
def q_count(spark, d):
    return table(spark, d, "lineitem").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_type FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def q_semi(spark, d):
    parts, lines = table(spark, d, "part"), table(spark, d, "lineitem").filter("l_quantity > 45")
    return parts.join(lines, parts["p_partkey"] == lines["l_partkey"], "left_semi").select("p_partkey", "p_type")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def q_unmapped(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey")


@query(f"WITH {SQL_PAIRS} SELECT count(DISTINCT (a, b)) AS pairs, count(DISTINCT a) AS smaller, round(count(DISTINCT (a, b)) / ((SELECT count(*) FROM part) * ((SELECT count(*) FROM part) - 1) / 2)::DOUBLE, 9) AS density FROM raw")
def q_density(spark, d):
    n = table(spark, d, "part").count()
    raw = raw_pairs(spark, d)
    return raw.agg(F.count_distinct("a", "b").alias("pairs"), F.count_distinct("a").alias("smaller")).withColumn("density", F.round(F.col("pairs") / (n * (n - 1) / 2), 9))
