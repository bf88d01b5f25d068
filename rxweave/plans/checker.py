"""Queries: the whole check of medication lists.  Line items stand for medications, parts for concepts; every tenth part is the nasal form of the one before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import checker as C
from ..operators import pairs as P
from ..operators.shared import new_folder, sized
from ..sources import store
from ..sources.tables import table
from .knowledge import RULES, SQL_KNOWN, SQL_PAIRS, graded, known_pairs, raw_pairs, templates
from .registry import query


def concepts(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    sources = F.array_compact(F.array(F.when(~(k % 10).isin(3, 7), "template"), F.when(~(k % 10).isin(5, 7), C.GRADED_SOURCE)))
    name = F.when(k % 10 == 3, F.concat(F.lit("p"), (k - 1).cast("string"), F.lit(" (nasal)"))).otherwise(F.concat(F.lit("p"), k.cast("string")))
    return table(spark, d, "part").select(k.alias("concept"), name.alias("concept_name"), sources.alias("sources"), F.when(k % 4 == 0, "").otherwise(F.col("p_brand")).alias("home"))


def entries(spark, d) -> DataFrame:
    k, line = F.col("l_partkey"), F.col("l_linenumber")
    rows = table(spark, d, "lineitem").filter("l_linestatus = 'O'")
    med = (line * 10_000_000 + k).cast("long")
    name = F.concat(F.lit("p"), F.when(k % 10 == 3, k - 1).otherwise(k).cast("string"))
    return rows.select(F.col("l_orderkey").alias("list_id"), med.alias("med"), med.alias("place"), name.alias("name"), F.when((k % 10 == 3) | (line % 5 == 0), "Nasal").alias("route")).distinct()


def known(raw: DataFrame) -> DataFrame:
    """(a, b, level, mechanisms, record_sources): the stored knowledge base by pair."""
    g, t = graded(raw), templates(raw)
    found = C.mechanisms(t.withColumn("text", F.concat(F.lit("text of "), "template")), P.template_severity(t, g))
    both = g.withColumnRenamed("severity", "level").join(found, ["a", "b"], "full_outer")
    names = F.array_compact(F.array(F.when(F.col("level").isNotNull(), C.GRADED_SOURCE), F.when(F.col("mechanisms").isNotNull(), "template")))
    return both.withColumn("record_sources", names)


def write_knowledge_base(raw: DataFrame, folder: str, named: DataFrame) -> None:
    """The knowledge base as a new version in a folder: pairs with what each source has, what each pair comes to, severities of templates, and concepts."""
    tables = {"interactions": known(raw), "pairs": known_pairs(raw), "template_severity": P.template_severity(templates(raw), graded(raw)), "concepts": named}
    store.publish(tables, folder, {"interactions": ["a", "b"], "pairs": ["a", "b"], "template_severity": ["template"], "concepts": ["concept"]}, {"source": "orders"})


_BASES: dict[tuple[str, str], str] = {}


def knowledge_base(spark, d) -> str:
    """The folder of the stored knowledge base, built once a session; checks read it from there."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _BASES:
        folder = new_folder(spark, "knowledge-base")
        write_knowledge_base(raw_pairs(spark, d), folder, concepts(spark, d))
        _BASES[key] = folder
    return _BASES[key]


def stored_known(spark, d) -> DataFrame:
    return store.load(spark, knowledge_base(spark, d), "interactions")


def rule_members(spark, d) -> DataFrame:
    rules = spark.createDataFrame([(n, s, t) for n, *sides in RULES for s, types in zip("AB", sides, strict=True) for t in types], "rule_no int, side string, kind string")
    p = table(spark, d, "part").select("p_type", F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("item"))
    return p.join(F.broadcast(rules), F.contains("p_type", "kind")).select("rule_no", "side", "item").distinct()


def checked(spark, d) -> DataFrame:
    return C.check(entries(spark, d), store.load(spark, knowledge_base(spark, d), "concepts"), stored_known(spark, d), rule_members(spark, d))


_MEMBERS = ", ".join(f"({n}, '{s}', '{t}')" for n, *sides in RULES for s, types in zip("AB", sides, strict=True) for t in types)
SQL_ENTRIES = """con AS MATERIALIZED (SELECT p_partkey AS k, CASE WHEN p_partkey % 10 = 3 THEN 'p' || (p_partkey - 1) || ' (nasal)' ELSE 'p' || p_partkey END AS name, p_type,
  p_partkey % 10 NOT IN (3, 7) AS t, p_partkey % 10 NOT IN (5, 7) AS g, p_partkey % 4 = 0 AS homeless FROM part),
ent AS MATERIALIZED (SELECT DISTINCT l_orderkey AS list_id, CAST(l_linenumber * 10000000 + l_partkey AS BIGINT) AS place, l_partkey % 10 = 3 OR l_linenumber % 5 = 0 AS local,
  CASE WHEN l_partkey % 10 = 3 THEN l_partkey WHEN l_linenumber % 5 = 0 AND l_partkey % 10 = 2 THEN l_partkey + 1 ELSE l_partkey END AS c FROM lineitem WHERE l_linestatus = 'O')"""
SQL_CHECK = f"""WITH {SQL_PAIRS}, {SQL_ENTRIES},
members AS (SELECT DISTINCT rule_no, side, p_partkey AS k FROM part JOIN (VALUES {_MEMBERS}) r(rule_no, side, kind) ON contains(p_type, kind)),
pr AS MATERIALIZED (SELECT list_id, least(x.c, y.c) AS a, greatest(x.c, y.c) AS b, min((x.place, y.place)) AS place, arg_min(x.local OR y.local, (x.place, y.place)) AS local,
  false AS fallback FROM ent x JOIN ent y USING (list_id) WHERE x.place < y.place AND x.c <> y.c GROUP BY ALL),
mech AS MATERIALIZED (SELECT a, b, count(*) AS n, min_by(derived_severity, (CASE derived_severity WHEN 'Major' THEN 0 WHEN 'Moderate' THEN 1 WHEN 'Minor' THEN 2 ELSE 3 END, template)) AS derived,
  array_to_string(list_slice(list(template ORDER BY CASE derived_severity WHEN 'Major' THEN 0 WHEN 'Moderate' THEN 1 WHEN 'Minor' THEN 2 ELSE 3 END, template), 1, 3), '|') AS top FROM templates JOIN severity USING (template) GROUP BY a, b),
kb AS MATERIALIZED (SELECT coalesce(g.a, m.a) AS a, coalesce(g.b, m.b) AS b, g.severity AS level, derived, coalesce(n, 0) AS n, coalesce(top, '') AS top FROM graded g FULL JOIN mech m ON g.a = m.a AND g.b = m.b),
both_rules AS MATERIALIZED (SELECT x.k AS a, y.k AS b, min(x.rule_no) AS rule_no FROM members x JOIN members y ON x.rule_no = y.rule_no AND x.side <> y.side WHERE x.k % 10 <> 3 AND y.k % 10 <> 3 GROUP BY ALL),
one AS MATERIALIZED (SELECT p.*, kb.a IS NOT NULL AS record, (ca.t AND cb.t) OR (ca.g AND cb.g AND NOT (ca.homeless AND cb.homeless)) AS cov FROM pr p LEFT JOIN kb USING (a, b) JOIN con ca ON ca.k = p.a JOIN con cb ON cb.k = p.b),
moved AS (SELECT list_id, least(x, y) AS a, greatest(x, y) AS b, place, local, true AS fallback, a AS wa, b AS wb FROM (SELECT *, CASE WHEN a % 10 = 3 THEN a - 1 ELSE a END AS x, CASE WHEN b % 10 = 3 THEN b - 1 ELSE b END AS y
  FROM one LEFT JOIN both_rules r USING (a, b) WHERE NOT record AND NOT coalesce(cov, false) AND r.rule_no IS NULL AND local) WHERE x <> y AND (x <> a OR y <> b)),
allp AS (SELECT list_id, a, b, place, local, fallback FROM one WHERE NOT EXISTS (SELECT 1 FROM moved WHERE moved.list_id = one.list_id AND wa = one.a AND wb = one.b) UNION ALL SELECT list_id, a, b, place, local, fallback FROM moved),
once AS (SELECT list_id, a, b, arg_min(fallback, (fallback, place)) AS fallback FROM allp GROUP BY ALL),
done AS MATERIALIZED (SELECT o.*, kb.level, kb.derived, kb.a IS NOT NULL AS record, coalesce(n, 0) AS n, coalesce(top, '') AS top, r.rule_no, (ca.t AND cb.t) OR (ca.g AND cb.g AND NOT (ca.homeless AND cb.homeless)) AS cov
  FROM once o LEFT JOIN kb USING (a, b) LEFT JOIN both_rules r USING (a, b) JOIN con ca ON ca.k = o.a JOIN con cb ON cb.k = o.b),
graded_as AS (SELECT *, CASE WHEN level IN ('Major', 'Moderate', 'Minor') THEN level ELSE coalesce(derived, 'Unknown') END AS sev, CASE WHEN level IN ('Major', 'Moderate', 'Minor') OR derived IS NULL THEN 'graded' ELSE 'derived' END AS bas FROM done),
result AS MATERIALIZED (SELECT list_id, a, b, fallback, n, top, rule_no, CASE WHEN record OR rule_no IS NOT NULL THEN 'INTERACTION' WHEN cov THEN 'NO_KNOWN_INTERACTION' ELSE 'NOT_COVERED' END AS status,
  CASE WHEN rule_no IS NOT NULL THEN 'Major' WHEN record THEN sev END AS severity, CASE WHEN rule_no IS NOT NULL AND NOT (record AND sev = 'Major') THEN 'rule' WHEN record THEN bas END AS basis FROM graded_as)"""


@query(SQL_CHECK + " SELECT list_id, a, b, fallback, status, coalesce(severity, '') AS severity, coalesce(basis, '') AS basis, CAST(coalesce(rule_no, 0) AS INTEGER) AS rule_no, CAST(n AS INTEGER) AS n_mechanisms FROM result")
def q_check(spark, d):
    r = checked(spark, d)
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return r.select(
        "list_id", F.col("a_concept").alias("a"), F.col("b_concept").alias("b"), "fallback", "status", empty("severity"), empty("basis"),
        F.coalesce("rule_no", F.lit(0)).alias("rule_no"), F.coalesce(F.size("mechanisms"), F.lit(0)).alias("n_mechanisms"),
    )


@query(SQL_CHECK + " SELECT a, b, n AS n_mechanisms, derived, top FROM mech")
def q_mechanisms(spark, d):
    m = stored_known(spark, d).filter("mechanisms is not null")
    top = F.array_join(F.transform(F.slice("mechanisms", 1, 3), lambda x: x["template"]), "|")
    return m.select("a", "b", F.size("mechanisms").cast("long").alias("n_mechanisms"), F.col("mechanisms")[0]["severity"].alias("derived"), top.alias("top"))


@query(f"WITH {SQL_ENTRIES} SELECT list_id, place, c AS concept FROM ent")
def q_route_variant(spark, d):
    return C.concepts_of(entries(spark, d), concepts(spark, d)).select("list_id", "place", "concept")


@query(SQL_CHECK + " SELECT list_id, wa AS was_a, wb AS was_b, a, b FROM moved")
def q_route_fallback(spark, d):
    """Pairs that no source covers, with the concepts that are checked instead."""
    pairs = C.list_pairs(C.concepts_of(entries(spark, d), concepts(spark, d)))
    first = C.with_rules(C.looked_up(pairs, stored_known(spark, d)), rule_members(spark, d))
    open_ = first.filter((F.col("status") == "NOT_COVERED") & (F.col("a_route").isNotNull() | F.col("b_route").isNotNull()))
    moved = C._systemic(open_.select(*pairs.columns, F.col("a_concept").alias("was_a"), F.col("b_concept").alias("was_b")), concepts(spark, d))
    return moved.select("list_id", "was_a", "was_b", F.col("a_concept").alias("a"), F.col("b_concept").alias("b"))


@query(SQL_CHECK + " SELECT a, b, level, n AS n_mechanisms FROM kb JOIN (SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem) USING (a, b)")
def q_pair_lookup(spark, d):
    """Records of asked pairs: part and supplier numbers of line items, taken as concepts."""
    asked = P.canonical_pairs(table(spark, d, "lineitem"), "l_partkey", "l_suppkey")
    k = stored_known(spark, d)
    return k.join(asked, ["a", "b"], "left_semi").select("a", "b", "level", F.coalesce(F.size("mechanisms"), F.lit(0)).cast("long").alias("n_mechanisms"))


@query(SQL_CHECK + " SELECT status, coalesce(severity, '-') AS severity, coalesce(basis, '-') AS basis, count(*) AS n FROM result GROUP BY ALL")
def q_check_counts(spark, d):
    none = lambda c: F.coalesce(c, F.lit("-")).alias(c)
    return checked(spark, d).groupBy("status", none("severity"), none("basis")).agg(F.count("*").alias("n"))


@query(f"""WITH {SQL_ENTRIES} SELECT list_id, c AS concept, count(DISTINCT place) AS n_meds FROM ent GROUP BY ALL HAVING count(DISTINCT place) > 1""")
def q_duplicate_concepts(spark, d):
    return C.concepts_of(entries(spark, d), concepts(spark, d)).groupBy("list_id", "concept").agg(F.count_distinct("med").alias("n_meds")).filter("n_meds > 1")


def findings(spark, d) -> DataFrame:
    """Interactions with risk, tier, verify flag and explanation; confidence comes from the lines' quantities."""
    r = checked(spark, d).filter("status = 'INTERACTION'")
    conf = sized(table(spark, d, "part").select(F.col("p_partkey").alias("k"), (0.5 + F.col("p_size") / 101.3).alias("confidence")))
    for s in "ab":
        r = r.join(conf.select(F.col("k").alias(f"{s}_concept"), F.col("confidence").alias(f"{s}_confidence")), f"{s}_concept")
    risk = P.risk(F.col("severity"), F.col("basis") == "derived", F.size("record_sources"), F.least("a_confidence", "b_confidence"))
    r = r.withColumn("risk", risk).withColumn("by_risk", P.tier(F.col("risk"), F.lit("")))
    major = F.col("severity") == "Major"
    return r.withColumns({"tier": F.when(major & (F.col("by_risk") != "critical"), "review").otherwise(F.col("by_risk")), "verify": major & (F.col("by_risk") != "critical")})


SQL_FINDINGS = SQL_CHECK + """, f AS MATERIALIZED (SELECT r.*, k.level, least(0.5::DOUBLE + pa.p_size / 101.3::DOUBLE, 0.5::DOUBLE + pb.p_size / 101.3::DOUBLE) AS conf, (k.level IS NOT NULL)::INT + (k.n > 0)::INT AS n_sources
  FROM result r LEFT JOIN kb k USING (a, b) JOIN part pa ON pa.p_partkey = r.a JOIN part pb ON pb.p_partkey = r.b WHERE status = 'INTERACTION'),
g AS MATERIALIZED (SELECT *, round(CASE severity WHEN 'Major' THEN 1.0 WHEN 'Moderate' THEN 0.6 WHEN 'Minor' THEN 0.3 ELSE 0.25 END::DOUBLE * CASE WHEN basis = 'derived' THEN 0.8 ELSE 1.0 END::DOUBLE
  * CASE WHEN n_sources >= 2 THEN 1.0 ELSE 0.85 END::DOUBLE * conf, 3) AS risk FROM f),
t AS MATERIALIZED (SELECT *, CASE WHEN risk >= 0.7 THEN 'critical' WHEN severity = 'Major' OR risk >= 0.5 THEN 'review' ELSE 'info' END AS tier, severity = 'Major' AND risk < 0.7 AS verify FROM g)"""


@query(SQL_FINDINGS + " SELECT list_id, a, b, risk, tier, verify FROM t")
def q_tier(spark, d):
    return findings(spark, d).select("list_id", F.col("a_concept").alias("a"), F.col("b_concept").alias("b"), "risk", "tier", "verify")


@query(SQL_FINDINGS + " SELECT tier, count(*) FILTER (tier IN ('critical', 'review')) AS actionable, count(*) AS n, count(*) FILTER (verify) AS to_verify FROM t GROUP BY tier")
def q_actionable(spark, d):
    act = F.col("tier").isin("critical", "review")
    return findings(spark, d).groupBy("tier").agg(F.count_if(act).alias("actionable"), F.count("*").alias("n"), F.count_if("verify").alias("to_verify"))


@query(SQL_FINDINGS + """ SELECT list_id, a, b, CAST(2 + (rule_no IS NOT NULL)::INT + (level IS NOT NULL)::INT + least(n, 3) + (basis = 'derived')::INT AS INTEGER) AS n_lines,
  CASE WHEN rule_no IS NOT NULL THEN 'Rule ' || rule_no WHEN level IS NOT NULL THEN 'Graded ' || level WHEN n > 0 THEN 'Template text of ' || split_part(top, '|', 1) ELSE '' END AS why FROM t""")
def q_explain(spark, d):
    c = F.col
    lines = C.explanation(c("a_concept_name"), c("b_concept_name"), c("rule_no"), c("level"), c("mechanisms"), c("basis"), c("severity"), c("risk"))
    rows = findings(spark, d).withColumn("lines", lines)
    return rows.select("list_id", c("a_concept").alias("a"), c("b_concept").alias("b"), F.size("lines").alias("n_lines"), F.get("lines", F.lit(1)).alias("why"))


@query(SQL_CHECK + """, u AS (SELECT list_id, a, b, row_number() OVER (PARTITION BY list_id ORDER BY a, b) AS r FROM result WHERE status = 'NOT_COVERED')
SELECT list_id, count(*) AS n, string_agg('p' || (CASE WHEN a % 10 = 3 THEN (a - 1) || ' (nasal)' ELSE a::VARCHAR END) || ' + p' || (CASE WHEN b % 10 = 3 THEN (b - 1) || ' (nasal)' ELSE b::VARCHAR END), '; ' ORDER BY r) FILTER (r <= 20) AS first FROM u GROUP BY list_id""")
def q_slice(spark, d):
    """Pairs that no source covers, by list: how many, and the first twenty."""
    rows = checked(spark, d).filter("status = 'NOT_COVERED'")
    pair = F.struct("a_concept", "b_concept", F.concat("a_concept_name", F.lit(" + "), "b_concept_name").alias("text"))
    sorted_ = rows.groupBy("list_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(pair)).alias("x"))
    return sorted_.select("list_id", "n", F.array_join(F.transform(F.slice("x", 1, 20), lambda p: p["text"]), "; ").alias("first"))


@query(f"WITH {SQL_KNOWN} SELECT a, b, severity, derived, sources FROM known")
def q_kb_reload(spark, d):
    """The base as it is read back from its stored version."""
    return store.load(spark, knowledge_base(spark, d), "pairs")


@query(SQL_CHECK + " SELECT 'concepts' AS name, count(*) AS n FROM part UNION ALL SELECT 'interactions', count(*) FROM kb UNION ALL SELECT 'pairs', count(*) FROM kb UNION ALL SELECT 'template_severity', count(*) FROM severity")
def q_kb_meta(spark, d):
    """What the stored version says of its tables."""
    return store.counts(spark, knowledge_base(spark, d))
