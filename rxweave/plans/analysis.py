"""Queries: notes to reports, and again after corrections.

Notes are those of notes.py.  A name is a product: parts whose number ends in 9 hold two concepts, their own and that of the number before, those that end in 6 are
not in the knowledge base; all others are their own concept.  Notes of urgent orders are corrected: a fifth of their medications are deleted, held ones are
resumed, and one is added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import analysis as A
from ..operators import checker as C
from ..operators import fusion as U
from ..operators.shared import written
from ..sources.tables import table
from . import checker as K
from .knowledge import RULES, SQL_PAIRS
from .notes import LETTERS, SOURCES, SQL_NOTES, claimed_mentions, seen
from .registry import query, stored


def _name(k: Column) -> Column:
    return F.concat(F.lit("drug"), F.translate(k.cast("string"), "0123456789", LETTERS))


def products(spark, d) -> DataFrame:
    """(spelling, names, norm_status)"""
    k = F.col("p_partkey")
    names = F.when(k % 10 == 6, F.array().cast("array<string>")).when(k % 10 == 9, F.array(_name(k - 1), _name(k))).otherwise(F.array(_name(k)))
    return table(spark, d, "part").select(_name(k).alias("spelling"), names.alias("names"), F.when(k % 10 == 6, "unmapped").otherwise("mapped").alias("norm_status"))


def concepts(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    sources = F.array_compact(F.array(F.when(~(k % 10).isin(3, 7), "template"), F.when(~(k % 10).isin(5, 7), C.GRADED_SOURCE)))
    return table(spark, d, "part").filter(k % 10 != 6).select(k.alias("concept"), _name(k).alias("concept_name"), sources.alias("sources"), F.when(k % 4 == 0, "").otherwise(F.col("p_brand")).alias("home"))


def rule_members(spark, d) -> DataFrame:
    rules = spark.createDataFrame([(n, s, t) for n, *sides in RULES for s, types in zip("AB", sides, strict=True) for t in types], "rule_no int, side string, kind string")
    p = table(spark, d, "part").select("p_type", _name(F.col("p_partkey")).alias("item"))
    return p.join(F.broadcast(rules), F.contains("p_type", "kind")).select("rule_no", "side", "item").distinct()


def note_medications(spark, d) -> DataFrame:
    """Medications of all notes with note_id and the columns of analysis.MEDICATION."""
    first = F.transform("claims.all", lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["value"].alias("value")))
    firsts = F.aggregate(F.sort_array(first), F.create_map().cast("map<string,string>"), lambda acc, x: F.when(F.map_contains_key(acc, x["kind"]), acc).otherwise(F.map_concat(acc, F.create_map(x["kind"], x["value"]))))
    k = F.translate(F.regexp_replace("name", "drug", ""), LETTERS, "0123456789").cast("long")
    full = claimed_mentions(spark, d).join(products(spark, d), F.col("name") == F.col("spelling")).withColumns({
        "raw": F.substring("text", F.col("s") + 1, F.col("e") - F.col("s")), "attributes": firsts,
        "sources": F.get(F.array(*(F.array(*map(F.lit, x)) for x in SOURCES)), (k % 4).cast("int")), "score": F.lit(1.0),
    })
    full = full.withColumn("n_attributes", F.size("attributes")).withColumn("key", U.group_key(F.col("names"), F.col("norm_status"), F.col("raw"))).drop("text", "claims", "name", "spelling")
    early = F.min_by("attributes", F.when(F.col("section") == "admission", F.struct(-F.col("n_attributes"), F.col("s"))))
    meds = U.medications(full, of_first=("raw", "names", "attributes"), early=early)
    route = U.local_route(F.concat_ws(" ", "raw", F.coalesce(F.col("attributes")["Route"], F.lit("")), F.coalesce(F.col("attributes")["Form"], F.lit(""))), F.col("names"))
    return meds.withColumns({
        "id": F.col("key"), "name": F.when(F.size("names") > 0, F.array_join("names", " + ")).otherwise(F.col("raw")), "before": F.col("early")["Strength"], "after": F.col("attributes")["Strength"], "route": route,
    }).select("note_id", *A.MEDICATION)


def note_lists(spark, d) -> DataFrame:
    kind = lambda k: F.exists("sections", lambda x: x["kind"] == k)
    return seen(spark, d).select("note_id", kind("discharge").alias("has_discharge"), (kind("admission") & kind("discharge")).alias("both_lists"))


def base(spark, d):
    """The tables that a check starts from: concepts, known pairs, members of rules."""
    return concepts(spark, d), K.stored_known(spark, d), rule_members(spark, d)


def analyzed(spark, d) -> DataFrame:
    return stored(spark, d, "reports", lambda s, f: A.reports(note_medications(s, f), note_lists(s, f), *base(s, f)))


def edits(spark, d) -> DataFrame:
    """What reviewers changed in the reports of notes of urgent orders."""
    urgent = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("note_id"))
    own = analyzed(spark, d).join(urgent, "note_id", "left_semi").select("note_id", F.explode("medications").alias("m"))
    none = lambda *names: [F.lit(None).cast("string").alias(c) for c in names]
    k = F.translate(F.regexp_replace(F.lower("m.raw"), "drug", ""), LETTERS, "0123456789").cast("long")
    gone = own.filter(k % 5 == 0).select("note_id", F.lit("delete").alias("op"), F.col("m.id").alias("id"), *none("raw", "status", "before", "after"))
    resumed = own.filter((k % 5 != 0) & (F.col("m.status") == "held")).select("note_id", F.lit("update").alias("op"), F.col("m.id").alias("id"), *none("raw"), F.lit("active").alias("status"), *none("before", "after"))
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("note_id")).agg(F.min("l_suppkey").alias("k")).join(urgent, "note_id")
    added = lines.select("note_id", F.lit("add").alias("op"), *none("id"), F.concat(F.lit(" "), F.initcap(_name(F.col("k")))).alias("raw"), *none("status", "before", "after"))
    return gone.union(resumed).union(added)


def reanalyzed(spark, d) -> DataFrame:
    changed = stored(spark, d, "edits", edits)
    return stored(spark, d, "reports-again", lambda s, f: A.again(analyzed(s, f), changed, products(s, f), note_lists(s, f), *base(s, f)))


_MEMBERS = ", ".join(f"({n}, '{s}', '{t}')" for n, *sides in RULES for s, types in zip("AB", sides, strict=True) for t in types)
_RANK = "CASE {} WHEN 'Major' THEN 0 WHEN 'Moderate' THEN 1 WHEN 'Minor' THEN 2 ELSE 3 END"
_DRUG = f"'drug' || translate(({{}})::VARCHAR, '0123456789', '{LETTERS}')"
SQL_BASE = f"""WITH RECURSIVE {SQL_PAIRS}, {SQL_NOTES},
con AS MATERIALIZED (SELECT p_partkey AS k, {_DRUG.format('p_partkey')} AS name, p_partkey % 10 NOT IN (3, 7) AS t, p_partkey % 10 NOT IN (5, 7) AS g, p_partkey % 4 = 0 AS homeless FROM part),
members AS (SELECT DISTINCT rule_no, side, p_partkey AS k FROM part JOIN (VALUES {_MEMBERS}) r(rule_no, side, kind) ON contains(p_type, kind)),
both_rules AS MATERIALIZED (SELECT x.k AS a, y.k AS b, min(x.rule_no) AS rule_no FROM members x JOIN members y ON x.rule_no = y.rule_no AND x.side <> y.side GROUP BY ALL),
mech AS MATERIALIZED (SELECT a, b, count(*) AS n, min_by(derived_severity, {_RANK.format('derived_severity')}) AS derived FROM templates JOIN severity USING (template) GROUP BY a, b),
kb AS MATERIALIZED (SELECT coalesce(g.a, m.a) AS a, coalesce(g.b, m.b) AS b, g.severity AS level, derived, coalesce(n, 0) AS n FROM graded g FULL JOIN mech m ON g.a = m.a AND g.b = m.b),
prod AS MATERIALIZED (SELECT p_partkey AS k, CASE p_partkey % 10 WHEN 6 THEN []::BIGINT[] WHEN 9 THEN [p_partkey - 1, p_partkey] ELSE [p_partkey] END AS cs FROM part),
named AS MATERIALIZED (SELECT k, cs, CASE WHEN len(cs) > 0 THEN array_to_string(list_transform(cs, lambda c: {_DRUG.format('c')}), ' + ') ELSE 'D' || substr({_DRUG.format('k')}, 2) END AS name,
  CASE WHEN len(cs) > 0 THEN 'D:' || array_to_string(list_sort(list_transform(cs, lambda c: {_DRUG.format('c')})), '+') ELSE 'T:' || {_DRUG.format('k')} END AS id FROM prod),
meds AS MATERIALIZED (SELECT s.note_id, s.k, p.id, p.name, p.cs, s.dis AS both_lists, rf <> 'R' AS adm, st = 'O' AND s.dis AS dis, CASE WHEN rf = 'R' THEN 'held' ELSE '' END AS text_status,
  CASE WHEN s.dis AND st = 'O' THEN 'active' WHEN rf = 'R' THEN 'held' WHEN s.dis THEN 'mentioned' ELSE 'active' END AS status, CASE WHEN rf <> 'R' THEN q || ' mg' END AS before,
  CASE WHEN st = 'O' AND s.dis THEN (q + CASE WHEN s.k % 2 = 0 THEN 5 ELSE 0 END) || ' mg' WHEN rf <> 'R' THEN q || ' mg' END AS after,
  round(0.4::DOUBLE * CASE s.k % 4 WHEN 0 THEN 0.75 WHEN 1 THEN 0.85 WHEN 2 THEN 1.0 ELSE 0.85 END::DOUBLE + 0.4::DOUBLE * CASE WHEN len(p.cs) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE + 0.2::DOUBLE * CASE WHEN st = 'O' AND s.dis THEN 1.0 ELSE 0.6 END::DOUBLE, 3) AS conf
  FROM said s JOIN named p USING (k))"""


def report_sql(meds: str) -> str:
    """CTEs that end in {meds}_findings and {meds}_reports, from a CTE of medications."""
    t = meds
    return f"""
{t}_placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY CASE status WHEN 'active' THEN 0 WHEN 'held' THEN 1 WHEN 'stopped' THEN 2 ELSE 3 END, lower(name), id) AS place FROM {t}),
{t}_ent AS MATERIALIZED (SELECT note_id, id, conf, (place, i) AS place, cs[i] AS c FROM (SELECT *, unnest(range(1, len(cs) + 1)) AS i FROM {t}_placed WHERE status = 'active')),
{t}_pr AS MATERIALIZED (SELECT x.note_id, least(x.c, y.c) AS a, greatest(x.c, y.c) AS b, arg_min(least(x.conf, y.conf), (x.place, y.place)) AS conf FROM {t}_ent x JOIN {t}_ent y ON x.note_id = y.note_id WHERE x.place < y.place AND x.id <> y.id AND x.c <> y.c GROUP BY ALL),
{t}_chk AS MATERIALIZED (SELECT p.*, kb.level, kb.a IS NOT NULL AS record, coalesce(n, 0) AS n, r.rule_no, (ca.t AND cb.t) OR (ca.g AND cb.g AND NOT (ca.homeless AND cb.homeless)) AS cov, ca.name AS an, cb.name AS bn,
  CASE WHEN level IN ('Major', 'Moderate', 'Minor') THEN level ELSE coalesce(derived, 'Unknown') END AS sev, NOT coalesce(level IN ('Major', 'Moderate', 'Minor'), false) AND derived IS NOT NULL AS der
  FROM {t}_pr p LEFT JOIN kb USING (a, b) LEFT JOIN both_rules r USING (a, b) JOIN con ca ON ca.k = p.a JOIN con cb ON cb.k = p.b),
{t}_sev AS MATERIALIZED (SELECT *, CASE WHEN rule_no IS NOT NULL THEN 'Major' ELSE sev END AS severity, CASE WHEN rule_no IS NOT NULL AND NOT (record AND sev = 'Major') THEN false ELSE der END AS derived,
  CASE WHEN record OR rule_no IS NOT NULL THEN 'INTERACTION' WHEN cov THEN 'NO_KNOWN_INTERACTION' ELSE 'NOT_COVERED' END AS status FROM {t}_chk),
{t}_int AS (SELECT *, round(CASE severity WHEN 'Major' THEN 1.0 WHEN 'Moderate' THEN 0.6 WHEN 'Minor' THEN 0.3 ELSE 0.25 END::DOUBLE * CASE WHEN derived THEN 0.8 ELSE 1.0 END::DOUBLE * CASE WHEN level IS NOT NULL AND n > 0 THEN 1.0 ELSE 0.85 END::DOUBLE * conf, 3) AS risk
  FROM {t}_sev WHERE status = 'INTERACTION'),
{t}_all AS (
  SELECT note_id, 'INT:' || a || '|' || b AS id, 'INTERACTION' AS type, CASE WHEN risk >= 0.7 THEN 'critical' WHEN severity = 'Major' OR risk >= 0.5 THEN 'review' ELSE 'info' END AS tier, risk, severity || ' interaction: ' || an || ' + ' || bn AS title, severity = 'Major' AND risk < 0.7 AS verify FROM {t}_int
  UNION ALL SELECT note_id, 'DUP:' || c, 'DUPLICATE_THERAPY', 'review', round(0.6::DOUBLE * min(conf), 3), 'Duplicate therapy: ' || {_DRUG.format('c')}, false FROM {t}_ent GROUP BY note_id, c HAVING count(DISTINCT id) > 1
  UNION ALL SELECT note_id, 'OMIT:' || id, 'OMISSION', CASE WHEN e THEN 'info' ELSE 'review' END, CASE WHEN e THEN 0.2 ELSE 0.5 END::DOUBLE, CASE WHEN e THEN 'Stopped/held: ' ELSE 'Not on discharge list: ' END || name, false
    FROM (SELECT *, status IN ('held', 'stopped') OR text_status = 'held' AS e FROM {t}_placed) WHERE both_lists AND adm AND NOT dis
  UNION ALL SELECT note_id, 'NEW:' || id, 'NEW_MEDICATION', 'info', 0.1::DOUBLE, 'New at discharge: ' || name, false FROM {t}_placed WHERE both_lists AND dis AND NOT adm
  UNION ALL SELECT note_id, 'DOSE:' || id, 'DOSE_CHANGE', 'review', 0.4::DOUBLE, 'Strength changed: ' || name || ' ' || before || ' → ' || after, false FROM {t}_placed WHERE both_lists AND dis AND adm AND before <> after
  UNION ALL SELECT note_id, 'NOT_CHECKED', 'NOT_CHECKED', 'info', 0::DOUBLE, count(*) || ' active medication(s) could not be checked', false FROM {t}_placed WHERE status = 'active' AND len(cs) = 0 GROUP BY note_id
  UNION ALL SELECT note_id, 'NOT_COVERED', 'NOT_COVERED', 'info', 0::DOUBLE, count(*) || ' drug pair(s) not covered by any interaction source', false FROM {t}_sev WHERE status = 'NOT_COVERED' GROUP BY note_id),
{t}_findings AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY CASE tier WHEN 'critical' THEN 0 WHEN 'review' THEN 1 ELSE 2 END, risk DESC, title, id) AS place FROM {t}_all),
{t}_reports AS (
  SELECT note_id, n AS medications, active, coalesce(pairs, 0) AS pairs_checked, coalesce(ints, 0) AS interactions, coalesce(nki, 0) AS no_known_interaction, coalesce(ncv, 0) AS not_covered, coalesce(critical, 0) AS critical, coalesce(review, 0) AS review, coalesce(info, 0) AS info,
    sha256(concat_ws(chr(10), said_meds, said_findings)) AS report_hash
  FROM (SELECT note_id, count(*) AS n, count(*) FILTER (status = 'active') AS active, string_agg(concat_ws('|', id, name, status, CAST(round(conf * 1000) AS INTEGER)), chr(10) ORDER BY place) AS said_meds FROM {t}_placed GROUP BY note_id)
  LEFT JOIN (SELECT note_id, count(*) AS pairs, count(*) FILTER (status = 'INTERACTION') AS ints, count(*) FILTER (status = 'NO_KNOWN_INTERACTION') AS nki, count(*) FILTER (status = 'NOT_COVERED') AS ncv FROM {t}_sev GROUP BY note_id) USING (note_id)
  LEFT JOIN (SELECT note_id, count(*) FILTER (tier = 'critical') AS critical, count(*) FILTER (tier = 'review') AS review, count(*) FILTER (tier = 'info') AS info,
    string_agg(concat_ws('|', id, tier, CAST(round(risk * 1000) AS INTEGER), title, verify::VARCHAR), chr(10) ORDER BY place) AS said_findings FROM {t}_findings GROUP BY note_id) USING (note_id))"""


#: Corrected lists: what was deleted is gone, what was held is resumed, and one medication is added with a number after its id if the list has it.
SQL_CORRECTED = f"""
urgent AS MATERIALIZED (SELECT o_orderkey AS note_id FROM orders WHERE o_orderpriority = '1-URGENT'),
kept AS (SELECT note_id, id, name, cs, both_lists, adm, dis, text_status, CASE WHEN status = 'held' AND note_id IN (FROM urgent) THEN 'active' ELSE status END AS status, before, after, conf
  FROM meds WHERE NOT (note_id IN (FROM urgent) AND k % 5 = 0)),
added AS (SELECT l_orderkey AS note_id, min(l_suppkey) AS k FROM lineitem WHERE l_orderkey IN (FROM urgent) GROUP BY l_orderkey),
fixed AS MATERIALIZED (SELECT * FROM kept UNION ALL
  SELECT a.note_id, CASE WHEN EXISTS (SELECT 1 FROM kept k WHERE k.note_id = a.note_id AND k.id = p.id) THEN p.id || '_1' ELSE p.id END, p.name, p.cs, n.dis, false, true, '', 'active', NULL, NULL, 1.0
  FROM added a JOIN named p USING (k) JOIN notes n USING (note_id))"""

COUNTS = ("medications", "active", "pairs_checked", "interactions", "no_known_interaction", "not_covered", *A.TIERS)


def _summary(reports: DataFrame) -> DataFrame:
    return reports.select("note_id", *(F.col(f"counts.{c}").alias(c) for c in COUNTS), "report_hash")


def _findings(reports: DataFrame) -> DataFrame:
    rows = reports.select("note_id", F.posexplode("findings").alias("place", "f"))
    return rows.select("note_id", (F.col("place") + 1).alias("place"), "f.id", "f.type", "f.tier", "f.risk", "f.title", "f.verify")


@query(SQL_BASE + "," + report_sql("meds") + " SELECT * FROM meds_reports")
def q_analyze(spark, d):
    """Every note's report: counts, and the hash of its medications and findings."""
    return _summary(analyzed(spark, d))


@query(SQL_BASE + "," + report_sql("meds") + " SELECT note_id, CAST(place AS INTEGER) AS place, id, type, tier, risk, title, verify FROM meds_findings")
def q_analyze_findings(spark, d):
    return _findings(analyzed(spark, d))


@query(SQL_BASE + "," + SQL_CORRECTED + "," + report_sql("fixed") + " SELECT * FROM fixed_reports")
def q_reanalyze(spark, d):
    """Reports after corrections; those of notes without any are handed on, not computed again."""
    return _summary(reanalyzed(spark, d))


@query(SQL_BASE + "," + SQL_CORRECTED + "," + report_sql("fixed") + " SELECT note_id, CAST(place AS INTEGER) AS place, id, type, tier, risk, title, verify FROM fixed_findings WHERE note_id IN (FROM urgent)")
def q_reanalyze_findings(spark, d):
    """Findings of the notes that were corrected."""
    changed = stored(spark, d, "edits", edits).select("note_id").distinct()
    return _findings(reanalyzed(spark, d).join(changed, "note_id", "left_semi"))
