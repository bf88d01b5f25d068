"""Queries: fields of rows, differences between lists, and what is shown of names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import slots as L
from ..functions import strings as S
from ..operators import fusion as U
from ..sources.tables import table
from .registry import query

_QTY = "CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)"
#: By line status: values in their own fields; strength and dosage one field on; a route in the place of a form and a frequency in that of a route.
SQL_ROWS = f"""r AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS p, l_returnflag AS f, {_QTY} || ' mg' AS st FROM lineitem)"""


def _rows(spark, d):
    f, st = F.col("l_returnflag"), F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" mg"))
    pick = lambda a, n, r: F.when(f == "A", a).when(f == "N", n).otherwise(r)
    e = F.lit("")
    values = {"strength": pick(st, F.lit("One (1)"), st), "dosage": pick(F.lit("One (1)"), st, F.lit("two")), "form": pick(F.lit("Tablet"), F.lit("Tablet"), F.lit("PO")), "route": pick(F.lit("PO"), e, F.lit("daily")), "frequency": pick(F.lit("BID"), F.lit("for 7 days"), e), "duration": pick(e, e, F.lit("unclear"))}
    pairs = F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v)))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), st.alias("st"), f.alias("f"), pairs.alias("v"))


@query(f"WITH {SQL_ROWS} SELECT o, n, p, CASE f WHEN 'A' THEN st || '|One (1)|Tablet|PO|BID|' WHEN 'N' THEN st || '|One (1)|Tablet|||for 7 days' ELSE st || '|two||PO|daily|unclear' END AS fields, CAST(CASE f WHEN 'A' THEN 0 WHEN 'N' THEN 3 ELSE 2 END AS INTEGER) AS moved FROM r")
def q_slot_repair(spark, d):
    rows = _rows(spark, d).withColumn("x", L.repaired(F.col("v")))
    fields = F.array_join(F.array(*(F.coalesce(F.try_element_at("x.values", F.lit(k)), F.lit("")) for k in L.FIELDS)), "|")
    return rows.select("o", "n", "p", fields.alias("fields"), "x.moved")


@query(f"WITH {SQL_ROWS} SELECT o, n, p, 'strength' AS kind FROM r")
def q_slot_detect(spark, d):
    return _rows(spark, d).select("o", "n", "p", L.detected(F.col("st")).alias("kind"))


@query(f"WITH {SQL_ROWS} SELECT o, n, p, CAST(CASE f WHEN 'A' THEN 2 ELSE 1 END AS INTEGER) AS n_rows, 'x' || p AS first_drug FROM r")
def q_salvage(spark, d):
    row = F.concat(F.lit('["x'), F.col("l_partkey").cast("string"), F.lit('", "a", "b", "", "", "", "", ""]'))
    other = F.when(F.col("l_returnflag") == "A", F.lit('["y \\"q\\"", "", "", "", "", "", "", "on"]')).otherwise(F.lit('["short", "row"]'))
    content = F.concat(F.lit('{"meds": ['), row, F.lit(", "), row, F.lit(", "), other, F.lit(', ["cut", "off'))
    rows = table(spark, d, "lineitem").withColumn("x", L.salvaged(content))
    return rows.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.size("x").alias("n_rows"), F.col("x")[0][0].alias("first_drug"))


@query("SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS p, CASE WHEN l_returnflag = 'A' THEN 'p' || l_partkey ELSE 'raw' END || '|' || CAST(l_quantity AS INTEGER) || '||||BID||' || CASE l_linestatus WHEN 'O' THEN 'active' ELSE '' END AS row FROM lineitem")
def q_med_row(spark, d):
    name = F.when(F.col("l_returnflag") == "A", F.concat(F.lit("p"), F.col("l_partkey").cast("string")))
    attributes = F.create_map(F.lit("Strength"), F.col("l_quantity").cast("int").cast("string"), F.lit("Route"), F.lit(""))
    row = L.as_row(name, F.lit(" raw "), attributes, F.create_map(F.lit("frequency"), F.lit("BID")), F.when(F.col("l_linestatus") == "O", "active"))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.array_join(row, "|").alias("row"))


LETTERS = {"widget": "widGET", "anvil": "anVIL"}


@query("""WITH p AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part)
SELECT p_partkey, CASE WHEN b = 'ring' THEN 'Band (ring)' WHEN b = 'widget' THEN 'widGET' WHEN b = 'anvil' THEN 'anVIL' ELSE upper(b[1]) || b[2:] END || ' + ' || upper(a[1]) || a[2:] AS shown FROM p""")
def q_display(spark, d):
    name = F.concat(F.substring_index("p_name", " ", -1), F.lit(" + "), F.substring_index("p_name", " ", 1))
    return table(spark, d, "part").select("p_partkey", L.display(name, F.create_map(F.lit("ring"), F.lit("band")), LETTERS).alias("shown"))


@query("""SELECT p_partkey, CASE WHEN length(split_part(p_name, ' ', 1)) <= 3 THEN upper(split_part(p_name, ' ', 1)) ELSE upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] END || ' ' ||
  CASE WHEN length(split_part(p_name, ' ', 2)) <= 3 THEN upper(split_part(p_name, ' ', 2)) ELSE upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] END AS title,
  upper(p_name[1]) || upper(split_part(p_name, ' ', 2)[1]) AS letters, upper(p_name[1]) || p_name[2:] AS capital FROM part""")
def q_pretty(spark, d):
    return table(spark, d, "part").select("p_partkey", S.pretty(F.translate("p_name", " ", "_")).alias("title"), S.initials(F.concat(F.lit("Dr. "), "p_name")).alias("letters"), S.first_caps(F.col("p_name")).alias("capital"))


@query("SELECT item_id, md5(trim(regexp_replace(replace(text, chr(10), chr(10) || chr(10)), '[ \\t]+\\n', chr(10), 'g'), chr(10) || chr(9) || ' ') || chr(10)) AS digest FROM benchmark")
def q_tidy(spark, d):
    messy = F.concat(F.lit(" \r\n"), F.regexp_replace("text", "\n", " \t\r\n\r\n\r\n"), F.lit("\r\n\r\n"))
    return table(spark, d, "benchmark").select("item_id", F.md5(S.tidy(messy).cast("binary")).alias("digest"))


@query("SELECT conv_id, turn, md5(CASE WHEN role = 'user' THEN 'Medications on Admission:' || chr(10) || trim(text) || chr(10) || chr(10) ELSE '' END || text) AS digest FROM conversations")
def q_prior_list(spark, d):
    """A list known before goes ahead of a note under a header of its own; a blank one adds nothing."""
    prior = F.when(F.col("role") == "user", F.col("text")).otherwise(" ")
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(S.with_prior(F.col("text"), prior).cast("binary")).alias("digest"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'ophthalmic' WHEN 1 THEN 'otic' WHEN 2 THEN 'topical' WHEN 3 THEN CASE WHEN p_type = 'PROMO' THEN 'topical' ELSE 'none' END ELSE 'none' END AS route FROM part")
def q_local_route(spark, d):
    n = F.col("p_partkey") % 5
    text = F.concat(F.col("p_name"), F.when(n == 0, " Drops both eyes").when(n == 1, " left EAR").when(n == 2, " Cream to Skin").when(n == 3, " Patch 24 hr").otherwise(" tablet"))
    names = F.array(F.when(F.col("p_type") == "PROMO", "lidocaine").otherwise("fentanyl"))
    return table(spark, d, "part").select("p_partkey", F.coalesce(U.local_route(text, names), F.lit("none")).alias("route"))


@query("SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS p, 'D:' || l_returnflag || CASE WHEN i > 1 THEN '_' || (i - 1) ELSE '' END AS id FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey) AS i FROM lineitem)")
def q_unique_suffix(spark, d):
    rows = table(spark, d, "lineitem").withColumns({"base": F.concat(F.lit("D:"), "l_returnflag"), "no": F.struct("l_linenumber", "l_partkey", "l_suppkey")})
    return U.unique_ids(rows, "l_orderkey", "base", "no").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), "id")


_SIDES = "x AS (SELECT l_orderkey AS o, l_partkey AS p, max(l_quantity) AS q, max(l_discount) AS disc FROM lineitem GROUP BY ALL), s AS (SELECT o, p, CASE WHEN q >= 35 THEN 'critical' WHEN q >= 20 THEN 'review' ELSE 'info' END AS off_, CASE WHEN disc >= 0.09 THEN NULL WHEN q * (1 - disc) >= 35 THEN 'critical' WHEN q * (1 - disc) >= 20 THEN 'review' ELSE 'info' END AS on_ FROM x)"


def _settings(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p")).agg(F.max("l_quantity").alias("q"), F.max("l_discount").alias("disc"))
    tier = lambda v: F.when(v >= 35, "critical").when(v >= 20, "review").otherwise("info")
    return rows.select("o", "p", tier(F.col("q")).alias("tier")), rows.filter("disc < 0.09").select("o", "p", tier(F.col("q") * (1 - F.col("disc"))).alias("tier"))


@query(f"WITH {_SIDES} SELECT o, p, off_ AS before, on_ AS after FROM s WHERE off_ IS DISTINCT FROM on_")
def q_diff(spark, d):
    """Findings whose tier differs between two settings, or that only one has."""
    return U.difference(*_settings(spark, d), ["o", "p"], "tier")


@query(f"WITH {_SIDES} SELECT 'off' AS setting, count(*) FILTER (off_ = 'critical') AS critical, count(*) FILTER (off_ = 'review') AS review, count(*) FILTER (off_ = 'info') AS info FROM s UNION ALL SELECT 'on', count(*) FILTER (on_ = 'critical'), count(*) FILTER (on_ = 'review'), count(*) FILTER (on_ = 'info') FROM s")
def q_tier_deltas(spark, d):
    """Counts by tier of two settings, tiers without any included."""
    off, on = _settings(spark, d)
    both = off.withColumn("setting", F.lit("off")).unionByName(on.withColumn("setting", F.lit("on")))
    return both.groupBy("setting").pivot("tier", ["critical", "review", "info"]).agg(F.count(F.lit(1))).na.fill(0)


@query("""WITH t AS (SELECT l_linenumber AS threshold, avg(l_discount) AS score, avg(l_quantity) AS cost FROM lineitem GROUP BY ALL), ok AS (SELECT * FROM t WHERE score >= (SELECT max(score) FROM t) - 0.005)
SELECT min_by(threshold, (cost, threshold)) AS threshold, round(min(cost), 5) AS cost FROM ok""")
def q_constrained_min(spark, d):
    """The cheapest threshold whose score is at most 0.005 below the best."""
    t = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("threshold")).agg(F.avg("l_discount").alias("score"), F.avg("l_quantity").alias("cost"))
    best = t.agg(F.max("score").alias("best"))
    ok = t.join(F.broadcast(best), F.col("score") >= F.col("best") - 0.005)  # one row
    return ok.agg(F.min_by("threshold", F.struct("cost", "threshold")).alias("threshold"), F.round(F.min("cost"), 5).alias("cost"))


@query("SELECT (SELECT count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N')) AS shared, (SELECT count(*) FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'N')) = 0 AS disjoint")
def q_disjoint(spark, d):
    lines = table(spark, d, "lineitem")
    side = lambda flag, *cols: lines.filter(F.col("l_returnflag") == flag).select(*cols)
    both = lambda *cols: side("A", *cols).intersect(side("N", *cols)).agg(F.count("*").alias("n"))
    rows = both("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").select((F.col("n") == 0).alias("disjoint"))
    return both("l_partkey").select(F.col("n").alias("shared")).join(rows)  # one row each


@query("SELECT o_orderkey AS id FROM orders JOIN (VALUES (TIMESTAMP '1996-01-01', TIMESTAMP '1996-07-01'), (TIMESTAMP '1998-03-01', TIMESTAMP '1998-03-15')) r(s, e) ON o_orderdate >= s AND o_orderdate < e")
def q_interval_semi(spark, d):
    ranges = F.array(*(F.struct(F.lit(s).cast("timestamp_ntz").alias("s"), F.lit(e).cast("timestamp_ntz").alias("e")) for s, e in (("1996-01-01", "1996-07-01"), ("1998-03-01", "1998-03-15"))))
    at = F.col("o_orderdate").cast("timestamp_ntz")
    return table(spark, d, "orders").filter(F.exists(ranges, lambda r: (r["s"] <= at) & (at < r["e"]))).select(F.col("o_orderkey").alias("id"))


@query("SELECT o_orderkey AS id, CAST(place AS INTEGER) AS place FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS place FROM orders) WHERE place <= 40")
def q_limit(spark, d):
    first = table(spark, d, "orders").select("o_orderkey").orderBy("o_orderkey").limit(40)  # the limit is the feature
    return first.agg(F.array_sort(F.collect_list("o_orderkey")).alias("x")).select(F.posexplode("x").alias("i", "id")).select("id", (F.col("i") + 1).alias("place"))
