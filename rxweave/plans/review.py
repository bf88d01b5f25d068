"""Queries: decision log and its analytics.  Events stand for decisions: purchase confirms, error overrides, signup corrects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import strings as S
from ..operators import logs as G
from ..operators import pairs as P
from ..operators.shared import written
from ..sources.tables import table
from .registry import query

GENESIS = "0" * 64
ACTIONS = {"purchase": "confirm", "error": "override", "signup": "correct"}
SQL_LOG = """log AS (SELECT event_id AS id, ts, user_id AS reviewer, value, CASE event_type WHEN 'purchase' THEN 'confirm' WHEN 'error' THEN 'override' WHEN 'signup' THEN 'correct' END AS action,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS finding, CASE WHEN value >= 70 THEN 'critical' WHEN value >= 50 THEN 'review' ELSE 'info' END AS tier
  FROM events WHERE event_type IN ('purchase', 'error', 'signup'))"""


def log(spark, d) -> DataFrame:
    e = table(spark, d, "events").filter(F.col("event_type").isin(*ACTIONS))
    action = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in ACTIONS.items()))
    tier = F.when(F.col("value") >= 70, "critical").when(F.col("value") >= 50, "review").otherwise("info")
    finding = F.from_json("props", "k int")["k"]
    return e.select(F.col("event_id").alias("id"), "ts", F.col("user_id").alias("reviewer"), "value", action.alias("action"), finding.alias("finding"), tier.alias("tier"))


@query(f"WITH {SQL_LOG} SELECT reviewer, finding, max(id) AS id, max_by(action, id) AS action, max_by(tier, id) AS tier FROM log GROUP BY reviewer, finding")
def q_latest_decision(spark, d):
    return P.latest(log(spark, d).select("reviewer", "finding", "id", "action", "tier"), ["reviewer", "finding"], "id")


def signed_log(spark, d) -> DataFrame:
    """Each reviewer's log, signed; entries whose reason is 5 were changed afterwards."""
    entries = log(spark, d).withColumn("payload", G.canonical({"action": F.col("action"), "finding": F.col("finding"), "tier": F.col("tier")}))
    made = G.signed(entries.select(F.col("reviewer").alias("log"), "id", "ts", "payload"))
    return made.withColumn("payload", F.regexp_replace("payload", '"finding": "5"', '"finding": "6"'))


@query(f"WITH {SQL_LOG}, x AS (SELECT reviewer, id, ts < lag(ts) OVER (PARTITION BY reviewer ORDER BY id) OR finding = 5 AS bad FROM log) SELECT reviewer, count(*) AS n, min(id) FILTER (bad) AS first_bad FROM x GROUP BY reviewer")
def q_chain_verify(spark, d):
    """Every hash is computed anew and held against the next entry's, and times against those before."""
    return G.verified(signed_log(spark, d)).select(F.col("log").alias("reviewer"), "n", "first_bad")


@query(f"""WITH {SQL_LOG}, n AS (SELECT reviewer, count(*) AS n, max(id) AS last FROM log GROUP BY reviewer), b AS (SELECT reviewer, min(id) AS bad FROM (SELECT reviewer, id, ts < lag(ts) OVER (PARTITION BY reviewer ORDER BY id) AS wrong FROM log) WHERE wrong GROUP BY reviewer)
SELECT reviewer, n - 1 AS n, CASE WHEN bad < last THEN bad ELSE (SELECT max(l.id) FROM log l WHERE l.reviewer = n.reviewer AND l.id < last) + 1 END AS first_bad FROM n LEFT JOIN b USING (reviewer) WHERE n > 1""")
def q_chain_cut(spark, d):
    """Logs without their last entry: the chain holds, but the anchor kept beside it tells."""
    entries = log(spark, d).withColumn("payload", G.canonical({"action": F.col("action")}))
    whole = written(G.signed(entries.select(F.col("reviewer").alias("log"), "id", "ts", "payload")))
    last = whole.groupBy("log").agg(F.max("id").alias("last"), F.count("*").alias("n")).filter("n > 1")
    kept = whole.join(last.select("log", "last"), "log").filter("id < last").select(*whole.columns)
    return G.verified(kept, G.heads(whole).join(last.select("log"), "log")).select(F.col("log").alias("reviewer"), "n", "first_bad")


@query(f"WITH {SQL_LOG}, c AS (SELECT min(reviewer) AS reviewer FROM log) SELECT reviewer, id, action, CAST(row_number() OVER (ORDER BY id) AS INTEGER) AS place FROM log JOIN c USING (reviewer)")
def q_log_filter(spark, d):
    """The entries of one case, the first of all in order, by number."""
    rows = log(spark, d)
    case = rows.select("reviewer").distinct().orderBy("reviewer").limit(1)  # a picker's choice
    place = F.row_number().over(Window.partitionBy("reviewer").orderBy("id"))
    return rows.join(F.broadcast(case), "reviewer").select("reviewer", "id", "action", place.alias("place"))


@query("SELECT user_id, max(event_id) AS id, max_by(event_type, event_id) AS kind FROM events GROUP BY user_id")
def q_latest_by(spark, d):
    e = table(spark, d, "events")
    return P.latest(e.select("user_id", F.col("event_id").alias("id"), F.col("event_type").alias("kind")), ["user_id"], "id")


@query(f"WITH {SQL_LOG} SELECT id, CASE WHEN action = 'override' AND finding % 5 = 0 THEN 'an override needs a reason' WHEN action = 'override' AND finding % 5 = 1 THEN 'the reason ''other'' needs a comment' ELSE '' END AS why FROM log")
def q_refused(spark, d):
    """Decisions that a log would not take: overrides without a reason, or with other and no comment."""
    reason = F.when(F.col("finding") % 5 == 0, F.lit(None)).when(F.col("finding") % 5 == 1, "other").otherwise("already_managed")
    why = G.refused(F.col("action"), F.col("reviewer").cast("string"), reason, F.lit(" "))
    return log(spark, d).select("id", F.coalesce(why, F.lit("")).alias("why"))


@query(f"WITH {SQL_LOG} SELECT id, CAST(row_number() OVER (ORDER BY id DESC) AS INTEGER) AS place FROM log ORDER BY id DESC LIMIT 25")
def q_recent(spark, d):
    newest = log(spark, d).select("id").orderBy(F.desc("id")).limit(25)  # the limit is the feature
    return newest.agg(F.reverse(F.array_sort(F.collect_list("id"))).alias("x")).select(F.posexplode("x").alias("i", "id")).select("id", (F.col("i") + 1).alias("place"))


@query(f"""WITH {SQL_LOG} SELECT reviewer, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n,
  list_reduce(list_prepend('{GENESIS}', list(id || ':' || action ORDER BY id)), lambda acc, x: sha256(acc || x)) AS last_hash FROM log GROUP BY ALL""")
def q_hash_chain(spark, d):
    """The last hash of each reviewer's log of a day: every entry hashes the one before and itself.  A log is read in order by nature."""
    entries = F.array_sort(F.collect_list(F.struct("id", F.concat_ws(":", F.col("id").cast("string"), "action").alias("payload"))))
    days = log(spark, d).groupBy("reviewer", F.col("ts").cast("date").cast("string").alias("day")).agg(entries.alias("x"))
    last = F.aggregate("x", F.lit(GENESIS), lambda acc, e: F.sha2(F.concat(acc, e["payload"]).cast("binary"), 256))
    return days.select("reviewer", "day", F.size("x").cast("long").alias("n"), last.alias("last_hash"))


@query(f"WITH {SQL_LOG} SELECT count(*) AS decisions, count(DISTINCT reviewer) AS reviewers, count(DISTINCT finding) AS findings, count(*) FILTER (action = 'override') AS overridden, count(*) FILTER (action <> 'confirm') AS not_confirmed FROM log")
def q_review_kpis(spark, d):
    return log(spark, d).agg(F.count("*").alias("decisions"), F.count_distinct("reviewer").alias("reviewers"), F.count_distinct("finding").alias("findings"), F.count_if(F.col("action") == "override").alias("overridden"), F.count_if(F.col("action") != "confirm").alias("not_confirmed"))


@query(f"WITH {SQL_LOG} SELECT tier, count(*) FILTER (action = 'confirm') AS confirmed, count(*) FILTER (action = 'override') AS overridden FROM log GROUP BY tier")
def q_by_tier(spark, d):
    return log(spark, d).groupBy("tier").agg(F.count_if(F.col("action") == "confirm").alias("confirmed"), F.count_if(F.col("action") == "override").alias("overridden"))


@query(f"WITH {SQL_LOG} SELECT coalesce(finding::VARCHAR, 'other') AS reason, count(*) AS n FROM log WHERE action = 'override' GROUP BY ALL")
def q_reasons(spark, d):
    return log(spark, d).filter("action = 'override'").groupBy(F.coalesce(F.col("finding").cast("string"), F.lit("other")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"""WITH {SQL_LOG}, days AS (SELECT CAST(unnest(generate_series(max(CAST(ts AS DATE)) - 13, max(CAST(ts AS DATE)), INTERVAL 1 DAY)) AS DATE) AS day FROM log)
SELECT CAST(day AS VARCHAR) AS day, count(id) AS n FROM days LEFT JOIN log ON CAST(ts AS DATE) = day GROUP BY ALL""")
def q_per_day(spark, d):
    """Decisions of the last 14 days, days without any included."""
    rows = log(spark, d).withColumn("day", F.col("ts").cast("date"))
    last = rows.agg(F.max("day").alias("last"))
    days = last.select(F.explode(F.sequence(F.date_sub("last", 13), "last")).alias("day"))
    counted = rows.groupBy("day").agg(F.count("*").alias("found"))
    return days.join(counted, "day", "left").select(F.col("day").cast("string").alias("day"), F.coalesce("found", F.lit(0)).cast("long").alias("n"))


@query(f"WITH {SQL_LOG} SELECT reviewer, id, CAST(ts AS DATE) <> lag(CAST(ts AS DATE)) OVER (PARTITION BY reviewer ORDER BY id) AS new_day FROM log")
def q_day_break(spark, d):
    day = F.col("ts").cast("date")
    return log(spark, d).select("reviewer", "id", (day != F.lag(day).over(Window.partitionBy("reviewer").orderBy("id"))).alias("new_day"))


@query(f"WITH {SQL_LOG} SELECT count(*) AS n, max(id) AS last_id, sha256(max_by(id || ':' || action, id)) AS last_hash FROM log")
def q_log_state(spark, d):
    newest = F.max_by(F.concat_ws(":", F.col("id").cast("string"), "action"), "id")
    return log(spark, d).agg(F.count("*").alias("n"), F.max("id").alias("last_id"), F.sha2(newest.cast("binary"), 256).alias("last_hash"))


@query(f"""WITH {SQL_LOG}, l AS (SELECT reviewer, finding, max_by(action, id) AS action, max_by(tier, id) AS tier FROM log GROUP BY ALL)
SELECT reviewer, count(*) AS findings, count(*) FILTER (tier IN ('critical', 'review')) AS actionable, count(*) FILTER (tier IN ('critical', 'review') AND action = 'confirm') AS decided,
  coalesce(CAST(round(100 * count(*) FILTER (tier IN ('critical', 'review') AND action = 'confirm') / nullif(count(*) FILTER (tier IN ('critical', 'review')), 0)::DOUBLE) AS INTEGER), 100) AS percent FROM l GROUP BY reviewer""")
def q_pending(spark, d):
    """How far the review is: decided findings of those that need a decision; 100 where none does."""
    latest = P.latest(log(spark, d).select("reviewer", "finding", "id", "action", "tier"), ["reviewer", "finding"], "id")
    act = F.col("tier").isin("critical", "review")
    counted = latest.groupBy("reviewer").agg(F.count("*").alias("findings"), F.count_if(act).alias("actionable"), F.count_if(act & (F.col("action") == "confirm")).alias("decided"))
    return counted.withColumn("percent", F.coalesce(F.round(F.try_divide(100.0 * F.col("decided"), F.col("actionable"))).cast("int"), F.lit(100)))


@query("SELECT event_id, CASE WHEN left(v, 1) IN ('=', '+', '-', '@') THEN '''' || v ELSE v END AS cell FROM (SELECT event_id, substr('=+-@ab', CAST(event_id % 6 AS INTEGER) + 1, 1) || event_type AS v FROM events)")
def q_csv_safe(spark, d):
    v = F.concat(F.substring(F.lit("=+-@ab"), (F.col("event_id") % 6).cast("int") + 1, F.lit(1)), "event_type")
    return table(spark, d, "events").select("event_id", S.csv_safe(v).alias("cell"))


@query("SELECT event_id, '{\"action\":\"' || event_type || '\",\"reviewer\":' || user_id || '}' AS payload FROM events")
def q_to_json(spark, d):
    return table(spark, d, "events").select("event_id", F.to_json(F.struct(F.col("event_type").alias("action"), F.col("user_id").alias("reviewer"))).alias("payload"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def q_json_rows(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("SELECT user_id, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'signup') AS signup FROM events GROUP BY user_id")
def q_kv_pivot(spark, d):
    return table(spark, d, "events").groupBy("user_id").pivot("event_type", ["purchase", "error", "signup"]).agg(F.count(F.lit(1))).na.fill(0)


@query("SELECT o_orderkey, substr(sha256(o_orderkey || '|' || o_orderstatus), 1, 10) AS case_id FROM orders")
def q_case_id(spark, d):
    key = F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus")
    return table(spark, d, "orders").select("o_orderkey", F.substring(F.sha2(key.cast("binary"), 256), 1, 10).alias("case_id"))


@query("""WITH x AS (SELECT o_custkey AS cust, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY ALL), p AS (SELECT c_custkey AS cust, coalesce(max(n) FILTER (s = 'F'), 0) AS before, coalesce(max(n) FILTER (s = 'O'), 0) AS after FROM customer LEFT JOIN x ON cust = c_custkey GROUP BY ALL)
SELECT CASE WHEN before = 0 AND after = 0 THEN 'none' WHEN before = 0 THEN 'new' WHEN after = 0 THEN 'stopped' WHEN before = after THEN 'same' ELSE 'changed' END AS flow, count(*) AS n FROM p GROUP BY ALL""")
def q_flow(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    sides = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(F.col("o_orderstatus") == "O").alias("o"))
    f, o = F.coalesce("f", F.lit(0)), F.coalesce("o", F.lit(0))
    flow = F.when((f == 0) & (o == 0), "none").when(f == 0, "new").when(o == 0, "stopped").when(f == o, "same").otherwise("changed")
    return c.select("c_custkey").join(sides, "c_custkey", "left").groupBy(flow.alias("flow")).agg(F.count("*").alias("n"))


@query("""WITH base AS (SELECT o_orderkey AS id, o_orderpriority AS v FROM orders), edits AS (SELECT o_orderkey AS id, 'edited' AS v FROM orders WHERE o_orderstatus = 'P'), gone AS (SELECT o_orderkey AS id FROM orders WHERE o_totalprice < 20000)
SELECT id, coalesce(e.v, b.v) AS v FROM base b LEFT JOIN edits e USING (id) WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT -c_custkey, 'added' FROM customer WHERE c_acctbal < 0""")
def q_list_edit(spark, d):
    """Deletions, changes and additions of a reviewed list as joins: nothing is changed in place."""
    orders = table(spark, d, "orders")
    edits = orders.filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"), F.lit("edited").alias("new"))
    gone = orders.filter("o_totalprice < 20000").select(F.col("o_orderkey").alias("id"))
    kept = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("v")).join(gone, "id", "left_anti").join(edits, "id", "left").select("id", F.coalesce("new", "v").alias("v"))
    return kept.unionByName(table(spark, d, "customer").filter("c_acctbal < 0").select((-F.col("c_custkey")).alias("id"), F.lit("added").alias("v")))
