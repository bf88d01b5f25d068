"""Queries: predicted spans against gold ones, curves of scores, and intervals by resampling.

Line items stand for spans of their orders: gold are all, predicted those with line status O or flag R, some of them one place on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import scoring as M
from ..sources.tables import table
from .evaluation import SQL_SCORES, scores
from .registry import query

SQL_SPANS = """g AS MATERIALIZED (SELECT DISTINCT l_orderkey AS note_id, l_returnflag AS kind, CAST(l_quantity AS INTEGER) AS s, CAST(l_quantity AS INTEGER) + l_linenumber AS e FROM lineitem),
p AS MATERIALIZED (SELECT DISTINCT l_orderkey AS note_id, l_returnflag AS kind, CAST(l_quantity AS INTEGER) + CAST(l_partkey % 3 AS INTEGER) % 2 AS s, CAST(l_quantity AS INTEGER) + l_linenumber AS e FROM lineitem WHERE l_linestatus = 'O' OR l_returnflag = 'R')"""
SQL_RATES = "round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision_, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1"


def spans(spark, d) -> tuple[DataFrame, DataFrame]:
    q, line = F.col("l_quantity").cast("int"), F.col("l_linenumber")
    rows = table(spark, d, "lineitem")
    key = (F.col("l_orderkey").alias("note_id"), F.col("l_returnflag").alias("kind"))
    gold = rows.select(*key, q.alias("s"), (q + line).cast("int").alias("e"))
    return gold, rows.filter("l_linestatus = 'O' or l_returnflag = 'R'").select(*key, (q + (F.col("l_partkey") % 3).cast("int") % 2).alias("s"), (q + line).cast("int").alias("e"))


@query(f"""WITH {SQL_SPANS}, c AS (SELECT coalesce(g.kind, p.kind) AS kind, count(*) FILTER (g.s IS NOT NULL AND p.s IS NOT NULL) AS tp, count(*) FILTER (g.s IS NULL) AS fp, count(*) FILTER (p.s IS NULL) AS fn
  FROM g FULL JOIN p ON g.note_id = p.note_id AND g.kind = p.kind AND g.s = p.s AND g.e = p.e GROUP BY 1),
a AS (SELECT * FROM c UNION ALL SELECT 'micro', sum(tp), sum(fp), sum(fn) FROM c) SELECT kind, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, {SQL_RATES} FROM a""")
def q_prf(spark, d):
    return M.with_micro(M.strict_counts(*spans(spark, d), ["note_id", "s", "e"]))


@query(f"""WITH RECURSIVE {SQL_SPANS}, gl AS MATERIALIZED (SELECT note_id, kind, list({{'s': s, 'e': e}} ORDER BY s, e) AS gs FROM g GROUP BY ALL), pl AS MATERIALIZED (SELECT note_id, kind, list({{'s': s, 'e': e}} ORDER BY s, e) AS ps FROM p GROUP BY ALL),
b AS MATERIALIZED (SELECT note_id, kind, coalesce(gs, []) AS gs, coalesce(ps, []) AS ps FROM gl FULL JOIN pl USING (note_id, kind)),
f(note_id, kind, i, free) AS (SELECT note_id, kind, 0, range(1, len(ps) + 1) FROM b UNION ALL
  SELECT f.note_id, f.kind, i + 1, CASE WHEN len(hit) > 0 THEN list_filter(free, lambda x: x <> hit[1]) ELSE free END FROM (SELECT f.*, b.gs, list_filter(free, lambda x: b.ps[x].s < b.gs[i + 1].e AND b.gs[i + 1].s < b.ps[x].e) AS hit FROM f JOIN b USING (note_id, kind) WHERE i < len(gs)) f),
l AS (SELECT note_id, kind, max_by(free, i) AS free FROM f GROUP BY ALL), c AS (SELECT b.kind, sum(len(ps) - len(free)) AS tp, sum(len(free)) AS fp, sum(len(gs)) - sum(len(ps) - len(free)) AS fn FROM b JOIN l USING (note_id, kind) GROUP BY b.kind),
a AS (SELECT * FROM c UNION ALL SELECT 'micro', sum(tp), sum(fp), sum(fn) FROM c) SELECT kind, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, {SQL_RATES} FROM a""")
def q_prf_lenient(spark, d):
    return M.with_micro(M.lenient_counts(*spans(spark, d)))


@query(f"""WITH {SQL_SPANS}, t AS (SELECT note_id, s FROM (SELECT note_id, unnest(range(50)) AS s FROM (SELECT DISTINCT note_id FROM g))),
x AS (SELECT EXISTS (SELECT 1 FROM g WHERE g.note_id = t.note_id AND g.s < t.s + 1 AND t.s < g.e) AS gold, EXISTS (SELECT 1 FROM p WHERE p.note_id = t.note_id AND p.s < t.s + 1 AND t.s < p.e) AS pred FROM t),
c AS (SELECT count(*) FILTER (gold AND pred) AS tp, count(*) FILTER (pred AND NOT gold) AS fp, count(*) FILTER (gold AND NOT pred) AS fn, count(*) FILTER (NOT gold AND NOT pred) AS tn FROM x)
SELECT *, round(coalesce(tn / nullif(tn + fp, 0)::DOUBLE, 0), 6) AS specificity, {SQL_RATES} FROM c""")
def q_token_confusion(spark, d):
    """Tokens (here: 50 places a note) inside any gold and any predicted span."""
    gold, predicted = spans(spark, d)
    side = lambda df, name: df.groupBy("note_id").agg(F.collect_set(F.struct("s", "e")).alias(name))
    notes = side(gold, "g").join(side(predicted, "p"), "note_id", "left")
    tokens = notes.select("note_id", "g", "p", F.explode(F.sequence(F.lit(0), F.lit(49))).alias("s"))
    inside = lambda c: F.coalesce(F.exists(c, lambda x: (x["s"] < F.col("s") + 1) & (F.col("s") < x["e"])), F.lit(False))
    x = tokens.select(inside("g").alias("g"), inside("p").alias("p"))
    c = x.agg(F.count_if(F.expr("g and p")).alias("tp"), F.count_if(F.expr("p and not g")).alias("fp"), F.count_if(F.expr("g and not p")).alias("fn"), F.count_if(F.expr("not g and not p")).alias("tn"))
    return c.select("*", F.round(F.coalesce(F.try_divide(F.col("tn").cast("double"), F.col("tn") + F.col("fp")), F.lit(0.0)), 6).alias("specificity"), *M.rates(F.col("tp"), F.col("fp"), F.col("fn")))


@query(f"""WITH {SQL_SCORES}, c AS (SELECT score, count(*) FILTER (toxic = 1) AS p, count(*) AS n FROM s GROUP BY score), r AS (SELECT p, sum(p) OVER w AS tp, sum(n) OVER w AS taken FROM c WINDOW w AS (ORDER BY score DESC))
SELECT round(sum(p * tp / taken::DOUBLE) / sum(p), 6) AS average_precision FROM r""")
def q_avg_precision(spark, d):
    return M.average_precision(scores(spark, d))


@query(f"""WITH {SQL_SCORES}, g AS (SELECT score, count(*) FILTER (toxic = 1) AS p, count(*) FILTER (toxic = 0) AS n FROM s GROUP BY score),
r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
SELECT round(sum(p * (below + n / 2.0)) / (sum(p) * sum(n)), 6) AS auc FROM r""")
def q_auc(spark, d):
    return M.auc(scores(spark, d))


@query(f"""WITH {SQL_SCORES}, g AS (SELECT score, count(*) FILTER (toxic = 1) AS p, count(*) AS n FROM s GROUP BY score),
r AS (SELECT score, sum(p) OVER w AS tp, sum(n) OVER w AS taken, sum(p) OVER () AS total FROM g WINDOW w AS (ORDER BY score DESC)),
f AS (SELECT score, 2 * tp / (taken + total)::DOUBLE AS f1 FROM r) SELECT round(max(f1), 6) AS f1, max_by(score, (round(f1, 9), score)) AS threshold FROM f""")
def q_best_threshold(spark, d):
    return M.best_threshold(scores(spark, d))


RESAMPLES, BLOCKS = 2000, 200
SQL_DRAWS = f"""b AS MATERIALIZED (SELECT block, coalesce(tp, 0) AS tp, coalesce(wrong, 0) AS wrong, coalesce(tp2, 0) AS tp2, coalesce(wrong2, 0) AS wrong2 FROM range({BLOCKS}) x(block) LEFT JOIN (SELECT doc_id % {BLOCKS} AS block, count(*) FILTER (toxic = 1 AND score >= 0.5) AS tp, count(*) FILTER ((toxic = 1) <> (score >= 0.5)) AS wrong,
  count(*) FILTER (toxic = 1 AND score >= 0.25) AS tp2, count(*) FILTER ((toxic = 1) <> (score >= 0.25)) AS wrong2 FROM s GROUP BY ALL) USING (block)),
draws AS MATERIALIZED (SELECT r, (('0x' || substr(md5('42:' || r || ':' || j), 1, 7))::BIGINT) % {BLOCKS} AS block FROM range({RESAMPLES}) x(r), range({BLOCKS}) y(j)),
f AS MATERIALIZED (SELECT r, coalesce(2 * sum(tp) / nullif(2 * sum(tp) + sum(wrong), 0)::DOUBLE, 0) AS f1, coalesce(2 * sum(tp2) / nullif(2 * sum(tp2) + sum(wrong2), 0)::DOUBLE, 0) AS f2 FROM draws JOIN b USING (block) GROUP BY r)"""


def _resamples(spark, d) -> DataFrame:
    """F1 at two thresholds for each resample, of the same draws."""
    real = F.col("toxic") == 1
    counts = [(F.count_if((F.col("score") >= t) & real).alias(f"tp{k}"), F.count_if((F.col("score") >= t) != real).alias(f"wrong{k}")) for k, t in (("", 0.5), ("2", 0.25))]
    found = scores(spark, d).groupBy((F.col("doc_id") % BLOCKS).alias("block")).agg(*(c for pair in counts for c in pair))
    blocks = spark.range(BLOCKS).select(F.col("id").alias("block")).join(found, "block", "left").na.fill(0)
    f1 = lambda k: F.coalesce(F.try_divide(2.0 * F.sum(f"tp{k}"), 2 * F.sum(f"tp{k}") + F.sum(f"wrong{k}")), F.lit(0.0)).alias(f"f{k or 1}")
    return M.resampled(blocks, spark, RESAMPLES).groupBy("r").agg(f1(""), f1("2"))


@query(f"WITH {SQL_SCORES}, {SQL_DRAWS} SELECT round(quantile_cont(f1, 0.025), 5) AS low, round(quantile_cont(f1, 0.975), 5) AS high FROM f")
def q_bootstrap(spark, d):
    """Interval of F1 over 2,000 resamples of 200 blocks of documents."""
    return _resamples(spark, d).agg(*M.interval(F.col("f1")))


@query(f"WITH {SQL_SCORES}, {SQL_DRAWS} SELECT round(avg(f2 - f1), 5) AS mean, round(quantile_cont(f2 - f1, 0.025), 5) AS low, round(quantile_cont(f2 - f1, 0.975), 5) AS high FROM f")
def q_bootstrap_paired(spark, d):
    """Interval of the difference of F1 between two thresholds, over the same resamples."""
    change = F.col("f2") - F.col("f1")
    return _resamples(spark, d).agg(F.round(F.avg(change), 5).alias("mean"), *M.interval(change))


@query(f"""WITH {SQL_SCORES}, c AS MATERIALIZED (SELECT doc_id % {BLOCKS} AS block, score, count(*) FILTER (toxic = 1) AS p, count(*) FILTER (toxic = 0) AS n FROM s GROUP BY ALL),
draws AS MATERIALIZED (SELECT r, (('0x' || substr(md5('7:' || r || ':' || j), 1, 7))::BIGINT) % {BLOCKS} AS block FROM range(200) x(r), range({BLOCKS}) y(j)),
g AS (SELECT r, score, sum(p) AS p, sum(n) AS n FROM draws JOIN c USING (block) GROUP BY ALL), w AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY r ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g),
a AS (SELECT r, sum(p * (below + n / 2.0)) / nullif(sum(p) * sum(n), 0) AS auc FROM w GROUP BY r) SELECT round(quantile_cont(auc::DOUBLE, 0.025), 5) AS low, round(quantile_cont(auc::DOUBLE, 0.975), 5) AS high, count(auc) AS used FROM a""")
def q_auc_bootstrap(spark, d):
    """Interval of the AUC over 200 resamples; those without both classes are left out."""
    found = scores(spark, d).groupBy((F.col("doc_id") % BLOCKS).alias("block"), "score").agg(F.count_if(F.col("toxic") == 1).alias("p"), F.count_if(F.col("toxic") == 0).alias("n"))
    held = found.groupBy("block").agg(F.collect_list(F.struct("score", "p", "n")).alias("x"))
    blocks = spark.range(BLOCKS).select(F.col("id").alias("block")).join(held, "block", "left")
    drawn = M.resampled(blocks, spark, 200, 7).select("r", F.explode("x").alias("x")).groupBy("r", "x.score").agg(F.sum("x.p").alias("p"), F.sum("x.n").alias("n"))
    one = drawn.groupBy("r").agg(F.sort_array(F.collect_list(F.struct("score", "p", "n"))).alias("x"))
    step = lambda acc, y: F.struct((acc["a"] + y["p"] * (acc["n"] + y["n"] / 2.0)).alias("a"), (acc["p"] + y["p"]).alias("p"), (acc["n"] + y["n"]).alias("n"))
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("n"))
    auc = one.select(F.aggregate("x", zero, step, lambda acc: F.try_divide(acc["a"], acc["p"] * acc["n"])).alias("auc"))
    return auc.agg(*M.interval(F.col("auc")), F.count("auc").alias("used"))
