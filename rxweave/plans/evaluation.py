"""Queries: link features and evaluation measures.  Part pairs of an order are the graph, labels against a text rule the scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import strings as S
from ..operators import graph as G
from ..operators.shared import written
from ..sources.tables import table
from .knowledge import SQL_PAIRS, raw_pairs
from .registry import query

SQL_EDGES = f"WITH {SQL_PAIRS}, links AS (SELECT DISTINCT a, b FROM raw WHERE source = 'O'), e AS (SELECT a AS u, b AS v FROM links UNION SELECT b, a FROM links), deg AS (SELECT u, count(*) AS d FROM e GROUP BY u)"


def links(spark, d):
    return raw_pairs(spark, d).filter("source = 'O'").select("a", "b").distinct()


@query(SQL_EDGES + " SELECT u, count(*) AS degree, min(v) AS first_neighbour FROM e GROUP BY u")
def q_adjacency(spark, d):
    return G.adjacency(links(spark, d)).groupBy("u").agg(F.count("*").alias("degree"), F.min("v").alias("first_neighbour"))


@query(SQL_EDGES + """, q AS (SELECT DISTINCT a, b FROM raw WHERE source = 'F'),
c AS (SELECT q.a, q.b, count(*) AS common, sum(CASE WHEN deg.d > 1 THEN 1 / ln(deg.d) ELSE 0 END) AS adamic, sum(1 / deg.d::DOUBLE) AS allocation FROM q JOIN e x ON x.u = q.a JOIN e y ON y.u = q.b AND y.v = x.v JOIN deg ON deg.u = x.v GROUP BY ALL),
f AS (SELECT q.a, q.b, coalesce(da.d, 0) - (l.a IS NOT NULL)::INT AS da, coalesce(db.d, 0) - (l.a IS NOT NULL)::INT AS db, coalesce(c.common, 0) AS common, adamic, allocation
  FROM q LEFT JOIN c USING (a, b) LEFT JOIN links l USING (a, b) LEFT JOIN deg da ON da.u = q.a LEFT JOIN deg db ON db.u = q.b)
SELECT a, b, CAST(da AS BIGINT) AS degree_a, CAST(db AS BIGINT) AS degree_b, common, round(coalesce(common / nullif(da + db - common, 0)::DOUBLE, 0), 6) AS jaccard, round(coalesce(adamic, 0), 6) AS adamic,
  round(coalesce(allocation, 0), 6) AS allocation, CAST(da * db AS BIGINT) AS preferential, CAST(least(da, db) AS BIGINT) AS degree_min, CAST(greatest(da, db) AS BIGINT) AS degree_max, round(coalesce(2 * common / nullif(da + db, 0)::DOUBLE, 0), 6) AS sorensen,
  round(coalesce(common / nullif(least(da, db), 0)::DOUBLE, 0), 6) AS hub_promoted, round(coalesce(common / nullif(greatest(da, db), 0)::DOUBLE, 0), 6) AS hub_depressed FROM f""")
def q_graph_features(spark, d):
    raw = raw_pairs(spark, d)
    one = lambda source: raw.filter(F.col("source") == source).select("a", "b").distinct()
    return G.link_features(written(G.adjacency(one("O"))), one("F"))


@query(f"""WITH {SQL_PAIRS}, links AS (SELECT DISTINCT a, b FROM raw WHERE source = 'O'),
n AS (SELECT DISTINCT CASE WHEN b % 2 = 0 THEN a ELSE b END AS x, (a * 7 + b) % 1000 + 1 AS y FROM links)
SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b FROM n WHERE x <> y AND NOT EXISTS (SELECT 1 FROM links WHERE links.a = least(x, y) AND links.b = greatest(x, y))""")
def q_negatives(spark, d):
    positive = links(spark, d)
    side = F.when(F.col("b") % 2 == 0, "t").otherwise("h")
    rows = positive.select(F.col("a").cast("string").alias("d1"), F.col("b").cast("string").alias("d2"), F.concat(((F.col("a") * 7 + F.col("b")) % 1000 + 1).cast("string"), F.lit("$"), side).alias("neg"))
    found = G.negatives(rows, positive.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b")))
    return found.select(F.least(*(F.col(x).cast("long") for x in "ab")).alias("a"), F.greatest(*(F.col(x).cast("long") for x in "ab")).alias("b"))


SQL_BITS = "v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x > 0) AS bits FROM embeddings)"
SQL_NEAR = f"WITH {SQL_BITS}, s AS (SELECT q.id AS query, v.id, coalesce(len(list_filter(list_zip(q.bits, v.bits), lambda z: z[1] AND z[2])) / nullif(len(list_filter(list_zip(q.bits, v.bits), lambda z: z[1] OR z[2])), 0)::DOUBLE, 0) AS similarity FROM v q, v WHERE q.id % 20 = 0 AND q.id <> v.id)"


def bit_rows(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), G.bits(F.col("embedding")).alias("bits"))


@query(SQL_NEAR + ", r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS place FROM s) SELECT query, id, round(similarity, 6) AS similarity, CAST(place AS INTEGER) AS place FROM r WHERE place <= 5")
def q_knn(spark, d):
    rows = bit_rows(spark, d)
    return G.nearest(rows.filter("id % 20 = 0"), rows, 5).select("query", "id", F.round("similarity", 6).alias("similarity"), "place")


SQL_SCORES = "s AS (SELECT doc_id, toxic, least(1.0, len(regexp_extract_all(lower(text), 'idiot|moron|scum|loser|trash')) / 4.0) AS score FROM labels JOIN documents USING (doc_id))"


def scores(spark, d):
    """Labels with the score of a plain word rule."""
    hits = F.regexp_count(F.lower("text"), F.lit("idiot|moron|scum|loser|trash"))
    rows = table(spark, d, "labels").select("doc_id", "toxic").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return rows.select("doc_id", "toxic", F.least(F.lit(1.0), hits / 4.0).alias("score"))


@query(f"WITH {SQL_SCORES}, c AS (SELECT count(*) FILTER (toxic = 1 AND score >= 0.5) AS tp, count(*) FILTER (toxic = 0 AND score >= 0.5) AS fp, count(*) FILTER (toxic = 1 AND score < 0.5) AS fn, count(*) FILTER (toxic = 0 AND score < 0.5) AS tn FROM s) SELECT *, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision_, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1 FROM c")
def q_confusion(spark, d):
    hit, real = F.col("score") >= 0.5, F.col("toxic") == 1
    c = scores(spark, d).agg(F.count_if(hit & real).alias("tp"), F.count_if(hit & ~real).alias("fp"), F.count_if(~hit & real).alias("fn"), F.count_if(~hit & ~real).alias("tn"))
    share = lambda x, y: F.round(F.coalesce(F.try_divide(x.cast("double"), y), F.lit(0.0)), 6)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select("*", share(tp, tp + fp).alias("precision_"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))


@query("""WITH g AS (SELECT source, count(*) AS n, count(*) FILTER (toxic = 1) AS hits FROM labels JOIN documents USING (doc_id) GROUP BY source), x AS (SELECT source, n, hits, hits / n::DOUBLE AS p FROM g)
SELECT source, n, hits, round((p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n), 5) AS low,
  round((p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n), 5) AS high FROM x""")
def q_wilson(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    g = rows.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("hits"))
    low, high = S.wilson(F.col("hits").cast("double"), F.col("n"))
    return g.select("source", "n", "hits", F.round(low, 5).alias("low"), F.round(high, 5).alias("high"))


@query("SELECT l_returnflag AS part, count(*) AS n, round(avg(l_quantity), 5) AS mean, round(coalesce(stddev_samp(l_quantity), 0), 5) AS sd FROM lineitem GROUP BY ALL")
def q_mean_sd(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("part")).agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 5).alias("mean"), F.round(F.coalesce(F.stddev_samp("l_quantity"), F.lit(0.0)), 5).alias("sd"))


@query("SELECT toxic, doc_id FROM (SELECT toxic, doc_id, row_number() OVER (PARTITION BY toxic ORDER BY md5('7:' || doc_id), doc_id) AS place FROM labels) WHERE place <= 10")
def q_stratified_sample(spark, d):
    key = F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string")).cast("binary"))
    place = F.row_number().over(Window.partitionBy("toxic").orderBy(key, "doc_id"))
    return table(spark, d, "labels").withColumn("place", place).filter("place <= 10").select("toxic", "doc_id")


@query(f"WITH {SQL_PAIRS}, t AS (SELECT DISTINCT a, b FROM raw WHERE source = 'O'), s AS (SELECT DISTINCT a, b FROM raw WHERE source = 'F') SELECT a, b FROM s WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.a = s.a AND t.b = s.b)")
def q_anti_pairs(spark, d):
    raw = raw_pairs(spark, d)
    one = lambda source: raw.filter(F.col("source") == source).select("a", "b").distinct()
    return one("F").join(one("O"), ["a", "b"], "left_anti")


@query(f"WITH {SQL_PAIRS}, g AS (SELECT DISTINCT a, b FROM raw WHERE source = 'O'), p AS (SELECT DISTINCT a, b FROM raw WHERE source = 'F') , c AS (SELECT count(*) FILTER (g.a IS NOT NULL AND p.a IS NOT NULL) AS tp, count(*) FILTER (p.a IS NULL) AS missed, count(*) FILTER (g.a IS NULL) AS extra FROM g FULL JOIN p ON g.a = p.a AND g.b = p.b) SELECT *, round(tp / nullif(tp + extra, 0)::DOUBLE, 6) AS precision_, round(tp / nullif(tp + missed, 0)::DOUBLE, 6) AS recall, round((tp + extra) / (SELECT count(DISTINCT list_id) FROM raw WHERE source = 'F')::DOUBLE, 6) AS per_list FROM c")
def q_alert_eval(spark, d):
    raw = raw_pairs(spark, d)
    gold = raw.filter("source = 'O'").select("a", "b").distinct().withColumn("g", F.lit(True))
    found = raw.filter("source = 'F'").select("a", "b").distinct().withColumn("p", F.lit(True))
    both = gold.join(found, ["a", "b"], "full_outer")
    c = both.agg(F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("tp"), F.count_if(F.col("p").isNull()).alias("missed"), F.count_if(F.col("g").isNull()).alias("extra"))
    lists = raw.filter("source = 'F'").agg(F.count_distinct("list_id").alias("lists"))
    share = lambda x, y: F.round(F.try_divide(x.cast("double"), y), 6)
    tp, found = F.col("tp"), F.col("tp") + F.col("extra")
    return c.join(lists).select("tp", "missed", "extra", share(tp, found).alias("precision_"), share(tp, tp + F.col("missed")).alias("recall"), share(found, F.col("lists")).alias("per_list"))  # one row each
