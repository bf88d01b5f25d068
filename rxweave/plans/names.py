"""Queries: names as written, and what they stand for.  Parts stand for medications, written in a dozen ways by their number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import names as O
from ..operators import similarity as X
from ..sources.tables import table
from .registry import query

#: Digits as letters, so that codes have no doses in them.
LETTERS = "klmnopqrst"
REAL = ("aspirin", "warfarin", "acetaminophen", "oxycodone")


def _noun():
    return F.substring_index("p_name", " ", -1)


def _code(c):
    return F.translate(F.regexp_replace(c.cast("string"), "[^0-9]", ""), "0123456789", LETTERS)


def lexicon(spark, d) -> DataFrame:
    """Nouns and series of parts and a few real names, each standing for itself."""
    p = table(spark, d, "part")
    own = p.select(_noun().alias("surface")).union(p.select(F.concat(F.lit("compound series "), _code(F.col("p_brand"))))).distinct()
    real = spark.createDataFrame([(x,) for x in REAL], "surface string")
    return own.union(real).select("surface", F.array("surface").alias("targets"), F.lit("kb").alias("source"))


def raw_names(spark, d) -> DataFrame:
    """(p_partkey, raw): a way to write something for each part."""
    noun, n = _noun(), F.col("p_partkey") % 12
    ways = [
        noun, F.concat(F.upper(noun), F.lit(" 25 mg")), F.concat(noun, F.lit(" HCl")), F.lit("Percocet"), F.lit("ASA 81 mg"), F.concat(noun, F.lit("/Aspirin")), F.lit("Statins"), F.lit("NS 0.9%"),
        F.concat(F.lit("Compound series "), _code(F.col("p_brand")), F.lit("z")), F.concat(F.lit("qqq"), _code(F.col("p_partkey"))), F.concat(noun, F.lit(" in sodium chloride 0.9%")), F.lit(""),
    ]
    raw = F.coalesce(*(F.when(n == k, w) for k, w in enumerate(ways)))
    return table(spark, d, "part").select("p_partkey", raw.alias("raw"))


SQL_RAW = """code AS (SELECT *, p_partkey % 12 AS k, split_part(p_name, ' ', 2) AS noun, translate(regexp_replace(p_brand, '[^0-9]', '', 'g'), '0123456789', 'klmnopqrst') AS c,
  translate(p_partkey::VARCHAR, '0123456789', 'klmnopqrst') AS q FROM part),
named AS (SELECT p_partkey, k, noun, c, CASE k WHEN 0 THEN noun WHEN 1 THEN upper(noun) || ' 25 mg' WHEN 2 THEN noun || ' HCl' WHEN 3 THEN 'Percocet' WHEN 4 THEN 'ASA 81 mg' WHEN 5 THEN noun || '/Aspirin'
  WHEN 6 THEN 'Statins' WHEN 7 THEN 'NS 0.9%' WHEN 8 THEN 'Compound series ' || c || 'z' WHEN 9 THEN 'qqq' || q WHEN 10 THEN noun || ' in sodium chloride 0.9%' ELSE '' END AS raw FROM code),
known AS (SELECT *, CASE WHEN k IN (0, 1, 2, 10) THEN noun WHEN k = 3 THEN 'acetaminophen|oxycodone' WHEN k = 4 THEN 'aspirin' WHEN k = 5 THEN least(noun, 'aspirin') || '|' || greatest(noun, 'aspirin')
    WHEN k = 8 THEN 'compound series ' || c ELSE '' END AS drugs,
  CASE k WHEN 0 THEN 'exact' WHEN 1 THEN 'cleaned' WHEN 2 THEN 'salt_stripped' WHEN 3 THEN 'exact' WHEN 4 THEN 'abbreviation' WHEN 5 THEN 'combination' WHEN 6 THEN 'drug_class' WHEN 7 THEN 'non_drug' WHEN 8 THEN 'fuzzy'
    WHEN 9 THEN 'unmapped' WHEN 10 THEN 'exact' ELSE 'empty' END AS stage,
  CASE WHEN k IN (0, 3, 6, 7, 10) THEN 1.0 WHEN k IN (1, 4) THEN 0.95 WHEN k IN (2, 5) THEN 0.9 WHEN k = 8 THEN round(2.0 * length('compound series ' || c) / (2 * length('compound series ' || c) + 1) * 0.85, 3) ELSE 0 END::DOUBLE AS score,
  CASE k WHEN 6 THEN 'drug_class' WHEN 7 THEN 'non_drug' WHEN 9 THEN 'unmapped' WHEN 11 THEN 'unmapped' ELSE 'mapped' END AS status FROM named)"""


@query(f"WITH {SQL_RAW} SELECT DISTINCT raw, drugs, stage, score, status FROM known")
def q_norm_cascade(spark, d):
    found = O.normalize(raw_names(spark, d), lexicon(spark, d))
    return found.select("raw", F.array_join("drugs", "|").alias("drugs"), "stage", "score", "status")


@query(f"WITH {SQL_RAW} SELECT p_partkey, CASE k WHEN 6 THEN 'drug_class' WHEN 7 THEN 'non_drug' WHEN 11 THEN 'empty' ELSE 'other' END AS kind FROM named")
def q_classify(spark, d):
    s = N.simplified(F.col("raw"))
    return raw_names(spark, d).select("p_partkey", F.coalesce(O.classify(s), F.lit("other")).alias("kind"))


@query(f"WITH {SQL_RAW} SELECT DISTINCT raw, drugs, score FROM known WHERE k = 8")
def q_fuzzy(spark, d):
    """Names that no earlier stage knows, by the surface that is most like them."""
    left = O.normalize(raw_names(spark, d), lexicon(spark, d), fuzzy=False).filter("stage = 'unmapped'")
    names = left.select("raw", N.stripped(N.cleaned(N.simplified(F.col("raw")))).alias("t"))
    return O.similar_names(names, lexicon(spark, d)).select("raw", F.array_join("drugs", "|").alias("drugs"), "score")


@query(f"WITH {SQL_RAW} SELECT status, stage, count(*) AS n, round(count(*) / (SELECT count(*) FROM part)::DOUBLE, 6) AS share FROM known GROUP BY ALL")
def q_coverage(spark, d):
    raw = raw_names(spark, d)
    times = raw.groupBy("raw").agg(F.count("*").alias("times"))
    return O.coverage(O.normalize(raw, lexicon(spark, d)).join(times, "raw"))


@query(f"WITH {SQL_RAW}, u AS (SELECT raw, count(*) AS n FROM known WHERE status = 'unmapped' GROUP BY raw) SELECT raw, n, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (ORDER BY n DESC, raw) AS place FROM u) WHERE place <= 25")
def q_top_unmapped(spark, d):
    raw = raw_names(spark, d)
    open_ = O.normalize(raw, lexicon(spark, d)).filter("status = 'unmapped'").select("raw")
    top = raw.join(open_, "raw").groupBy("raw").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "raw").limit(25)
    rows = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "raw"))).alias("x")).select(F.posexplode("x").alias("i", "r"))  # 25 rows
    return rows.select("r.raw", (-F.col("r.m")).alias("n"), (F.col("i") + 1).alias("place"))


@query(f"""WITH {SQL_RAW} SELECT setting, count(*) FILTER (CASE setting WHEN 'all' THEN status = 'mapped' WHEN 'no_abbreviations' THEN status = 'mapped' AND k NOT IN (3, 4)
  WHEN 'no_salts' THEN status = 'mapped' AND k <> 2 ELSE status = 'mapped' AND k <> 8 END) AS mapped, count(*) AS n FROM known, (VALUES ('all'), ('no_abbreviations'), ('no_salts'), ('no_fuzzy')) s(setting) GROUP BY setting""")
def q_ablation(spark, d):
    """One run for each setting of the cascade's switches, side by side."""
    raw, lex = raw_names(spark, d), lexicon(spark, d)
    out = None
    for setting, off in {"all": {}, "no_abbreviations": {"abbreviations": False}, "no_salts": {"salts": False}, "no_fuzzy": {"fuzzy": False}}.items():
        found = raw.join(O.normalize(raw, lex, **off).select("raw", "status"), "raw")
        one = found.agg(F.count_if(F.col("status") == "mapped").alias("mapped"), F.count("*").alias("n")).select(F.lit(setting).alias("setting"), "mapped", "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {SQL_RAW}, r AS (SELECT CASE WHEN l_linestatus <> 'O' THEN 'inactive' WHEN status = 'non_drug' THEN 'dropped' WHEN status <> 'mapped' THEN 'unchecked' ELSE 'checkable' END AS route_to FROM lineitem JOIN known ON p_partkey = l_partkey)
SELECT route_to, count(*) AS n FROM r GROUP BY ALL""")
def q_route_status(spark, d):
    raw = raw_names(spark, d)
    meds = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.when(F.col("l_linestatus") == "O", "active").otherwise("stopped").alias("status")).join(raw, "p_partkey")
    return O.routed(meds, O.normalize(raw, lexicon(spark, d))).groupBy("route_to").agg(F.count("*").alias("n"))


@query("SELECT p_type AS name, min_by(s, (length(s), s)) AS alias FROM (SELECT p_type, p_name AS s FROM part UNION SELECT p_type, p_type || ' ' || p_brand FROM part) WHERE NOT starts_with(s, p_type || ' ') GROUP BY p_type")
def q_shortest_alias(spark, d):
    p = table(spark, d, "part")
    names = p.select("p_type", F.explode(F.array("p_name", F.concat_ws(" ", "p_type", "p_brand"))).alias("surface")).distinct()
    # A way to write several names is no alias of any; here each is taken to mean its own type.
    lex = names.select("surface", F.array("p_type").alias("targets"))
    return O.display_alias(lex, names.select("surface").distinct())


@query("SELECT p_partkey, p_name AS cleaned FROM part")
def q_clean(spark, d):
    messy = F.concat(F.lit(" ("), "p_brand", F.lit(") "), F.upper("p_name"), F.lit(", 50 mg 1/2 [box] 2.5% -"))
    return table(spark, d, "part").select("p_partkey", N.cleaned(N.simplified(messy)).alias("cleaned"))


@query("SELECT p_partkey, p_name AS stripped FROM part")
def q_strip_words(spark, d):
    salted = F.concat_ws(" ", "p_name", F.lit("hcl sodium"), F.when(F.col("p_partkey") % 2 == 0, "er tablet").otherwise("q12h prn"))
    return table(spark, d, "part").select("p_partkey", N.stripped(salted).alias("stripped"))


@query()
def q_token_set(spark, d):
    """The three parts whose words are most like those of each part with a number divisible by 20, by token-set ratio.  SQL has no common subsequence: tests hold it against a plain search."""
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text"))
    return X.nearest_by_tokens(rows.filter("id % 20 = 0"), rows, 3).withColumn("score", F.round("score", 6))
