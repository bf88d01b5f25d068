"""Queries: tables read from files as others write them, after a round trip through such files, and caches of extracted text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import strings as S
from ..operators.shared import new_folder
from ..sources import files as I
from ..sources import tables as R
from ..sources.tables import table
from .registry import query


@query("SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS p FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'F'")
def q_partition_filter(spark, d):
    """A layout by setting and fold; only the folder asked for is read."""
    folder = new_folder(spark, "splits")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_returnflag").alias("setting"), F.col("l_linestatus").alias("fold"))
    rows.write.partitionBy("setting", "fold").option("header", True).csv(folder)
    return R.split_files(spark, folder, "o long, n int, p long", setting="A", fold="F")


@query("SELECT 's' || least(l_partkey, l_suppkey) AS a, 's' || greatest(l_partkey, l_suppkey) AS b, l_returnflag AS code, count(*) AS n FROM lineitem GROUP BY ALL")
def q_scan_multifile(spark, d):
    """All files of a class each: the class comes from the path, ids are put in order with their names."""
    folder = new_folder(spark, "graded")
    side = lambda c: [F.lpad(F.col(c).cast("string"), 12, "0"), F.concat(F.lit("s"), F.col(c).cast("string"))]
    rows = table(spark, d, "lineitem").select(*side("l_partkey"), *side("l_suppkey"), F.lit("Major"), F.col("l_returnflag").alias("code"))
    rows.toDF("id_a", "drug_a", "id_b", "drug_b", "level", "code").write.partitionBy("code").option("header", True).csv(folder)
    return R.graded_files(spark, f"{folder}/*/*.csv", r"code=([A-Z])/").groupBy(F.col("drug_a").alias("a"), F.col("drug_b").alias("b"), "code").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey AS o, CASE WHEN l_returnflag = 'A' THEN 'generic ' || l_partkey ELSE 'name ' || l_partkey END AS name, CAST(l_shipdate AS VARCHAR)[:10] AS day, count(*) AS n FROM lineitem GROUP BY ALL")
def q_coalesce_trim(spark, d):
    """Typed rows from CSV: dates parsed, the generic name or else the name, trimmed."""
    folder, rows = new_folder(spark, "prescriptions"), table(spark, d, "lineitem")
    key = F.col("l_partkey").cast("string")
    rows.select(
        F.lit(1).alias("subject_id"), F.col("l_orderkey").alias("hadm_id"), F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("startdate"), F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("enddate"),
        F.concat(F.lit(" name "), key).alias("drug"), F.when(F.col("l_returnflag") == "A", F.concat(F.lit("generic "), key, F.lit(" "))).alias("drug_name_generic"), F.lit("PO").alias("route"),
    ).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder)
    return R.prescriptions(spark, folder).groupBy(F.col("hadm_id").cast("long").alias("o"), "name", F.date_format("startdate", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, string_agg(x, '|' ORDER BY i) AS names FROM (SELECT p_partkey, i, ([lower(p_name), lower(p_type), lower(p_brand)])[i] AS x FROM part, range(1, 4) r(i)) GROUP BY p_partkey")
def q_split_list(spark, d):
    aliases = F.concat(F.lit(" "), "p_type", F.lit("|"), F.upper("p_brand"))
    return table(spark, d, "part").select("p_partkey", F.array_join(S.alias_list(F.upper("p_name"), aliases), "|").alias("names"))


@query("SELECT doc_id, md5(text) AS digest FROM documents WHERE text IS NOT NULL")
def q_decode(spark, d):
    """Whole texts, uploaded in UTF-8 with a byte order mark, in Latin-1 where that has all of their characters, or in UTF-8 without a mark."""
    docs = table(spark, d, "documents").filter("text is not null")
    plain = F.encode("text", "UTF-8")
    content = F.when(F.col("lang") == "en", F.concat(F.unhex(F.lit("EFBBBF")), plain)).when(F.col("text").rlike(r"^[\x{00}-\x{FF}]*$"), F.encode("text", "ISO-8859-1")).otherwise(plain)
    return docs.select("doc_id", F.md5(R.decoded(content).cast("binary")).alias("digest"))


@query("""WITH x AS (SELECT page_id, lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) AS ext, coalesce(length(html), 0) AS n FROM pages)
SELECT page_id, CASE WHEN n > 20000 THEN 'too large' WHEN ext NOT IN ('txt', 'docx', 'pdf') THEN 'unsupported' ELSE '' END AS error FROM x""")
def q_dispatch(spark, d):
    """What an upload of each page under its address would meet: a limit on size, then its extension."""
    pages = table(spark, d, "pages")
    error = I.upload_error(F.col("url"), F.coalesce(F.length("html"), F.lit(0)), most=20_000)
    return pages.select("page_id", F.coalesce(error, F.lit("")).alias("error"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN round(o_totalprice, 2) WHEN 'F' THEN round(o_totalprice, 2) ELSE 0 END::DOUBLE AS f1 FROM orders")
def q_nested_coalesce(spark, d):
    price = lambda x: F.round(x, 2).cast("string")
    content = F.when(F.col("o_orderstatus") == "O", F.concat(F.lit('{"strict": {"micro": {"f1": '), price(F.col("o_totalprice")), F.lit("}}}")))
    content = content.when(F.col("o_orderstatus") == "F", F.concat(F.lit('{"results": {"f1": '), price(F.col("o_totalprice")), F.lit("}}"))).otherwise("{}")
    x = F.from_json(content, "strict struct<micro: struct<f1: double>>, results struct<f1: double>")
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(x["strict"]["micro"]["f1"], x["results"]["f1"], F.lit(0.0)).alias("f1"))


SQL_ANN = "x AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY p) AS i FROM (SELECT l_orderkey AS o, l_partkey AS p, max(CAST(l_quantity AS INTEGER)) AS q FROM lineitem GROUP BY ALL))"


def annotations(spark, d) -> DataFrame:
    """(note_id, ann): a drug and a strength for each part of an order, in pieces where the quantity is even, and a relation of the two."""
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("note_id"), F.col("l_partkey").alias("p")).agg(F.max(F.col("l_quantity").cast("int")).alias("q"))
    held = rows.groupBy("note_id").agg(F.array_sort(F.collect_list(F.struct("p", "q"))).alias("x"))
    text = lambda c: c.cast("string")

    def lines(r, i):
        drug, strength, b = text(2 * i + 1), text(2 * i + 2), r["q"] * 10
        span = F.when(r["q"] % 2 == 0, F.concat(text(b), F.lit(" "), text(b + 3), F.lit(";"), text(b + 5), F.lit(" "), text(b + 9))).otherwise(F.concat(text(b), F.lit(" "), text(b + 9)))
        return F.concat(
            F.lit("T"), drug, F.lit("\tDrug "), span, F.lit("\tdrug"), text(r["p"]), F.when(r["q"] % 3 == 0, "\nmore\n").otherwise("\n"), F.lit("#1\tnote\n"),
            F.lit("T"), strength, F.lit("\tStrength "), text(b + 10), F.lit(" "), text(b + 12), F.lit("\t"), text(r["q"]), F.lit("\nR"), text(i + 1), F.lit("\tStrength-Drug Arg1:T"), strength, F.lit(" Arg2:T"), drug, F.lit("\n"),
        )

    return held.select("note_id", F.array_join(F.transform("x", lines), "").alias("ann"))


@query(f"WITH {SQL_ANN} SELECT o AS note_id, 'T' || (2 * i - 1) AS id, 'Drug' AS type, q * 10 AS start, q * 10 + 9 AS \"end\", 'drug' || p || CASE WHEN q % 3 = 0 THEN chr(10) || 'more' ELSE '' END AS text FROM x UNION ALL SELECT o, 'T' || (2 * i), 'Strength', q * 10 + 10, q * 10 + 12, q::VARCHAR FROM x")
def q_parse_lines(spark, d):
    return R.standoff(annotations(spark, d))[0].drop("spans")


@query(f"WITH {SQL_ANN} SELECT o AS note_id, 'drug' || p || CASE WHEN q % 3 = 0 THEN chr(10) || 'more' ELSE '' END AS drug, 'Strength' AS type, q::VARCHAR AS value FROM x")
def q_attr_of(spark, d):
    """Attributes of drugs, over relations."""
    entities, relations = R.standoff(annotations(spark, d))
    side = lambda name, value: entities.select("note_id", F.col("id").alias(name), F.col("type").alias(f"{name}_type"), F.col("text").alias(value))
    both = relations.select("note_id", "arg1", "arg2").join(side("arg1", "value"), ["note_id", "arg1"]).join(side("arg2", "drug"), ["note_id", "arg2"])
    return both.filter("arg1_type <> 'Drug'").select("note_id", "drug", F.col("arg1_type").alias("type"), "value")


def cache_key(text, model: str = "model", version: str = "v1"):
    return F.substring(F.sha2(F.concat_ws("|", F.lit(model), F.lit(version), text).cast("binary"), 256), 1, 24)


SQL_CACHE = "k AS (SELECT conv_id, turn, role, substr(sha256('model|v1|' || text), 1, 24) AS key FROM conversations), c AS (SELECT DISTINCT key FROM k WHERE role = 'assistant')"


@query(f"WITH {SQL_CACHE} SELECT conv_id, turn, key FROM k WHERE key NOT IN (SELECT key FROM c)")
def q_cache_miss(spark, d):
    """Texts whose output no earlier run has; the answers of all conversations stand for the cache."""
    rows = table(spark, d, "conversations").withColumn("key", cache_key(F.col("text")))
    return rows.join(rows.filter("role = 'assistant'").select("key").distinct(), "key", "left_anti").select("conv_id", "turn", "key")


@query(f"WITH {SQL_CACHE} SELECT conv_id, bool_and(key IN (SELECT key FROM c)) AS all_cached FROM k GROUP BY conv_id")
def q_all_cached(spark, d):
    rows = table(spark, d, "conversations").withColumn("key", cache_key(F.col("text")))
    cache = rows.filter("role = 'assistant'").select("key").distinct().withColumn("hit", F.lit(True))
    return rows.join(cache, "key", "left").groupBy("conv_id").agg(F.bool_and(F.coalesce("hit", F.lit(False))).alias("all_cached"))


@query("SELECT role, substr(sha256('prompt of ' || role || '|0|4096'), 1, 12) AS signature, count(DISTINCT conv_id) AS n FROM conversations GROUP BY role")
def q_signature(spark, d):
    """What outputs depend on besides the text; a cache whose rows have more than one signature is stale."""
    sign = F.substring(F.sha2(F.concat(F.lit("prompt of "), "role", F.lit("|0|4096")).cast("binary"), 256), 1, 12)
    rows = table(spark, d, "conversations").withColumn("signature", sign)
    return rows.groupBy("role").agg(F.min("signature").alias("signature"), F.max("signature").alias("other"), F.count_distinct("conv_id").alias("n")).filter("signature = other").drop("other")
