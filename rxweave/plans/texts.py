"""Queries: names, notes, spans and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import strings as S
from ..operators import text as T
from ..operators.shared import written
from ..sources.tables import table
from .registry import query

SQL_NORM = "trim(regexp_replace(lower({}), '[ \\t\\n\\r\\f]+', ' ', 'g'))"


@query(f"SELECT p_partkey, {SQL_NORM.format('p_name')} AS name FROM part")
def q_norm(spark, d):
    return table(spark, d, "part").select("p_partkey", S.norm(F.col("p_name")).alias("name"))


@query("SELECT a.p_partkey, trim(x) AS piece FROM part a, unnest(string_split(a.p_name || ' / ' || a.p_type || '+' || a.p_brand, '/')) AS s(y), unnest(string_split(y, '+')) AS t(z), unnest(string_split(z, '-')) AS u(x) WHERE trim(x) <> ''")
def q_combination(spark, d):
    name = F.concat("p_name", F.lit(" / "), "p_type", F.lit("+"), "p_brand")
    return table(spark, d, "part").select("p_partkey", F.explode(S.combination(name)).alias("piece"))


@query("SELECT c_custkey, 'Seen by {a} and {b}.' AS template FROM customer")
def q_template(spark, d):
    c = table(spark, d, "customer").withColumn("b", F.concat(F.lit("Dr "), "c_name"))
    text = F.concat(F.lit("Seen by "), "c_name", F.lit(" and "), "b", F.lit("."))
    return c.select("c_custkey", S.template(text, F.col("c_name"), F.col("b")).alias("template"))


@query("SELECT doc_id, len(string_split(text, chr(10))) AS n_lines, length(text) AS n_chars FROM documents WHERE text IS NOT NULL")
def q_note_stats(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"), F.length("text").cast("long").alias("n_chars"))


SQL_LINES = """parts AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, line_no, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM parts)"""


def note_lines(spark, d):
    return T.lines(table(spark, d, "documents").filter("text is not null").select("doc_id", "text"), "doc_id")


@query(f"WITH {SQL_LINES} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(start AS BIGINT) AS start, md5(line) AS line FROM lines")
def q_line_offsets(spark, d):
    return note_lines(spark, d).select("doc_id", "line_no", "start", F.md5(F.col("line").cast("binary")).alias("line"))


SQL_SPANS = "a AS (SELECT l_orderkey AS k, l_linenumber AS i, CAST(l_quantity AS INTEGER) AS s, CAST(l_quantity AS INTEGER) + l_linenumber * 2 AS e FROM lineitem)"


def spans(spark, d, suffix=""):
    q = F.col("l_quantity").cast("int")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias(f"i{suffix}"), q.alias(f"s{suffix}"), (q + F.col("l_linenumber") * 2).alias(f"e{suffix}"))


@query(f"WITH {SQL_SPANS} SELECT x.k, x.i, y.i AS i2 FROM a x JOIN a y ON x.k = y.k AND x.i < y.i AND x.s < y.e AND y.s < x.e")
def q_overlap_join(spark, d):
    return T.overlaps(spans(spark, d), spans(spark, d, "2"), "k").filter("i < i2").select("k", "i", "i2")


@query(f"WITH {SQL_SPANS} SELECT k, i, s - coalesce(lag(e) OVER w, 0) AS gap_before, lead(s) OVER w AS next_start FROM a WINDOW w AS (PARTITION BY k ORDER BY s, i)")
def q_neighbour_window(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("k").orderBy("s", "i")
    return spans(spark, d).select("k", "i", (F.col("s") - F.coalesce(F.lag("e").over(w), F.lit(0))).alias("gap_before"), F.lead("s").over(w).alias("next_start"))


@query(f"WITH {SQL_LINES} SELECT doc_id, CAST(line_no // 8 AS BIGINT) AS snippet, count(*) AS n, md5(string_agg(line, chr(10) ORDER BY line_no)) AS digest FROM lines GROUP BY ALL")
def q_line_snippets(spark, d):
    """Groups of eight lines, cut in the row."""
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", F.split("text", "\n", -1).alias("x"))
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size("x") - 1) / 8)), lambda i: F.slice("x", (i * 8 + 1).cast("int"), 8))
    return docs.select("doc_id", F.posexplode(groups).alias("snippet", "g")).select("doc_id", F.col("snippet").cast("long"), F.size("g").cast("long").alias("n"), F.md5(F.array_join("g", "\n").cast("binary")).alias("digest"))


# Fixed value: what makes a line look like an item of a list.
LISTY = r"(?i)^\s*(\d{1,2}[.)]|[-*•])\s|\b\d+(\.\d+)?\s?(mg|mcg|g|units?|ml|meq)\b|\bsig:|\b(q\d+h|bid|tid|qid|qhs|prn|daily)\b|^[A-Za-z ]{2,30}:\s*\S"
SQL_LISTY = LISTY.replace("'", "''")


@query(f"WITH {SQL_LINES}, s AS (SELECT doc_id, round(coalesce(avg(regexp_matches(line, '{SQL_LISTY}')::INT) FILTER (regexp_matches(line, '[^\\s]')), 1.0), 6) AS score FROM lines GROUP BY doc_id) SELECT doc_id, score, score >= 0.5 AS is_list FROM s")
def q_list_score(spark, d):
    """How much of a text looks like a list, and whether it is one: such chunks go past the language model."""
    docs = table(spark, d, "documents").filter("text is not null")
    full = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\s]"))
    hits = F.size(F.filter(full, lambda x: x.rlike(LISTY)))
    score = F.round(F.coalesce(F.try_divide(hits.cast("double"), F.size(full)), F.lit(1.0)), 6)
    return docs.select("doc_id", score.alias("score")).withColumn("is_list", F.col("score") >= 0.5)


@query("SELECT doc_id, len(t) AS n_tokens, len(list_distinct(list_transform(t, lambda x: lower(x)))) AS n_kinds FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS t FROM documents) WHERE len(t) > 0")
def q_tokens(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)).alias("t")).filter(F.size("t") > 0)
    return docs.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct(F.transform("t", lambda x: F.lower(x)))).cast("long").alias("n_kinds"))


@query("""WITH p AS (SELECT doc_id, ' ' || lower(text) || ' ' AS t FROM documents WHERE text IS NOT NULL), x AS (SELECT doc_id, t, regexp_extract(t, '[^a-z0-9]and\\s+the[^a-z0-9]') AS hit, regexp_replace(t, '([^a-z0-9])', '\\1\\1', 'g') AS wide FROM p)
SELECT doc_id, CAST(len(regexp_split_to_array(wide, '[^a-z0-9]and\\s+the[^a-z0-9]')) - 1 AS BIGINT) AS n, CASE WHEN hit <> '' THEN CAST(strpos(t, hit) AS BIGINT) - 1 END AS first_at FROM x""")
def q_find_all(spark, d):
    """Places of a value, whatever white space its words have between them, with no letter or digit beside it."""
    docs = table(spark, d, "documents").filter("text is not null").withColumn("at", S.spans_of(F.col("text"), S.pattern_of(F.lit("and the"))))
    return docs.select("doc_id", F.size("at").cast("long").alias("n"), F.get("at", F.lit(0))["s"].cast("long").alias("first_at"))


SQL_TFIDF = f"""{SQL_LINES}, sn AS MATERIALIZED (SELECT doc_id, line_no // 8 AS snippet, lower(string_agg(line, chr(10) ORDER BY line_no)) AS text FROM lines GROUP BY ALL),
w AS MATERIALIZED (SELECT doc_id, snippet, regexp_extract_all(text, '[a-zà-ÿ0-9_]{{2,}}') AS ws FROM sn),
t AS (SELECT doc_id, snippet, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS term FROM w),
c AS MATERIALIZED (SELECT doc_id, snippet, term, count(*) AS tf FROM t GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM c GROUP BY term HAVING count(*) >= 2),
x AS (SELECT doc_id, snippet, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM sn)) / (1 + df)::DOUBLE) + 1) AS w FROM c JOIN df USING (term)),
n AS MATERIALIZED (SELECT doc_id, snippet, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id, snippet)) AS weight FROM x)"""


@query(f"""WITH {SQL_TFIDF}, s AS (SELECT q.doc_id AS q_doc_id, q.snippet AS q_snippet, n.doc_id, n.snippet, sum(q.weight * n.weight) AS score FROM n q JOIN n USING (term) WHERE q.doc_id % 20 = 0 AND (q.doc_id <> n.doc_id OR q.snippet <> n.snippet) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY q_doc_id, q_snippet ORDER BY round(score, 9) DESC, doc_id, snippet) AS place FROM s WHERE score > 0) SELECT q_doc_id, q_snippet, CAST(place AS INTEGER) AS place, round(score, 5) AS score FROM r WHERE place <= 3""")
def q_tfidf_topk(spark, d):
    """The three snippets most like each one of the documents whose number is divisible by 20, among those of all documents."""
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", F.split("text", "\n", -1).alias("x"))
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size("x") - 1) / 8)), lambda i: F.array_join(F.slice("x", (i * 8 + 1).cast("int"), 8), "\n"))
    snippets = docs.select("doc_id", F.posexplode(groups).alias("snippet", "text")).withColumn("snippet", F.col("snippet").cast("long"))
    rows = T.vectors(snippets, ["doc_id", "snippet"], "text")
    return T.top_similar(rows, rows.filter("doc_id % 20 = 0"), ["doc_id", "snippet"], 3).select("q_doc_id", "q_snippet", "place", F.round("score", 5).alias("score"))
