"""Pair knowledge base and interaction check, over sets of lists at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Weights and thresholds of the risk model.
SEVERITY_RANK = {"Major": 0, "Moderate": 1, "Minor": 2, "Unknown": 3}
SEVERITY_WEIGHT = {"Major": 1.0, "Moderate": 0.6, "Minor": 0.3, "Unknown": 0.25}
DERIVED_FACTOR, ONE_SOURCE, CRITICAL, REVIEW = 0.8, 0.85, 0.7, 0.5
LEAST_GRADED, MAJORITY, FEW_MAJOR = 10, 0.5, 0.75


def rank(severity: Column) -> Column:
    return F.coalesce(*(F.when(severity == k, F.lit(v)) for k, v in SEVERITY_RANK.items()), F.lit(3))


def ordered_pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def canonical_pairs(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct unordered pairs, without pairs of a thing with itself."""
    return rows.filter(F.col(a) != F.col(b)).select(*ordered_pair(a, b)).distinct()


def pairs_in_lists(lists: DataFrame, key: str, item: str) -> DataFrame:
    """Every unordered pair of different items of a list, once: (key, a, b).  Work grows with the square of a list, not of the table."""
    items = lists.select(key, item).distinct()
    return items.withColumnRenamed(item, "a").join(items.withColumnRenamed(item, "b"), key).filter("a < b")


def most_severe(graded: DataFrame) -> DataFrame:
    """The most severe level of each pair (a, b, severity)."""
    return graded.groupBy("a", "b").agg(F.min_by("severity", rank(F.col("severity"))).alias("severity"))


def preferred_roots(components: DataFrame, names: DataFrame) -> DataFrame:
    """(node, root): the node of each component that is preferred, then has the shortest name, then the first one.  names has (node, name, preferred)."""
    named = components.withColumnRenamed("root", "part").join(names, "node")
    best = named.groupBy("part").agg(F.min_by("node", F.struct(~F.col("preferred"), F.length("name"), F.col("name"))).alias("root"))
    return named.join(best, "part").select("node", "root")


def template_severity(templates: DataFrame, graded: DataFrame) -> DataFrame:
    """A severity for each template from the graded pairs that carry it.

    With LEAST_GRADED graded pairs or more, Major, Moderate and Minor are tried in turn for a share of MAJORITY; with fewer,
    Major needs FEW_MAJOR of at least three; Moderate else.
    """
    both = templates.join(graded.filter("severity <> 'Unknown'"), ["a", "b"], "left")
    share = lambda level: F.coalesce(F.try_divide(F.count_if(F.col("severity") == level).cast("double"), F.count("severity")), F.lit(0.0))
    counted = both.groupBy("template").agg(F.count("*").alias("n_pairs"), F.count("severity").alias("n_graded"), *(share(k).alias(k) for k in ("Major", "Moderate", "Minor")))
    enough = F.col("n_graded") >= LEAST_GRADED
    level = (
        F.when(enough & (F.col("Major") >= MAJORITY), "Major").when(enough & (F.col("Minor") >= MAJORITY), "Minor").when(enough, "Moderate")
        .when((F.col("n_graded") >= 3) & (F.col("Major") >= FEW_MAJOR), "Major").otherwise("Moderate")
    )
    return counted.select("template", level.alias("derived_severity"), "n_pairs", "n_graded", F.round("Major", 6).alias("share_major"))


def pair_status(pairs: DataFrame, known: DataFrame, covered: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with severity and status: INTERACTION with a record, NO_KNOWN_INTERACTION if a source knows both, NOT_COVERED else.

    known has (a, b, severity); covered (item, sources as array).
    """
    x, y = covered.select(F.col("item").alias("a"), F.col("sources").alias("sa")), covered.select(F.col("item").alias("b"), F.col("sources").alias("sb"))
    joined = pairs.join(known, ["a", "b"], "left").join(x, "a", "left").join(y, "b", "left")
    common = F.size(F.array_intersect(F.coalesce("sa", F.array()), F.coalesce("sb", F.array()))) > 0
    status = F.when(F.col("severity").isNotNull(), "INTERACTION").when(common, "NO_KNOWN_INTERACTION").otherwise("NOT_COVERED")
    return joined.withColumn("status", status).drop("sa", "sb")


def rule_matches(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The first rule that holds for each pair (a, b), in either order.  members has (rule_no, side in 'A' and 'B', item)."""
    side = lambda s, name: members.filter(F.col("side") == s).select("rule_no", F.col("item").alias(name))
    one = pairs.join(side("A", "a"), "a").join(side("B", "b"), ["b", "rule_no"])
    other = pairs.join(side("B", "a"), "a").join(side("A", "b"), ["b", "rule_no"])
    return one.unionByName(other).groupBy("a", "b").agg(F.min("rule_no").alias("rule_no"))


def risk(severity: Column, derived: Column, sources: Column, confidence: Column) -> Column:
    weight = F.coalesce(*(F.when(severity == k, F.lit(v)) for k, v in SEVERITY_WEIGHT.items()))
    return F.round(weight * F.when(derived, DERIVED_FACTOR).otherwise(1.0) * F.when(sources >= 2, 1.0).otherwise(ONE_SOURCE) * confidence, 3)


def tier(risk: Column, severity: Column) -> Column:
    """critical, review or info; a Major pair is review at least."""
    by_risk = F.when(risk >= CRITICAL, "critical").when(risk >= REVIEW, "review").otherwise("info")
    return F.when((by_risk == "info") & (severity == "Major"), "review").otherwise(by_risk)


def duplicates(items: DataFrame, key: str, concept: str, item: str) -> DataFrame:
    """Concepts that several items of one list share."""
    return items.groupBy(key, concept).agg(F.count_distinct(item).alias("n_items"), F.array_join(F.sort_array(F.collect_set(F.col(item).cast("string"))), "|").alias("items")).filter("n_items > 1")


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], strength: str) -> DataFrame:
    """Differences of two lists: omission, new, change of strength, same; unknown strengths are never a change."""
    l, r = left.withColumnRenamed(strength, "before"), right.withColumnRenamed(strength, "after")
    both = l.withColumn("in_left", F.lit(True)).join(r.withColumn("in_right", F.lit(True)), keys, "full_outer")
    kind = (
        F.when(F.col("in_right").isNull(), "omission").when(F.col("in_left").isNull(), "new")
        .when(F.col("before") != F.col("after"), "change").otherwise("same")
    )
    weight = F.when(kind == "omission", 0.5).when(kind == "change", 0.4).when(kind == "new", 0.1).otherwise(0.0)
    return both.select(*keys, "before", "after", kind.alias("kind"), weight.alias("risk"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b), root the smallest node that it reaches.

    Large-star and small-star steps in turn: each node links its neighbours to the smallest one around it.  The number of
    rounds grows with the logarithm of the longest path, minima are aggregated before they are shuffled, and no node's links are gathered.
    """
    now = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    mark = _mark(now)
    while True:
        now = written(_star(_star(now, True), False))
        before, mark = mark, _mark(now)
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links have a > b.  A node's larger neighbours (large) or its smaller ones and itself go to the smallest around it."""
    one = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = one.union(links.select("b", "a")) if large else one
    lowest = both.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low"))
    joined = both.join(lowest, "u")
    out = (joined.filter("v > u") if large else joined).select(F.col("v").alias("a"), F.col("low").alias("b"))
    return (out if large else out.union(lowest.select("u", "low"))).filter("a <> b").distinct()


def _mark(links: DataFrame) -> tuple:
    h = F.xxhash64("a", "b")
    return tuple(links.agg(F.count("*"), F.sum(h.bitwiseAND(F.lit((1 << 31) - 1))), F.sum(F.shiftrightunsigned(h, 33))).first())


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest row of each key; pre-aggregated before it is shuffled, so keys may be hot."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("row")).select(*keys, "row.*")
