"""Interaction check of whole sets of medication lists against a stored knowledge base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import pairs as P
from .shared import sized, written

GRADED_SOURCE, RULE_SOURCE = "graded", "rule"


def concepts_of(entries: DataFrame, concepts: DataFrame) -> DataFrame:
    """entries (..., name, route) with concept, concept_name, sources, home: the concept of a name given by a local route, if there is one, else that of the name."""
    base, variant = (sized(concepts.select(*(F.col(c).alias(f"{k}_{c}") for c in ("concept", "concept_name", "sources", "home")))) for k in ("base", "local"))
    local = F.concat(F.col("base_concept_name"), F.lit(" ("), F.lower("route"), F.lit(")"))
    found = entries.join(base, F.col("name") == F.col("base_concept_name")).join(variant, local == F.col("local_concept_name"), "left")
    pick = lambda c: F.when(F.col("local_concept").isNotNull(), F.col(f"local_{c}")).otherwise(F.col(f"base_{c}")).alias(c)
    return found.select(*entries.columns, *(pick(c) for c in ("concept", "concept_name", "sources", "home")))


def list_pairs(entries: DataFrame) -> DataFrame:
    """Pairs of different concepts of different medications of a list, each once, at the first place where it occurs; the smaller concept is a.

    entries has list_id, med, place, route, concept, concept_name, sources, home; place orders the entries of a list.
    """
    kinds = ("concept", "concept_name", "sources", "home", "med", "route", "place")
    x, y = (entries.select("list_id", *(F.col(c).alias(f"{k}_{c}") for c in kinds)) for k in "xy")
    both = x.join(y, "list_id").filter("x_place < y_place and x_med <> y_med and x_concept <> y_concept")
    swap = F.col("x_concept") > F.col("y_concept")
    side = lambda one, other: [F.when(swap, F.col(f"{other}_{c}")).otherwise(F.col(f"{one}_{c}")).alias(f"{'a' if one == 'x' else 'b'}_{c}") for c in kinds]
    rows = both.select("list_id", *side("x", "y"), *side("y", "x"), F.struct("x_place", "y_place").alias("first"))
    rest = [c for c in rows.columns if c not in ("list_id", "a_concept", "b_concept", "first")]
    return rows.groupBy("list_id", "a_concept", "b_concept").agg(F.min_by(F.struct(*rest), "first").alias("r")).select("list_id", "a_concept", "b_concept", "r.*")


def looked_up(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """pairs with status, severity, basis, level, mechanisms and record_sources.

    known has (a, b, level, mechanisms, record_sources): what the sources have of a pair.  A source that both cover and that has no record says that
    none is known, except the graded one for two concepts whose own classes it lacks.
    """
    joined = pairs.join(known, (F.col("a_concept") == F.col("a")) & (F.col("b_concept") == F.col("b")), "left").drop("a", "b")
    common = F.array_intersect("a_sources", "b_sources")
    homeless = (F.col("a_home") == "") & (F.col("b_home") == "")
    checked = F.when(homeless, F.array_remove(common, GRADED_SOURCE)).otherwise(common)
    record = F.col("record_sources").isNotNull()
    plain = F.col("level").isin("Major", "Moderate", "Minor")
    derived = F.get("mechanisms", F.lit(0))["severity"]
    status = F.when(record, "INTERACTION").when(F.size(checked) > 0, "NO_KNOWN_INTERACTION").otherwise("NOT_COVERED")
    severity = F.when(record, F.when(plain, F.col("level")).otherwise(F.coalesce(derived, F.lit("Unknown"))))
    basis = F.when(record, F.when(plain | derived.isNull(), GRADED_SOURCE).otherwise("derived"))
    return joined.withColumns({"status": status, "severity": severity, "basis": basis})


def with_rules(checked: DataFrame, members: DataFrame) -> DataFrame:
    """checked with rule_no; a rule that holds raises its pair to Major, and makes a pair without a record an interaction.

    members has (rule_no, side in 'A' and 'B', item by concept name); of several rules the first counts.
    """
    pairs = checked.select(F.col("a_concept_name").alias("a"), F.col("b_concept_name").alias("b")).distinct()
    matches = sized(P.rule_matches(pairs, sized(members)).select(F.col("a").alias("rule_a"), F.col("b").alias("rule_b"), "rule_no"))
    joined = checked.join(matches, (F.col("a_concept_name") == F.col("rule_a")) & (F.col("b_concept_name") == F.col("rule_b")), "left").drop("rule_a", "rule_b")
    rule, record = F.col("rule_no").isNotNull(), F.col("status") == "INTERACTION"
    raised = rule & ~(record & (F.col("severity") == "Major"))
    return joined.withColumns({
        "basis": F.when(raised, RULE_SOURCE).otherwise(F.col("basis")),
        "record_sources": F.when(rule & ~record, F.array(F.lit(RULE_SOURCE))).otherwise(F.col("record_sources")),
        "severity": F.when(rule, "Major").otherwise(F.col("severity")),
        "status": F.when(rule, "INTERACTION").otherwise(F.col("status")),
    })


def _systemic(pairs: DataFrame, concepts: DataFrame) -> DataFrame:
    """pairs with the concepts that their local ones stand beside, in order again; only those that differ and are two."""
    out = pairs
    for k in "ab":
        plain = sized(concepts.select(*(F.col(c).alias(f"s_{c}") for c in ("concept", "concept_name", "sources", "home"))))
        base = F.regexp_replace(F.col(f"{k}_concept_name"), r" \([^(]*\)$", "")
        moved = out.join(plain, (base == F.col("s_concept_name")) & (base != F.col(f"{k}_concept_name")), "left")
        new = {f"{k}_{c}": F.when(F.col("s_concept").isNotNull(), F.col(f"s_{c}")).otherwise(F.col(f"{k}_{c}")) for c in ("concept", "concept_name", "sources", "home")}
        out = moved.withColumn("moved", F.coalesce("moved", F.lit(False)) | F.col("s_concept").isNotNull() if "moved" in out.columns else F.col("s_concept").isNotNull()).withColumns(new).drop("s_concept", "s_concept_name", "s_sources", "s_home")
    out = out.filter("moved and a_concept <> b_concept").drop("moved")
    swap = F.col("a_concept") > F.col("b_concept")
    kinds = [c[2:] for c in out.columns if c.startswith("a_")]
    flipped = {f"{k}_{c}": F.when(swap, F.col(f"{o}_{c}")).otherwise(F.col(f"{k}_{c}")) for k, o in ("ab", "ba") for c in kinds}
    return out.withColumns(flipped)


def check(entries: DataFrame, concepts: DataFrame, known: DataFrame, members: DataFrame) -> DataFrame:
    """Every pair of every list with its status, severity, basis, sources, mechanisms and rule.

    entries has (list_id, med, place, name, route), one row per known name of an active medication.  Where no source covers a
    pair and one of the two is given by a local route, the concepts without the route are checked instead; a pair that the list has anyway is then
    reported once.
    """
    return check_concepts(concepts_of(entries, concepts), concepts, known, members)


def check_concepts(entries: DataFrame, concepts: DataFrame, known: DataFrame, members: DataFrame) -> DataFrame:
    """check() for entries whose concepts are known already, see concepts_of()."""
    pairs = written(list_pairs(entries))
    kinds = pairs.columns
    first = with_rules(looked_up(pairs, known), members)
    local = (F.col("status") == "NOT_COVERED") & (F.col("a_route").isNotNull() | F.col("b_route").isNotNull())
    first = written(first.withColumn("again", local))
    again = with_rules(looked_up(_systemic(first.filter("again").select(*kinds, F.col("a_concept").alias("was_a"), F.col("b_concept").alias("was_b")), concepts), known), members)
    replaced = again.select("list_id", F.col("was_a").alias("a_concept"), F.col("was_b").alias("b_concept"))
    kept = first.drop("again").join(replaced, ["list_id", "a_concept", "b_concept"], "left_anti")
    both = kept.withColumn("fallback", F.lit(False)).unionByName(again.drop("was_a", "was_b").withColumn("fallback", F.lit(True)))
    rest = [c for c in both.columns if c not in ("list_id", "a_concept", "b_concept")]
    once = both.groupBy("list_id", "a_concept", "b_concept").agg(F.min_by(F.struct(*rest), F.struct("fallback", "a_place", "b_place")).alias("r"))
    return once.select("list_id", "a_concept", "b_concept", "r.*")


def mechanisms(templates: DataFrame, severities: DataFrame) -> DataFrame:
    """(a, b, mechanisms): the templates (a, b, template, text) of each pair with what is known of them, the most severe first, then by template and text."""
    rows = templates.join(sized(severities), "template")
    item = F.struct(P.rank(F.col("derived_severity")).alias("rank"), "template", "text", F.col("derived_severity").alias("severity"), "n_graded", "share_major")
    return rows.groupBy("a", "b").agg(F.sort_array(F.collect_set(item)).alias("mechanisms"))


def explanation(a: Column, b: Column, rule: Column, level: Column, found: Column, basis: Column, severity: Column, risk: Column) -> Column:
    """Lines that say why a pair is reported; lines without a reason are left out."""
    top = F.get(found, F.lit(0))
    lines = F.array(
        F.concat(a, F.lit(" with "), b),
        F.when(rule.isNotNull(), F.concat(F.lit("Rule "), rule.cast("string"))),
        F.when(level.isNotNull(), F.concat(F.lit("Graded "), level)),
    )
    texts = F.transform(F.slice(F.coalesce(found, F.array()), 1, 3), lambda m: F.concat(F.lit("Template "), m["text"]))
    derived = F.when(basis == "derived", F.format_string("Severity %s is derived: %d of 100 of %d graded pairs are Major", severity, F.round(100 * top["share_major"]).cast("int"), top["n_graded"]))
    return F.filter(F.concat(lines, texts, F.array(derived, F.concat(F.lit("Risk "), F.format_number(risk, 2)))), lambda x: x.isNotNull())
