"""From mentions to medications: one row per medication of a note, with status, confidence, and what changed between its lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .notes import HELD, STOPPED

# Weights of the parts of a confidence and their scores, orders, and routes with the words that mean them.
WEIGHTS = {"detection": 0.4, "normalization": 0.4, "status": 0.2}
DETECTION = {"llm+other": 1.0, "llm": 0.85, "other_multi": 0.85, "other": 0.75}
IN_LIST, INFERRED, AMBIGUOUS = 1.0, 0.6, 0.5
STATUS_ORDER = ("active", "held", "stopped", "mentioned")
KIND_ORDER = ("omission", "dose", "new", "held", "unverified", "same", "absent")
LOCAL_ROUTES = (
    ("ophthalmic", r"(?i)\b(ophthalmic|ophth|eye|eyes|ou)\b"),
    ("otic", r"(?i)\b(otic|ear|ears)\b"),
    ("nasal", r"(?i)\b(nasal|intranasal|nostrils?|nares)\b"),
    ("topical", r"(?i)\b(topical|topically|tp|cream|ointment|lotion|apply|affected area|skin)\b"),
)
LOCAL_PATCHES = ("lidocaine", "diclofenac", "capsaicin", "menthol")


def detection_score(sources: Column) -> Column:
    """How sure a mention is by who found it."""
    any_of = lambda *names: F.arrays_overlap(sources, F.array(*map(F.lit, names)))
    llm, other = any_of("llm", "propagated"), F.array_intersect(sources, F.array(F.lit("scispacy"), F.lit("dictionary")))
    return F.when(llm & (F.size(other) > 0), DETECTION["llm+other"]).when(llm, DETECTION["llm"]).when(F.size(other) > 1, DETECTION["other_multi"]).otherwise(DETECTION["other"])


def group_key(drugs: Column, norm_status: Column, text: Column) -> Column:
    known = norm_status.isin("mapped", "ambiguous") & (F.size(drugs) > 0)
    return F.when(known, F.concat(F.lit("D:"), F.array_join(F.sort_array(drugs), "+"))).otherwise(F.concat(F.lit("T:"), F.btrim(F.regexp_replace(F.lower(text), r"\s+", " "))))


def status_of(has_discharge: Column, in_discharge: Column, words: Column, listed_held: Column, none_current: Column) -> Column:
    """active, held, stopped or mentioned.

    listed_held: whether every mention in the discharge list has a word for held; none_current: whether every mention is an allergy, negated or of the past.
    """
    held = F.arrays_overlap(words, F.array(*map(F.lit, HELD)))
    off = F.when(F.arrays_overlap(words, F.array(*map(F.lit, STOPPED))), "stopped").otherwise("held")
    listed = F.when(in_discharge & ~(held & listed_held), "active").when(held, off).otherwise("mentioned")
    unlisted = F.when(held, off).when(none_current, "mentioned").otherwise("active")
    return F.when(has_discharge, listed).otherwise(unlisted)


def medications(mentions: DataFrame, notes: DataFrame | None = None, of_first: tuple[str, ...] = (), **more: Column) -> DataFrame:
    """A row for each medication of a note, from one pass over its mentions.

    mentions has note_id, s, e, key, section, status, not_current, sources, n_attributes, norm_status, score; notes has note_id, has_discharge.  The mention that
    stands for all has the most attributes among those of the discharge list, else of the admission list, else of all; the first of equals.
    Without notes mentions has has_discharge.  Columns of_first are those of that mention, more are aggregates of all.
    """
    place = F.when(F.col("section") == "discharge", 0).when(F.col("section") == "admission", 1).otherwise(2)
    discharged = F.col("section").eqNullSafe("discharge")
    word = F.lower(F.coalesce("status", F.lit("")))
    rows = mentions.filter("norm_status <> 'non_drug'").groupBy("note_id", "key").agg(
        F.count("*").alias("n_mentions"), F.bool_or(F.col("section").eqNullSafe("admission")).alias("in_admission"), F.bool_or(discharged).alias("in_discharge"),
        F.min_by(F.struct(F.col("s").alias("representative"), *of_first), F.struct(place, -F.col("n_attributes"), F.col("s"))).alias("of_first"),
        F.sort_array(F.collect_set(F.when(word != "", word))).alias("words"), F.coalesce(F.bool_and(F.when(discharged, word.isin(*HELD))), F.lit(True)).alias("listed_held"),
        F.bool_and("not_current").alias("none_current"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"),
        F.min_by("norm_status", "s").alias("norm_status"), F.min_by("score", "s").alias("score"),
        *([F.bool_or("has_discharge").alias("has_discharge")] if notes is None else []), *(v.alias(k) for k, v in more.items()),
    )
    rows = rows.select("note_id", "key", "of_first.*", *(c for c in rows.columns if c not in ("note_id", "key", "of_first")))
    joined = rows if notes is None else rows.join(notes.select("note_id", "has_discharge"), "note_id")
    status = status_of(F.col("has_discharge"), F.col("in_discharge"), F.col("words"), F.col("listed_held"), F.col("none_current"))
    normal = F.when(F.col("norm_status") == "mapped", F.col("score")).when(F.col("norm_status") == "ambiguous", AMBIGUOUS).otherwise(0.0)
    known = F.when(F.col("has_discharge") & F.col("in_discharge"), IN_LIST).otherwise(INFERRED)
    confidence = WEIGHTS["detection"] * detection_score(F.col("sources")) + WEIGHTS["normalization"] * normal + WEIGHTS["status"] * known
    text_status = F.coalesce(*(F.when(F.array_contains("words", w), w) for w in ("stopped", "discontinued", "held", "changed", "started")), F.lit(""))
    return joined.withColumns({"status": status, "confidence": F.round(confidence, 3), "text_status": text_status})


def order_of(status: Column) -> Column:
    return F.coalesce(*(F.when(status == s, F.lit(k)) for k, s in enumerate(STATUS_ORDER)), F.lit(len(STATUS_ORDER)))


def sorted_medications(meds: DataFrame) -> DataFrame:
    """meds with place: by status, then by name in lower case, then by key."""
    return meds.withColumn("place", F.row_number().over(Window.partitionBy("note_id").orderBy(order_of(F.col("status")), F.lower("name"), "key")))


def unique_ids(rows: DataFrame, key: str, base: str, order: str) -> DataFrame:
    """rows with id: the base, and base_1, base_2 ... for those that repeat it in one list.

    A number that would give another row's base is passed over, so that ids stay different: those taken are looked up in the list's own bases.
    """
    w = Window.partitionBy(key, base).orderBy(order)
    bases = rows.groupBy(key).agg(F.collect_set(base).alias("bases"))
    numbered = rows.withColumn("again", F.row_number().over(w) - 1).join(bases, key)
    taken = F.filter(F.transform(F.sequence(F.lit(1), F.col("again") + F.size("bases")), lambda i: F.concat(F.col(base), F.lit("_"), i.cast("string"))), lambda c: ~F.array_contains("bases", c))
    return numbered.withColumn("id", F.when(F.col("again") == 0, F.col(base)).otherwise(F.get(taken, F.col("again") - 1))).drop("again", "bases")


def local_route(text: Column, names: Column) -> Column:
    """The local route that a medication's text, route and form speak of; patches are topical for a few drugs only."""
    by_word = F.coalesce(*(F.when(text.rlike(p), F.lit(r)) for r, p in LOCAL_ROUTES))
    patch = text.rlike(r"(?i)\bpatch") & F.arrays_overlap(names, F.array(*map(F.lit, LOCAL_PATCHES)))
    return F.coalesce(by_word, F.when(patch, "topical"))


def change_kind(in_admission: Column, in_discharge: Column, status: Column, before: Column, after: Column) -> Column:
    """What changed for a medication of either list: strengths are compared without white space, and only where both are stated."""
    plain = lambda v: F.regexp_replace(F.lower(v), r"\s+", "")
    both = F.when(before.isNull() | after.isNull() | (before == "") | (after == ""), "unverified").when(plain(before) != plain(after), "dose").otherwise("same")
    return F.when(in_admission & ~in_discharge, F.when(status.isin("held", "stopped"), "held").otherwise("omission")).when(in_discharge & ~in_admission, "new").when(in_admission & in_discharge, both)


def highlighted(text: Column, spans: Column) -> Column:
    """The text with its spans (array<struct<s, e>>) marked; a span that begins inside one before it is left out."""
    step = lambda acc, x: F.when(x["s"] >= acc["at"], F.struct(x["e"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.lit("<mark>"), F.substring(text, x["s"] + 1, x["e"] - x["s"]), F.lit("</mark>")).alias("out"))).otherwise(acc)
    return F.aggregate(F.array_sort(spans), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def difference(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows of either side whose value is missing on the other or differs: (keys, before, after)."""
    x, y = before.select(*keys, F.col(value).alias("before")), after.select(*keys, F.col(value).alias("after"))
    return x.join(y, keys, "full_outer").filter(~F.col("before").eqNullSafe(F.col("after")))
