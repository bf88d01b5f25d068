"""Whole reports: medications of a note, the check of its active ones, differences of its lists, counts and a hash, in one row for each note.

Lists are short, so all of a note's medications and pairs meet in one row, by shuffles on the note's id only, and findings are arrays made by built-in functions.
A corrected list goes the same way; only notes whose list was corrected are computed again, see again().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import checker as C
from . import fusion as U
from . import pairs as P
from .shared import sized, written

# Risks of findings that no severity decides, how many uncovered pairs are spelled out, the order of tiers.
DUPLICATE_RISK, OMITTED, EXPLAINED, ADDED, CHANGED = 0.6, 0.5, 0.2, 0.1, 0.4
NAMED_PAIRS = 20
TIERS = ("critical", "review", "info")
FINDING = "id string, type string, tier string, risk double, title string, meds array<string>, explanation array<string>, evidence string, verify boolean"
#: What a medication is in a report.
MEDICATION = ("id", "name", "raw", "names", "norm_status", "status", "text_status", "confidence", "in_admission", "in_discharge", "before", "after", "route")


def _finding(id: Column, kind: str, tier, risk, title: Column, meds: Column, explanation: Column, evidence: Column, verify=False) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    values = (id, F.lit(kind), lit(tier), lit(risk).cast("double"), title, meds, explanation, evidence, lit(verify))
    return F.struct(*(v.alias(c.split(" ")[0]) for v, c in zip(values, FINDING.split(", "), strict=True)))


def _quoted(text: Column) -> Column:
    return F.concat(F.lit("'"), text, F.lit("'"))


def _interaction(p: Column) -> Column:
    a, b = (F.element_at("by_id", p[f"{k}_med"]) for k in "ab")
    confidence = F.least(a["confidence"], b["confidence"])
    risk = P.risk(p["severity"], p["basis"] == "derived", F.size(p["record_sources"]), confidence)
    by_risk = P.tier(risk, F.lit(""))
    verify = (p["severity"] == "Major") & (by_risk != "critical")
    said = lambda m, k: F.concat(_quoted(m["raw"]), F.lit(" as "), p[f"{k}_concept_name"])
    lines = C.explanation(said(a, "a"), said(b, "b"), p["rule_no"], p["level"], p["mechanisms"], p["basis"], p["severity"], risk)
    lines = F.concat(lines, F.when(verify, F.array(F.lit("Possibly Major, but found with lower confidence: verify both medications."))).otherwise(F.array().cast("array<string>")))
    evidence = F.to_json(F.struct(*(p[c].alias(c) for c in ("severity", "basis", "level", "rule_no", "record_sources", "mechanisms"))))
    title = F.concat(p["severity"], F.lit(" interaction: "), p["a_concept_name"], F.lit(" + "), p["b_concept_name"])
    id = F.concat(F.lit("INT:"), p["a_concept"].cast("string"), F.lit("|"), p["b_concept"].cast("string"))
    return _finding(id, "INTERACTION", F.when(verify, "review").otherwise(by_risk), risk, title, F.array(a["id"], b["id"]), lines, evidence, verify)


def _duplicate(d: Column) -> Column:
    meds = F.transform(d["meds"], lambda m: F.element_at("by_id", m))
    risk = F.round(DUPLICATE_RISK * F.array_min(F.transform(meds, lambda m: m["confidence"])), 3)
    line = F.concat(d["concept_name"], F.lit(" is contained in: "), F.array_join(F.transform(meds, lambda m: _quoted(m["raw"])), ", "))
    id = F.concat(F.lit("DUP:"), d["concept"].cast("string"))
    return _finding(id, "DUPLICATE_THERAPY", "review", risk, F.concat(F.lit("Duplicate therapy: "), d["concept_name"]), d["meds"], F.array(line), F.to_json(F.struct(d["concept"].alias("concept"))))


def _change(m: Column) -> Column:
    """What the lists say of a medication, or null."""
    kind = U.change_kind(m["in_admission"], m["in_discharge"], F.lit(""), m["before"], m["after"])
    explained = m["status"].isin("held", "stopped") | m["text_status"].isin("held", "stopped", "discontinued")
    id = lambda tag: F.concat(F.lit(f"{tag}:"), m["id"])
    both = F.to_json(F.struct(m["before"].alias("admission"), m["after"].alias("discharge")))
    left_out = _finding(
        id("OMIT"), "OMISSION", F.when(explained, "info").otherwise("review"), F.when(explained, EXPLAINED).otherwise(OMITTED),
        F.concat(F.when(explained, "Stopped/held: ").otherwise("Not on discharge list: "), m["name"]), F.array(m["id"]),
        F.array(F.concat(_quoted(m["raw"]), F.lit(" is on the list on admission only.")), F.when(explained, F.concat(F.lit("By the note it was "), F.coalesce(F.nullif(m["text_status"], F.lit("")), m["status"]), F.lit("."))).otherwise("The note gives no reason: confirm that this is intended.")), both,
    )
    new = _finding(id("NEW"), "NEW_MEDICATION", "info", ADDED, F.concat(F.lit("New at discharge: "), m["name"]), F.array(m["id"]), F.array(F.concat(_quoted(m["raw"]), F.lit(" is on the discharge list only."))), both)
    dose = _finding(
        id("DOSE"), "DOSE_CHANGE", "review", CHANGED, F.concat(F.lit("Strength changed: "), m["name"], F.lit(" "), m["before"], F.lit(" → "), m["after"]), F.array(m["id"]),
        F.array(F.concat(F.lit("Strength on admission "), _quoted(m["before"]), F.lit(", at discharge "), _quoted(m["after"]), F.lit(": confirm that this is intended."))), both,
    )
    return F.when(kind == "omission", left_out).when(kind == "new", new).when(kind == "dose", dose)


def _unchecked() -> Column:
    meds = F.filter("medications", lambda m: (m["status"] == "active") & ~F.array_contains("known_meds", m["id"]))
    lines = F.concat(F.transform(meds, lambda m: F.concat(_quoted(m["raw"]), F.lit(": "), F.replace(m["norm_status"], F.lit("_"), F.lit(" ")))), F.array(F.lit("Interactions of these were not checked.")))
    title = F.concat(F.size(meds).cast("string"), F.lit(" active medication(s) could not be checked"))
    return F.when(F.size(meds) > 0, _finding(F.lit("NOT_CHECKED"), "NOT_CHECKED", "info", 0.0, title, F.transform(meds, lambda m: m["id"]), lines, F.lit("{}")))


def _uncovered(pairs: Column) -> Column:
    names = F.transform(F.slice(pairs, 1, NAMED_PAIRS), lambda p: F.concat(p["a_concept_name"], F.lit(" + "), p["b_concept_name"]))
    meds = F.sort_array(F.array_distinct(F.flatten(F.transform(pairs, lambda p: F.array(p["a_med"], p["b_med"])))))
    title = F.concat(F.size(pairs).cast("string"), F.lit(" drug pair(s) not covered by any interaction source"))
    evidence = F.to_json(F.struct(F.transform(pairs, lambda p: F.struct(p["a_concept"].alias("a"), p["b_concept"].alias("b"))).alias("pairs")))
    lines = F.concat(names, F.array(F.lit("No source covers both: no record does not mean that a pair is safe.")))
    return F.when(F.size(pairs) > 0, _finding(F.lit("NOT_COVERED"), "NOT_COVERED", "info", 0.0, title, meds, lines, evidence))


def reports(meds: DataFrame, lists: DataFrame, concepts: DataFrame, known: DataFrame, members: DataFrame) -> DataFrame:
    """One row for each note with medications: note_id, medications, findings, counts, report_hash.

    meds has note_id and the columns of MEDICATION, id unique within a note; lists has note_id, both_lists (whether the note has a list on
    admission and one at discharge; without both nothing is said of changes).  concepts, known and members are as in checker.check().  Medications are in the order of
    status and name, findings in that of tier, risk and title.  The hash covers both and nothing else, so equal contents have equal hashes.
    """
    meds = written(U.sorted_medications(meds.withColumn("key", F.col("id"))).select("note_id", "place", *MEDICATION))
    active = meds.filter("status = 'active'").select(F.col("note_id").alias("list_id"), F.col("id").alias("med"), "place", "route", F.posexplode("names").alias("no", "name"))
    entries = written(C.concepts_of(active.withColumn("place", F.struct("place", "no")).drop("no"), concepts))
    checked = C.check_concepts(entries, concepts, known, members)
    kinds = ("a_concept", "b_concept", "a_concept_name", "b_concept_name", "a_med", "b_med", "status", "severity", "basis", "level", "rule_no", "record_sources", "mechanisms")
    pairs = checked.groupBy("list_id").agg(F.sort_array(F.collect_list(F.struct(*kinds))).alias("pairs"))
    shared = entries.groupBy("list_id", "concept").agg(F.min("concept_name").alias("concept_name"), F.sort_array(F.collect_set(F.struct("place", "med"))).alias("x"))
    shared = shared.withColumn("meds", F.array_distinct(F.col("x.med")))
    of_list = shared.groupBy("list_id").agg(
        F.array_distinct(F.flatten(F.collect_list("meds"))).alias("known_meds"), F.sort_array(F.collect_list(F.when(F.size("meds") > 1, F.struct("concept", "concept_name", "meds")))).alias("shared"),
    )
    listed = meds.groupBy(F.col("note_id").alias("list_id")).agg(F.sort_array(F.collect_list(F.struct("place", F.struct(*MEDICATION).alias("m")))).alias("x"))
    both = lists.select(F.col("note_id").alias("list_id"), "both_lists")
    rows = listed.join(pairs, "list_id", "left").join(of_list, "list_id", "left").join(both, "list_id", "left").select(
        F.col("list_id").alias("note_id"), F.col("x.m").alias("medications"), F.coalesce("both_lists", F.lit(False)).alias("both_lists"), F.coalesce("known_meds", F.array().cast("array<string>")).alias("known_meds"),
        *(F.coalesce(c, F.array().cast(t)).alias(c) for c, t in (("pairs", dict(pairs.dtypes)["pairs"]), ("shared", dict(of_list.dtypes)["shared"]))),
    )
    rows = rows.withColumn("by_id", F.map_from_entries(F.transform("medications", lambda m: F.struct(m["id"], m))))
    with_status = lambda s: F.filter("pairs", lambda p: p["status"] == s)
    changes = F.when(F.col("both_lists"), F.transform("medications", _change)).otherwise(F.array().cast(f"array<struct<{FINDING.replace(' ', ':', ).replace(',:', ',')}>>"))
    found = F.concat(
        F.transform(with_status("INTERACTION"), _interaction), F.transform("shared", _duplicate), F.array_compact(changes), F.array_compact(F.array(_unchecked(), _uncovered(with_status("NOT_COVERED")))),
    )
    rank = lambda f: F.array_position(F.array(*map(F.lit, TIERS)), f["tier"])
    in_order = F.array_sort(F.transform(found, lambda f: F.struct(rank(f).alias("rank"), (-f["risk"]).alias("low"), f["title"].alias("title"), f["id"].alias("id"), f.alias("f"))))
    rows = rows.withColumn("findings", F.transform(in_order, lambda x: x["f"]))
    n = lambda c: F.size(c).cast("long")
    of_tier = lambda tier: F.filter("findings", lambda f: f["tier"] == tier)
    counts = {
        "medications": n("medications"), "active": n(F.filter("medications", lambda m: m["status"] == "active")), "pairs_checked": n("pairs"), "interactions": n(with_status("INTERACTION")),
        "no_known_interaction": n(with_status("NO_KNOWN_INTERACTION")), "not_covered": n(with_status("NOT_COVERED")), **{t: n(of_tier(t)) for t in TIERS},
    }
    return rows.select("note_id", "medications", "findings", F.struct(*(v.alias(k) for k, v in counts.items())).alias("counts"), _hash().alias("report_hash"))


def _hash() -> Column:
    thousandths = lambda v: F.round(v * 1000).cast("int").cast("string")
    meds = F.transform("medications", lambda m: F.concat_ws("|", m["id"], m["name"], m["status"], thousandths(m["confidence"])))
    findings = F.transform("findings", lambda f: F.concat_ws("|", f["id"], f["tier"], thousandths(f["risk"]), f["title"], f["verify"].cast("string")))
    return F.sha2(F.array_join(F.concat(meds, findings), "\n").cast("binary"), 256)


def corrected(rows: DataFrame, products: DataFrame) -> DataFrame:
    """Medications of corrected lists, with the columns of MEDICATION.

    rows has note_id, no (its place in the list), raw, and any of the columns of MEDICATION but names, norm_status and id's uniqueness; what is null
    takes its default: active, confidence 1, in the discharge list if active.  products has spelling, names, norm_status, as normalised from the raw
    text.  Blank rows and things that are no drugs are left out; an id that repeats within a list gets a number.
    """
    typed = {"id": "string", "status": "string", "text_status": "string", "confidence": "double", "in_admission": "boolean", "in_discharge": "boolean", "before": "string", "after": "string", "route": "string"}
    rows = rows.withColumns({c: F.lit(None).cast(t) for c, t in typed.items() if c not in rows.columns}).withColumn("raw", F.btrim("raw")).filter("raw <> ''")
    known = sized(products.select("spelling", "names", F.col("norm_status").alias("norm_status_")))
    rows = rows.drop("names", "norm_status", "name").join(known, F.lower("raw") == F.col("spelling"), "left").drop("spelling")
    rows = rows.withColumns({"names": F.coalesce("names", F.array().cast("array<string>")), "norm_status": F.coalesce("norm_status_", F.lit("unmapped"))}).filter("norm_status <> 'non_drug'")
    mapped = F.size("names") > 0
    base = F.coalesce("id", F.when(mapped, F.concat(F.lit("D:"), F.array_join(F.sort_array("names"), "+"))).otherwise(F.concat(F.lit("T:"), F.lower("raw"))))
    status = F.lower(F.coalesce("status", F.lit("active")))
    rows = U.unique_ids(rows.drop("id_").withColumn("base", base).drop("id"), "note_id", "base", "no")
    return rows.withColumns({
        "status": status, "confidence": F.coalesce("confidence", F.lit(1.0)), "text_status": F.coalesce("text_status", F.lit("")), "in_admission": F.coalesce("in_admission", F.lit(False)),
        "in_discharge": F.coalesce("in_discharge", status == "active"), "name": F.when(mapped, F.array_join("names", " + ")).otherwise(F.col("raw")),
    }).select("note_id", *MEDICATION)


def edited(reports: DataFrame, edits: DataFrame) -> DataFrame:
    """The corrected lists of the notes that edits name: rows (note_id, no, columns of MEDICATION).

    edits has note_id, op ('delete', 'update', 'add'), id, and raw, status, before, after, which an update takes where they are not null.  Notes without an edit are
    not read further than their id: their lists stay packed.
    """
    changed = edits.select("note_id").distinct()
    own = reports.join(sized(changed), "note_id", "left_semi").select("note_id", F.posexplode("medications").alias("no", "m")).select("note_id", "no", "m.*")
    fields = ("raw", "status", "before", "after")
    gone = edits.filter("op = 'delete'").select("note_id", "id")
    new = edits.filter("op = 'update'").select("note_id", "id", *(F.col(c).alias(f"new_{c}") for c in fields))
    kept = own.join(gone, ["note_id", "id"], "left_anti").join(new, ["note_id", "id"], "left")
    kept = kept.withColumns({c: F.coalesce(f"new_{c}", c) for c in fields}).drop(*(f"new_{c}" for c in fields)).drop("name", "names", "norm_status")
    added = edits.filter("op = 'add'").select("note_id", F.lit(1 << 30).alias("no"), "id", *fields)
    return kept.unionByName(added, allowMissingColumns=True)


def again(reports_before: DataFrame, edits: DataFrame, products: DataFrame, lists: DataFrame, concepts: DataFrame, known: DataFrame, members: DataFrame) -> DataFrame:
    """Reports after corrections: those of notes with an edit are computed from their corrected lists, all others are handed on as they are.

    No text is read again.  A note whose list becomes empty has no report.
    """
    changed = written(edits.select("note_id").distinct())
    rows = written(corrected(edited(reports_before, edits), products))
    new = reports(rows, lists.join(sized(changed), "note_id", "left_semi"), concepts, known, members)
    return reports_before.join(sized(changed), "note_id", "left_anti").unionByName(new)
