"""Notes: sections, mentions of names, their attributes and what the text around them says, as columns over whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import let, spans_of
from .shared import sized

# Titles of sections, words inside lists that end none, titles that always end one, and what looks like an item or a dose.
ADMISSION = (
    r"(?i)^(medications? on admission|admission medications?|meds on admission|admission meds|home medications?|home meds|meds at home|medications? at home|"
    r"outpatient medications?|outpatient meds|pre-?admission medications?|medications? prior to admission|prior to admission medications?|"
    r"meds prior to admission|meds on transfer|medications? on transfer|transfer medications?|transfer meds)$"
)
DISCHARGE = r"(?i)^(discharge medications?|discharge meds|medications? on discharge|meds on discharge|medications? at discharge|discharge medication list)$"
INLINE = (
    r"(?i)(?:^|\s)(sig|disp|refills?|qty|dose|doses|instructions|note|notes|hold|take|give|start|stop|indication|duration|route|frequency|tablets?|"
    r"capsules?|patch|scale)$"
)
KNOWN_END = (
    r"(?i)^(discharge (disposition|diagnos[ie]s|condition|instructions|followup|follow-up)|disposition|facility|follow ?-?up( instructions)?|"
    r"followup instructions|attending|physical exam|pertinent results|brief hospital course|hospital course|allergies|chief complaint|history|"
    r"past medical history|past surgical history|social history|family history|major surgical or invasive procedure|labs?|imaging|studies|"
    r"assessment|plan|assessment and plan|impression|condition at discharge|diagnos[ie]s|instructions|patient instructions|signed|dictated by|"
    r"completed by|service|procedures?|wound care|diet|activity|code status|primary diagnosis|secondary diagnos[ie]s)$"
)
DOSEY = r"(?i)\d|\b(mg|mcg|units?|tabs?|caps?|po|iv|daily|bid|tid|prn|sig)\b"
ITEM = r"(?i)^[ \t]*(\d+[.)]|[-*•])\s|\bsig\s*:"
COLON_TITLE = r"^[ \t]*([A-Za-z][A-Za-z0-9 /&'(),-]{2,60}?)[ \t]*:"
CAPS_TITLE = r"^[ \t]*([A-Z][A-Z /&'-]{3,50})[ \t]*$"
LAB_HEADER = r"(?i)^\s*(pertinent results|laboratory data|labs?|admission labs|discharge labs|lab results|studies|imaging|micro(biology)?)\s*:"
ANY_HEADER = r"^\s*[A-Z][A-Za-z /&-]{2,40}:(?:\s|$)"

# Patterns of attributes, in the order in which they claim text.
_NUM = r"\d+(?:[.,]\d+)?(?:\s*-\s*\d+(?:[.,]\d+)?)?"
ATTRIBUTES = {
    "Strength": rf"(?i)(?<![\w.]){_NUM}\s*(?:mg|mcg|g|gm|grams?|units?|meq|mmol|ml|mg/ml|mcg/hr|mg/hr|units/hr|%)(?:\s*/\s*(?:{_NUM})?\s*(?:ml|hr|kg|dose|patch|actuation))?(?![A-Za-z])",
    "Dosage": r"(?i)(?<![\w])(?:one|two|three|four|half|1/2)\s*\(\d+(?:\.\d+)?\)",
    "Form": (
        r"(?i)(?<![A-Za-z])(?:(?:tablets?|capsules?),?\s*(?:delayed|extended|sustained|rapid)\s*(?:release|dissolve)(?:\s*\([^)]*\))?(?:\s*\d+\s*hr)?|"
        r"tablets?,?\s*(?:chewable|sublingual|rapid dissolve)|solution\s+for\s+nebulization|adhesive\s+patch,?\s*medicated|patch\s+\d+\s*hr|"
        r"tablets?|tabs?|capsules?|caps?|solution|suspension|syrup|patch|cream|ointment|inhaler|spray|drops?|powder|suppository|lozenge|elixir|syringe)(?![A-Za-z])"
    ),
    "Route": (
        r"(?i)(?<![A-Za-z])(?:P\.O\.?|PO|IV|IM|SC|SQ|SL|PR|subcutaneous(?:ly)?|sublingual|topical(?:ly)?|oral|inhalation|nebulization|intravenous(?:ly)?|"
        r"intramuscular|by mouth|orally|transdermal|nasal|ophthalmic|gtt|drip)(?![A-Za-z])"
    ),
    "Frequency": (
        r"(?i)(?<![A-Za-z])(?:Q\s?\d+\s?-?\s?\d*\s?H(?:RS?)?|Q\.\s?D\.?|Q\.?\s?DAY|QD|QOD|QHS|QAM|QPM|HS|BID|TID|QID|DAILY|once a day|twice a day|three times a day|"
        r"four times a day|every \w+ \(\d+\) hours|every (?:morning|evening|night|day|other day)|at bedtime|at night|nightly|weekly)(?![A-Za-z])"
        r"(?:\s*\([^()]{1,40}\))?(?:\s*\.?\s*as needed)?|(?<![A-Za-z])(?:PRN|as needed)(?![A-Za-z])"
    ),
    "Duration": (
        r"(?i)(?<![A-Za-z])(?:for|x)\s*(?:\d+|one|two|three|four|five|six|seven|ten|fourteen)\s*(?:\(\d+\)\s*)?(?:more\s+)?(?:days?|weeks?|months?|doses?)(?![A-Za-z])"
    ),
}
WORD = r"[A-Za-z][A-Za-z0-9'-]*"
BOUNDARY = r"\n\s*\d{1,2}[.)]\s|\n\s*\n"
RULE_BEFORE, AFTER, MAX_WORDS = 15, 300, 4

# Cues of a status and what may stand between one and its object, negations, ends of sentences, and contexts of what is not taken now.
CUE = r"(?i)\b(held|holding|stopped|discontinued|d/c'?d)\b"
FILLERS = ("the", "his", "her", "their", "home", "all", "patient's", "pt's", "outpatient")
NEGATED = r"(?i)\b(not|never|no longer)\s+(be\s+)?$"
SENTENCE_END = r"[.;\n]\s"
NOT_CURRENT = (
    r"(?i)\b(allerg\w*|intoleran\w*|reaction to|rash (with|from|to)|anaphylaxis|no|not on|never|denies|without|avoid|h/o|history of|"
    r"previously (on|took|taking)|prior)\b[^.;\n]{0,40}$"
)
ALLERGY_HEADER = r"(?im)^[ \t]*allerg(y|ies)[^:\n]*:"
CUE_REACH, ALLERGY_REACH = 80, 400
HELD = ("held", "hold", "stopped", "discontinued", "dc'd", "d/c")
STOPPED = ("stopped", "discontinued", "dc'd", "d/c")


def cut_out(text: Column, begin: Column, end: Column) -> Column:
    """text[begin:end], 0-based."""
    return F.substring(text, begin + 1, F.greatest(end - begin, F.lit(0)))


def line_rows(text: Column) -> Column:
    """array<struct<no, s, line>>: lines with the place of their first character, in one pass."""
    parts = F.split(text, "\n", -1)
    none = F.array().cast("array<struct<no:int,s:int,line:string>>")
    step = lambda acc, x: F.struct(
        (acc["no"] + 1).alias("no"), (acc["at"] + F.length(x) + 1).alias("at"), F.array_append(acc["rows"], F.struct(acc["no"].alias("no"), acc["at"].alias("s"), x.alias("line"))).alias("rows")
    )
    return F.aggregate(parts, F.struct(F.lit(0).alias("no"), F.lit(0).alias("at"), none.alias("rows")), step, lambda acc: acc["rows"])


def kind_of(title: Column) -> Column:
    return F.when(title.rlike(ADMISSION), "admission").when(title.rlike(DISCHARGE), "discharge")


def headers(notes: DataFrame, text: str = "text") -> DataFrame:
    """notes with lines and headers, an array<struct<s, e, title, kind>>.

    A title before a colon counts if the line before is blank or the title is a known one; a line in capitals only if it is known.
    """
    rows = notes.withColumn("lines", line_rows(F.coalesce(text, F.lit(""))))

    def described(x: Column, i: Column) -> Column:
        blank = (i == 0) | (F.btrim(F.get(F.col("lines"), i - 1)["line"], F.lit(" \t\r")) == "")

        def titled(t: Column) -> Column:
            whole = F.when(t["colon"] != "", F.length(F.regexp_extract(x["line"], COLON_TITLE, 0))).otherwise(F.length(x["line"]))
            bare = F.btrim(F.regexp_replace(F.when(t["colon"] != "", t["colon"]).otherwise(t["caps"]), r"\s*\([^)]*\)\s*", " "))
            return let(bare, lambda title: F.struct(x["s"].alias("s"), (x["s"] + whole).alias("e"), title.alias("title"), F.when(title != "", kind_of(title)).alias("kind"), (t["colon"] == "").alias("caps"), blank.alias("blank")))

        return let(F.struct(F.regexp_extract(x["line"], COLON_TITLE, 1).alias("colon"), F.regexp_extract(x["line"], CAPS_TITLE, 1).alias("caps")), titled)

    rows = rows.withColumn("headers", F.transform("lines", described))
    counts = lambda h: (h["title"] != "") & ~h["title"].rlike(INLINE) & (h["kind"].isNotNull() | h["title"].rlike(KNOWN_END) | (h["blank"] & ~h["caps"]))
    return rows.withColumn("headers", F.filter("headers", counts))


def prose_break(text: Column, begin: Column, end: Column) -> Column:
    """Where a list ends before a paragraph of prose: a blank line and a sentence of five words or more without doses, with no more items after it; else end."""
    described = lambda x: F.struct(F.length(x).alias("n"), (F.btrim(x, F.lit(" \t\r")) == "").alias("blank"), x.rlike(ITEM).alias("item"), x.rlike(DOSEY).alias("dosey"), (F.size(F.split(F.btrim(x), r"\s+")) >= 5).alias("long"))

    def step(acc: Column, x: Column) -> Column:
        # From the last line to the first: items and lines with doses so far, whether the line after is prose that nothing follows, and the lines from here on.
        good = ~x["blank"] & x["long"] & ~x["item"] & ~x["dosey"] & ~acc["item"] & (acc["dosey"] < 2)
        broken = x["blank"] & acc["prose"]
        left = (acc["left"] + x["n"] + 1).cast("int")
        return F.struct((acc["item"] | x["item"]).alias("item"), (acc["dosey"] + x["dosey"].cast("int")).alias("dosey"), good.alias("prose"), left.alias("left"), F.when(broken, left).otherwise(acc["found"]).alias("found"))

    start = F.struct(F.lit(False).alias("item"), F.lit(0).alias("dosey"), F.lit(False).alias("prose"), F.lit(-1).alias("left"), F.lit(-1).alias("found"))
    # left counts the characters from a line's first one to the end of the list; the break is the line end before it.
    last_first = lambda rows: F.aggregate(F.reverse(F.slice(rows, 2, F.size(rows))), start, step, lambda acc: acc["found"])
    found = lambda at: let(F.transform(F.split(cut_out(text, at["b"], at["e"]), "\n", -1), described), last_first)
    place = lambda at: let(found(at), lambda n: F.when(n >= 0, at["e"] - n - 1).otherwise(at["e"]))
    return let(F.struct(begin.alias("b"), end.alias("e")), place)


def sections(notes: DataFrame, text: str = "text") -> DataFrame:
    """notes with sections, an array<struct<kind, title, s, e>>: lists of medications from the end of their header to the next header or prose."""
    rows = headers(notes, text)
    size = F.length(F.coalesce(text, F.lit("")))
    after = lambda h: F.coalesce(F.array_min(F.transform(F.filter("headers", lambda o: o["s"] > h["s"]), lambda o: o["s"])), size)
    found = F.transform(F.filter("headers", lambda h: h["kind"].isNotNull()), lambda h: F.struct(h["kind"].alias("kind"), h["title"].alias("title"), h["e"].alias("s"), prose_break(F.col(text), h["e"], after(h)).alias("e")))
    return rows.withColumn("sections", found).drop("headers")


def lab_ranges(lines: Column, size: Column) -> Column:
    """array<struct<s, e>>: from each header of laboratory results to the next header of another kind."""
    lab = F.filter(lines, lambda x: x["line"].rlike(LAB_HEADER))
    other = lambda h: F.filter(lines, lambda x: (x["s"] > h["s"]) & x["line"].rlike(ANY_HEADER) & ~x["line"].rlike(LAB_HEADER))
    return F.transform(lab, lambda h: F.struct(h["s"].alias("s"), F.coalesce(F.array_min(F.transform(other(h), lambda x: x["s"])), size).alias("e")))


def inside(position: Column, ranges: Column) -> Column:
    return F.exists(ranges, lambda r: (r["s"] <= position) & (position < r["e"]))


def section_of(position: Column, found: Column) -> Column:
    """The kind of the first section around a position; null outside."""
    return F.get(F.filter(found, lambda x: (x["s"] <= position) & (position < x["e"])), F.lit(0))["kind"]


def dictionary_mentions(notes: DataFrame, vocabulary: DataFrame, skip_labs: bool = True, text: str = "text") -> DataFrame:
    """(note_id, s, e, name): leftmost longest runs of up to four words of a line that the vocabulary (name) has; ranges of laboratory results are left out."""
    from .reading import matched

    found = matched(notes.select("note_id", F.col(text).alias("text")), vocabulary, skip_labs)
    return found.select("note_id", F.explode("hits").alias("x")).select("note_id", "x.*")


def runs_in(notes: DataFrame, vocabulary: DataFrame, skip_labs: bool = True, text: str = "text") -> DataFrame:
    """The same for vocabularies of any length.

    Runs meet the vocabulary in a join; a fold over the hits of one line then takes each word once.
    """
    rows = notes.select("note_id", line_rows(F.coalesce(text, F.lit(""))).alias("lines"), F.length(F.coalesce(text, F.lit(""))).alias("size"))
    rows = rows.withColumn("labs", lab_ranges(F.col("lines"), F.col("size")) if skip_labs else F.array().cast("array<struct<s:int,e:int>>"))
    lines = rows.select("note_id", "labs", F.explode("lines").alias("x")).filter(~inside(F.col("x.s"), F.col("labs"))).select("note_id", "x.*")
    words = lines.select("note_id", "no", "s", F.lower("line").alias("line"), spans_of(F.col("line"), F.lit(WORD)).alias("w")).filter(F.size("w") > 0)

    def runs(n: int) -> Column:
        name = lambda i: F.array_join(F.transform(F.slice("w", i + 1, n), lambda x: cut_out(F.col("line"), x["s"], x["e"])), " ")
        run = lambda x, i: F.struct(x["s"].alias("a"), (-F.get(F.col("w"), i + n - 1)["e"]).alias("b"), name(i).alias("name"))
        return F.transform(F.slice("w", 1, F.greatest(F.size("w") - (n - 1), F.lit(0))), run)

    tried = words.select("note_id", "no", "s", F.explode(F.concat(*(runs(n) for n in range(1, MAX_WORDS + 1)))).alias("r")).select("note_id", "no", "s", "r.*")
    hits = tried.join(sized(vocabulary.select("name").distinct()), "name", "left_semi")
    held = hits.groupBy("note_id", "no", "s").agg(F.sort_array(F.collect_list(F.struct("a", "b", "name"))).alias("all"))
    step = lambda acc, x: F.when(x["a"] >= acc["end"], F.struct((-x["b"]).alias("end"), F.array_append(acc["kept"], x).alias("kept"))).otherwise(acc)
    none = F.array().cast("array<struct<a:int,b:int,name:string>>")
    kept = F.aggregate("all", F.struct(F.lit(0).alias("end"), none.alias("kept")), step, lambda acc: acc["kept"])
    return held.select("note_id", "s", F.explode(kept).alias("x")).select("note_id", (F.col("s") + F.col("x.a")).alias("s"), (F.col("s") - F.col("x.b")).alias("e"), F.col("x.name").alias("name"))


def add_apart(spans: DataFrame) -> DataFrame:
    """Of spans (note_id, rank, s, e, ...) those that overlap none kept before them, taken by rank and place: one after the other, as a fold over a note's spans."""
    rest = [c for c in spans.columns if c not in ("note_id", "rank", "s", "e")]
    held = spans.groupBy("note_id").agg(F.sort_array(F.collect_list(F.struct("rank", "s", "e", *rest))).alias("all"))
    empty = F.slice("all", 1, 0)
    step = lambda acc, x: F.when(F.exists(acc, lambda o: (x["s"] < o["e"]) & (o["s"] < x["e"])), acc).otherwise(F.array_append(acc, x))
    return held.select("note_id", F.explode(F.aggregate("all", empty, step)).alias("x")).select("note_id", "x.*")


def windows(mentions: DataFrame, before: int, after: int = AFTER, boundary: str = BOUNDARY) -> DataFrame:
    """mentions (note_id, s, e, ..., text) with lo and hi: the text around a mention up to its neighbours, its reach and the next item."""
    w = Window.partitionBy("note_id").orderBy("s", "e")
    lo = F.greatest(F.col("s") - before, F.coalesce(F.lag("e").over(w), F.lit(0)))
    hi = F.least(F.col("e") + after, F.coalesce(F.lead("s").over(w), F.length("text")))
    near = mentions.withColumns({"lo": lo, "hi": hi, "no": F.row_number().over(w)})
    cut_at = F.regexp_instr(cut_out(F.col("text"), F.col("e"), F.col("hi")), F.lit(boundary))
    return near.withColumn("hi", F.when(cut_at > 0, F.col("e") + cut_at - 1).otherwise(F.col("hi")))


def attribute_candidates(text: Column, lo: Column, hi: Column) -> Column:
    """array<struct<kind_no, kind, s, e>>: matches of the attribute patterns in text[lo:hi], with the character before in view."""
    back = F.when(lo > 0, F.lit(1)).otherwise(0)
    char = cut_out(text, lo - back, lo)
    seen = F.concat(F.when(char.rlike("[A-Za-z]"), "z").otherwise(char), cut_out(text, lo, hi))
    shifted = lambda k, n: lambda x: F.struct(F.lit(k).alias("kind_no"), F.lit(n).alias("kind"), (x["s"] - back + lo).alias("s"), (x["e"] - back + lo).alias("e"))
    found = [F.transform(F.filter(spans_of(seen, F.lit(p)), lambda x: x["s"] >= back), shifted(k, n)) for k, (n, p) in enumerate(ATTRIBUTES.items())]
    return F.concat(*found)


def claimed_attributes(mentions: DataFrame, before: int = RULE_BEFORE) -> DataFrame:
    """(note_id, no, kind, s, e, value): attributes of the mentions (note_id, s, e, text) of each note.

    Mentions claim text in their order, kinds in theirs; what overlaps a mention or an earlier claim is not claimed again.
    """
    near = windows(mentions, before)
    own = near.select("note_id", "no", "s", "e", "text", attribute_candidates(F.col("text"), F.col("lo"), F.col("hi")).alias("c"))
    claim = F.struct("no", "c")
    held = own.groupBy("note_id").agg(F.first("text").alias("text"), F.collect_list(F.struct("s", "e")).alias("taken"), F.array_sort(F.collect_list(claim)).alias("all"))
    rows = F.flatten(F.transform("all", lambda m: F.transform(m["c"], lambda c: F.struct(m["no"].alias("no"), c["kind"].alias("kind"), c["s"].alias("s"), c["e"].alias("e")))))
    none = F.array().cast("array<struct<no:int,kind:string,s:int,e:int>>")
    free = lambda acc, x: ~F.exists(F.col("taken"), lambda o: (x["s"] < o["e"]) & (o["s"] < x["e"])) & ~F.exists(acc, lambda o: (x["s"] < o["e"]) & (o["s"] < x["e"]))
    step = lambda acc, x: F.when(free(acc, x), F.array_append(acc, x)).otherwise(acc)
    kept = held.select("note_id", "text", F.explode(F.aggregate(rows, none, step)).alias("x"))
    return kept.select("note_id", "x.*", cut_out(F.col("text"), F.col("x.s"), F.col("x.e")).alias("value"))


def sentence(text: Column, s: Column, e: Column) -> tuple[Column, Column]:
    """Begin and end of the sentence around a span, at most CUE_REACH characters to each side."""
    far = F.greatest(s - CUE_REACH, F.lit(0))
    before = F.regexp_replace(cut_out(text, far, s), r"(?s)^.*[.;\n]\s", "")
    ends = F.regexp_instr(cut_out(text, e, e + CUE_REACH), F.lit(SENTENCE_END))
    return s - F.length(before), F.when(ends > 0, e + ends - 1).otherwise(F.least(e + CUE_REACH, F.length(text)))


def cue_status(text: Column, s: Column, e: Column, spans: Column) -> Column:
    """held or stopped if a cue in the sentence means the mention at s..e; spans are all mentions of the note; '' else.

    A cue means the drug right after it, with nothing but fillers between, else the nearest one before it, else the nearest one after it.
    """

    def within(at: Column) -> Column:
        drugs = F.array_sort(F.filter(spans, lambda d: (d["s"] >= at["lo"]) & (d["e"] <= at["hi"])))
        cues = F.transform(spans_of(cut_out(text, at["lo"], at["hi"]), F.lit(CUE)), lambda c: F.struct((c["s"] + at["lo"]).alias("s"), (c["e"] + at["lo"]).alias("e")))
        meant = F.filter(cues, lambda c: ~cut_out(text, F.greatest(c["s"] - 20, at["lo"]), c["s"]).rlike(NEGATED))
        return let(F.struct(drugs.alias("drugs"), meant.alias("cues")), said)

    def said(x: Column) -> Column:
        def target(c: Column) -> Column:
            after = F.get(F.filter(x["drugs"], lambda d: d["s"] >= c["e"]), F.lit(0))
            before = F.try_element_at(F.filter(x["drugs"], lambda d: d["e"] <= c["s"]), F.lit(-1))
            between = F.filter(F.split(F.lower(cut_out(text, c["e"], after["s"])), r"\s+"), lambda w: w != "")
            direct = after.isNotNull() & F.forall(between, lambda w: w.isin(*FILLERS))
            return F.when(direct, after["s"]).otherwise(F.coalesce(before["s"], after["s"]))

        word = lambda own: F.lower(cut_out(text, F.get(own, F.lit(0))["s"], F.get(own, F.lit(0))["e"]))
        return let(F.filter(x["cues"], lambda c: target(c) == s), lambda own: F.when(F.size(own) == 0, "").when(word(own).startswith("hold") | (word(own) == "held"), "held").otherwise("stopped"))

    lo, hi = sentence(text, s, e)
    return let(F.struct(lo.alias("lo"), hi.alias("hi")), within)


def not_current(text: Column, s: Column) -> Column:
    """Whether a mention stands in a list of allergies, or is negated or of the past in its sentence."""
    found = spans_of(cut_out(text, F.lit(0), s), F.lit(ALLERGY_HEADER))
    last = F.try_element_at(found, F.lit(-1))["e"]
    listed = last.isNotNull() & ~F.contains(cut_out(text, last, s), F.lit("\n\n")) & (s - last < ALLERGY_REACH)
    before = F.regexp_replace(cut_out(text, F.greatest(s - CUE_REACH, F.lit(0)), s), r"(?s)^.*[.;\n]\s", "")
    return F.coalesce(listed, F.lit(False)) | before.rlike(NOT_CURRENT)


def chunks(text: Column, size: int, overlap: int) -> Column:
    """array<struct<s, e>>: pieces of at most size characters that end at a line end in their second half, if there is one.

    The next piece begins overlap characters before, at the next line begin if one follows there.  A fold, since each piece depends on the one before.
    """
    n = F.length(text)
    none = F.array().cast("array<struct<s:int,e:int>>")

    def step(acc: Column, _: Column) -> Column:
        s = acc["at"]
        full = F.least(s + size, n)
        half = cut_out(text, s + size // 2, full)
        last = F.length(half) - F.length(F.substring_index(half, "\n", -1))  # just past the last line end in the second half
        e = F.when((full < n) & F.contains(half, F.lit("\n")), s + size // 2 + last).otherwise(full)
        back = F.greatest(e - overlap, s + 1)
        line = F.instr(cut_out(text, back, e), "\n")
        moved = F.struct(F.when(e >= n, n).otherwise(F.when(line > 0, back + line).otherwise(back)).cast("int").alias("at"), F.array_append(acc["all"], F.struct(s.cast("int").alias("s"), e.cast("int").alias("e"))).alias("all"))
        return F.when(acc["at"] >= n, acc).otherwise(moved)

    turns = F.sequence(F.lit(0), F.ceil(n / max(1, size // 2 - overlap)).cast("int"))
    cut_up = F.aggregate(turns, F.struct(F.lit(0).alias("at"), none.alias("all")), step, lambda acc: acc["all"])
    return F.when(n <= size, F.array(F.struct(F.lit(0).alias("s"), n.alias("e")))).otherwise(cut_up)
