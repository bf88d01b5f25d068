"""Personal data by weak supervision: labelers vote on spans, expectation maximisation weighs them, a classifier decides.

Spans of four kinds come from strict patterns (the base, which always stays) and from looser ones.  Seven labelers vote on
each: the strict pattern with its checks, a gazetteer of known beginnings and ends, the words before, what comes after, digits and parts,
the characters beside it and the separators in it.  Votes are counted over all documents; from the table of counts, which has a row
for each combination that occurs and not for each span, expectation maximisation estimates how reliable each labeler is, and a logistic
regression on votes, kind and shape is trained on the estimated labels.  It judges all spans that are not base.  Built-in functions throughout.
"""

from __future__ import annotations

from math import exp, log

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, let, table
from .spans import cut_out, matches, pieces

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, with possessive repeats where what follows can't need what they took, so that no text takes quadratic time.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(]\x20?(?:at|AT)\x20?[\])]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]\x20?(?:dot|DOT)\x20?[\])]\x20?)[A-Za-z0-9-]++)++",
    "ip": r"[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}",
    "card": r"[0-9]{4}(?:[./_][0-9]{4}){3}",
    "phone": r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}",
}
#: Public facts that matches are looked up in, by kind: ends of domains, first octets of addresses in use at home and by providers, first digits
#: of cards' issuers, and calling codes.  Callers pass tables of their own; they are small, and are compiled into the plan.
GAZETTEER = {
    "email": (
        "com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "name", "io", "co", "ai", "app", "dev", "me", "tv", "eu", "de", "at", "ch", "fr",
        "be", "nl", "lu", "es", "pt", "it", "uk", "ie", "us", "ca", "mx", "br", "ar", "cl", "pe", "au", "nz", "jp", "cn", "kr", "in", "sg", "hk", "tw",
        "ru", "ua", "pl", "cz", "sk", "hu", "ro", "bg", "gr", "tr", "il", "za", "eg", "ng", "ke", "se", "no", "dk", "fi", "is",
    ),
    "ip": ("10", "127", "172", "192", "100", "169", "8", "1", "9", "2001", "2a00", "2a01", "2a02", "2600", "2606", "2607", "2804", "2400", "fe80", "fd00"),
    "card": ("4", "51", "52", "53", "54", "55", "22", "23", "24", "25", "26", "27", "34", "37", "6011", "65", "644", "645", "646", "647", "648", "649", "35", "36", "38", "39", "62", "50", "56", "57", "58", "63", "67"),
    "phone": (
        "1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55",
        "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98", "212", "213", "216",
        "218", "351", "352", "353", "354", "355", "356", "357", "358", "359", "370", "371", "372", "380", "381", "385", "386", "420", "421", "852", "886", "971", "972",
    ),
}
#: Words before a span that speak for each kind, in four languages, and words that speak against any.
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|contacto|kontakt|correo|courriel|write to|schreiben|écrire|escribir|reach)\b",
    "ip": r"(?i)\b(?:ip|host|server|servidor|serveur|address|adresse|dirección|client|login|gateway|router)\b",
    "card": r"(?i)\b(?:card|karte|carte|tarjeta|visa|mastercard|amex|credit|debit|kredit|crédit|crédito|payment|zahlung|paiement|pago|cc)\b",
    "phone": r"(?i)\b(?:phone|tel|telephone|telefon|téléphone|teléfono|call|anruf|appeler|llamar|mobile|mobil|móvil|cell|fax|handy|contact|kontakt)\b",
}
AGAINST = r"(?i)\b(?:version|release|build|order|invoice|isbn|issn|ref|page|section|chapter|figure|table|id|no|nr|bestellung|rechnung|seite|facture|pedido|página)\b[\x20:#.]*$"
AFTER = {
    "email": r"^[\x20]?(?:[.,;)>\]]|$|[\x20\n])", "ip": r"(?i)^(?::[0-9]{2,5}\b|/[0-9]{1,2}\b)", "card": r"(?i)^[\x20,;]*(?:exp|cvv|cvc|valid|gültig|valable|válida)\b", "phone": r"(?i)^[\x20,;(]*(?:ext|x[0-9]|fax|home|work|mobile|durchwahl|poste)\b",
}
UNITS = r"(?i)^[\x20]?(?:%|€|\$|£|mm\b|cm\b|km\b|kg\b|mg\b|ml\b|usd\b|eur\b|px\b|ms\b|bytes\b|kb\b|mb\b|gb\b|pages?\b)"
BEFORE = 40
ROUNDS = 30
#: Spans that the labelers' first reliabilities count for, so that a few spans of a small corpus do not turn them round.
PRIOR = 50.0
#: Added spans reach this probability.
LEAST = 0.5
VOTES = ("pattern_vote", "gazetteer_vote", "before_vote", "after_vote", "check_vote", "beside_vote", "separator_vote")
#: What else the classifier sees: the span's length and its share of digits, in steps.
SHAPE = ("length_step", "digit_step")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check; every second digit from the right counts double."""
    n = F.length(digits)

    def add(acc: Column, k: Column) -> Column:
        d = F.substring(digits, k, F.lit(1)).cast("int") * (1 + F.pmod(n - k, F.lit(2)))
        return acc + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    """The checks that the base makes of a match."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)


def _listed(kind: str, m: Column, known: tuple[str, ...]) -> Column:
    """Whether the gazetteer has what a match begins or ends with."""
    if kind == "email":
        return F.lower(F.regexp_extract(m, r"([A-Za-z]+)[^A-Za-z]*$", 1)).isin(*known)
    if kind == "ip":
        return F.lower(F.regexp_extract(m, r"^0*([0-9A-Fa-f]+)", 1)).isin(*known)
    digits = F.regexp_replace(m, "[^0-9]", "")
    most = max(map(len, known))
    found = F.lit(False)
    for n in range(1, most + 1):
        found = found | F.left(digits, F.lit(n)).isin(*known)
    if kind == "phone":  # a number without + is a local one, which has an area code from 2 on
        return F.when(m.startswith("+"), found).otherwise(digits.rlike("^[2-9]"))
    return found


def _checked(kind: str, m: Column) -> Column:
    """A vote on digits and parts, whatever stands between them."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    if kind == "email":
        return F.when(m.rlike(r"\.\.|^\.|\.@|@-|-$"), -1).otherwise(1)
    if kind == "ip":
        part = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
        return F.when(m.rlike(rf"^{part}(?:\.{part}){{3}}$|:"), 1).otherwise(-1)
    if kind == "card":
        return F.when(n.between(13, 19), F.when(luhn(digits), 1).otherwise(-1)).otherwise(-1)
    return F.when(n.between(10, 13), 1).when(n.between(9, 15), 0).otherwise(-1)


def _candidates(text: Column, kind: str, known: tuple[str, ...]) -> Column:
    """array<struct<s, e, base, loose, votes, shape>> of a kind: strict matches, whether they pass or not, and loose ones that overlap no base span."""

    def described(m: Column, strict: bool, parts: Column) -> Column:
        beside = F.struct(
            cut_out(parts, F.greatest(m["s"] - BEFORE, F.lit(0)), F.least(m["s"], F.lit(BEFORE))).alias("before"), cut_out(parts, m["e"], 16).alias("after"),
            (valid(kind, m["m"]) if strict else F.lit(False)).alias("good"),
        )
        return let(beside, lambda x: judged(m, strict, x["before"], x["after"], x["good"]))

    def judged(m: Column, strict: bool, before: Column, after: Column, good: Column) -> Column:
        gaps = F.size(F.array_distinct(F.regexp_extract_all(m["m"], F.lit(r"[^0-9A-Za-z@+()]"), F.lit(0))))
        votes = (
            F.when(good, 1).otherwise(-1 if strict else 0),
            F.when(_listed(kind, m["m"], known), 1).otherwise(-1),
            F.when(before.rlike(CONTEXT[kind]), 1).when(before.rlike(AGAINST), -1).otherwise(0),
            F.when(after.rlike(UNITS), -1).when(after.rlike(AFTER[kind]), 1).otherwise(0),
            _checked(kind, m["m"]),
            F.when(before.rlike(r"[0-9A-Za-z_#/\\-]$") | after.rlike(r"^[0-9A-Za-z_#/\\-]"), -1).otherwise(1),
            F.when(gaps == 1, 1).when(gaps == 0, 0).otherwise(-1 if kind in ("card", "phone") else 0),
        )
        length, digits = F.length(m["m"]), F.regexp_count(m["m"], F.lit("[0-9]"))
        shape = (F.least(F.floor(length / 8), F.lit(4)).cast("int"), F.floor(4 * digits / length).cast("int"))
        return F.struct(m["s"].alias("s"), m["e"].alias("e"), good.alias("base"), F.lit(not strict).alias("loose"), *(v.alias(n) for v, n in zip(votes, VOTES, strict=True)), *(v.alias(n) for v, n in zip(shape, SHAPE, strict=True)))

    def with_loose(found: Column, parts: Column) -> Column:
        loose = F.transform(matches(text, LOOSE[kind]), lambda m: described(m, False, parts))
        apart = lambda base: F.filter(loose, lambda c: ~F.exists(base, lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])))
        return F.concat(found, let(F.filter(found, lambda b: b["base"]), apart))

    def both(parts: Column) -> Column:
        return let(F.transform(matches(text, STRICT[kind]), lambda m: described(m, True, parts)), lambda found: with_loose(found, parts))

    # A text without a first hint of the kind is not searched.
    hint = {"email": r"@|[\[(]\x20?(?:at|AT)", "ip": r"[0-9]\.[0-9]|[0-9A-Fa-f]:[0-9A-Fa-f]", "card": "[0-9][0-9]|[0-9][ -][0-9]", "phone": r"\+[0-9]|[0-9]{3}\)?[\x20.-][0-9]{3}"}[kind]
    none = "s:int,e:int,base:boolean,loose:boolean," + ",".join(f"{v}:int" for v in (*VOTES, *SHAPE))
    return F.when(text.rlike(hint), let(pieces(text), both)).otherwise(F.array().cast(f"array<struct<{none}>>"))


def candidates(docs: DataFrame, gazetteer: dict[str, tuple[str, ...]] = GAZETTEER) -> DataFrame:
    """(doc_id, email, ip, card, phone): the spans of each kind with their votes, one row per row of docs; null texts have none."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", *(_candidates(text, k, gazetteer[k]).alias(k) for k in KINDS))


def vote_counts(found: DataFrame) -> DataFrame:
    """How often each combination of votes and shape occurs, by kind, from all documents; at most 4 x 3^7 x 25 rows, and far fewer that occur."""
    named = lambda k: lambda c: F.struct(F.lit(k).alias("kind"), *(c[v].alias(v) for v in (*VOTES, *SHAPE)))
    spans = F.flatten(F.array(*(F.transform(F.col(k), named(k)) for k in KINDS)))
    return found.select(F.explode(spans).alias("c")).select("c.*").groupBy("kind", *VOTES, *SHAPE).agg(F.count("*").alias("n"))


def first_chances() -> dict:
    """P(vote | real or not) that expectation maximisation starts from: labelers are right four times in five when they do not abstain."""
    return {v: {t: {x: (0.6 if x == t else 0.15 if x else 0.25) for x in (-1, 0, 1)} for t in (1, -1)} for v in VOTES}


def reliabilities(rows: list) -> dict:
    """Expectation maximisation over counted votes: the share of real spans of each kind, and P(vote | real or not) of each labeler.

    Labelers are taken as independent given the truth and alike for all kinds.  What they start from counts like PRIOR spans.
    """
    share, start = dict.fromkeys(KINDS, 0.5), first_chances()
    chance = start
    for _ in range(ROUNDS):
        real = {v: {t: {x: PRIOR * start[v][t][x] for x in (-1, 0, 1)} for t in (1, -1)} for v in VOTES}
        total = {k: {1: PRIOR / 2, -1: PRIOR / 2} for k in KINDS}
        for r in rows:
            p = _posterior(r, share, chance)
            for t, weight in ((1, p * r["n"]), (-1, (1 - p) * r["n"])):
                total[r["kind"]][t] += weight
                for v in VOTES:
                    real[v][t][r[v]] += weight
        share = {k: total[k][1] / (total[k][1] + total[k][-1]) for k in KINDS}
        chance = {v: {t: {x: c / sum(real[v][t].values()) for x, c in real[v][t].items()} for t in (1, -1)} for v in VOTES}
    return {"share": share, "chance": chance}


def _posterior(row, share: dict, chance: dict) -> float:
    p = share[row["kind"]]
    odds = log(p / (1 - p)) + sum(log(chance[v][1][row[v]] / chance[v][-1][row[v]]) for v in VOTES)
    return 1 / (1 + exp(-max(-30.0, min(30.0, odds))))


def span_classifier(counts: DataFrame) -> dict | None:
    """A logistic regression over votes, shape and kind, trained on the counted combinations: intercept and weights by name; None without spans."""
    rows = counts.collect()  # a row for each combination that occurs, not for each span
    if not rows:
        return None
    found = reliabilities(rows)
    made = [(r["kind"], *(r[v] for v in (*VOTES, *SHAPE)), float(label), max(0.001, min(0.999, p if label else 1 - p)) * r["n"]) for r in rows for p in [_posterior(r, found["share"], found["chance"])] for label in (0, 1)]
    spark = counts.sparkSession
    names = (*VOTES, *SHAPE)
    examples = spark.createDataFrame(made, f"kind string, {', '.join(f'{n} int' for n in names)}, label double, weight double")
    kinds = [F.when(F.col("kind") == k, 1.0).otherwise(0.0).alias(f"is_{k}") for k in KINDS[1:]]
    inputs = [*names, *(f"is_{k}" for k in KINDS[1:])]
    examples = VectorAssembler(inputCols=inputs, outputCol="features").transform(examples.select(*names, *kinds, "label", "weight"))
    model = LogisticRegression(weightCol="weight", regParam=0.001, maxIter=50).fit(examples)
    return {"intercept": float(model.intercept), **{n: float(x) for n, x in zip(inputs, model.coefficients, strict=True)}}


def personal_data(docs: DataFrame, gazetteer: dict[str, tuple[str, ...]] = GAZETTEER) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, spans_added), one row per row of docs.

    Null and empty texts have no spans.  Base spans are the strict matches that pass their checks; spans has those and the others
    that the classifier accepts: looser matches, and strict ones that failed a check.  Whole texts are searched, however long; ties do not
    arise, repeated rows are judged alike, an empty table gives an empty table.  Other columns of docs are not read.
    """
    found = cut(candidates(docs, gazetteer))
    model = span_classifier(cut(vote_counts(found)))

    def accepted(kind: str, c: Column) -> Column:
        if model is None:
            return F.lit(False)
        score = F.lit(model["intercept"] + model.get(f"is_{kind}", 0.0))
        for v in (*VOTES, *SHAPE):
            score = score + F.lit(model[v]) * c[v]
        return ~c["base"] & (score >= log(LEAST / (1 - LEAST)))

    def joined(test) -> Column:
        name = lambda k: lambda c: F.concat(F.lit(f"{k}:"), c["s"].cast("string"), F.lit(":"), c["e"].cast("string"))
        return F.array_join(F.flatten(F.array(*(F.transform(F.array_sort(F.filter(F.col(k), _accepts(test, k))), name(k)) for k in KINDS))), ",")

    counted = (F.size(F.filter(F.col(k), lambda c: c["base"])).cast("long").alias(f"n_{k}") for k in KINDS)
    added = sum((F.size(F.filter(F.col(k), _accepts(accepted, k))) for k in KINDS), F.lit(0))
    return found.select(
        "doc_id", *counted, F.sha2(joined(lambda k, c: c["base"]).cast("binary"), 256).alias("base_sha256"),
        joined(lambda k, c: c["base"] | accepted(k, c)).alias("spans"), added.cast("long").alias("spans_added"),
    )


def _accepts(accepted, kind: str):
    return lambda c: accepted(kind, c)


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
