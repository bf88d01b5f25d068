"""Quality rules, line first: lines that look like junk, navigation or boilerplate go, and documents that lose too much text are rejected.

Everything is built-in functions over one row at a time: no shuffle, no Python, whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CHARS, WORD, fresh, let, table

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MAX_LOST = 0.6
#: Phrases of pages rather than prose, lower case, by language.  Texts are held against all of them; callers pass a table of their own.
BOILERPLATE = {
    "en": (
        "all rights reserved", "licensed under", "terms of use", "terms of service", "privacy policy", "cookie policy", "accept cookies", "enable javascript",
        "lorem ipsum", "click here", "sign up for", "subscribe to", "share this", "powered by", "back to top", "log in to", "skip to content", "read more",
    ),
    "de": (
        "alle rechte vorbehalten", "nutzungsbedingungen", "allgemeine geschäftsbedingungen", "datenschutzerklärung", "cookies akzeptieren",
        "javascript aktivieren", "hier klicken", "newsletter abonnieren", "diese seite teilen", "nach oben", "zum inhalt springen", "weiterlesen",
    ),
    "fr": (
        "tous droits réservés", "conditions d'utilisation", "conditions générales", "politique de confidentialité", "accepter les cookies",
        "activer javascript", "cliquez ici", "abonnez-vous", "partager cette page", "haut de page", "aller au contenu", "lire la suite",
    ),
    "es": (
        "todos los derechos reservados", "términos de uso", "condiciones de uso", "política de privacidad", "aceptar cookies", "activar javascript",
        "haga clic aquí", "suscríbete", "compartir esta página", "volver arriba", "saltar al contenido", "leer más",
    ),
}
#: Lines of so many words at most, without a mark at their end, are short; so many in a row are a menu.  A heading or a name alone is none.
SHORT, MENU = 2, 3


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words that lie in a 5-word window found twice or more in the text.  Windows are compared by 64-bit hash within one document."""

    def counted(w: Column) -> Column:
        window = lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW)))
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), window)
        return F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(let(hashes, covered)).cast("long")

    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(ordered, union_of_repeats))

    def union_of_repeats(s: Column) -> Column:
        h = lambda k: F.get(s, k)["h"]
        same = lambda x, k: F.coalesce(x["h"] == h(k), F.lit(False))
        twice = lambda x, k: same(x, k - 1) | same(x, k + 1)
        starts = F.sort_array(F.transform(F.filter(s, twice), lambda x: x["i"]))
        # n: words covered so far; end: of the last window.
        step = lambda acc, p: F.struct(
            (acc["n"] + F.lit(WINDOW) - F.greatest(F.lit(0), acc["end"] - p)).cast("int").alias("n"), (p + WINDOW).cast("int").alias("end")
        )
        return F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda acc: acc["n"])

    return let(words, counted)


def phrases_of(rules: dict[str, tuple[str, ...]]) -> str:
    """One pattern for all phrases of a rule table."""
    return "|".join(sorted(f"\\Q{p}\\E" for own in rules.values() for p in own))


def bad_line(line: Column, phrases: str) -> Column:
    """Whether a line by itself fails the punctuation, navigation or boilerplate rule.  Lines without words never fail."""
    spaced = F.regexp_count(line, F.lit(WORD))
    # Words that end in two exclamation marks or a symbol, or that are a symbol.
    marked = F.regexp_count(line, F.lit(r"(?:!!|[#*$%&|<>])(?:[\x20\x09-\x0D]|$)"))
    junk = (marked >= 1) & (10 * marked >= 3 * spaced)
    navigation = F.regexp_count(line, F.lit(r"[|»›•]")) >= 2
    return junk | navigation | F.lower(line).rlike(phrases)


def short_line(line: Column) -> Column:
    """Whether a line has a word, SHORT at most, and no mark at its end."""
    ends_well = line.rlike(r"[.!?:;,…\"'”’)\]][\x20\x09-\x0D]*$")
    return line.rlike(WORD) & (F.regexp_count(line, F.lit(WORD)) <= SHORT) & ~ends_well


def kept_lines(text: Column, phrases: str) -> Column:
    """The lines of a text that pass: those that fail by themselves go, and those in runs of MENU short lines or more."""

    def kept(rows: Column) -> Column:
        short = lambda i: F.coalesce(F.get(rows, i)["short"], F.lit(False))
        # In a run of three or more, a line is the first, a middle one or the last of three.
        menu = lambda i: short(i) & ((short(i - 1) & short(i + 1)) | (short(i + 1) & short(i + 2)) | (short(i - 1) & short(i - 2)))
        return F.transform(F.filter(F.transform(rows, lambda r, i: F.struct(r["line"].alias("line"), (r["bad"] | menu(i)).alias("bad"))), lambda r: ~r["bad"]), lambda r: r["line"])

    return let(F.transform(F.split(text, "\n"), lambda line: F.struct(line.alias("line"), bad_line(line, phrases).alias("bad"), short_line(line).alias("short"))), kept)


def visible(text: Column) -> Column:
    """Code points in words."""
    return F.length(F.translate(text, SPACE_CHARS, "")).cast("long")


def clean_lines(docs: DataFrame, max_lost: float = MAX_LOST, rules: dict[str, tuple[str, ...]] = BOILERPLATE) -> DataFrame:
    """docs with clean_text, the lines that pass, and lost, the share of characters in words that went (0 for texts without words).

    Null and empty texts are empty.  keeps_text is false where more than max_lost of the text went.  Texts of any length are read whole, a
    row at a time; ties do not arise, repeated rows are judged alike and an empty table stays empty.  Columns named clean_text, lost or keeps_text are replaced,
    all others are returned as they are.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = F.array_join(kept_lines(text, phrases_of(rules)), "\n")
    total, left = visible(text), visible(F.col("clean_text"))
    lost = F.when(total == 0, F.lit(0.0)).otherwise(1 - left / total)
    return docs.withColumn("clean_text", kept).withColumn("lost", lost).withColumn("keeps_text", F.col("lost") <= max_lost)


def statistics(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed, which replace columns of those names.

    Whole texts are counted, however long; null and empty texts count nothing and fail.  Repeated rows are counted alike, an empty table stays empty.
    """
    (facts,) = fresh([*docs.columns, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"], "facts")
    text = F.coalesce(F.col("text"), F.lit(""))
    with_word = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    found = let(
        words_of(text),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")),
    )
    return (
        docs.withColumn(facts, found)
        .withColumn("n_words", F.col(facts)["n_words"])
        .withColumn("word_chars", visible(text))
        .withColumn("n_symbols", (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"))
        .withColumn("n_dup_lines", let(with_word, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")))
        .withColumn("n_repeat_words", F.col(facts)["n_repeat_words"])
        .withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
        .drop(facts)
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return clean_lines(statistics(docs)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("keeps_text")).alias("kept"),
    )
