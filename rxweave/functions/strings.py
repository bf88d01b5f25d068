"""Name and text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[ \t\n\r\f]+"
DOSE = r"(^|[^a-z0-9])[0-9]+(\.[0-9]+)?[ ]?(mg|mcg|ml|g|units?|%)($|[^a-z0-9])"


def let(value: Column, body) -> Column:
    """body(value) with value computed once: an expression that a lambda mentions twice would otherwise be computed twice."""
    return F.transform(F.array(value), body)[0]


def norm(s: Column) -> Column:
    """Lower case, trimmed, runs of white space as one blank."""
    return F.trim(F.regexp_replace(F.lower(s), SPACE, " "))


def clean(s: Column) -> Column:
    """A surface name without brackets, commas and doses."""
    bare = F.regexp_replace(F.regexp_replace(norm(s), r"\([^)]*\)|\[[^\]]*\]", " "), ",", " ")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, DOSE, " "), SPACE, " "), r"^[ .,;:-]+|[ .,;:-]+$", "")


def strip_words(s: Column, words: list[str]) -> Column:
    """s without the words, wherever they come after the first word."""
    parts = F.split(s, " ")
    return F.array_join(F.filter(parts, lambda w, i: (i == 0) | ~w.isin(words)), " ")


def combination(s: Column) -> Column:
    """Parts of a combination product: array of names."""
    return F.filter(F.transform(F.split(s, r"[/+]|-| and | with "), lambda x: F.trim(x)), lambda x: x != "")


def alias_list(label: Column, aliases: Column) -> Column:
    """The label and the aliases of a pipe-separated list, each normalised."""
    return F.array_compact(F.concat(F.array(norm(label)), F.coalesce(F.transform(F.split(aliases, r"\|"), lambda a: norm(a)), F.array().cast("array<string>"))))


def tidy(s: Column) -> Column:
    """Line ends as newlines, no blanks at line ends, one empty line at most, a newline at the end."""
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "\r\n?", "\n"), " ", " "), "[ \t]+\n", "\n")
    return F.concat(F.regexp_replace(F.regexp_replace(s, "\n\n\n+", "\n\n"), r"^[ \t\n]+|[ \t\n]+$", ""), F.lit("\n"))


def template(description: Column, a: Column, b: Column) -> Column:
    """A description with both names as placeholders, the longer name first so that a name within a name survives."""
    first = F.replace(F.replace(description, a, F.lit("{a}")), b, F.lit("{b}"))
    second = F.replace(F.replace(description, b, F.lit("{b}")), a, F.lit("{a}"))
    return F.when(F.length(a) >= F.length(b), first).otherwise(second)


def csv_safe(s: Column) -> Column:
    """A cell that no spreadsheet takes for a formula."""
    return F.when(F.substring(s, 1, 1).isin("=", "+", "-", "@", "\t", "\r"), F.concat(F.lit("'"), s)).otherwise(s)


def pretty(stem: Column) -> Column:
    """A file stem as a title: short words in capitals, others with a capital."""
    words = F.filter(F.split(stem, "[_-]"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.when(F.length(w) <= 3, F.upper(w)).otherwise(F.initcap(w))), " ")


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval of a share; null for n = 0."""
    p = F.try_divide(hits, n)
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return middle - half, middle + half


def find_all(text: Column, value: str) -> Column:
    """Starts (0-based) of a literal in a text, case ignored, from left to right without overlap."""
    parts, n = F.split(F.lower(text), f"\\Q{value.lower()}\\E", -1), len(value)
    none = F.array().cast("array<int>")
    step = lambda acc, p: F.struct((acc["at"] + F.length(p) + n).alias("at"), F.array_append(acc["starts"], acc["at"] + F.length(p)).alias("starts"))
    return F.aggregate(F.slice(parts, 1, F.size(parts) - 1), F.struct(F.lit(0).alias("at"), none.alias("starts")), step, lambda acc: acc["starts"])


def pattern_of(value: Column) -> Column:
    """A pattern for a value as it may stand in a text: any white space between its words, no letter or digit beside it, case ignored."""
    words = F.filter(F.split(value, r"\s+"), lambda w: w != "")
    body = F.array_join(F.transform(words, lambda w: F.concat(F.lit("\\Q"), w, F.lit("\\E"))), "\\s+")
    edge = r"[A-Za-z0-9]"
    return F.concat(
        F.lit("(?i)"), F.when(F.left(value, F.lit(1)).rlike(edge), rf"(?<!{edge})").otherwise(""), body, F.when(F.right(value, F.lit(1)).rlike(edge), rf"(?!{edge})").otherwise("")
    )


def spans_of(text: Column, pattern: Column) -> Column:
    """array<struct<s, e>>: leftmost matches of a pattern in a text, 0-based, end exclusive.

    Functions return no positions, so the text is cut at its matches: lengths of what is between and of the matches add up to them.
    """
    found, between = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
    none = F.array().cast("array<struct<s:int,e:int>>")
    step = lambda acc, x: F.struct(
        (acc["at"] + F.length(x["b"]) + F.length(x["f"])).alias("at"),
        F.array_append(acc["spans"], F.struct((acc["at"] + F.length(x["b"])).alias("s"), (acc["at"] + F.length(x["b"]) + F.length(x["f"])).alias("e"))).alias("spans"),
    )
    pairs = F.filter(F.arrays_zip(found.alias("f"), between.alias("b")), lambda x: x["f"].isNotNull())
    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])


def first_caps(s: Column) -> Column:
    """s with a capital first letter."""
    return F.concat(F.upper(F.left(s, F.lit(1))), F.substring(s, 2, 1 << 30))


def initials(name: Column) -> Column:
    """First letters of the first and last word, titles left out; ? without any."""
    words = F.filter(F.split(name, r"\s+"), lambda w: (w != "") & ~F.lower(w).isin("dr", "dr.", "mr", "mrs", "ms", "prof", "prof."))
    letters = F.concat(F.left(F.get(words, F.lit(0)), F.lit(1)), F.when(F.size(words) > 1, F.left(F.element_at(words, -1), F.lit(1))).otherwise(""))
    return F.upper(F.when(F.size(words) == 0, "?").otherwise(letters))


def line_at(text: Column, position: Column) -> Column:
    """The line of a text around a 0-based position, trimmed."""
    before = F.substring_index(F.left(text, position), "\n", -1)
    return F.btrim(F.concat(before, F.substring_index(F.substring(text, position + 1, F.length(text)), "\n", 1)))


def with_prior(text: Column, prior: Column) -> Column:
    """A note with the list known before it, under the header of one; blank lists add nothing."""
    head = F.concat(F.lit("Medications on Admission:\n"), F.btrim(prior), F.lit("\n\n"), text)
    return F.when(F.btrim(F.coalesce(prior, F.lit(""))) == "", text).otherwise(head)
