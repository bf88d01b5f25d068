"""Secret scans: candidates by pattern, false positives removed by a random forest.  Built-in functions and Spark's own forest.

A candidate is what follows a secret's name and a sign, if it has 6 or more characters, or else a run of 16 or more key
characters; a name before "=" is not part of it.  The forest sees its length, how its characters follow each other (turns between
classes, and how likely its letters follow each other in the dictionary), how much of it dictionary words cover, the path it came from and
the words beside it, weighed by how often the labelled findings have them beside real secrets.  It is trained on labelled findings.
The dictionary is counted over all texts.  Scanning is a map over documents; words are counted before they are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import pairwise
from math import log

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, let, table
from .spans import cut_out, matches, pieces

RUN = r"[A-Za-z0-9+/_-]{16,}+={0,2}"
#: What stands before a candidate in a match: a secret's name and a sign, or any name and "="; tried at the begin of a word only.
NAMED = r"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9_-]*+[\"']?[\x20\t]*[:=])[A-Za-z0-9_-]*?(?i:key|token|secret|passw(?:or)?d|pwd|credential|bearer|authorization)[\"']?[\x20\t]*(?::=|=>|[:=])[\x20\t]*[\"']?"
ANY_NAME = r"(?<![A-Za-z0-9_-])[A-Za-z_][A-Za-z0-9_-]*+=[\"']?"
VALUE = r"[^\s\"'`<>(){}\[\],;=:][^\s\"'`<>(){}\[\],;]{4,}[^\s\"'`<>(){}\[\],;.:]"
CANDIDATE = f"{NAMED}{VALUE}|{ANY_NAME}{RUN}|{RUN}"
#: Group 1 of a match is the candidate.
CUT = f"^(?:{NAMED}(?={VALUE}$)|{ANY_NAME}(?={RUN}$)|)(.*)$"
BESIDE = 40
TREES, DEPTH, SEED = 40, 6, 11
#: Rows of labelled_findings, the bounded set that a forest is trained on where the caller has none of their own.
LABELLED = 6000
#: Words of the dictionary, the most frequent ones of all texts, their letters at least and at most, and those that are there in any case.
WORDS, WORD_LETTERS = 4000, (4, 12)
DICTIONARY = (
    "about", "access", "account", "admin", "after", "and", "build", "change", "class", "client", "config", "content", "data", "default",
    "demo", "document", "example", "file", "for", "from", "have", "here", "image", "index", "item", "key", "library", "link", "list", "local",
    "main", "message", "name", "number", "object", "online", "order", "page", "part", "path", "place", "product", "public", "question", "report",
    "sample", "section", "server", "service", "shared", "source", "string", "system", "table", "test", "that", "the", "this", "time", "tion",
    "token", "type", "user", "value", "version", "with", "world", "your",
)
#: Words beside, and of paths, that are weighed.
WEIGHED = 200
NAMES = r"(?i)(?:api|access|auth|private|secret|client)?[_\x20-]?(?:key|token|secret|passw(?:or)?d|pwd|credential|bearer|authorization)\b"
OTHER_NAMES = r"(?i)\b(?:sha-?(?:1|256|512)?|md5|checksum|digest|commit|revision|hash|uuid|guid|etag|integrity|isbn|order|invoice|card|tracking|session_id|id)\b"
TRIAL_PATH = r"(?i)(?:^|[/_.-])(?:test|tests|spec|fixture|fixtures|example|examples|sample|mock|doc|docs|lock|vendor)(?:[/_.-]|$)"
FEATURES = (
    "length", "digits", "uppers", "symbols", "turns", "letter_digit_turns", "case_turns", "vowel_turns", "distinct", "longest_digits",
    "hex_only", "covered", "followed", "named", "other_named", "assigned", "quoted", "trial_path", "has_prefix", "beside_odds", "path_odds",
)


@dataclass(frozen=True)
class Background:
    """What candidates are held against: dictionary words, log-probabilities of one letter after another, and log-odds of words beside and of paths."""

    words: tuple[str, ...] = DICTIONARY
    follows: tuple[float, ...] = ()
    beside: dict[str, float] = field(default_factory=dict)
    paths: dict[str, float] = field(default_factory=dict)


@dataclass(frozen=True)
class Scanner:
    background: Background
    forest: PipelineModel


def dictionary(docs: DataFrame, size: int = WORDS) -> tuple[str, ...]:
    """The most frequent words of all texts, in lower case, and DICTIONARY; size bounds what comes to the driver."""
    least, most = WORD_LETTERS
    found = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(rf"(?<![a-z0-9])[a-z]{{{least},{most}}}(?![a-z0-9])"), F.lit(0))
    counted = docs.select(F.explode(found).alias("w")).groupBy("w").agg(F.count("*").alias("n")).filter("n > 1")
    top = counted.orderBy(F.desc("n"), "w").limit(size).collect()
    return tuple(sorted({r.w for r in top} | set(DICTIONARY)))


def letter_chances(words: tuple[str, ...]) -> tuple[float, ...]:
    """Natural logarithms of P(next letter | letter) in a list of words, with one more of each pair, for a-z by a-z."""
    counts = [[1.0] * 26 for _ in range(26)]
    for w in words:
        for x, y in pairwise(w):
            counts[ord(x) - 97][ord(y) - 97] += 1
    return tuple(log(c / sum(row)) for row in counts for c in row)


def word_odds(findings: DataFrame, texts: Column, most: int = WEIGHED) -> dict[str, float]:
    """Log-odds of each word of an array for real findings, those that are found often and say most; a bounded list."""
    rows = findings.select("label", F.explode(F.array_distinct(texts)).alias("w")).groupBy("w").agg(F.sum("label").alias("real"), F.count("*").alias("n"))
    total = findings.agg(F.sum("label").alias("all_real"), F.count("*").alias("all")).first()
    odds = F.log((F.col("real") + 1) / (F.col("n") - F.col("real") + 1)) - F.lit(log(((total.all_real or 0) + 1) / ((total["all"] or 0) - (total.all_real or 0) + 1)))
    top = rows.withColumn("odds", odds).filter("n >= 5").orderBy(F.desc(F.abs("odds")), "w").limit(most)
    return {r.w: float(r.odds) for r in top.collect()}


def words_beside(before: Column, after: Column) -> Column:
    """The last three words before a candidate and the first two after it, in lower case."""
    words = lambda t: F.regexp_extract_all(F.lower(t), F.lit("[a-z]{2,}"), F.lit(0))
    last = words(before)
    return F.concat(F.slice(last, F.greatest(F.size(last) - 2, F.lit(1)), 3), F.slice(words(after), 1, 2))


def path_words(path: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(path.cast("string"), F.lit(""))), F.lit("[a-z]+"), F.lit(0))


def summed(words: Column, odds: dict[str, float]) -> Column:
    """The sum of the odds of an array's words; words without any count nothing."""
    if not odds:
        return F.lit(0.0)
    table = F.create_map(*(F.lit(x) for pair in odds.items() for x in pair))
    return F.aggregate(words, F.lit(0.0), lambda acc, w: acc + F.coalesce(F.try_element_at(table, w), F.lit(0.0)))


def covered(m: Column, words: tuple[str, ...]) -> Column:
    """The share of a candidate's characters that dictionary words cover, the longest at each place."""
    least, most = WORD_LETTERS
    known = tuple(w for w in words if least <= len(w) <= most)

    def at(gram: Column, i: Column, n: Column) -> Column:
        sizes = F.filter(F.sequence(F.lit(least), F.lit(most)), lambda k: F.left(gram, k).isin(*known))
        # A word cut off by the end is shorter than asked for, and found with its own length as well.
        return F.struct(i.alias("b"), F.least(F.coalesce(F.array_max(sizes), F.lit(0)), n - i).alias("k"))

    def share(x: Column) -> Column:
        parts, n = x["parts"], x["n"]
        # What begins at each place, as far as a word may reach.
        places = F.transform(F.sequence(F.lit(0), n - 1), lambda i: let(cut_out(parts, i, most), lambda gram: at(gram, i, n)))
        step = lambda acc, p: F.struct((acc["n"] + F.greatest(F.lit(0), p["b"] + p["k"] - F.greatest(acc["end"], p["b"]))).alias("n"), F.greatest(acc["end"], p["b"] + p["k"]).alias("end"))
        return F.aggregate(F.filter(places, lambda p: p["k"] > 0), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda acc: acc["n"]) / n

    return let(F.struct(pieces(F.lower(m)).alias("parts"), F.length(m).alias("n")), share)


def followed(m: Column, follows: tuple[float, ...]) -> Column:
    """The mean log-probability of a candidate's letters after each other; 0 without two letters in a row."""
    if not follows:
        return F.lit(0.0)
    table = F.array(*map(F.lit, follows))
    pairs = F.regexp_extract_all(F.lower(m), F.lit("(?=([a-z][a-z]))"), F.lit(1))
    values = F.transform(pairs, lambda p: F.get(table, (F.ascii(p) - 97) * 26 + F.ascii(F.substring(p, 2, 1)) - 97))
    return F.coalesce(F.try_divide(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x), F.size(values)), F.lit(0.0))


def features(m: Column, before: Column, after: Column, path: Column, known: Background) -> dict[str, Column]:
    """The forest's inputs for a candidate m between the texts before and after it."""
    n = F.length(m).cast("double")
    share = lambda pattern: F.regexp_count(m, F.lit(pattern)) / n
    path = F.coalesce(path.cast("string"), F.lit(""))
    runs = F.transform(F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0)), lambda r: F.length(r))
    flag = lambda c: c.cast("double")
    return {
        "length": n,
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "symbols": share("[+/=_-]"),
        "turns": share("(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])"),
        "letter_digit_turns": share("(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"),
        "case_turns": share("(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"),
        "vowel_turns": share("(?i)(?<=[aeiou])(?=[b-df-hj-np-tv-z])"),
        "distinct": F.size(F.array_distinct(F.split(m, ""))) / n,
        "longest_digits": F.coalesce(F.array_max(runs), F.lit(0)) / n,
        "hex_only": flag(m.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "covered": covered(m, known.words),
        "followed": followed(m, known.follows),
        "named": flag(before.rlike(NAMES)),
        "other_named": flag(before.rlike(OTHER_NAMES)),
        "assigned": flag(before.rlike(r"[:=][\x20\t]*[\"']?$")),
        "quoted": flag(before.rlike("[\"']$") & after.rlike("^[\"']")),
        "trial_path": flag(path.rlike(TRIAL_PATH)),
        "has_prefix": flag(m.rlike("^(?:AKIA|ASIA|ghp_|gho_|sk_live_|sk-|xox[abp]-|AIza|eyJ|glpat-)")),
        "beside_odds": summed(words_beside(before, after), known.beside),
        "path_odds": summed(path_words(path), known.paths),
    }


def _found(docs: DataFrame, path: str | None) -> DataFrame:
    """(doc_id, path, start_at, end_at, candidate, before, after), one row per candidate."""
    text = F.coalesce(F.col("text"), F.lit(""))
    named = F.transform(matches(text, CANDIDATE), lambda m: F.struct(m["e"].alias("e"), F.regexp_extract(m["m"], CUT, 1).alias("c")))

    def beside(parts: Column) -> Column:
        return F.transform(named, lambda m: let(m["e"] - F.length(m["c"]), lambda s: F.struct(
            s.alias("start_at"), m["e"].alias("end_at"), m["c"].alias("candidate"),
            cut_out(parts, F.greatest(s - BESIDE, F.lit(0)), F.least(s, F.lit(BESIDE))).alias("before"), cut_out(parts, m["e"], BESIDE).alias("after"),
        )))

    place = F.col(path) if path else F.lit("")
    return docs.filter(text.rlike(CANDIDATE)).select("doc_id", place.alias("path"), F.explode(let(pieces(text), beside)).alias("c")).select("doc_id", "path", "c.*")


def candidates(docs: DataFrame, path: str | None, known: Background | None = None) -> DataFrame:
    """(doc_id, start_at, end_at, candidate, and its features), one row per candidate; code points, end exclusive.  Null texts have none."""
    return _with_features(_found(docs, path), known or Background()).drop("before", "after", "path")


def _with_features(rows: DataFrame, known: Background) -> DataFrame:
    return rows.withColumns(features(F.col("candidate"), F.col("before"), F.col("after"), F.col("path"), known))


def labelled_findings(spark: SparkSession, rows: int = LABELLED) -> DataFrame:
    """(path, before, candidate, after, label): what the scan finds in made lines, one value in each, half of them real, by a fixed rule.

    Real ones are random hexadecimal, base 64 or prefixed strings, strings of letters alone and short passwords, most of them assigned
    to a name; the others are digests with names such as commit, UUIDs, long numbers, joined words, repeated characters, placeholders
    and single words.  What is found beside a real value is false.  Callers with
    labelled findings of their own pass a table of this form instead.
    """
    pick = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(n)).cast("int")
    choose = lambda salt, values: F.get(F.array(*map(F.lit, values)), pick(salt, len(values)))
    hexes = F.sha2(F.concat(F.lit("h"), F.col("id").cast("string")).cast("binary"), 256)
    b64 = F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(F.lit("b"), F.col("id").cast("string")).cast("binary"), 256))), "[+/=]", "x")
    size = choose("size", (20, 24, 32, 36, 40))
    kind = pick("kind", 9)
    word = lambda k: choose(f"word{k}", DICTIONARY)
    real = (
        F.when(kind <= 1, F.substring(hexes, F.lit(1), choose("hex", (32, 40, 40, 48, 64))))
        .when(kind == 2, F.upper(F.substring(hexes, 1, 40)))
        .when(kind == 3, F.substring(b64, F.lit(1), size))
        .when(kind == 4, F.concat(choose("prefix", ("AKIA", "ghp_", "sk_live_", "xoxb-", "AIza", "glpat-")), F.substring(b64, F.lit(1), size)))
        .when(kind == 5, F.concat(F.substring(b64, 1, 20), choose("join", ("", "-", "_")), F.substring(hexes, 1, 12)))
        .when(kind == 6, F.substring(F.translate(b64, "0123456789", "qWzKxVjTbN"), F.lit(1), size))
        .otherwise(F.concat(F.substring(b64, F.lit(1), choose("short", (4, 5, 6, 8))), choose("mark", (".", "!", "@", "#", "-", "$")), F.substring(b64, F.lit(20), choose("rest", (3, 4, 6)))))
    )
    uuid = F.concat_ws("-", *(F.substring(hexes, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    digits = F.regexp_replace(F.concat(F.col("id").cast("string"), F.conv(F.substring(hexes, 1, 14), 16, 10)), "[^0-9]", "")
    joint = choose("joint", ("", "-", "_", "/"))
    false = (
        F.when(kind == 0, F.substring(hexes, F.lit(1), choose("hex", (32, 40, 40, 64))))
        .when(kind == 1, uuid)
        .when(kind == 2, F.rpad(digits, 16, "7"))
        .when(kind == 3, F.concat(word(1), joint, word(2), joint, word(3), joint, word(4), joint, pick("no", 100).cast("string")))
        .when(kind == 4, F.concat(F.repeat(choose("char", ("x", "0", "A", "1", "-", "=")), 16), pick("no", 1000).cast("string")))
        .when(kind == 6, F.concat(F.initcap(word(1)), F.initcap(word(2)), F.initcap(word(3)), F.initcap(word(9))))
        .when(kind == 7, F.concat(word(1), choose("mark", ("", ".", "-", "_")), word(2)))
        .when(kind == 8, choose("empty", ("changeme", "required", "password", "undefined", "optional", "your-password", "example", "another", "somewhere", "********")))
        .otherwise(F.concat(choose("stub", ("YOUR_API_KEY_", "example_token_", "changeme-changeme-", "INSERT-KEY-HERE-")), pick("no", 1000).cast("string"), F.lit("_example")))
    )
    is_real = F.col("id") % 2 == 0
    name = choose("name", ("token", "api_key", "secret", "password", "access_key", "auth token", "client_secret"))
    sign = choose("sign", (" = \"", ": \"", "=", ": ", "=\"", " = '"))
    filler = F.concat_ws(" ", word(5), word(6), word(7))
    other = choose("other", ("commit ", "sha256:", "md5 ", "checksum: ", "uuid=", "revision ", "etag: \"", "order ", ""))
    bare = (pick("bare", 10) < 2) & (kind < 7)
    before = F.when(is_real, F.concat(filler, F.lit(" "), F.when(bare, F.lit("")).otherwise(F.concat(name, sign)))).otherwise(
        # Some placeholders and words are assigned to names as well; digests are not, for there the name decides.
        F.concat(filler, F.lit(" "), F.when((kind >= 7) | ((kind >= 3) & (pick("assign", 2) == 0)), F.concat(name, sign)).when(kind <= 1, F.when(other == "", F.lit("commit ")).otherwise(other)).otherwise(F.lit("")))
    )
    after = F.concat(F.regexp_extract(before, "([\"'])$", 1), F.lit(" "), word(8))
    path = F.when(pick("path", 10) < F.when(is_real, 1).otherwise(4), choose("trial", ("tests/data", "docs/readme", "examples/a", "yarn.lock"))).otherwise(choose("src", ("src/main", "web", "conf/app", "")))
    value = F.when(is_real, real).otherwise(false)
    made = spark.range(rows).select(F.struct(value.alias("value"), is_real.alias("is_real")).alias("doc_id"), path.alias("path"), F.concat(before, value, after).alias("text"))
    label = (F.col("doc_id.is_real") & (F.col("candidate") == F.col("doc_id.value"))).cast("double")
    return _found(made, "path").select("path", "before", "candidate", "after", label.alias("label"))


def train(findings: DataFrame, words: tuple[str, ...] = DICTIONARY, trees: int = TREES, depth: int = DEPTH) -> Scanner:
    """A scanner from labelled findings (path, before, candidate, after, label); null texts count as empty and rows without a label are left out."""
    filled = cut(findings.filter("label in (0, 1)").na.fill("", ["path", "before", "candidate", "after"]).filter("candidate <> ''"))
    odds = [word_odds(filled, texts) for texts in (words_beside(F.col("before"), F.col("after")), path_words(F.col("path")))]
    known = Background(words, letter_chances(words), *odds)
    rows = _with_features(filled, known).select(*FEATURES, F.col("label").cast("double").alias("label"))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED, featuresCol="inputs")
    return Scanner(known, Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="inputs"), forest]).fit(rows))


def scan(docs: DataFrame, scanner: Scanner, path: str | None = None, least: float = 0.5) -> DataFrame:
    """(doc_id, start_at, end_at, candidate, score, is_secret), one row per candidate of docs (doc_id, text).

    path names a column with the place of a document, if there is one.  Repeated rows and ties give repeated results; an
    empty table, null and empty texts give none.  Texts of any length are scanned whole.  Other columns are not read.
    """
    scored = scanner.forest.transform(candidates(docs, path, scanner.background))
    score = vector_to_array("probability")[1]
    return scored.select("doc_id", "start_at", "end_at", "candidate", score.alias("score"), (score >= least).alias("is_secret"))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    found = scan(docs, train(labelled_findings(spark), dictionary(docs)), path="source")
    return found.select("doc_id", "start_at", "end_at", F.sha2(F.col("candidate").cast("binary"), 256).alias("candidate_sha256"), F.round("score", 6).alias("score"), "is_secret")
