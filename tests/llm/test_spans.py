"""Positions in texts against plain search: many matches, long texts, marks in the text, characters outside the basic plane."""

import base64
import random
import re
import sys
from pathlib import Path

from pyspark.sql import functions as F

from rxweave.llm import pii, secrets, spans

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402


def test_matches(spark):
    random.seed(8)
    texts = ["", "a", "\x00", "a1\x00b22", "🦆1 22🦆", *("".join(random.choices("ab12 🦆é\x00\n", k=random.randrange(0, 900))) for _ in range(60)), *("".join(random.choices("ab12 🦆é\n", k=1500)) for _ in range(20))]
    pattern = r"(?<!b)[0-9]+(?=[^1])"
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", spans.matches(F.col("t"), pattern).alias("x"), spans.pieces(F.col("t")).alias("p")).collect()
    for r in rows:
        assert [tuple(m) for m in r.x] == [(m.group(), m.start(), m.end()) for m in re.finditer(pattern, texts[r.i])]
        assert "".join(r.p) == texts[r.i] and all(len(p) == spans.PIECE for p in r.p[:-1])


def test_running_sums_and_cuts(spark):
    for n in (0, 1, 255, 256, 257, 1500):
        got = spark.range(1).select(spans.running(F.transform(F.sequence(F.lit(1), F.lit(n + 1)), lambda i: i * 2)).alias("x")).first().x
        assert got == [i * (i + 1) for i in range(n + 1)]
    text = "".join(chr(97 + i % 26) for i in range(700)) + "🦆"
    places = [0, 1, 255, 256, 300, 511, 512, 699, 700, 701]
    row = spark.createDataFrame([(text,)], "t string").select(*(spans.cut_out(spans.pieces(F.col("t")), F.lit(i), 40).alias(f"c{i}") for i in places)).first()
    assert [row[f"c{i}"] for i in places] == [text[i : i + 40] for i in places]


def test_many_matches_in_one_text(spark):
    """Thousands of addresses and numbers in one text, and an inlined image: the same spans as plain code."""
    text = " ".join(f"10.{i % 300}.{i // 256}.{i % 200} a{i}@b{i}.org +1 212 555 {1000 + i % 9000}" for i in range(4000))
    found = pii.candidates(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    want = brute.base_spans(text)
    for kind in pii.KINDS:
        assert [(c.s, c.e) for c in found[kind] if c.base] == want[kind]
    random.seed(9)
    image = base64.b64encode(random.randbytes(60_000)).decode()
    got = secrets.candidates(spark.createDataFrame([(1, f"img = {image} end"), (2, "x" * 100_000)], "doc_id long, text string"), None).collect()
    assert {(r.doc_id, r.start_at, r.end_at) for r in got} == {(1, 6, 6 + len(image)), (2, 0, 100_000)} and all(0 <= r.covered <= 1 for r in got)
