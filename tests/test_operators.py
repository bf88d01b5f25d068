from pyspark.sql import functions as F

from rxweave.functions import strings as S
from rxweave.operators import graph, pairs, text
from rxweave.sources import tables
from rxweave.streaming import decisions


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_names(spark):
    assert one(spark, S.norm(F.lit("  Aspirin\t EC "))) == "aspirin ec"
    assert one(spark, S.clean(F.lit("Metoprolol (Toprol) 25 mg, [tab]"))) == "metoprolol"
    assert one(spark, S.combination(F.lit("a / b + c and d"))) == ["a", "b", "c", "d"]
    assert one(spark, S.tidy(F.lit("a  \r\n\n\n\nb"))) == "a\n\nb\n"
    assert one(spark, S.csv_safe(F.lit("=1+1"))) == "'=1+1"
    assert one(spark, S.pretty(F.lit("af_pneumonia"))) == "AF Pneumonia"
    assert one(spark, S.find_all(F.lit("Ab ab xab"), "ab")) == [0, 3, 7]


def test_status_and_tiers(spark):
    p = spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "a int, b int")
    known = spark.createDataFrame([(1, 2, "Major")], "a int, b int, severity string")
    covered = spark.createDataFrame([(1, ["x"]), (2, ["x"]), (3, ["x"]), (4, ["y"])], "item int, sources array<string>")
    got = {r.b: r.status for r in pairs.pair_status(p, known, covered).collect()}
    assert got == {2: "INTERACTION", 3: "NO_KNOWN_INTERACTION", 4: "NOT_COVERED"}
    tier = lambda risk, level: one(spark, pairs.tier(F.lit(risk), F.lit(level)))
    assert [tier(0.7, "Minor"), tier(0.5, "Minor"), tier(0.499, "Minor"), tier(0.3, "Major")] == ["critical", "review", "info", "review"]


def test_reconcile(spark):
    left = spark.createDataFrame([(1, "5"), (2, "5"), (3, None)], "k int, s string")
    right = spark.createDataFrame([(2, "6"), (3, "1"), (4, "1")], "k int, s string")
    assert {r.k: r.kind for r in pairs.reconcile(left, right, ["k"], "s").collect()} == {1: "omission", 2: "change", 3: "same", 4: "new"}


def test_graph(spark):
    edges = graph.adjacency(spark.createDataFrame([("A", "B"), ("A", "C"), ("B", "C")], "a string, b string"))
    r = graph.link_features(edges, spark.createDataFrame([("A", "B")], "a string, b string")).first()
    assert (r.degree_a, r.degree_b, r.common) == (1, 1, 1)
    rows = spark.createDataFrame([("A", "B", "D$t"), ("A", "C", "B$t"), ("A", "C", "x")], "d1 string, d2 string, neg string")
    made = graph.negatives(rows, spark.createDataFrame([("A", "B"), ("A", "C")], "a string, b string"))
    assert [(r.a, r.b) for r in made.collect()] == [("A", "D")]
    links = spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "a int, b int")
    assert {r.node: r.root for r in pairs.components(links).collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5}


def test_lines_and_spans(spark):
    notes = spark.createDataFrame([(1, "ab\nc\n")], "note_id int, text string")
    assert [(r.line_no, r.start, r.line) for r in text.lines(notes).orderBy("line_no").collect()] == [(0, 0, "ab"), (1, 3, "c"), (2, 5, "")]
    spans = F.array(*(F.struct(F.lit(s).alias("s"), F.lit(e).alias("e")) for s, e in ((0, 1), (0, 2), (1, 3), (2, 3))))
    assert [tuple(x) for x in one(spark, text.longest_matches(spans))] == [(0, 2), (2, 3)]


def test_standoff(spark):
    ann = "T1\tDrug 0 4\taspi\nrin\nT2\tDose 5 6;8 9\tx y\n#1\tnote\nR1\tDose-Drug Arg1:T2 Arg2:T1\n"
    entities, relations = tables.standoff(spark.createDataFrame([(1, ann)], "note_id int, ann string"))
    got = {r.id: (r.type, r.start, r.end, r.text) for r in entities.collect()}
    assert got == {"T1": ("Drug", 0, 4, "aspi\nrin"), "T2": ("Dose", 5, 9, "x y")}
    assert [(r.type, r.arg1, r.arg2) for r in relations.collect()] == [("Dose-Drug", "T2", "T1")]


def test_decoding(spark):
    rows = spark.createDataFrame([(bytearray(b"\xef\xbb\xbfabc"),), (bytearray(b"caf\xe9"),)], "content binary")
    assert [r.x for r in rows.select(tables.decoded(F.col("content")).alias("x")).collect()] == ["abc", "café"]


def test_stream_ends_like_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = decisions.per_day(decisions.arriving(spark, str(tmp_path / "in"), events.schema, 1), "60 days")
    decisions.run_to_end(stream, f"file://{tmp_path}/out", str(tmp_path / "check"))
    batch = {r.day: r.n for r in events.groupBy(F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n")).collect()}
    settled = {r.day: r.n for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert settled.items() <= batch.items()  # days within the watermark stay open
