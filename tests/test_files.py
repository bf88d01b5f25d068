"""Files as uploaded and exported, and logs as streams."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from rxweave.operators import graph
from rxweave.sources import files
from rxweave.streaming import decisions

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def document(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def test_uploads(spark):
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    table = f"<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}{p('c')}</w:tc></w:tr></w:tbl>"
    rows = [("n.docx", document(p("First") + table + p("Last"))), ("bad.docx", b"no zip"), ("t.TXT", b"caf\xe9 \r\n\r\n\r\n\r\nx"), ("e.txt", b"  \n"), ("x.exe", b"1"), ("p.pdf", b"%PDF-1.4"), ("big.txt", b"y" * 5000)]
    got = {r.name: (r.text, r.error) for r in files.notes_of(spark.createDataFrame(rows, "name string, content binary"), 4000).collect()}
    assert got["n.docx"] == ("First\na\tb c\nLast\n", None) and got["bad.docx"] == (None, "not readable") and got["t.TXT"] == ("café\n\nx\n", None)
    assert [got[n][1] for n in ("e.txt", "x.exe", "big.txt")] == ["empty", "unsupported", "too large"] and got["p.pdf"][0] is None and got["p.pdf"][1]


def test_archives_of_notes(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "train.zip", "w") as z:
        for name, text in {"d/2.txt": "two", "d/2.ann": "T1\tDrug 0 3\ttwo", "d/1.txt": "one", "d/1.ann": "", "d/3.txt": "alone", "__MACOSX/d/1.txt": "junk", "d/._1.txt": "junk"}.items():
            z.writestr(name, text)
    got = files.all_splits(spark, {"train": f"file://{tmp_path}/train.zip", "test": f"file://{tmp_path}/tr*.zip"}).collect()
    assert [(r.split, r.note_id, r.text) for r in got] == [("train", "1", "one"), ("train", "2", "two"), ("test", "1", "one"), ("test", "2", "two")]


def test_pipe_tables_and_folders(spark, tmp_path):
    (tmp_path / "names.rrf").write_text("1|" + "|" * 9 + "|RXNORM|IN||Aspirin  EC|\n2|" + "|" * 9 + "|OTHER|IN||x|\n")
    assert [tuple(r) for r in files.concept_names(spark, f"file://{tmp_path}/names.rrf").collect()] == [("1", "IN", "aspirin ec")]
    (tmp_path / "rel.rrf").write_text("1||||2|||form_of|||RXNORM|\n1||||3|||isa|||RXNORM|\n")
    assert [tuple(r) for r in files.concept_relations(spark, f"file://{tmp_path}/rel.rrf").collect()] == [("1", "2", "form_of")]
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes" / "af_pneumonia.txt").write_text("a\nb")
    assert [tuple(r) for r in files.whole_notes(spark, f"file://{tmp_path}/notes").collect()] == [("AF Pneumonia", "a\nb")]


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([(1, "=1+1"), (2, None), (3, 'a "b"')], "id int, cell string")
    files.export_csv(rows, "id", f"file://{tmp_path}/csv")
    back = spark.read.option("header", True).option("escape", '"').csv(f"file://{tmp_path}/csv")
    assert {(r.id, r.cell) for r in back.collect()} == {("1", "'=1+1"), ("2", None), ("3", 'a "b"')}
    files.export_json_lines(rows, f"file://{tmp_path}/json")
    assert sorted(json.loads(r.value)["id"] for r in spark.read.text(f"file://{tmp_path}/json").collect()) == [1, 2, 3]
    chunks = spark.createDataFrame([(1, 0, 10, "one two"), (1, 10, 20, "none")], "note_id int, s int, e int, text string")
    mentions = spark.createDataFrame([(1, 2, 5, ["x", ""]), (1, 9, 12, ["cut", ""])], "note_id int, s int, e int, row array<string>")
    (r,) = files.chat_examples(chunks, mentions, "be exact").collect()
    messages = json.loads(r.example)["messages"]
    assert [m["role"] for m in messages] == ["system", "user", "assistant"] and json.loads(messages[2]["content"]) == {"meds": [["x", ""]]}


def test_streams_end_like_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(f"file://{tmp_path}/in")
    stream = decisions.arriving(spark, f"file://{tmp_path}/in", events.schema, 1)
    decisions.keep_latest(stream, ["user_id"], "event_id", "event_type", f"file://{tmp_path}/latest", f"file://{tmp_path}/c1")
    want = {r.user_id: r.event_type for r in events.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("event_type")).collect()}
    assert {r.user_id: r.event_type for r in decisions.newest(spark, f"file://{tmp_path}/latest", ["user_id"], "event_id").collect()} == want


def test_signed_streams(spark, tmp_path):
    from rxweave.operators import logs

    entries = spark.createDataFrame([(i % 2, i, f"p{i}") for i in range(12)], "log int, id long, payload string").withColumn("ts", F.timestamp_seconds("id").cast("timestamp_ntz"))
    for part in range(3):
        entries.filter(F.floor(F.col("id") / 4) == part).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(entries.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    decisions.append_signed(stream, f"file://{tmp_path}/log", f"file://{tmp_path}/c")
    log = spark.read.parquet(f"file://{tmp_path}/log/entries")
    assert log.count() == 12 and [r.first_bad for r in logs.verified(log).collect()] == [None, None]
    assert {tuple(r) for r in logs.heads(log).collect()} == {tuple(r) for r in logs.heads(logs.signed(entries)).collect()}


def test_link_models(spark):
    rows = spark.range(300).select((F.col("id") % 17).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("y"), (F.col("id") % 17 > 8).cast("double").alias("label"), (F.col("id") % 10 == 0).alias("is_validation"))
    trees, plain = graph.link_models(rows, ["x", "y"], 5)
    for model in (trees, plain):
        assert model.transform(rows).filter("prediction = label").count() >= 280
    assert graph.top_inputs(trees, ["x", "y"], 1)[0][0] == "x"


def log_rows(spark, *ids):
    return spark.createDataFrame([(i % 2, i, f"p{i}") for i in ids], "log int, id long, payload string").withColumn("ts", F.timestamp_seconds("id").cast("timestamp_ntz"))


def test_replayed_batches_are_added_once(spark, tmp_path):
    from rxweave.operators import logs

    folder = f"file://{tmp_path}/log"
    assert logs.append(log_rows(spark, 0, 1, 2), folder, "stream", 0) and logs.append(log_rows(spark, 3, 4), folder, "stream", 1)
    assert not logs.append(log_rows(spark, 3, 4), folder, "stream", 1) and not logs.append(log_rows(spark, 0, 1, 2), folder, "stream", 0)
    assert logs.append(log_rows(spark, 5), folder, "other", 1)
    log = spark.read.parquet(f"{folder}/entries")
    assert sorted(r.id for r in log.collect()) == list(range(6)) and [r.first_bad for r in logs.verified(log).collect()] == [None, None]
    assert {tuple(r) for r in logs.heads(log).collect()} == {tuple(r) for r in logs.heads(logs.signed(log_rows(spark, *range(6)))).collect()}


@pytest.mark.parametrize("stop", ["commits/", "entries/", "anchors/"])
def test_stops_in_between(spark, tmp_path, monkeypatch, stop):
    """Before the commit nothing is added, and the batch can be added again; after it the rest is carried out by whoever comes next."""
    from rxweave.operators import logs

    folder, move = f"file://{tmp_path}/log", logs.Files.move
    logs.append(log_rows(spark, 0, 1), folder, "w", 0)

    def stopped(self, source, target):
        if target.startswith(stop):
            raise RuntimeError("stopped")
        move(self, source, target)

    monkeypatch.setattr(logs.Files, "move", stopped)
    with pytest.raises(RuntimeError):
        logs.append(log_rows(spark, 2, 3), folder, "w", 1)
    monkeypatch.setattr(logs.Files, "move", move)
    assert logs.append(log_rows(spark, 2, 3), folder, "w", 1) == (stop == "commits/")
    assert logs.append(log_rows(spark, 4), folder, "w", 2)
    log = spark.read.parquet(f"{folder}/entries")
    anchors = spark.read.parquet(f"{folder}/anchors").groupBy("log").agg(F.max("n").alias("n"), F.max_by("head", "n").alias("head"))
    assert sorted(r.id for r in log.collect()) == list(range(5)) and [r.first_bad for r in logs.verified(log, anchors).collect()] == [None, None]


def test_two_writers(spark, tmp_path, monkeypatch):
    """Who commits second on the same state gets an error and adds nothing."""
    from rxweave.operators import logs

    folder, names = f"file://{tmp_path}/log", logs.Files.names
    logs.append(log_rows(spark, 0, 1), folder)
    monkeypatch.setattr(logs.Files, "names", lambda self, name: [] if name == "commits" else names(self, name))
    with pytest.raises(Exception, match="AlreadyExists"):
        logs.append(log_rows(spark, 2), folder)
    monkeypatch.setattr(logs.Files, "names", names)
    assert spark.read.parquet(f"{folder}/entries").count() == 2 and logs.append(log_rows(spark, 2), folder)
