"""Stored tables with versions, documents, corrections, banks of examples."""

import json
from collections import Counter, defaultdict
from math import log, sqrt

import pytest
from pyspark.sql import functions as F

from rxweave.operators import corrections, examples
from rxweave.sources import store


def test_versions(spark, tmp_path):
    folder = f"file://{tmp_path}/kb"
    rows = lambda n: spark.range(n).select(F.col("id").alias("a"), (F.col("id") * 2).alias("b"))
    with pytest.raises(FileNotFoundError, match="build_kb"):
        store.current(spark, folder, "run build_kb")
    first = store.publish({"pairs": rows(5)}, folder, {"pairs": ["a", "b"]}, parts=2)
    reader = store.load(spark, folder, "pairs")
    second = store.publish({"pairs": rows(9)}, folder, {"pairs": ["a", "b"]}, parts=2)
    assert first != second and store.load(spark, folder, "pairs").count() == 9 and reader.count() == 5
    assert store.load(spark, folder, "pairs", first).count() == 5 and [tuple(r) for r in store.counts(spark, folder).collect()] == [("pairs", 9)]
    assert store.retire(spark, folder) == 1 and store.load(spark, folder, "pairs").count() == 9


def test_a_writer_that_stops_leaves_the_old_version(spark, tmp_path):
    folder = f"file://{tmp_path}/kb"
    store.publish({"pairs": spark.range(5)}, folder)
    with pytest.raises(Exception, match="boom"):
        store.publish({"pairs": spark.range(9), "more": spark.range(3).select(F.raise_error(F.lit("boom")).alias("x"))}, folder)
    assert store.load(spark, folder, "pairs").count() == 5 and store.current(spark, folder)["tables"] == ["pairs"]


def test_documents(spark, tmp_path):
    folder = f"file://{tmp_path}/lexicon"
    rows = spark.createDataFrame([("aspirin", ["a", "é"], None), ("none", None, 2.5)], "surface string, targets array<string>, score double")
    with pytest.raises(FileNotFoundError, match="build it"):
        store.load_document(spark, folder)
    store.save_document(rows, folder)
    assert sorted(map(tuple, store.load_document(spark, folder).collect())) == sorted(map(tuple, rows.collect()))


def test_corrections(spark, tmp_path):
    folder = f"file://{tmp_path}/corrections"
    kind = "id long, note_hash string, original array<struct<raw:string,status:string>>, corrected string, reviewer string, case_id string, note_text string"
    rows = lambda *r: spark.createDataFrame(list(r), kind).withColumn("ts", F.timestamp_seconds("id").cast("timestamp_ntz"))
    one = (1, "h", [("a", "active")], json.dumps([{"raw": "ä", "status": "held"}]), " r ", None, "text")
    assert corrections.record(rows(one, (2, "g", [], "[]", "s", "c", None)), folder, "w", 0)
    assert corrections.record(rows((3, "h", None, '[{"raw": "b"}]', "r", None, None)), folder, "w", 1) and not corrections.record(rows((3, "h", None, "[]", "r", None, None)), folder, "w", 1)
    for bad in ((4, "h", [], "[]", " ", None, None), (4, None, [], "[]", "r", None, None)):
        with pytest.raises(ValueError, match="correction 4"):
            corrections.record(rows(bad), folder)
    found = corrections.entries(spark, folder, "raw string, status string")
    got = {r.id: r for r in found.collect()}
    assert sorted(got) == [1, 2, 3] and got[1].reviewer == "r" and got[1].corrected[0].raw == "ä" and got[1].original[0].status == "active" and got[3].original is None
    assert {r.note_hash: r.id for r in corrections.latest(found).collect()} == {"h": 3, "g": 2}


def plain_bank(text, drugs, attributes, lines):
    starts, out = [0], []
    for line in text.split("\n")[:-1]:
        starts.append(starts[-1] + len(line) + 1)
    for piece, i in enumerate(range(0, len(starts), lines)):
        lo, hi = starts[i], starts[i + lines] if i + lines < len(starts) else len(text)
        rows = []
        for no, s, e, drug in drugs:
            if lo <= s and e <= hi:
                own = {k: v for n, k, vs, ve, v in attributes if n == no and lo <= vs and ve <= hi}
                rows.append([drug, *(own.get(c, "") for c in examples.COLUMNS), ""])
        if rows and text[lo:hi].strip():
            out.append((piece, text[lo:hi].strip(), rows))
    return out


def test_bank(spark):
    text = "".join(f"{i}. drug{i} {i} mg\n" + "filler line that goes on " * (i % 9) + "\n" for i in range(60)) + "drug0 again"
    drugs, attributes = [], []
    for i in range(60):
        s = text.index(f"{i}. drug{i} ") + len(f"{i}. ")
        drugs.append((i, s, s + len(f"drug{i}"), f"drug{i}"))
        attributes += [(i, "Strength", s + len(f"drug{i} "), s + len(f"drug{i} {i} mg"), f"{i} mg"), (i, "Form", s + 40, s + 44, text[s + 40 : s + 44])]
    drugs.append((60, text.index("drug0 again"), len(text) - 6, "drug0"))
    frames = spark.createDataFrame([(1, text), (2, "no drug\nhere"), (3, "")], "note_id long, text string"), spark.createDataFrame([(1, *d) for d in drugs], "note_id long, no int, drug_s int, drug_e int, drug string"), spark.createDataFrame([(1, *a) for a in attributes], "note_id long, no int, kind string, value_s int, value_e int, value string")
    for lines in (1, 3, 8):
        got = examples.bank(*frames, lines).collect()
        assert sorted((r.piece, r.text, r.rows) for r in got) == plain_bank(text, drugs, attributes, lines) and {r.note_id for r in got} == {1}
    assert examples.bank(frames[0].limit(0), frames[1].limit(0), frames[2].limit(0)).count() == 0


def test_corrections_bank(spark):
    kind = "note_id long, text string, meds array<struct<name:string,raw:string,values:map<string,string>,status:string>>"
    rows = spark.createDataFrame([(4, " ", [("d", "d", {}, "")]), (1, "", [("a", "A 5", {"Strength": "5 mg"}, "held"), (None, "b", {}, None)]), (2, "text ", [("c", None, {"Route": "PO"}, "")]), (3, "t", [])], kind)
    got = {r.note_id: (r.text, r.rows) for r in examples.corrections_bank(rows).collect()}
    assert got == {1: ("A 5\nb", [["a", "5 mg", "", "", "", "", "", "held"], ["b", "", "", "", "", "", "", ""]]), 2: ("text", [["c", "", "", "", "PO", "", "", ""]])}


def test_few_shot(spark):
    """Against a plain search over all pairs."""
    words = "aspirin warfarin daily held tablet mg home given twice note".split()
    texts = {i: " ".join(words[(i * j) % (3 + i % 8)] for j in range(1, 6 + i % 5)) for i in range(24)}
    bank = spark.createDataFrame([(i, 0, t, [["d", "", "", "", "", "", "", str(i)]]) for i, t in texts.items() if i % 3], "note_id long, piece int, text string, rows array<array<string>>")
    asked = spark.createDataFrame([(i, 0, t) for i, t in texts.items() if i % 4 == 0], "note_id long, piece int, text string")
    terms = {i: Counter([*(w := t.split()), *(f"{a} {b}" for a, b in zip(w, w[1:]))]) for i, t in texts.items() if i % 3 or i % 4 == 0}
    df = Counter(x for t in terms.values() for x in t)
    n, weights = len(terms), {}
    for i, t in terms.items():
        v = {x: (1 + log(c)) * (log((1 + n) / (1 + df[x])) + 1) for x, c in t.items() if df[x] >= 2}
        size = sqrt(sum(x * x for x in v.values()))
        weights[i] = {x: y / size for x, y in v.items()}
    got = {r.note_id: r.messages for r in examples.few_shot(asked, bank, "sys", 2).collect()}
    assert set(got) == {i for i in texts if i % 4 == 0}
    for i, messages in got.items():
        scores = defaultdict(float)
        for j in terms:
            if j % 3 and j != i:
                scores[j] = sum(y * weights[j].get(x, 0) for x, y in weights[i].items())
        best = sorted((j for j in scores if scores[j] > 0), key=lambda j: (-round(scores[j], 9), j))[:2]
        assert [m.role for m in messages] == ["system", *["user", "assistant"] * len(best), "user"] and messages[-1].content == texts[i]
        assert [json.loads(m.content)["meds"][0][7] for m in messages[2:-1:2]] == [str(j) for j in best]


def test_modes_of_extraction(spark):
    from rxweave.operators import extraction as X

    notes = spark.createDataFrame([(1, [(90, 120)], True), (2, [], False)], "note_id int, labs array<struct<s:int,e:int>>, available boolean")
    model = spark.createDataFrame([(1, 0, 10, "llm"), (1, 30, 40, "propagated"), (2, 0, 10, "llm")], "note_id int, s int, e int, source string")
    entities = spark.createDataFrame([(1, 5, 35, "aspirin x"), (1, 50, 57, "aspirin"), (1, 52, 60, "aspirin"), (1, 70, 75, "patient"), (1, 100, 107, "aspirin"), (2, 0, 7, "aspirin")], "note_id int, s int, e int, name string")
    dictionary = spark.createDataFrame([(1, 56, 66), (1, 80, 88), (2, 0, 7), (2, 20, 27)], "note_id int, s int, e int")
    drugs = spark.createDataFrame([("aspirin",)], "name string")
    got = lambda mode: {(r.note_id, r.s, r.mode): "+".join(r.sources) for r in X.combined(notes, model, entities, dictionary, drugs, mode).collect()}
    fallback = {(2, 0, "rules"): "scispacy", (2, 20, "rules"): "dictionary"}
    assert got("llm") == {(1, 0, "llm"): "llm+scispacy", (1, 30, "llm"): "propagated"} | fallback
    assert got("hybrid") == {(1, 0, "hybrid"): "llm+scispacy", (1, 30, "hybrid"): "propagated", (1, 50, "hybrid"): "scispacy", (1, 80, "hybrid"): "dictionary"} | fallback
    assert got("scispacy") == {(1, 50, "scispacy"): "scispacy", (2, 0, "scispacy"): "scispacy"}
    assert got("rules") == {(1, 50, "rules"): "scispacy", (1, 80, "rules"): "dictionary"} | fallback
    with pytest.raises(ValueError, match="mode"):
        X.combined(notes, model, entities, dictionary, drugs, "all")
    values = lambda *r: spark.createDataFrame([(1, 1, *x) for x in r], "note_id int, no int, kind string, value string")
    own, ruled = values(("Strength", "5 mg"), ("Dosage", "two"), ("Route", "PO")), values(("Strength", "6 mg"), ("Route", "IV"), ("Form", "Tablet"))
    merged = lambda mode: {r.kind: (r.value, r.source) for r in X.merged_attributes(own, ruled, mode).collect()}
    assert merged("hybrid") == {"Strength": ("5 mg", "llm"), "Route": ("IV", "rules"), "Form": ("Tablet", "rules")}
    assert merged("llm") == {"Strength": ("5 mg", "llm"), "Dosage": ("two", "llm"), "Route": ("PO", "llm")} and set(merged("rules")) == {"Strength", "Route", "Form"}
