"""Whole reports and predictions: what is carried on after corrections, measures recounted from scores, features against plain sets."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rxweave.operators import analysis as A
from rxweave.operators import graph as G
from rxweave.operators import predictor as R
from rxweave.plans import analysis, prediction

DATA = "/root/testdata/sf0.001"
CONCEPTS = [(1, "warfarin", ["graded", "template"], "x"), (2, "aspirin", ["graded", "template"], "x"), (3, "metformin", ["graded"], ""), (4, "newdrug", [], "")]
PRODUCTS = [(n, [n], "mapped") for _, n, *_ in CONCEPTS] + [("bayer", ["aspirin"], "mapped"), ("oxygen", [], "non_drug"), ("both", ["warfarin", "aspirin"], "mapped")]


@pytest.fixture(scope="module")
def base(spark):
    known = spark.createDataFrame([(1, 2, "Major", None, ["graded"])], "a long, b long, level string, mechanisms array<struct<rank:int,template:string,text:string,severity:string,n_graded:bigint,share_major:double>>, record_sources array<string>")
    return spark.createDataFrame(CONCEPTS, "concept long, concept_name string, sources array<string>, home string"), known, spark.createDataFrame([], "rule_no int, side string, item string")


def corrected(spark, rows):
    products = spark.createDataFrame(PRODUCTS, "spelling string, names array<string>, norm_status string")
    return A.corrected(spark.createDataFrame(rows, "note_id long, no int, raw string, id string, status string, confidence double, in_admission boolean, in_discharge boolean, before string, after string"), products)


def report(spark, base, rows, both=True):
    lists = spark.createDataFrame([(1, both)], "note_id long, both_lists boolean")
    return A.reports(corrected(spark, rows), lists, *base)


def med(no, raw, id=None, status=None, confidence=None, adm=None, dis=None, before=None, after=None):
    return (1, no, raw, id, status, confidence, adm, dis, before, after)


def test_report_of_a_list(spark, base):
    rows = [med(0, " Warfarin ", adm=True, before="5 mg", after="2.5 MG"), med(1, "Bayer", confidence=0.5), med(2, "aspirin", adm=True, before="81 mg", after="81MG"), med(3, "newdrug"), med(4, "mystery"), med(5, "oxygen"), med(6, "  "), med(7, "metformin", status="Held", adm=True)]
    r = report(spark, base, rows).first()
    assert [m.id for m in r.medications] == ["D:aspirin", "D:aspirin_1", "T:mystery", "D:newdrug", "D:warfarin", "D:metformin"] or [m.id for m in r.medications] == ["D:aspirin_1", "D:aspirin", "T:mystery", "D:newdrug", "D:warfarin", "D:metformin"]
    found = {f.id: f for f in r.findings}
    assert set(found) == {"INT:1|2", "DUP:2", "DOSE:D:warfarin", "OMIT:D:metformin", "NEW:D:aspirin", "NEW:D:newdrug", "NEW:T:mystery", "NOT_CHECKED", "NOT_COVERED"}
    assert (found["INT:1|2"].tier, found["INT:1|2"].verify) in (("critical", False), ("review", True)) and found["DUP:2"].risk == 0.3
    assert found["OMIT:D:metformin"].title == "Stopped/held: metformin" and found["OMIT:D:metformin"].tier == "info" and found["NOT_CHECKED"].meds == ["T:mystery"]
    assert "2 drug pair(s)" in found["NOT_COVERED"].title and r.counts.pairs_checked == 3 and r.counts.medications == 6
    assert [f.tier for f in r.findings] == sorted((f.tier for f in r.findings), key=A.TIERS.index)
    again = report(spark, base, rows[::-1]).first()
    assert again.report_hash == r.report_hash and again.findings == r.findings
    assert report(spark, base, [*rows[:-1], med(7, "metformin", status="active", adm=True)]).first().report_hash != r.report_hash
    assert not {f.type for f in report(spark, base, rows, False).first().findings} & {"OMISSION", "NEW_MEDICATION", "DOSE_CHANGE"}


def test_major_stays_in_review(spark, base):
    r = report(spark, base, [med(0, "warfarin", confidence=0.1), med(1, "aspirin")]).first()
    f = next(f for f in r.findings if f.type == "INTERACTION")
    assert (f.tier, f.verify, f.risk) == ("review", True, 0.085) and "verify" in f.explanation[-1]


def test_combination_meets_itself_only_as_duplicate(spark, base):
    r = report(spark, base, [med(0, "both"), med(1, "warfarin")]).first()
    assert [f.id for f in r.findings if f.type != "NEW_MEDICATION"] == ["INT:1|2", "DUP:1"]


def test_empty_tables(spark, base):
    assert A.reports(corrected(spark, []), spark.createDataFrame([], "note_id long, both_lists boolean"), *base).count() == 0


def test_again_computes_changed_notes_only(spark, base):
    lists = spark.createDataFrame([(1, True), (2, True)], "note_id long, both_lists boolean")
    both = [med(0, "warfarin"), med(1, "aspirin")]
    before = A.reports(corrected(spark, both + [(2, *m[1:]) for m in both]), lists, *base).withColumn("report_hash", F.concat(F.lit("kept:"), "report_hash")).cache()
    edits = spark.createDataFrame([(1, "delete", "D:aspirin", None, None, None, None), (1, "update", "D:warfarin", None, "held", None, None), (1, "add", None, "Warfarin", None, None, None)], "note_id long, op string, id string, raw string, status string, before string, after string")
    products = spark.createDataFrame(PRODUCTS, "spelling string, names array<string>, norm_status string")
    after = {r.note_id: r for r in A.again(before, edits, products, lists, *base).collect()}
    assert after[2].report_hash.startswith("kept:") and not after[1].report_hash.startswith("kept:")
    assert {m.id: m.status for m in after[1].medications} == {"D:warfarin": "held", "D:warfarin_1": "active"} and after[1].counts.pairs_checked == 0


def test_measures_recounted(spark):
    scores = prediction.link_scores(spark, DATA).collect()
    by = defaultdict(list)
    for r in scores:
        by[r.fold, r.model].append((r.label, round(r.probability, 6)))
    got = {(r.fold, r.model): r for r in prediction.q_link_model(spark, DATA).collect()}
    assert set(got) == set(by) and {m for _, m in got} == {"warm", "graph", "logistic", "popularity", "cold-one", "cold-both"}
    for key, rows in by.items():
        pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
        won = sum((p > n) + (p == n) / 2 for p in pos for n in neg)
        assert got[key].pairs == len(rows) and got[key].auc == pytest.approx(won / (len(pos) * len(neg)), abs=2e-6)
        tp, fp = sum(p >= 0.5 for p in pos), sum(p >= 0.5 for p in neg)
        assert got[key].recall == pytest.approx(tp / len(pos), abs=1e-6) and got[key].precision_ == pytest.approx(tp / (tp + fp) if tp + fp else 0, abs=1e-6)
    tested = {(r.fold, r.a, r.b) for r in scores if r.model == "warm" and r.label}
    assert all(r.label == 1 for r in scores if (r.fold, r.a, r.b) in tested and not r.model.startswith("cold"))


def test_signals(spark):
    rows = prediction.q_signals(spark, DATA).collect()
    vectors = {r.vec_id for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()}
    assert len(rows) == prediction.uncovered(spark, DATA).count() and rows
    for r in rows:
        assert (r.probability is None) == (not {r.a, r.b} <= vectors) and (r.probability is None) == (r.model is None)
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.place):
        by[r.list_id].append(-1 if r.probability is None else r.probability)
    assert all(x == sorted(x, reverse=True) for x in by.values())


def test_chemistry_against_plain_sets(spark):
    random.seed(4)
    bits = {i: random.getrandbits(63) & random.getrandbits(63) for i in range(24)}
    edges = {(u, v) for u in range(20) for v in random.sample(range(20), 3) if u != v}
    edges |= {(v, u) for u, v in edges}
    pairs = [(a, b, h) for a in range(0, 22, 2) for b, h in ((a + 1, None), (a + 2, "both"), (a + 3, "first"), (25, "second"))]
    partners, sim = defaultdict(set), lambda x, y: (bits[x] & bits[y]).bit_count() / max(1, (bits[x] | bits[y]).bit_count())
    for u, v in edges:
        partners[u].add(v)
    e = spark.createDataFrame(sorted(edges), "u long, v long")
    rows = spark.createDataFrame(sorted(bits.items()), "id long, bits long")
    p = spark.createDataFrame(pairs, "a long, b long, hide string")
    near = R.nearest_known(rows, e, p.select(F.col("a").alias("id")).union(p.select("b")))
    got = {(r.a, r.b): r for r in R.chemistry(p, e, rows, near).collect()}
    assert len(got) == len(pairs)
    for a, b, hide in pairs:
        r = got[a, b]
        if a not in bits or b not in bits:
            assert not r.known and r.tanimoto == 0 and set(r.sums) == {0}
            continue
        hidden = {"both": {a, b}, "first": {a}, "second": {b}}.get(hide, set())
        of = lambda one, other: max((sim(one, w) for w in partners[other] - {one}), default=0) if other not in hidden else 0
        knn = lambda d: [x for x in sorted((x for x in bits if partners[x] and x != d), key=lambda x: (-sim(d, x), x))[:10] if x not in hidden][:5]
        links = sum(x != y and {x, y} != {a, b} and y in partners[x] for x in knn(a) for y in knn(b))
        assert (r.known, r.tanimoto, r.to_partners_of_a, r.to_partners_of_b) == (True, *(pytest.approx(v) for v in (sim(a, b), of(b, a), of(a, b)))) and r.neighbour_links == pytest.approx(links / 25)
        assert r.sums == [(bits[a] >> i & 1) + (bits[b] >> i & 1) for i in range(64)] and r.ands == [(bits[a] & bits[b]) >> i & 1 for i in range(64)]


def test_features_of_hubs(spark):
    """Common neighbours are the same from whichever end they are looked for."""
    edges = {(0, v) for v in range(1, 40)} | {(u, v) for u in range(1, 8) for v in range(u + 1, 9)}
    e = G.adjacency(spark.createDataFrame(sorted(edges), "a long, b long"))
    got = {(r.a, r.b): r.common for r in G.link_features(e, spark.createDataFrame([(0, 1), (1, 0), (5, 30), (30, 50)], "a long, b long")).collect()}
    assert got == {(0, 1): 7, (1, 0): 7, (5, 30): 1, (30, 50): 0}
