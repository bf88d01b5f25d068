"""The Merkle manifest, exact duplicates and importance resampling against plain definitions and the SQL of their queries."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rxweave.llm import exact, merkle, queries, resample

DATA = "/root/testdata/sf0.001"
CLASH = "place long, total long, grp string, node string, own string, block int, at long, row long, origin int, digest string, rank long, score double, low long"
BLANK = (None,) * (CLASH.count(",") + 1)
LONG = "Some words, and a line\nthat repeat over and over. " * 60_000


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    random.seed(3)
    texts = [None, "", " \n", "One two", "one\ntwo", "onetwo ", LONG, LONG + " ", "ünï çødé 🦆\n", "a\x00b"]
    rows = [(i if i % 17 else None, random.choice(texts) if i % 3 else f"text number {i} with words {i * i} " * 6, random.choice([None, "", "a", "é", "hot", "hot", "hot"]), "en", i % 5 or None) for i in range(120)]
    rows += [rows[5], rows[5], rows[34], (7, "the same id, another text", "b", None, 1)]
    return spark.createDataFrame([(*r, *BLANK) for r in rows], f"doc_id long, text string, source string, lang string, n_chars long, {CLASH}").repartition(23).cache()


def test_manifest(spark, docs):
    fields = [F.col(c) for c in merkle.FIELDS]
    rows = docs.withColumn("leaf", merkle.leaf(fields)).cache()
    for levels in (2, merkle.LEVELS):
        found = merkle.manifest(rows, levels=levels)
        assert found.columns == [*rows.columns, "subroot", "root", "path"]
        got = found.collect()
        assert len(got) == rows.count()
        by, one = defaultdict(list), lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
        for r in got:
            assert r.leaf == sha(*(one(r[c]) for c in merkle.FIELDS))
            by[r.source].append(((r.doc_id is not None, r.doc_id or 0, r.leaf), r))
        subroots = {}

        def climbed(nodes, mine):
            """(root, siblings of the node at mine, level by level)."""
            beside = []
            while len(nodes) > 1:
                first = mine - mine % 3
                beside.append(("".join(nodes[first:mine]), "".join(nodes[mine + 1 : first + 3])))
                nodes = [sha(*nodes[k : k + 3]) for k in range(0, len(nodes), 3)]
                mine //= 3
            return nodes[0], beside

        ordered = {s: sorted(v, key=lambda x: x[0]) for s, v in by.items()}
        names = sorted(ordered, key=lambda s: (s is not None, (s or "").encode()))
        for s in names:
            subroots[s] = climbed([k[2] for k, _ in ordered[s]], 0)[0]
        for i, s in enumerate(names):
            root, above = climbed([subroots[x] for x in names], i)
            # Rows that tie as a whole may stand either way round: their paths are compared as a set.
            want, have = defaultdict(list), defaultdict(list)
            for k, (key, r) in enumerate(ordered[s]):
                want[key].append([*climbed([x[2] for x, _ in ordered[s]], k)[1], *above])
                have[key].append([tuple(p) for p in r.path])
                assert (r.subroot, r.root) == (subroots[s], root)
            assert {k: sorted(v) for k, v in want.items()} == {k: sorted(v) for k, v in have.items()}
    assert merkle.manifest(rows.limit(0)).count() == 0
    assert merkle.manifest(rows.limit(3).withColumn("path", F.lit("p"))).columns[-4:] == ["path", "subroot", "root", "path_"]
    one = merkle.manifest(rows.limit(1)).first()
    assert one.path == [] and one.root == one.subroot == one.leaf
    folded = found.select(merkle.folded(F.col("leaf"), F.col("path")).alias("f"), "root", merkle.folded(F.reverse("leaf"), F.col("path")).alias("g")).collect()
    assert all(r.f == r.root != r.g for r in folded)


def test_exact(docs):
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups["".join(c for c in t if c not in " \t\n\x0b\x0c\r")].append((-len(t), i is None, i or 0))
    want = Counter()
    for plain, members in groups.items():
        for k, (_, none, i) in enumerate(sorted(members)):
            best = min(members)
            want[(None if none else i, None if best[1] else best[2], len(members), k == 0, hashlib.sha256(plain.encode()).hexdigest())] += 1
    for fan in (2, exact.FAN):
        found = exact.duplicates(docs, fan).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.digest.hex()) for r in found) == want
    left = exact.drop_duplicates(docs)
    assert left.columns == docs.columns
    kept = Counter((k[0], k[4]) for k in want.elements() if k[3])
    assert Counter((r.doc_id, sha("".join(c for c in r.text or "" if c not in " \t\n\x0b\x0c\r"))) for r in left.collect()) == kept
    assert exact.duplicates(docs.limit(0)).count() == 0 and exact.drop_duplicates(docs.limit(0)).count() == 0


def test_exact_merges_sorted_runs(docs):
    plan = exact.merged(exact.digests(docs), 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortAggregate") >= 10 and "ObjectHashAggregate" not in plan  # 23 tasks: five rounds


def resampled(docs, items, longest, percent, least):
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)} | {chr(c): " " for c in range(128) if not chr(c).isalnum()})

    def features(text):
        w = (text or "").translate(fold).split(" ")
        w = [x for x in w if x]
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % resample.BUCKETS for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    found = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for *_, f in found for b in f), Counter(b for x in items for b in features(x)[1])
    all_s, all_t = sum(s.values()) + 10000, sum(t.values()) + 10000
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t)))
    rows = []
    for i, words, f in found:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(sha(f"2024:{'' if i is None else i}")[:8], 16)
        rows.append((i, words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    k = percent * len(able) // 100
    ranks = Counter((r[0], *r[2:], n + 1 if n < k else None) for n, r in enumerate(able))
    return ranks + Counter((r[0], *r[2:], None) for r in rows if r[1] < least)


@pytest.mark.parametrize("longest,percent,least", [(1, 10, 20), (3, 50, 0)])
def test_resample(spark, docs, longest, percent, least):
    target = spark.createDataFrame([(1, "words that repeat, text number 3"), (2, None), (3, "")], "item_id long, text string")
    got = resample.resample(docs, target, percent, least, longest=longest).collect()
    want = resampled([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()], longest, percent, least)
    assert Counter(tuple(r) for r in got) == want


def test_resample_edges(spark, docs):
    target = docs.limit(0)
    assert resample.resample(docs.limit(0), target).count() == 0 and resample.resample(docs, target).count() == docs.count()
    drawn = resample.draw(docs, target, 30)
    assert drawn.columns == docs.columns and 0 < drawn.count() < docs.count()


def test_words_across_cuts(monkeypatch):
    monkeypatch.setattr(resample, "AT_ONCE", 50)
    text = "Ünï wörds, and longer-ones " * 40 + "x" * 9000 + " end"
    whole = resample.Hasher(1000, 3)
    cuts = list(whole.pieces(text))
    monkeypatch.setattr(resample, "AT_ONCE", 1 << 20)
    ((words, one),) = list(resample.Hasher(1000, 3).pieces(text))
    assert len(cuts) > 10 and sum(n for n, _ in cuts) == words
    assert Counter(b for _, f in cuts for b in f.tolist()) == Counter(one.tolist())


@pytest.mark.parametrize("values", [[3, 1, 2, 7, 5, 4, 0, 6], [-(1 << 63), (1 << 63) - 1, 0, -1, 5, 1 << 40, 1 << 62, -7], [1 << 40, (1 << 40) + 70_000, 9, -3, 65_536, 65_535, 1 << 20, 8]])
def test_first_keys(spark, values):
    rows = spark.createDataFrame([(v % 3, v) for v in values], "a long, b long").cache()
    ordered = sorted((v % 3, v) for v in values)
    for k in (1, 4, 7, 8):
        assert sorted(map(tuple, rows.filter(resample.first_keys(rows, ["a", "b"], k)).collect())) == ordered[:k]
    assert resample.first_keys(rows, ["a", "b"], 0) is None


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_exact_dedup", "op13_importance_resample"])
def test_queries(spark, name):
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    order = lambda df: df[sorted(df.columns)].sort_values("doc_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(order(queries.QUERIES[name](spark, DATA).toPandas()), order(con.sql(queries.ORACLES[name]).df()), check_dtype=False)
