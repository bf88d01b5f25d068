"""Near-duplicates of the pipeline against the similarity of all pairs."""

import random

import brute
import corpus_pipeline
import numpy as np
import pytest

from rxweave.llm import similar

DATA = "/root/testdata/sf0.001"


def components(texts):
    """The smallest id that each id reaches over pairs of similarity 0.8 or more."""
    sets, root = {}, {i: i for i in texts}
    for i, t in texts.items():
        w = brute.words(brute.lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if 9 * both >= 4 * (len(sets[i]) + len(sets[j])):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def made():
    """Copies of one text with words changed here and there, some of them too far from it; texts with one line in common; blanks."""
    random.seed(8)
    word = lambda: f"w{random.randrange(5000)}"
    base, line = [word() for _ in range(120)], "all rights are kept by those who hold them"
    texts = [" ".join(base)]
    for _ in range(150):
        t = list(base)
        for _ in range(random.randrange(6)):
            t[random.randrange(120)] = word()
        texts.append(" ".join(t))
    texts += [" ".join(word() for _ in range(random.randrange(2, 40))) + " " + line for _ in range(150)]
    return dict(enumerate([*texts, None, "", " \n", "one", "One", "one two three four", "one two three four five"]))


@pytest.mark.parametrize("block", [4, 10_000])
def test_components(spark, block):
    texts = made()
    want = components(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    groups = {}
    for r in similar.near_duplicates(docs, block=block).collect():
        groups.setdefault(r.root, set()).add(want[r.doc_id])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def family(size):
    """Copies of one text, each with words of its own in a fifth of its places: they meet under many shingles and are alike in hardly any pair."""
    random.seed(3)
    base = [f"b{i}" for i in range(300)]
    texts = []
    for k in range(size):
        t = list(base)
        for at in random.sample(range(300), 6 + k % 12):
            t[at] = f"x{random.randrange(10**9)}"
        texts.append(" ".join(t))
    return dict(enumerate(texts))


def test_parities_bound_the_difference():
    random.seed(5)
    sets = similar.Shingler()([t for t in {**family(40), **made()}.values()] + [" ".join(f"v{i}" for i in range(n)) for n in (30, 900, 1100)])
    odd = [np.frombuffer(similar.parities(s), np.uint8) for s in sets]
    size = np.array([len(o) for o in odd])
    i, j = (x.ravel() for x in np.indices((len(sets), len(sets))))
    bits = similar.parities_apart(np.concatenate(odd), np.cumsum(size) - size, size, i, j)
    differ = np.array([len(np.setxor1d(sets[a], sets[b])) for a, b in zip(i.tolist(), j.tolist(), strict=True)])
    n = np.array([len(x) for x in sets])
    far = (differ > 150) & (5 * np.minimum(n[i], n[j]) >= 4 * np.maximum(n[i], n[j]))
    assert (bits <= differ).all() and far.any() and (3 * bits[far] > differ[far]).all()


@pytest.mark.parametrize("block", [16, 2048])
def test_family_leaves_few_pairs(spark, monkeypatch, block):
    """Pairs whose whole sets are compared stay near the links, though nearly all members of the family meet."""
    texts, asked = family(240), []
    links = similar._Corpus.links
    monkeypatch.setattr(similar._Corpus, "links", lambda self, pairs: asked.append(pairs.count()) or links(self, pairs))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    roots = {r.doc_id: r.root for r in similar.near_duplicates(docs, block=block).collect()}
    want = components(texts)
    assert len({(roots[i], want[i]) for i in texts}) == len(set(roots.values())) == len(set(want.values())) > 20
    assert asked[1] < 3000  # of 28,680


def test_members_of_one_part_are_linked_once(spark, monkeypatch):
    """A family whose members are mostly similar to each other, but not all to its first: pairs that are compared grow with the members."""
    random.seed(11)
    base = [f"w{random.randrange(9000)}" for _ in range(150)]
    texts = {}
    for i in range(500):
        t = list(base)
        for _ in range(random.randrange(1, 4)):
            t[random.randrange(150)] = f"v{random.randrange(9000)}"
        texts[i] = " ".join(t)
    asked, links = [], similar._Corpus.links
    monkeypatch.setattr(similar._Corpus, "links", lambda self, pairs: asked.append(pairs.count()) or links(self, pairs))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    roots = {r.doc_id: r.root for r in similar.near_duplicates(docs).collect()}
    want = components(texts)
    assert len({(roots[i], want[i]) for i in texts}) == len(set(roots.values())) == len(set(want.values()))
    assert sum(asked[1:]) < 2000, asked


def test_stage_on_a_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, DATA)
    want = components({r.doc_id: r.text for r in docs.collect()})
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), DATA).count() == 0
