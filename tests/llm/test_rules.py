"""Secrets, personal data and line rules against plain versions of their definitions."""

import math
import random
import re

import brute
import pytest

from rxweave.llm import pii, quality, secrets

TEXTS = [
    None, "", "Mail a@b.co and a.b..c@d.zz; ip: 10.0.0.7:80 or version 1.2.3.400 or 999.1.1.1.", "card 4111 1111 1111 1111 exp 10/30, card 4111 1111 1111 1112, 4111.1111.1111.1111",
    "call +49 30 1234567 or (212) 555-1234 x9, order no. 212 555 1234, write to john (at) mail (dot) com", "fe80:0:0:0:1:2:3:4 server 1.1.1.1/24 and 2.5.1.3 mm", "+12 34 +1 2-3.4(5)6 789 0123",
] * 3


def plain_votes(kind, text, s, e, strict, good):
    m, before, after = text[s:e], text[max(0, s - pii.BEFORE) : s], text[e : e + 16]
    digits, known = re.sub("[^0-9]", "", m), pii.GAZETTEER[kind]
    if kind == "email":
        last = re.search(r"([A-Za-z]+)[^A-Za-z]*$", m)
        listed, check = last is not None and last[1].lower() in known, -1 if re.search(r"\.\.|^\.|\.@|@-|-$", m) else 1
    elif kind == "ip":
        listed = re.match(r"0*([0-9A-Fa-f]+)", m)[1].lower() in known
        parts = m.split(".")
        check = 1 if ":" in m or (len(parts) == 4 and all(p == str(int(p)) and int(p) <= 255 for p in parts)) else -1
    else:
        listed = any(digits.startswith(k) for k in known) if kind == "card" or m.startswith("+") else digits[:1] in "23456789"
        check = (1 if 13 <= len(digits) <= 19 and brute.luhn(digits) else -1) if kind == "card" else 1 if 10 <= len(digits) <= 13 else 0 if 9 <= len(digits) <= 15 else -1
    gaps = len(set(re.findall(r"[^0-9A-Za-z@+()]", m)))
    return (
        1 if good else -1 if strict else 0, 1 if listed else -1, 1 if re.search(pii.CONTEXT[kind], before) else -1 if re.search(pii.AGAINST, before) else 0,
        -1 if re.search(pii.UNITS, after) else 1 if re.search(pii.AFTER[kind], after) else 0, check, -1 if re.search(r"[0-9A-Za-z_#/\\-]$", before) or re.match(r"[0-9A-Za-z_#/\\-]", after) else 1,
        1 if gaps == 1 else 0 if gaps == 0 else -1 if kind in ("card", "phone") else 0,
    )


def test_votes(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    seen = 0
    for r in pii.candidates(docs).collect():
        text = TEXTS[r.doc_id] or ""
        for kind in pii.KINDS:
            for c in r[kind]:
                seen += 1
                assert tuple(c[v] for v in pii.VOTES) == plain_votes(kind, text, c.s, c.e, not c.loose, c.base), (kind, text[c.s : c.e])
                assert (c.length_step, c.digit_step) == (min((c.e - c.s) // 8, 4), 4 * len(re.findall("[0-9]", text[c.s : c.e])) // (c.e - c.s))
    assert seen >= 3 * 12


def test_reliabilities_are_those_of_plain_em():
    random.seed(4)
    rows = [{"kind": random.choice(pii.KINDS), **{v: random.choice((-1, 0, 1)) for v in pii.VOTES}, "n": random.randrange(1, 400)} for _ in range(60)]
    share, chance, start = dict.fromkeys(pii.KINDS, 0.5), pii.first_chances(), pii.first_chances()
    for _ in range(pii.ROUNDS):
        post = []
        for r in rows:
            yes, no = share[r["kind"]], 1 - share[r["kind"]]
            for v in pii.VOTES:
                yes, no = yes * chance[v][1][r[v]], no * chance[v][-1][r[v]]
            post.append(yes / (yes + no))
        for k in pii.KINDS:
            own = [(p, r["n"]) for p, r in zip(post, rows, strict=True) if r["kind"] == k]
            share[k] = (pii.PRIOR / 2 + sum(p * n for p, n in own)) / (pii.PRIOR + sum(n for _, n in own))
        chance = {
            v: {t: {x: pii.PRIOR * start[v][t][x] + sum((p if t == 1 else 1 - p) * r["n"] for p, r in zip(post, rows, strict=True) if r[v] == x) for x in (-1, 0, 1)} for t in (1, -1)} for v in pii.VOTES
        }
        chance = {v: {t: {x: c / sum(d.values()) for x, c in d.items()} for t, d in both.items()} for v, both in chance.items()}
    got = pii.reliabilities(rows)
    assert all(math.isclose(got["share"][k], share[k], rel_tol=1e-9) for k in pii.KINDS)
    assert all(math.isclose(got["chance"][v][t][x], chance[v][t][x], rel_tol=1e-9) for v in pii.VOTES for t in (1, -1) for x in (-1, 0, 1))


@pytest.mark.parametrize("copies", [1, 30])
def test_added_spans(spark, copies):
    """The verdict on spans is the same for a small and a larger corpus."""
    good = "please call (212) 555-1234 or pay by card 4111.1111.1111.1111 and write to john (at) mail (dot) com"
    bad = "see version 1.2.3.400 and order no. 1234 5678 9012 3456"
    base = ["mail a@b.com", "ip 10.0.0.1", "card 4111 1111 1111 1111", "call +1 212 555 1234", good, bad]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(base * copies)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    assert got[4].spans_added >= 2 and f"card:{good.index('4111')}:{good.index('4111') + 19}" in got[4].spans.split(",")
    assert got[5].spans_added == 0 and got[0].spans == "email:5:12"


def plain_clean(text):
    lines = (text or "").split("\n")
    words = [brute.words(x) for x in lines]
    phrases = [p for own in quality.BOILERPLATE.values() for p in own]

    def bad(x, w):
        marked = sum(1 for t in w if re.search(r"(?:!!|[#*$%&|<>])$", t))
        return (marked >= 1 and 10 * marked >= 3 * len(w)) or len(re.findall("[|»›•]", x)) >= 2 or any(p in x.lower() for p in phrases)

    short = [1 <= len(w) <= 2 and not re.search(r"[.!?:;,…\"'”’)\]][\x20\x09-\x0D]*$", x) for x, w in zip(lines, words, strict=True)]
    menu, i = set(), 0
    while i < len(lines):
        j = i
        while j < len(lines) and short[j]:
            j += 1
        if j - i >= 3:
            menu |= set(range(i, j))
        i = max(j, i + 1)
    kept = [x for k, (x, w) in enumerate(zip(lines, words, strict=True)) if not bad(x, w) and k not in menu]
    total, left = (sum(len(c) for c in brute.words("\n".join(v))) for v in (lines, kept))
    return "\n".join(kept), 1 - left / total if total else 0.0


def test_lines(spark):
    random.seed(6)
    pool = ["Home", "About us", "Contact", "A heading", "A sentence that goes on for a while.", "Click HERE now", "a | b | c", "!! $$ ##", "", "  ", "Alle Rechte vorbehalten 2020", "Nombre", "It ends here.", "x!! y z", "don't (ok)"]
    texts = ["\n".join(random.choices(pool, k=random.randrange(1, 14))) for _ in range(300)] + [None, "", "\n", "word " * 50_000]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, facts string, lost int")
    for r in quality.clean_lines(docs).collect():
        clean, lost = plain_clean(texts[r.doc_id])
        assert r.clean_text == clean and math.isclose(r.lost, lost, abs_tol=1e-12) and r.keeps_text == (lost <= quality.MAX_LOST)
    assert quality.statistics(docs).columns[:4] == docs.columns


def test_features_of_candidates(spark):
    words = ("alpha", "beta", "alphabet", "gamma", "here")
    known = secrets.Background(words, secrets.letter_chances(words), {"token": 1.5, "commit": -2.0}, {"tests": -1.0})
    texts = ["the token = \"xAlphabetGamma99\" here", "commit 0123456789abcdef0123456789abcdef01234567 of", "path only beta_beta_beta_beta_1 x", "secret: Q7!zz.9k"]
    docs = spark.createDataFrame([(i, t, "src/tests/a" if i else None) for i, t in enumerate(texts)], "doc_id long, text string, p string")
    rows = secrets.candidates(docs, "p", known).collect()
    assert len(rows) == 4
    for r in rows:
        m, text = r.candidate, texts[r.doc_id]
        assert text[r.start_at : r.end_at] == m
        marks = [False] * len(m)
        for i in range(len(m)):
            for w in words:
                if 4 <= len(w) <= 12 and m.lower()[i : i + len(w)] == w:
                    marks[i : i + len(w)] = [True] * len(w)
        assert math.isclose(r.covered, sum(marks) / len(m)) and r.length == len(m)
        pairs = [m.lower()[i : i + 2] for i in range(len(m) - 1) if re.fullmatch("[a-z][a-z]", m.lower()[i : i + 2])]
        chances = [known.follows[(ord(a) - 97) * 26 + ord(b) - 97] for a, b in pairs]
        assert math.isclose(r.followed, sum(chances) / len(chances) if chances else 0.0, abs_tol=1e-9)
        beside = re.findall("[a-z]{2,}", text[max(0, r.start_at - 40) : r.start_at].lower())[-3:] + re.findall("[a-z]{2,}", text[r.end_at : r.end_at + 40].lower())[:2]
        assert math.isclose(r.beside_odds, sum(known.beside.get(w, 0) for w in beside)) and r.path_odds == (-1.0 if r.doc_id else 0.0)
        kinds = ["a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "-" for c in m]
        assert math.isclose(r.turns, sum(x != y and x != "-" for x, y in zip(kinds, kinds[1:], strict=False)) / len(m)) and math.isclose(r.distinct, len(set(m)) / len(m))


def test_dictionary_is_counted_over_all_texts(spark):
    docs = spark.createDataFrame([(i, "common words here, Common " + "rare" * (i == 3)) for i in range(20)] + [(99, None)], "doc_id long, text string")
    assert set(secrets.dictionary(docs)) == {"common", "words", "here"} | set(secrets.DICTIONARY)
