"""Operators 2 and 6 against brute force, and components of links."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartloom.llm import graph, jaccard, syncmers

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LEAST = -(2**63)


def shingles(text, k):
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else [])


def brute(rows, k, num, den):
    sets = [(LEAST if r[0] is None else r[0], shingles(r[1], k)) for r in rows]
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and den * len(a & b) >= num * len(a | b):
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    return {i: (len(s), root(i)) for i, s in sets}


@pytest.mark.parametrize(("k", "num", "den", "rounds", "few"), [(4, 85, 100, 8, 2), (4, 85, 100, 1, 0), (5, 80, 100, 0, 0), (2, 1, 2, 3, 0)])
def test_components_of_similar_documents(docs, rows, k, num, den, rounds, few, monkeypatch):
    monkeypatch.setattr(jaccard, "ROUNDS", rounds)
    monkeypatch.setattr(jaccard, "FEW", few)
    got = jaccard.join(docs, k, num, den).collect()
    want = brute(rows, k, num, den)
    assert len(got) == len(rows)
    for r in got:
        n, component = want[LEAST if r.doc_id is None else r.doc_id]
        assert (r.n_shingles, r.component_id) == (n, None if component == LEAST else component), r.doc_id


def test_one_of_each_group_stays(docs, rows):
    want = brute(rows, 5, 80, 100)
    kept = jaccard.distinct(docs)
    assert kept.columns == docs.columns
    assert sorted(LEAST if r.doc_id is None else r.doc_id for r in kept.collect()) == sorted({c for _, c in want.values()})


def test_texts_that_share_an_id_are_documents_of_their_own(spark):
    prose = lambda name, n=60: [f"{name}{i}" for i in range(n)]
    near = lambda words, i: " ".join([*words[:i], "changed", *words[i + 1 :]])
    clean = [(i, " ".join(prose(f"c{j}x")), j) for j, i in enumerate([None] * 12 + [7] * 12)]
    copies = [(i, near(prose("p"), 59 - j % 2), j) for j, i in enumerate([None, None, 7, 7, 9, 9])] + [(4, near(prose("q"), 59), 0), (7, " ".join(prose("q")), 1)]
    df = spark.createDataFrame([*clean, *copies, (None, "", 1), (None, None, 2), (None, " ", 3)], "doc_id long, text string, nr long").repartition(3)
    kept = sorted(((r.doc_id, r.text, r.nr) for r in jaccard.distinct(df).collect()), key=str)
    p = [r for r in kept if r[1] and r[1].startswith("p0 ")]
    assert len(p) == 1 and p[0][0] is None
    assert [r for r in kept if r not in p] == sorted([*clean, copies[6], (None, "", 1), (None, None, 2), (None, " ", 3)], key=str)
    for r in jaccard.join(df).collect():
        assert (r.doc_id, r.component_id) in {(None, None), (7, 7), (7, None), (9, None), (4, 4), (7, 4)}
    found = [(r.doc_id, r.component_id) for r in jaccard.join(df).collect()]
    assert (found.count((7, 7)), found.count((7, None)), found.count((9, None)), found.count((7, 4))) == (12, 2, 2, 1)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(1, j) for j in range(2, 90)] + [(7, 7), (500, 400), (400, 500)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(100, 161), 100), **dict.fromkeys(range(1, 90), 1), 400: 400, 500: 400}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize(("rounds", "few"), [(2, 0), (8, 2), (0, 0)])
def test_clusters_about_the_threshold(spark, monkeypatch, rounds, few):
    """Chains of edits, passages that many texts share, and templates with distances just over and just under the radius."""
    monkeypatch.setattr(jaccard, "ROUNDS", rounds)
    monkeypatch.setattr(jaccard, "FEW", few)
    r = random.Random(3)
    prose = lambda n: [f"w{r.randrange(400)}" for _ in range(n)]
    passage, texts = prose(50), []
    for _ in range(6):
        words = prose(r.choice([8, 30, 80, 150]))
        for _ in range(25):  # each text edits the one before or the first
            words = list(words)
            words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
            texts.append(words)
    texts += [passage + prose(n) for n in range(1, 40)] + [prose(10) + passage + prose(3) for _ in range(20)]
    rows = [(i, " ".join(t)) for i, t in enumerate(r.sample(texts, len(texts)) + texts[:10])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(jaccard, "BLOCK", 3_000)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.join(df, 3, 80, 100).collect()}
    assert got == brute(rows, 3, 80, 100)


def test_first_shingles_of_linked_sets_meet():
    r = random.Random(2)
    for num, den in ((85, 100), (80, 100), (1, 2)):
        for _ in range(300):
            a = set(r.sample(range(10_000), r.randint(1, 60)))
            b = {x if r.random() < num / den + 0.1 else x + 20_000 for x in a} | set(r.sample(range(50_000, 60_000), r.randint(0, 3)))
            if den * len(a & b) < num * len(a | b):
                continue
            firsts = []
            for s in (a, b):
                values = np.array(sorted(s), np.uint64)
                firsts.append(set(values[jaccard.first_ones(values, np.zeros(len(s), np.int64), np.array([len(s)]), num, den)].tolist()))
            least = min(jaccard.beyond(jaccard.least_shared(len(s), num, den)) for s in (a, b))
            assert len(firsts[0] & firsts[1]) >= least


def test_empty_tables(nothing):
    assert jaccard.join(nothing).count() == 0 and syncmers.fingerprints(nothing).count() == 0


def test_fingerprints(docs, rows):
    got = syncmers.fingerprints(docs).collect()
    assert len(got) == len(rows)
    ordered = sorted(((LEAST if r[0] is None else r[0]), r[1] or "") for r in rows)
    want = {}
    for x, (i, text) in enumerate(ordered):
        after, quarter = ordered[(x + 1) % len(ordered)][1], len(text) // 4
        edited = text[: len(text) - quarter] + after[:quarter]
        want.setdefault(i, set()).add((len(text), hashlib.sha256(edited.encode()).hexdigest()))
    texts = {i: t for i, t in ordered}
    by_text = {}
    for r in got:
        i = LEAST if r.doc_id is None else r.doc_id
        assert (r.n_chars, r.edited_sha256) in want[i]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert by_text.setdefault(texts[i], r.fingerprint) == r.fingerprint
    long = [r for r in got if r.n_chars > 300 and len(set(WORD.findall(texts[LEAST if r.doc_id is None else r.doc_id]))) > 50]
    assert sum(r.near_edited for r in long) / len(long) > 0.4


def test_anchors_do_not_depend_on_their_surroundings(spark):
    words = [f"w{i * i % 97}" for i in range(200)]
    texts = [" ".join(words), "some other words first " + " ".join(words[50:150]) + " and others last"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(syncmers.anchors(F.col("text")).alias("a"))
    a, b = ({x.pos: x.hash for x in r.a} for r in df.collect())
    shared = {p: h for p, h in b.items() if 4 <= p <= 100}
    assert shared == {p - 50 + 4: h for p, h in a.items() if 50 <= p <= 146} and len(shared) > 30


def test_every_text_with_words_has_an_anchor(spark):
    texts = [" ".join(f"w{n}x{i}x{j}" for j in range(n)) for n in range(1, 9) for i in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", syncmers.sketch(F.col("text")).alias("marks"))
    marks = {r.text: tuple(r.marks) for r in df.collect()}
    assert all(marks.values()) and len(set(marks.values())) == len(texts)
    pairs = spark.createDataFrame([(a, b) for a, b in zip(texts[180:239], texts[181:240], strict=True)], "a string, b string")
    assert {x[0] for x in pairs.select(syncmers.likeness(syncmers.sketch(F.col("a")), syncmers.sketch(F.col("b")))).collect()} == {0.0}


def test_single_document_is_its_own_next(spark):
    (r,) = syncmers.fingerprints(spark.createDataFrame([(3, "abcdefgh")], "doc_id long, text string")).collect()
    assert r.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and r.near_next == 1
