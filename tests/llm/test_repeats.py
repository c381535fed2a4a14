"""Operators 1 and 3 against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from chartloom.llm import rlz, suffixes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LEAST = -(2**63)


def distinct(rows):
    return sorted({(LEAST if r[0] is None else r[0], r[1] or "") for r in rows})


def brute_words(rows, window):
    seen, out = set(), {}
    for i, text in distinct(rows):
        words = WORD.findall(text)
        gone = [False] * len(words)
        for j in range(len(words) - window + 1):
            key = tuple(words[j : j + window])
            if key in seen:
                gone[j : j + window] = [True] * window
            seen.add(key)
        out[i] = (len(words), sum(gone), hashlib.sha256(" ".join(w for w, g in zip(words, gone, strict=True) if not g).encode()).hexdigest())
    return out


@pytest.mark.parametrize(("window", "gram", "block"), [(20, 8, 5_000_000), (20, 8, 3000), (5, 2, 500), (25, 4, 2000)])
def test_words(docs, rows, window, gram, block):
    got = rlz.digests(docs, window, gram, block).collect()
    assert len(got) == len(rows)
    want = brute_words(rows, window)
    assert {r.doc_id: want[LEAST if r.doc_id is None else r.doc_id] for r in got} == {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got}


def test_factors_name_their_sources(docs, rows):
    texts = {i: WORD.findall(t) for i, t in distinct(rows)}
    found = 0
    for r in rlz.dedup(docs).collect():
        for f in r.factors:
            here, there = texts[r.doc_id if r.doc_id is not None else LEAST], texts[LEAST if f.source is None else f.source]
            n = f.end - f.start
            assert n >= 20 and here[f.start : f.end] == there[f.source_start : f.source_start + n]
            found += 1
    assert found > 10


def test_greedy_parse():
    runs = np.array([(0, 3, 7, 10), (3, 2, 7, 13), (4, 9, 8, 50), (40, 1, 9, 0)], rlz.RUN)
    assert rlz.factors(runs, 5) == [(0, 9, 7, 10), (4, 17, 8, 50), (40, 45, 9, 0)]
    assert rlz.factors(runs[:0], 5) == []


def brute_bytes(rows, window):
    texts = {i: t.encode() for i, t in distinct(rows)}
    places: dict = {}
    for i, raw in texts.items():
        for j in range(len(raw) - window + 1):
            places.setdefault(raw[j : j + window], []).append((i, j))
    gone = {i: np.zeros(len(raw) + 1, bool) for i, raw in texts.items()}
    for at in places.values():
        if len(at) > 1:
            for i, j in at:
                gone[i][j : j + window] = True
    out = {}
    for i, raw in texts.items():
        g = gone[i][:-1]
        kept = np.frombuffer(raw, np.uint8)[~g].tobytes()
        out[i] = (len(raw), int(g.sum()), int((np.diff(np.concatenate([[0], g.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(
    ("window", "gram", "block", "shallow", "many", "few"),
    [(400, 32, 1_500_000, 64, 128, 16), (60, 8, 4000, 16, 128, 16), (30, 4, 1500, 8, 128, 16), (400, 32, 1_500_000, 64, 1, 16), (60, 8, 4000, 16, 1, 1), (30, 4, 1500, 8, 3, 2), (30, 4, 4000, 8, 128, 1)],
)
def test_bytes(docs, rows, window, gram, block, shallow, many, few):
    got = suffixes.digests(docs, window, gram, block, shallow, many, few).collect()
    assert len(got) == len(rows)
    want = brute_bytes(rows, window)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[LEAST if r.doc_id is None else r.doc_id], r.doc_id


def test_bytes_at_a_hot_edge(spark):
    """One passage in many texts, each with words of its own around it."""
    r = random.Random(3)
    prose = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage = prose(700)
    rows = [(i, prose(r.randint(0, 500)) + passage + prose(r.randint(0, 500))) for i in range(300)]
    rows += [(1000 + i, prose(900)) for i in range(20)] + [(2000, rows[5][1]), (2001, rows[5][1])] + rows[7:9]
    want = brute_bytes(rows, 400)
    for r in suffixes.digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r.doc_id


def test_bytes_kept(docs):
    for r in suffixes.dedup(docs, 60, 8, 4000, 16).collect():
        assert len(r.kept) == r.n_bytes - r.n_removed and sum(s.end - s.start for s in r.spans) == r.n_removed and len(r.spans) == r.n_spans


def test_deep_shallow_sorts():
    r = random.Random(1)
    for _ in range(60):
        texts = [bytes(r.choice(b"ab\0") for _ in range(r.randint(0, 40))) for _ in range(r.randint(1, 30))]
        texts += [b"ab" * 20 + t for t in texts[:10]]
        groups = np.array([r.randint(0, 2) for _ in texts])
        order, common = suffixes.deep_shallow(groups, texts, 16)
        for g in set(groups.tolist()):
            mine = [i for i in order.tolist() if groups[i] == g]
            at = [k for k, i in enumerate(order.tolist()) if groups[i] == g]
            for k in range(1, len(mine)):
                a, b = texts[mine[k - 1]], texts[mine[k]]
                shared = next((j for j in range(min(len(a), len(b))) if a[j] != b[j]), min(len(a), len(b)))
                assert common[at[k]] == shared
            # the least common value between two places is what any two members share
            for x in range(len(mine)):
                for y in range(x + 1, len(mine)):
                    a, b = texts[mine[x]], texts[mine[y]]
                    shared = next((j for j in range(min(len(a), len(b))) if a[j] != b[j]), min(len(a), len(b)))
                    assert min(common[at[x + 1 : y + 1]]) == shared


def test_empty_tables(nothing):
    assert rlz.digests(nothing).count() == 0 and suffixes.digests(nothing).count() == 0
