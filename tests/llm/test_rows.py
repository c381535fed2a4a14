"""Operators 4, 5, 7, 8, 9 and 10, and the pipeline."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest

from chartloom.llm import bpe, classifier, mixing, pii, rules, unigram
from chartloom.llm.common import lean
from chartloom.llm.hashing import _powers, powers
from chartloom.llm.queries import tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute_personal(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub(r"\D", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub(r"\D", "", m[0])) <= 15]


def test_personal_data_rules():
    r = random.Random(3)
    for k in range(4000):
        text = "".join(r.choice("a@.%-+ 01239é()b" if k % 2 else "0123456789 -+.") for _ in range(r.randint(0, 60)))
        assert [x[:3] for x in pii.find(text) if x[0] in pii.BASE] == brute_personal(text), text
    assert pii.find("x" * 50_000 + "@") == [] and pii.find("1" * 50_000) == [] and pii.find(None) == []
    found = {x[0]: x[3] for x in pii.find("Our bank account, IBAN GB82 WEST 1234 5698 7654 32; my ssn is 078-05-1120; id 078-05-1120" + "." * 80)}
    assert found["iban"] == 1.0 and found["ssn"] >= pii.LEAST
    assert not [x for x in pii.find("IBAN GB82 WEST 1234 5698 7654 33, nothing near 078-05-1120") if x[0] in pii.ADDED]


def test_personal_data_of_documents(spark, docs, rows, nothing):
    got = pii.scan(docs).collect()
    assert len(got) == len(rows) and pii.scan(nothing).count() == 0
    df = spark.createDataFrame([(1, "mail a.b@c.de or +1 (706) 555-3138, 10.0.0.1", 0), (2, None, 7), (3, "a@b@c.de", 1)], "doc_id long, text string, n_chars long")
    r = {x.doc_id: x for x in pii.scan(df).collect()}
    assert (r[1].n_email, r[1].n_ip, r[1].n_card, r[1].n_phone) == (1, 1, 0, 1) and r[1].spans == "email:5:13,ip:36:44,phone:17:34"
    assert r[1].base_sha256 == hashlib.sha256(r[1].spans.encode()).hexdigest() and r[2].spans == ""
    m = {x.doc_id: (x.text, x.n_chars) for x in pii.redact(df).collect()}
    assert m == {1: ("mail <email> or <phone>, <ip>", 29), 2: (None, 7), 3: ("a@<email>", 9)}


def test_mixing(docs, rows, nothing):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and mixing.mix(nothing).count() == 0
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    target = dict.fromkeys(sizes, 0.0)  # water-filling, the slow way
    open_, left = set(sizes), float(sum(sizes.values()))
    while open_:
        level = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if 3 * sizes[s] <= weights[s] * level}
        for s in full or open_:
            target[s] = 3 * sizes[s] if full else weights[s] * level
        left -= sum(target[s] for s in full or open_)
        open_ -= full or open_
    taken = collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, target[r.source]) and r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"]
        taken[r.source] += r.taken
    most = max(r["size"] for r in got)
    assert all(abs(taken[s] - target[s]) <= 2 * most for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect()))


def test_mixed_documents(docs, nothing):
    copies = collections.Counter()
    for r in mixing.mix(docs).collect():
        copies[r.doc_id] += r.copies
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and collections.Counter(r.doc_id for r in mixed.collect()) == +copies
    assert mixing.mixed_documents(nothing).count() == 0


def test_mixing_one_hot_source(spark):
    df = spark.range(900).selectExpr("id AS doc_id", "repeat('w ', int(1 + id % 7)) AS text", "if(id < 800, 'hot', 'z' || id % 3) AS source")
    r = mixing.mix(df).groupBy("source", "target").sum("taken").collect()
    assert all(abs(x["sum(taken)"] - x.target) <= 0.05 * x.target + 14 for x in r)


@pytest.fixture(scope="module")
def known():
    tokenizers = pytest.importorskip("tokenizers")
    pytest.importorskip("public_tokenizers")
    return tokenizers.Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))


def test_bpe_as_the_library(docs, rows, known, nothing):
    got = bpe.encode(docs, tokenizer("byte_bpe_50k.json")).collect()
    assert len(got) == len(rows) and bpe.encode(nothing, tokenizer("byte_bpe_50k.json")).count() == 0
    want = collections.Counter((r[0], tuple(known.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    assert collections.Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want
    texts = collections.Counter((r[0], r[1] or "") for r in rows)
    assert collections.Counter((r.doc_id, r.decoded) for r in got) == texts
    for r in bpe.digests(docs, tokenizer("byte_bpe_50k.json")).collect():
        assert (r.doc_id, r.decoded_sha256) in {(i, hashlib.sha256(t.encode()).hexdigest()) for i, t in texts}


def test_tasks_of_another_kind_drop_the_tokenizer():
    path = tokenizer("byte_bpe_50k.json")
    held = lambda: bpe.codec.cache_info().currsize + _powers.cache_info().currsize
    bpe.codec(path), powers(10)
    assert list(lean(lambda batches: (held() for _ in batches))([1])) == [0]
    assert list(lean(lambda batches: (len(powers(10)) for _ in batches))([1])) == [2] and held() == 0
    bpe.codec(path), powers(10)
    assert list(lean(lambda batches: (held() for _ in batches), holds="codec")([1])) == [1] and held() == 1


def test_bpe_of_odd_texts(known):
    codec = bpe.Codec(tokenizer("byte_bpe_50k.json"))
    r = random.Random(2)
    parts = ["a", "the", "=", "  ", "\n", "é", "😀", "<|endoftext|>", "'s", " 1", "\x1c", "\x85", "​", "　", "ⅷ", "日本", "\x00", "́", "²"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 60))) for _ in range(800)] + ["=" * 500, "a" * 3000, " " * 300, ""]
    for text, ids in zip(texts, codec.encode_all(texts), strict=True):
        want = known.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert codec.decode(want) == known.decode(want, skip_special_tokens=False)


def test_rules_base_columns(docs, rows, nothing):
    got = rules.judge(docs).collect()
    assert len(got) == len(rows) and rules.judge(nothing).count() == 0
    want = collections.defaultdict(set)
    for r in rows:
        text = r[1] or ""
        words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
        windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        again = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
        want[r[0]].add((len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)))
    for r in got:
        counts = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert counts in want[r.doc_id]
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.kept and r.base_failed)


def test_estimation_recovers_rates():
    r = random.Random(7)
    patterns = collections.Counter()
    for _ in range(20_000):
        good = r.random() < 0.9
        v = tuple((1 if r.random() < 0.97 else 0) if good else (-1 if r.random() < p else 1) for p in (0.5, 0.4, 0.6))
        patterns[v] += 1
    posterior, rates = rules.estimate(sorted(patterns.items()))
    assert posterior[1, 1, 1] > 0.9 and posterior[-1, 1, 1] < 0.5 and posterior[-1, -1, 1] < 0.01
    assert rules.estimate([]) == ({}, [])


def test_a_noisy_rule_does_not_reject_alone():
    def drawn(noise, own):
        r = random.Random(11)
        patterns = collections.Counter()
        for _ in range(20_000):
            bad = r.random() < 0.1
            alone = not bad and r.random() < own  # junk that the first rule alone sees
            patterns[-1 if alone or r.random() < noise else 1, *(-1 if r.random() < (0.6 if bad else 0.01) else 1 for _ in range(6))] += 1
        return sorted(patterns.items())

    lone, others = (-1, 1, 1, 1, 1, 1, 1), (1, -1, -1, -1, 1, 1, 1)
    for noise in (0.03, 0.1, 0.3):
        posterior, rates = rules.estimate(drawn(noise, 0.0))
        assert posterior[lone] > 0.9 and posterior[others] < 0.1 and abs(rates[0][1][-1] - noise) < 0.02
    posterior, _ = rules.estimate(drawn(0.0, 0.07))
    assert posterior[lone] < 0.5 and posterior[others] < 0.1 and posterior[(1,) * 7] > 0.9
    assert rules.estimate([((-1, 1), 5), ((1, 1), 95)])[0][-1, 1] < 0.5  # nothing to tell noise by


def test_rules_and_classifier_keep_clean_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    judged = {r.doc_id: r for r in rules.judge(docs).collect()}
    clean = [judged[i].kept for i, q in labels.items() if q == 1 and not judged[i].base_failed]
    junk = [judged[i].kept for i, q in labels.items() if q == 0]
    assert sum(clean) >= 0.99 * len(clean) and sum(junk) <= 0.05 * len(junk)
    held = {r.doc_id: r.kept for r in classifier.classify(docs, classifier.fit(docs)).collect()}
    clean, junk = ([held[i] for i, q in labels.items() if q == k] for k in (1, 0))
    assert sum(clean) >= 0.99 * len(clean) and sum(junk) <= 0.05 * len(junk)


def test_classifier_on_awkward_documents(docs, rows, nothing):
    model = classifier.fit(docs)
    got = classifier.classify(docs, model).collect()
    assert len(got) == len(rows) and not [r for r in got if r.kept and not dict((x[0], x[1]) for x in rows)[r.doc_id]]
    kept = classifier.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert classifier.classify(nothing, classifier.fit(nothing)).count() == 0


def test_token_counts_as_the_library(docs, rows, nothing):
    tokenizers = pytest.importorskip("tokenizers")
    pytest.importorskip("public_tokenizers")
    path = tokenizer("piece_bpe_32k.model")
    pre = tokenizers.pre_tokenizers
    split = pre.Sequence([pre.WhitespaceSplit(), pre.Metaspace(replacement="▁", prepend_scheme="always", split=True)])
    library = tokenizers.Tokenizer(tokenizers.models.Unigram(unigram.vocabulary(path), unk_id=0, byte_fallback=False))
    library.pre_tokenizer = split
    want = collections.Counter((r[0], len(library.encode(r[1] or "").ids)) for r in rows)
    assert collections.Counter((r.doc_id, r.n_tokens) for r in unigram.token_counts(docs, path).collect()) == want
    assert unigram.token_counts(nothing, path).count() == 0
    r = random.Random(4)
    for _ in range(150):  # equal scores
        vocab = [("<unk>", 0.0)] + [(p, float(r.choice([-1, -2, -3]))) for p in {"".join(r.choice("▁abc") for _ in range(r.randint(1, 4))) for _ in range(12)}]
        library = tokenizers.Tokenizer(tokenizers.models.Unigram(vocab, unk_id=0, byte_fallback=False))
        library.pre_tokenizer = split
        counter = unigram.Counter([("\0", 0.0), *vocab[1:]])
        for _ in range(10):
            word = "".join(r.choice("abcd▁") for _ in range(r.randint(1, 12)))
            assert len(library.encode(word).ids) == counter.count(word), (vocab, word)


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    before = docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = []
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, sf)
        docs = spark.createDataFrame(out.collect(), out.schema)
        counts.append(docs.count())
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns
    assert counts[0] < before.count() and counts[1] < counts[0] and counts[2] == counts[1] and counts[4] == counts[3]
    done = pipeline.run(spark, sf)
    assert sorted(map(str, done.collect())) == sorted(map(str, docs.collect()))
