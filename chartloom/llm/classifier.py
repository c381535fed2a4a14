"""A quality classifier from weak labels: heuristic labellers, their estimated accuracies, a hashed linear scorer."""

from __future__ import annotations

import operator
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm.common import SPACES, WORD, lean
from chartloom.llm.rules import estimate

LABELLERS = ("symbols", "capitals", "exclaims", "variety", "lines", "stutter", "endings")
#: Weights of the scorer, all of them broadcast; documents that it is fitted on (expected number); steps of the fit.
WEIGHTS, FITTED, STEPS = 1 << 12, 3000, 200
#: How much a labeller's measure, put in steps of a twentieth, counts beside the letter pairs of a text.
MEASURED = 0.5

_WORDS = re.compile(WORD)
_SAID = re.compile(rf"[^{SPACES}]")
_ENDED = re.compile(rf"[.!?…:;。！？][\"'»”)\]]*[{SPACES}]*$")
_SYMBOLS = [ord(c) for c in "#*$%&|<>"]


def measures(text: str) -> tuple[list[float | None], np.ndarray]:
    """Each labeller's measure, None where it abstains for want of matter, and the text's bytes.

    High means bad. Long documents are measured whole.
    """
    raw = np.frombuffer(text.encode(), np.uint8)
    words = _WORDS.findall(text)
    n = len(words)
    if not n:
        return [None] * len(LABELLERS), raw
    counts = np.bincount(raw, minlength=256)
    capitals, small = int(counts[65:91].sum()), int(counts[97:123].sum())
    lines = [x for x in text.split("\n") if _SAID.search(x)]
    out: list[float | None] = [int(counts[_SYMBOLS].sum()) / n, capitals / (capitals + small) if capitals + small >= 10 else None, int(counts[33]) / n]
    # the share of distinct pairs of words: near 1 in prose of any length
    out.append(1 - len(set(zip(words, words[1:]))) / (n - 1) if n >= 10 else None)  # noqa: B905
    out.append(1 - len(set(lines)) / len(lines) if len(lines) >= 4 else None)
    # a word said twice by chance is forgiven once
    out.append(max(0, sum(map(operator.eq, words, words[1:])) - 1) / (n - 1) if n >= 5 else None)
    out.append(1 - sum(bool(_ENDED.search(x)) for x in lines) / len(lines) if len(lines) >= 3 else None)
    return out, raw


#: For each labeller the measure up to which it votes for a document, and from which it votes against it.
BOUNDS = ((0.02, 0.1), (0.15, 0.35), (0.05, 0.25), (0.2, 0.45), (0.1, 0.4), (0.04, 0.12), (0.4, 0.9))


def votes(measured: list[float | None]) -> tuple[int, ...]:
    return tuple(0 if x is None else -1 if x >= bad else 1 if x <= good else 0 for x, (good, bad) in zip(measured, BOUNDS, strict=True))


def hashed(measured: list[float | None], raw: np.ndarray) -> np.ndarray:
    """The scorer's input: hashed counts of letter pairs, log-damped and of length 1, and hashed steps of the measures."""
    pairs = raw[:-1].astype(np.uint32) << 8 | raw[1:]
    x = np.log1p(np.bincount((pairs * np.uint32(2654435761)) >> np.uint32(20), minlength=WEIGHTS)[:WEIGHTS].astype(np.float32))
    x /= max(float(np.sqrt(x @ x)), 1.0)
    for j, m in enumerate(measured):
        step = 21 if m is None else int(min(m, 1.0) * 20)
        x[(j * 64 + step + 1) * 2654435761 % (1 << 32) >> 20] += MEASURED
    return x


@dataclass
class Model:
    """Posteriors by vote pattern (at most 3 ** labellers of them) and the scorer's fixed number of weights."""

    posterior: dict[tuple[int, ...], float]
    weights: np.ndarray
    bias: float

    def judge(self, text: str) -> tuple[float, float]:
        """(posterior of the labellers, score of the scorer)."""
        measured, raw = measures(text)
        z = float(hashed(measured, raw) @ self.weights) + self.bias
        return self.posterior.get(votes(measured), 1.0), 1 / (1 + float(np.exp(-np.clip(z, -50, 50))))


def fit_scorer(x: np.ndarray, y: np.ndarray, steps: int = STEPS, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels: accelerated gradient steps, both classes weighing the same."""
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    if not len(y):
        return w, 1.0
    good = min(max(float(y.sum()), 1.0), max(len(y) - 1.0, 1.0))
    weigh = (y / good + (1 - y) / max(len(y) - good, 1.0)) / 2
    rate = 4.0 / float((x * x).sum(axis=1).mean() + 1)
    at_w, at_b = w.copy(), b
    for k in range(steps):
        pull = weigh * (1 / (1 + np.exp(-(x @ at_w + at_b))) - y)
        new_w, new_b = at_w - rate * (x.T @ pull + decay * at_w), at_b - rate * float(pull.sum())
        push = k / (k + 3)
        at_w, at_b, w, b = new_w + push * (new_w - w), new_b + push * (new_b - b), new_w, new_b
    return w.astype(np.float32), float(b)


def fit(docs: DataFrame, fitted: int = FITTED) -> Model:
    """Labellers' accuracies from the vote patterns of all documents, then the scorer.

    The scorer is fitted on the documents whose hash of id and text falls under a share that
    ``fitted`` is of all, repeated rows once; this bound is the one thing that looks at a part
    of the rows. Null and empty texts count as texts without words, null ids as ids.
    """

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen[votes(measures(text.as_py() or "")[0])] += 1
        yield pa.RecordBatch.from_pydict({"votes": pa.array([list(v) for v in seen], pa.list_(pa.int32())), "n": pa.array([*seen.values()], pa.int64())})

    patterns = docs.select("text").mapInArrow(count, "votes array<int>, n long").groupBy("votes").agg(F.sum("n").alias("n")).limit(3 ** len(LABELLERS)).collect()
    posterior, _ = estimate(sorted((tuple(r["votes"]), r["n"]) for r in patterns))
    n = sum(r["n"] for r in patterns)
    share = min(1.0, fitted / max(n, 1))
    some = docs.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(29)), F.lit(1 << 30)) < int(share * (1 << 30)))
    texts = [r["text"] or "" for r in some.select("doc_id", "text").distinct().collect()]
    both = [measures(t) for t in sorted(texts)]
    x = np.stack([hashed(*m) for m in both]) if both else np.zeros((0, WEIGHTS), np.float32)
    y = np.array([posterior[votes(m[0])] for m in both], np.float32)
    return Model(posterior, *fit_scorer(x, y))


def _judged(texts: list[str | None], model: Model, threshold: float) -> tuple[list[tuple[float, float]], list[bool]]:
    judged = [model.judge(t or "") for t in texts]
    return judged, [s >= threshold and bool(t) and _SAID.search(t) is not None for t, (_, s) in zip(texts, judged, strict=True)]


def classify(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, posterior (of the labellers), score (of the scorer), kept for each row.

    Null and empty texts and those of white space are not kept. Repeated rows and ties get
    equal scores. Columns beyond doc_id and text are ignored. Empty tables give no rows.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            judged, kept = _judged(batch.column(1).to_pylist(), model, threshold)
            columns = [pa.array([p for p, _ in judged], pa.float64()), pa.array([s for _, s in judged], pa.float64()), pa.array(kept, pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "posterior", "score", "kept"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, posterior double, score double, kept boolean")


def accepted(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, with all their columns."""
    place = docs.columns.index("text")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_judged(batch.column(place).to_pylist(), model, threshold)[1], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
