"""Personal data: expressions propose spans, checksums confirm, context words score."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from chartloom.llm.common import lean

#: The kinds of the base rule, in the order in which they are listed.
BASE = ("email", "ip", "card", "phone")
#: Kinds that the method adds; base spans are never dropped for them.
ADDED = ("iban", "ssn")
KINDS = BASE + ADDED

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits is tried from its first digit only: a later start gives no match that the first does not
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_APART = re.compile(r"[\x20-]")
_NOT_DIGIT = re.compile(r"[^0-9]")

#: What a kind's expression and validator alone are worth, and words that raise it nearby.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.35}
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "payment", "pay"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "transfer"),
    "ssn": ("ssn", "social", "security"),
}
#: Characters before and after a span that are read for context, what a word adds, and what an added span needs.
NEAR, BONUS, LEAST = 60, 0.35, 0.6


def luhn(digits: str) -> bool:
    """The checksum of payment cards."""
    doubled = [2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2])]
    return (sum(map(int, digits[::-2])) + sum(doubled)) % 10 == 0


def mod97(iban: str) -> bool:
    """The checksum of international account numbers (letters count from 10)."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, each found from its @, so that long runs of letters cost no retries."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, end := m.end()))
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)
    return found


def _scored(text: str, kind: str, start: int, end: int) -> float:
    near = (text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]).lower()
    return min(1.0, SCORES[kind] + BONUS * any(word in near for word in CONTEXT[kind]))


def find(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) in code points, end exclusive, ordered by kind as listed, then start.

    The four base kinds stay whatever their score; an added kind needs ``LEAST``.
    """
    if not text:
        return []
    spans: list[tuple[str, int, int]] = []
    if "@" in text:
        spans += [("email", *x) for x in emails(text)]
    spans += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) < 4 and int(x[-3:]) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() and 16 <= len(digits := _APART.sub("", m[0])) <= 19 and luhn(digits):
            spans.append(("card", *m.span()))
    if "+" in text:
        spans += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    out = [(kind, a, b, _scored(text, kind, a, b)) for kind, a, b in spans]
    more = [("iban", *m.span()) for m in _IBAN.finditer(text) if 15 <= len(x := m[0].replace(" ", "")) <= 34 and mod97(x)]
    more += [("ssn", *m.span()) for m in _SSN.finditer(text)]
    return out + [(kind, a, b, s) for kind, a, b in more if (s := _scored(text, kind, a, b)) >= LEAST]


def _listed(spans: list) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b, _ in spans)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, n_added, base_sha256, spans, least_score for each row.

    Null and empty texts have no spans. Repeated rows give repeated rows. Columns beyond
    doc_id and text are ignored. Rows are independent: nothing is shuffled.
    """
    names = [f"n_{k}" for k in BASE] + ["n_added", "base_sha256", "spans", "least_score"]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                spans = find(text.as_py())
                base = [x for x in spans if x[0] in BASE]
                counts = [sum(x[0] == k for x in base) for k in BASE]
                rows.append((*counts, len(spans) - len(base), hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(spans), min((x[3] for x in spans), default=None)))
            columns = [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in names]
            kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", *names])

    schema = ", ".join(f"{n} {'long' if n.startswith('n_') else 'double' if n == 'least_score' else 'string'}" for n in names)
    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {schema}")


def masked(text: str) -> str:
    """``text`` with each span replaced by its kind in angle brackets; of overlapping spans the first to start counts."""
    out, end = [], 0
    for kind, a, b, _ in sorted(find(text), key=lambda x: (x[1], -x[2])):
        if a >= end:
            out += [text[end:a], f"<{kind}>"]
            end = b
        elif b > end:  # the rest of an overlapping span goes too
            end = b
    return "".join([*out, text[end:]])


def redact(docs: DataFrame, column: str = "text", length: str = "n_chars") -> DataFrame:
    """The rows of ``docs`` with spans in ``column`` masked and ``length``, if there, counted anew; null stays null."""
    names = docs.columns

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            texts = [x if x is None else masked(x) for x in batch.column(names.index(column)).to_pylist()]
            columns[names.index(column)] = pa.array(texts, pa.string())
            if length in names:
                old = batch.column(names.index(length)).to_pylist()
                columns[names.index(length)] = pa.array([o if t is None else len(t) for o, t in zip(old, texts, strict=True)], batch.schema.field(names.index(length)).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)
