"""Removal of repeated passages by relative Lempel-Ziv parsing.

Every block of the corpus is indexed by its word windows; documents are factored against
all blocks at once: each window learns where its words start first, neighbouring windows
with neighbouring sources make up factors, and a factor of at least a window's length is a
duplicate span. A window that lies over the border of two factors belongs to neither; it
has been looked up like the others and gives a factor of its own.

The index is dealt out by anchors. A window's anchor is the least hash of the word k-grams
in it, so equal windows have equal anchors in equal places, and neighbouring windows mostly
share one: a record names the anchor once for all its windows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm.common import NULL_ID, key_of, keyed_partitions, lean, partitions
from chartloom.llm.hashing import Texts, U, between, blocks, fitting, inside, join48, mix, pack, prefix, sliding_least, sorted_rows, split48, unpack

#: Words of a window, words of an anchor's k-gram, bytes of text in an indexed block.
WINDOW, GRAM, BLOCK = 20, 8, 5_000_000
#: A run of windows: the first one's start, how many, the source's document and first start.
RUN = np.dtype([("start", "<u4"), ("n", "<u4"), ("source", "<i8"), ("at", "<u4")])

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _runs(doc: np.ndarray, start: np.ndarray, source: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, RUN) of windows ordered by document and start: neighbours with neighbouring sources joined."""
    if not len(doc):
        return doc, np.zeros(0, RUN)
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1) | (source[1:] != source[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(fresh)
    out = np.zeros(len(first), RUN)
    out["start"], out["source"], out["at"] = start[first], source[first], at[first]
    out["n"] = np.diff(np.concatenate([first, [len(doc)]]))
    return doc[first], out


def _indexed(window: int, gram: int, keys: list[int], size: int):
    """Blocks of (id, text) to (key, blob): runs found inside the block, and its first windows by anchor."""
    parts, reach = len(keys), window - gram

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in blocks(batches, size):
            ids, texts = sorted_rows(rows)
            words, before = Texts(texts).words(2)
            sums = prefix(words)
            start = inside(before, len(words), window)
            if not len(start):
                continue
            hashes = between(sums, start, start + window, 3)
            grams = between(sums, np.arange(len(words) - gram + 1), np.arange(gram, len(words) + 1), 4)
            anchor = sliding_least(grams, reach + 1)[start].astype(np.int64)
            doc = np.searchsorted(before, start, side="right")
            begin = np.concatenate([[0], before[:-1]])
            # the first window of each kind in the block; ids ascend, so it starts earliest
            order = np.argsort(hashes, kind="stable")
            fresh = np.ones(len(order), bool)
            fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (grams[anchor[order]][1:] != grams[anchor[order]][:-1])
            first = np.empty(len(order), np.int64)
            first[order] = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))]
            again = np.flatnonzero((first != np.arange(len(first))) & ((ids[doc[first]] != ids[doc]) | (start[first] - begin[doc[first]] < start - begin[doc])))
            at = first[again]
            run_doc, runs = _runs(doc[again], start[again] - begin[doc[again]], ids[doc[at]], start[at] - begin[doc[at]])
            new = np.flatnonzero(first == np.arange(len(first)))
            anchor, start_new, doc_new = anchor[new], start[new], doc[new]
            head = np.ones(len(new), bool)
            head[1:] = (anchor[1:] != anchor[:-1]) | (doc_new[1:] != doc_new[:-1])
            record = np.cumsum(head) - 1
            heads = np.flatnonzero(head)
            mask = np.zeros(len(heads), np.int64)
            np.add.at(mask, record, 1 << (start_new - anchor + reach))
            key = grams[anchor[heads]]
            place, owner = anchor[heads] - begin[doc_new[heads]], doc_new[heads]
            counts = np.diff(np.concatenate([heads, [len(new)]]))
            to = (key % U(parts)).astype(np.int64)
            by = np.argsort(to, kind="stable")
            cuts = np.searchsorted(to[by], np.arange(parts + 1))
            run_to = (mix(run_doc.astype(U), 31) % U(parts)).astype(np.int64)
            out = []
            for p in range(parts):
                mine, passed = by[cuts[p] : cuts[p + 1]], np.flatnonzero(run_to == p)
                if not len(mine) and not len(passed):
                    continue
                used, local = np.unique(owner[mine], return_inverse=True)
                n = counts[mine]
                each = np.repeat(heads[mine] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                blob = pack([
                    ("<i8", ids[run_doc[passed]]), ("u1", runs[passed].view("u1")), ("<i8", ids[used]), *split48(key[mine] // U(parts)), (fitting(local), local),
                    (fitting(place[mine]), place[mine]), ("<u4" if reach >= 16 else "<u2", mask[mine]), *split48(hashes[new[each]]),
                ])
                out.append((keys[p], blob))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary())], names=["key", "blob"])

    return run


def _by_document(doc: np.ndarray, runs: np.ndarray) -> pa.RecordBatch:
    """A row (id, runs) for each document."""
    order = np.argsort(doc, kind="stable")
    doc, runs = doc[order], runs[order]
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
    raw, size = runs.tobytes(), runs.dtype.itemsize
    ends = np.concatenate([first, [len(doc)]]) * size
    return pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array([raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())], names=["id", "runs"])


def _resolved(window: int, gram: int, keys: list[int]):
    """Blobs of one partition to (key, blob) by document: each window that starts earlier elsewhere, with the place."""
    reach, parts = window - gram, len(keys)

    def dealt(doc: np.ndarray, runs: np.ndarray) -> pa.RecordBatch:
        to = (mix(doc.astype(U), 32) % U(parts)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        cuts = np.searchsorted(to[order], np.arange(parts + 1))
        some = [p for p in range(parts) if cuts[p] < cuts[p + 1]]
        blobs = [pack([("<i8", doc[i]), ("u1", runs[i].view("u1"))]) for p in some for i in (order[cuts[p] : cuts[p + 1]],)]
        return pa.RecordBatch.from_arrays([pa.array([keys[p] for p in some], pa.int64()), pa.array(blobs, pa.binary())], names=["key", "blob"])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, passed = [], []
        for batch in batches:
            for blob in batch.column(1):
                doc, runs, *rest = unpack(blob.as_py())
                passed.append((doc, runs.view(RUN)))
                held.append(rest)
        if not held:
            return
        base = np.concatenate([[0], np.cumsum([len(h[0]) for h in held])])
        ids = np.concatenate([h[0] for h in held])
        key = np.concatenate([join48(h[1], h[2]) for h in held])
        owner = np.concatenate([h[3].astype(np.int64) + base[i] for i, h in enumerate(held)])
        place = np.concatenate([h[4].astype(np.int64) for h in held])
        mask = np.concatenate([h[5] for h in held])
        hashes = np.concatenate([join48(h[6], h[7]) for h in held])
        del held
        bits = np.unpackbits(mask.view(np.uint8), bitorder="little").reshape(len(mask), mask.itemsize * 8)
        record, bit = (x.astype(np.int32) for x in np.nonzero(bits))
        del bits
        both = mix(key)[record] + hashes * U(0x9E3779B97F4A7C15)
        order = np.argsort(both)
        same = both[order[1:]] == both[order[:-1]]
        met = np.zeros(len(order) + 1, bool)
        met[1:-1] = same
        some = order[met[1:] | met[:-1]]  # windows that occur twice or more
        del order, same, met
        record, bit, both, hashes = record[some], bit[some], both[some], hashes[some]
        doc, start = ids[owner[record]], place[record] + bit - reach
        order = np.lexsort((start, doc, both))
        doc, start, both, hashes, key = doc[order], start[order], both[order], hashes[order], key[record[order]]
        fresh = np.ones(len(doc), bool)
        fresh[1:] = (both[1:] != both[:-1]) | (hashes[1:] != hashes[:-1]) | (key[1:] != key[:-1])
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(doc)), 0)) if len(doc) else np.zeros(0, np.int64)
        again = np.flatnonzero((doc != doc[first]) | (start != start[first]))
        at = first[again]
        doc, start, source, at = doc[again], start[again], doc[at], start[at]
        order = np.lexsort((start, doc))
        passed.append(_runs(doc[order], start[order], source[order], at[order]))
        yield dealt(np.concatenate([d for d, _ in passed]), np.concatenate([r for _, r in passed]))

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blobs of one partition's documents to a row (id, runs) for each."""
    held = [unpack(blob.as_py()) for batch in batches for blob in batch.column(1)]
    if held:
        yield _by_document(np.concatenate([h[0] for h in held]), np.concatenate([h[1].view(RUN) for h in held]))


def factors(runs: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int, int]]:
    """The parse of one document: factors (start, end, source document, source start) in words.

    Runs with one source side by side are one phrase. From the first word that a phrase
    covers, the parse takes the phrase that reaches furthest, then goes on where that
    ends: with the phrases over the border first, which start before it.
    """
    if not len(runs):
        return []
    runs = runs[np.lexsort((runs["start"], runs["start"].astype(np.int64) - runs["at"], runs["source"]))]
    start, n, at = (runs[c].astype(np.int64) for c in ("start", "n", "at"))
    fresh = np.ones(len(runs), bool)
    fresh[1:] = (runs["source"][1:] != runs["source"][:-1]) | (start[1:] - at[1:] != start[:-1] - at[:-1]) | (start[1:] > (start + n)[:-1])
    heads = np.flatnonzero(fresh)
    phrases = sorted(zip(start[heads].tolist(), (np.maximum.reduceat(start + n, heads) + window - 1).tolist(), runs["source"][heads].tolist(), at[heads].tolist(), strict=True))
    out, i, here = [], 0, 0
    best: tuple[int, int, int, int] | None = None
    while i < len(phrases) or best is not None:
        while i < len(phrases) and phrases[i][0] <= here:
            if best is None or phrases[i][1] > best[1]:
                best = phrases[i]
            i += 1
        if best is not None and best[1] > here:
            out.append(best)
            here, best = best[1], None
        else:
            best = None
            if i < len(phrases):
                here = max(here, phrases[i][0])
    return out


def _kept(window: int, as_text: bool):
    """(doc_id, text, runs) to what is left of each text."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, runs in zip(batch.column(1), batch.column(2), strict=True):
                words = _WORD.findall((text.as_py() or "").encode())
                n = len(words)
                found = factors(np.frombuffer(runs.as_py(), RUN), window) if runs.is_valid else []
                if found:
                    left = np.ones(n, bool)
                    for start, end, _, _ in found:
                        left[start:end] = False
                    words = [w for w, keep in zip(words, left.tolist(), strict=False) if keep]
                kept = b" ".join(words)
                spans = [{"start": a, "end": b, "source": None if s == NULL_ID else s, "source_start": c} for a, b, s, c in found]
                out.append((n, n - len(words), kept.decode() if as_text else hashlib.sha256(kept).hexdigest(), spans if as_text else len(spans), max((b - a for a, b, _, _ in found), default=0)))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("source", pa.int64()), ("source_start", pa.int64())]))
            kinds = [pa.int64(), pa.int64(), pa.string(), span if as_text else pa.int64(), pa.int64()]
            names = ["doc_id", "n_words", "n_removed", "kept" if as_text else "kept_sha256", "factors" if as_text else "n_factors", "longest"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=names)

    return run


def parsed(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """doc_id, text (null: empty), runs: each row with the runs of its windows that start earlier elsewhere."""
    spark = docs.sparkSession
    keys = keyed_partitions(spark, partitions(spark))
    rows = docs.select("doc_id", key_of(F.col("doc_id")).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    index = rows.select("id", "text").mapInArrow(_indexed(window, gram, keys, block), "key long, blob binary").repartition(len(keys), "key")
    runs = index.mapInArrow(_resolved(window, gram, keys), "key long, blob binary").repartition(len(keys), "key").mapInArrow(_gathered, "id long, runs binary")
    return rows.join(runs, "id", "left").select("doc_id", "text", "runs")


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_removed, kept, factors, longest: one row for each input row.

    A word goes if a window of ``window`` words that covers it also starts earlier: in a
    document of a smaller doc_id, or earlier in the same one; windows are judged on the
    input. ``kept`` joins the words that are left by one space. Windows are compared by
    96 bits of hashes or more.

    Null and empty texts have no words; texts shorter than a window lose nothing. A null
    doc_id counts as the least. Repeated rows count as one document, rows of one doc_id
    with different texts as parts of it: a span found in one goes from all. Empty tables
    give no rows. Columns beyond doc_id and text are ignored.
    """
    schema = "n_words long, n_removed long, kept string, factors array<struct<start:long,end:long,source:long,source_start:long>>, longest long"
    return _applied(docs, window, gram, block, True, schema)


def digests(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """As ``dedup``, with the SHA-256 digest of the kept text and the number of factors in their place."""
    return _applied(docs, window, gram, block, False, "n_words long, n_removed long, kept_sha256 string, n_factors long, longest long")


def _applied(docs: DataFrame, window: int, gram: int, block: int, as_text: bool, schema: str) -> DataFrame:
    rows = parsed(docs, window, gram, block)
    return rows.mapInArrow(_kept(window, as_text), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {schema}")
