"""Byte-level BPE encoding by traversal of a prefix-sharing trie, and decoding."""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import pairwise
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chartloom.llm.common import HELD, lean

#: How byte-level tokenizers part text before the merges. Fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words that a worker remembers, the longest that it does, characters encoded at a time.
REMEMBERED, LONGEST, CHARS = 500_000, 48, 400_000


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies.

    Printable bytes stand for themselves; the others take the letters from 256 on.
    """
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encodes and decodes with one tokenizer file.

    The encoding of a word is fixed by its last token and the encoding of what stands
    before that: of the tokens that end a prefix exactly one stays apart from the last
    token of the shorter prefix when both are merged afresh. So each prefix, a node of
    the trie of all distinct words, needs its last token only, and words that share a
    prefix share its nodes. Words are visited in sorted order, which is the depth-first
    order of their trie; the path to the current node is all that is held of it.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        letters = byte_letters()
        plain = lambda token: bytes(letters[c] for c in token)
        vocab = file["model"]["vocab"]
        self.ids = {plain(t): i for t, i in vocab.items()}
        self.merges, self.made = {}, {}
        for rank, pair in enumerate(file["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
            self.made.setdefault(vocab[a + b], (rank, vocab[a], vocab[b]))
        self.bytes_of = {i: t for t, i in self.ids.items()}
        self.special = {x["content"]: x["id"] for x in file["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.sizes = {i: len(t) for i, t in self.bytes_of.items()}
        self.endings = {t[i:] for t in self.ids for i in range(len(t))}
        self.apart: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        import regex

        self.split = regex.compile(PATTERN).findall
        self.at_special = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None

    def merged(self, word: bytes) -> list[int]:
        """The merges by rank, one at a time: for single tokens only."""
        out = [self.ids[word[i : i + 1]] for i in range(len(word))]
        while len(out) > 1:
            best = min(((self.merges[p][0], i) for i, p in enumerate(pairwise(out)) if p in self.merges), default=None)
            if best is None:
                break
            i = best[1]
            out[i : i + 2] = [self.merges[out[i], out[i + 1]][1]]
        return out

    def _stay_apart(self, a: int, b: int) -> bool:
        """Whether merging a's and b's bytes afresh gives a and b again.

        Takes back the merges at the border, the latest first. A pair over the border
        that merges before the one taken back would have been joined instead; of equal
        merges the left one comes first.
        """
        known = self.apart.get(a << 20 | b)
        if known is None:
            if len(self.apart) > 1_000_000:
                self.apart.clear()
            key, limit, known = a << 20 | b, 1 << 40, True
            while True:
                if (over := self.merges.get((a, b))) is not None and over[0] < limit:
                    known = False
                    break
                of_a, of_b = self.made.get(a), self.made.get(b)
                if of_a is None and of_b is None:
                    break
                if of_b is None or of_a is not None and of_a[0] > of_b[0]:
                    limit, a = of_a[0], of_a[2]
                else:
                    limit, b = of_b[0] + 1, of_b[1]
            self.apart[key] = known
        return known

    def _stays_whole(self, a: int) -> bool:
        known = self.whole.get(a)
        if known is None:
            known = self.whole[a] = self.merged(self.bytes_of[a]) == [a]
        return known

    def traverse(self, words: list[bytes]) -> Iterator[list[int]]:
        """The ids of each of some sorted words."""
        last: list[int] = []  # last[i]: last token of the path's first i+1 bytes
        ids, endings, sizes, apart = self.ids, self.endings, self.sizes, self.apart
        for word, shared in zip(words, _shared(words), strict=True):
            del last[shared:]
            for end in range(shared + 1, len(word) + 1):
                start, found = end - 1, []
                while start >= 0 and (tail := word[start:end]) in endings:
                    if (token := ids.get(tail)) is not None:
                        found.append((token, start))
                    start -= 1
                for token, start in reversed(found):
                    if start:
                        if (known := apart.get(last[start - 1] << 20 | token)) is None:
                            known = self._stay_apart(last[start - 1], token)
                        if not known:
                            continue
                    if self._stays_whole(token):
                        last.append(token)
                        break
            out, end = [], len(word)
            while end:
                out.append(last[end - 1])
                end -= sizes[out[-1]]
            yield out[::-1]

    def learn(self, words: set[str]) -> None:
        """Encodes the words that are not remembered."""
        if len(self.words) > REMEMBERED:
            self.words.clear()
        ordered = sorted(w.encode() for w in words)
        for word, ids in zip(ordered, self.traverse(ordered), strict=True):
            self.words[word.decode()] = pack(f"<{len(ids)}I", *ids)

    def parts(self, text: str) -> list[str | int]:
        """The words of a text in order, special tokens as their ids."""
        if self.at_special is None or not any(s in text for s in self.special):
            return self.split(text)
        out, end = [], 0
        for m in self.at_special.finditer(text):
            out += [*self.split(text[end : m.start()]), self.special[m[0]]]
            end = m.end()
        return out + self.split(text[end:])

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        for chunk in _chunks(texts):
            parts = [self.parts(t) for t in chunk]
            words = {w for p in parts for w in p if w.__class__ is str}
            if new := {w for w in words if w not in self.words}:
                self.learn(new)
                if missing := {w for w in words if w not in self.words}:  # what was known has made room
                    self.learn(missing)
            for p in parts:
                if any(w.__class__ is int for w in p):
                    yield b"".join(w.to_bytes(4, "little") if w.__class__ is int else self.words[w] for w in p)
                else:
                    yield b"".join(map(self.words.__getitem__, p))
            for w in words:
                if len(w) > LONGEST:
                    self.words.pop(w, None)

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def _shared(words: list[bytes]) -> list[int]:
    """How many leading bytes each word has in common with the one before (counted up to ``LONGEST``)."""
    if not words:
        return []
    cells = np.array(words, f"S{LONGEST}").view(np.uint8).reshape(len(words), LONGEST)
    same = np.ones((len(words), LONGEST + 1), bool)
    same[:, -1] = False
    same[0] = False
    np.equal(cells[1:], cells[:-1], out=same[1:, :-1])
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    least = np.minimum(sizes, np.concatenate([[0], sizes[:-1]]))
    return np.minimum(same.argmin(axis=1), least).tolist()


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    some, n = [], 0
    for t in texts:
        some.append(t)
        n += len(t)
        if n >= CHARS:
            yield some
            some, n = [], 0
    if some:
        yield some


@lru_cache(maxsize=1)
def codec(path: str) -> Codec:
    return Codec(path)


HELD["codec"] = codec.cache_clear


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit), decoded for each row.

    Null text is encoded as the empty one. Repeated rows give repeated rows. Columns
    beyond doc_id and text are ignored. Nothing is shuffled; a worker remembers a bounded
    number of words. ``path`` names the tokenizer's file on the executors.
    """
    return _mapped(docs, path, lambda ids, text: (len(ids) // 4, ids, text), [("n_tokens", "long", pa.int64()), ("ids", "binary", pa.binary()), ("decoded", "string", pa.string())])


def digests(docs: DataFrame, path: str) -> DataFrame:
    """As ``encode``, with SHA-256 digests of ids and decoded text in their place."""
    sha = lambda b: hashlib.sha256(b).hexdigest()
    kinds = [("n_tokens", "long", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())]
    return _mapped(docs, path, lambda ids, text: (len(ids) // 4, sha(ids), sha(text.encode())), kinds)


def _mapped(docs: DataFrame, path: str, row, kinds: list) -> DataFrame:
    names = ["doc_id", *[k[0] for k in kinds]]

    @functools.partial(lean, holds="codec")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [t or "" for t in part.column(1).to_pylist()]
                rows = [row(ids, own.decode(memoryview(ids).cast("I"))) for ids in own.encode_all(texts)]
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, k[2]) for c, k in zip(columns, kinds, strict=True)]], names=names)

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{n} {t}" for n, t, _ in kinds))
