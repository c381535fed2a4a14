"""Token counts of a unigram tokenizer: Aho-Corasick matches and a Viterbi pass that only counts."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from chartloom.llm.common import lean

#: The white space that parts words (Unicode White_Space) and the sign put before each word. Fixed values.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
MARK = "▁"
#: What an unknown character costs below the least score of the vocabulary. Fixed value.
UNKNOWN = 10.0
#: Words that a worker remembers, the longest that it does, characters counted at a time.
REMEMBERED, LONGEST, CHARS = 500_000, 48, 400_000


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece file, scored -ln(1 + rank): earlier pieces are likelier.

    The file's control, unknown and byte pieces get no matches: they keep their ids under
    names that no text can hold.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(model.get_piece_size()):
        odd = model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
        out.append(("\0" * (i + 1) if odd else model.id_to_piece(i), -math.log(1 + i)))
    return out


class Counter:
    """Counts pieces of words over one vocabulary.

    The best score to reach each character and the number of pieces on that way are all
    that is kept. The tokenizer's rules of choice: of ways with equal scores the one whose
    last piece starts first; a character that no single piece covers can be unknown at
    the least score less ``UNKNOWN``; neighbouring unknown characters are one piece.
    """

    def __init__(self, vocab: list[tuple[str, float]]):
        import ahocorasick
        import regex

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocab:
            if piece and "\0" not in piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.single = {p for p, _ in vocab if len(p) == 1}
        self.unknown = min((s for _, s in vocab), default=0.0) - UNKNOWN
        if len(self.automaton):
            self.automaton.make_automaton()
        self.split = regex.compile(f"[^{SPACE}]+").findall
        self.known: dict[str, int] = {}

    def count(self, word: str) -> int:
        """The pieces of one word with a mark before it; each mark in it begins a part of its own."""
        first, *rest = (word if word.startswith(MARK) else MARK + word)[1:].split(MARK)
        return self._part(MARK + first) + sum(self._part(MARK + x) for x in rest)

    def _part(self, text: str) -> int:
        at: list[list[tuple[int, float]]] = [[] for _ in text]
        if len(self.automaton):
            for end, match in self.automaton.iter(text):
                at[end].append(match)
        scores, pieces, open_ = [0.0], [0], [False]
        for i, matches in enumerate(at):
            best = None
            for size, score in sorted(matches, reverse=True):  # the first start first
                way = score + scores[i + 1 - size]
                if best is None or way > best:
                    best, n = way, pieces[i + 1 - size] + 1
            unknown = False
            if text[i] not in self.single:
                way = self.unknown + scores[i]
                if best is None or way > best:
                    best, n, unknown = way, pieces[i] + (not open_[i]), True
            scores.append(best)
            pieces.append(n)
            open_.append(unknown)
        return pieces[-1]

    def count_all(self, texts: list[str]) -> Iterator[tuple[int, int]]:
        """(pieces, words) of each text."""
        known = self.known
        for text in texts:
            if len(known) > REMEMBERED:
                known.clear()
            words, n = self.split(text), 0
            for w in words:
                k = known.get(w)
                if k is None:
                    k = self.count(w)
                    if len(w) <= LONGEST:
                        known[w] = k
                n += k
            yield n, len(words)


@lru_cache(maxsize=1)
def counter(path: str) -> Counter:
    return Counter(vocabulary(path))


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, n_words for each row, of whole texts.

    Null and empty texts and those of white space only have no tokens. Repeated rows give
    repeated rows. Columns beyond doc_id and text are ignored. Nothing is shuffled; a
    worker remembers a bounded number of words. ``path`` names the vocabulary on the
    executors.
    """
    rows = docs.select("doc_id", "text")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                counts = list(own.count_all([t or "" for t in part.column(1).to_pylist()]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([c[0] for c in counts], pa.int64()), pa.array([c[1] for c in counts], pa.int64())], names=["doc_id", "n_tokens", "n_words"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_words long")
