"""Removal of repeated byte strings by sparse suffix sorting, deep-shallow.

Of all suffixes those that start at anchors are sorted: the anchor of a window is the least
hash of the k-grams in it, so equal windows have equal anchors in equal places and their
suffixes there share a long prefix. Suffixes are dealt out by anchor. Where all windows of
an anchor stand in equal surroundings a hash settles them; what is left is sorted by bytes:
multikey quicksort on 8-byte symbols to a shallow depth, then a blind trie for each group
still undivided. Right and left of the anchor, the orders and their longest common prefixes
tell for each window whether another one is equal.

An anchor in very many different surroundings, such as the edge of a passage that a third of
all documents share, would make one group of them all: there each window goes by its own
hash to a partition of its own, and equal windows of a block are settled before they go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm.common import cut, key_of, keyed_partitions, lean, partitions
from chartloom.llm.hashing import Texts, U, between, blocks, byte_numbers, fitting, inside, join48, mix, pack, prefix, sliding_least, sorted_rows, split48, unpack

#: Bytes of a window, of an anchor's k-gram, of text in a block, of the shallow sort (whole symbols).
WINDOW, GRAM, BLOCK, SHALLOW = 400, 32, 1_500_000, 64
#: Surroundings of one anchor that are sorted together, and that a block sends to the anchor's partition; where there are more, windows go by hash.
MANY, FEW = 128, 16
#: Windows hashed at once.
HASHED = 500_000
#: Bytes [start, end) that go; and surroundings to compare: group, first window, windows, anchor's place behind the first, settled, of a group beyond MANY.
SPAN = np.dtype([("start", "<u4"), ("end", "<u4")])
PLACE = np.dtype([("group", "<u8"), ("first", "<u4"), ("windows", "<u2"), ("anchor", "<u2"), ("settled", "u1"), ("hot", "u1")])


def _common(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the longest common prefix, known to be ``at`` or more."""
    most = min(len(a), len(b))
    if a[at:most] == b[at:most]:
        return most
    low, high = at, most - 1
    while low < high:
        mid = (low + high + 1) // 2
        if a[at:mid] == b[at:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class BlindTrie:
    """Sorts strings that share a long prefix: inner nodes know depths and branching bytes only."""

    def __init__(self, texts: list[bytes], members: list[int], depth: int):
        self.texts, self.depth = texts, depth
        self.root: list | int = members[0]
        self.equal: dict[int, list[int]] = {}
        for i in members[1:]:
            self._insert(i)

    @staticmethod
    def _branch(text: bytes, depth: int) -> int:
        return text[depth] if depth < len(text) else -1

    def _insert(self, new: int) -> None:
        text, node = self.texts[new], self.root
        while type(node) is list:  # blindly down to some leaf
            node = node[1].get(self._branch(text, node[0])) if self._branch(text, node[0]) in node[1] else next(iter(node[1].values()))
        leaf = self.texts[node]
        shared = _common(text, leaf, self.depth)
        if shared == len(text) == len(leaf):
            self.equal.setdefault(node, []).append(new)
            return
        above, node = None, self.root
        while type(node) is list and node[0] < shared:
            above, node = node, node[1][self._branch(text, node[0])]
        mine = self._branch(text, shared)
        if type(node) is list and node[0] == shared:
            node[1][mine] = new
            return
        between_ = [shared, {mine: new, self._branch(leaf, shared): node}]
        if above is None:
            self.root = between_
        else:
            above[1][self._branch(text, above[0])] = between_

    def ordered(self) -> Iterator[tuple[int, int]]:
        """(member, prefix in common with the member before) in order."""
        stack: list[tuple[list | int, int]] = [(self.root, self.depth)]
        while stack:
            node, shared = stack.pop()
            if type(node) is list:
                children = [child for _, child in sorted(node[1].items())]
                stack += [(child, node[0]) for child in reversed(children[1:])]
                stack.append((children[0], shared))
            else:
                yield node, shared
                for twin in self.equal.get(node, ()):
                    yield twin, len(self.texts[node])


def deep_shallow(groups: np.ndarray, texts: list[bytes], shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(order, common) of texts within groups: ``common`` is the prefix shared with the text before, 0 where a group starts.

    Multikey quicksort splits by one 8-byte symbol after the other, and only what is still
    undivided goes on to the next; blind tries order what is equal up to ``shallow``.
    """
    n = len(texts)
    width = shallow // 8
    cells = np.frombuffer(b"".join(t[:shallow].ljust(shallow, b"\0") for t in texts), ">u8").reshape(n, width).astype(U)
    sizes = np.fromiter(map(len, texts), np.int64, n)
    order = np.argsort(groups, kind="stable")
    bucket = np.concatenate([[0], np.cumsum(groups[order][1:] != groups[order][:-1])]) if n else np.zeros(0, np.int64)
    common = np.zeros(n, np.int64)  # of a place with the one before; set when the two part
    parted = np.concatenate([[True], bucket[1:] != bucket[:-1]]) if n else np.zeros(0, bool)
    for j in range(width):
        open_ = ~parted
        open_[:-1] |= ~parted[1:]
        places = np.flatnonzero(open_)
        if not len(places):
            break
        key = np.cumsum(parted)[places]
        symbol = cells[order[places], j]
        by = np.lexsort((symbol, key))
        order[places] = order[places][by]
        symbol = symbol[by]
        new = np.zeros(len(places), bool)
        new[1:] = (symbol[1:] != symbol[:-1]) & (key[1:] == key[:-1])
        at = np.flatnonzero(new)
        x = symbol[at] ^ symbol[at - 1]
        same = np.zeros(len(x), np.int64)
        for byte in range(1, 8):
            same += x < U(1 << (64 - 8 * byte))
        common[places[at]] = 8 * j + same
        parted[places[at]] = True
    # padding looks like zero bytes: what is short goes to the tries as well, compared by real length
    starts = np.flatnonzero(parted)
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), n], strict=True):
        if b - a > 1:
            members = order[a:b].tolist()
            depth = min(shallow, int(sizes[members].min()))
            for k, (i, shared) in enumerate(BlindTrie(texts, members, depth).ordered()):
                order[a + k] = i
                if k:
                    common[a + k] = shared
    inner = np.flatnonzero(common > 0)
    common[inner] = np.minimum(common[inner], np.minimum(sizes[order[inner]], sizes[order[inner - 1]]))
    return order, common


def repeated(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], lefts: np.ndarray, rights: np.ndarray, window: int) -> Iterator[tuple[int, int, int]]:
    """(member, j, k): in one group, members whose windows from j to k bytes before the anchor occur twice or more.

    ``left`` and ``right`` are (order, common) of what stands before and after the anchor.
    Two members share the window that starts j bytes before it if they have j bytes to the
    left and window - j to the right in common. Both partitions change at few values of j;
    between these one look at all members is enough.
    """
    m = len(lefts)
    n_left, n_right = left[1], right[1]
    steps = np.unique(np.concatenate([n_left + 1, window - n_right, lefts + 1, window - rights, [0]]))
    steps = steps[(steps >= 0) & (steps <= min(int(lefts.max()), window))].tolist()
    last = min(int(lefts.max()), window)
    a, b = np.empty(m, np.int64), np.empty(m, np.int64)
    for j, after in zip(steps, [*steps[1:], last + 1], strict=True):
        fits = (lefts >= j) & (rights >= window - j)
        if fits.sum() < 2:
            continue
        a[left[0]] = np.cumsum(n_left < j)
        b[right[0]] = np.cumsum(n_right < window - j)
        pair = (a * (m + 1) + b)[fits]
        _, back, count = np.unique(pair, return_inverse=True, return_counts=True)
        for i in np.flatnonzero(fits)[count[back] > 1].tolist():
            yield i, j, after - 1


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(doc, spans): spans that touch or overlap in one document as one."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if not len(doc):
        return doc, _spans(start, end)
    apart = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]])) << 33
    reach = np.maximum.accumulate(end + apart)
    heads = np.flatnonzero(np.concatenate([[True], (start + apart)[1:] > reach[:-1]]))
    last = np.concatenate([heads[1:], [len(doc)]]) - 1
    return doc[heads], _spans(start[heads], (reach - apart)[last])


def _dealt(to: np.ndarray, parts: int) -> list[np.ndarray]:
    """For each partition the indices that go to it."""
    by = np.argsort(to, kind="stable")
    cuts = np.searchsorted(to[by], np.arange(parts + 1))
    return [by[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _places(key: np.ndarray, first: np.ndarray, count: np.ndarray, anchor: np.ndarray, settled: np.ndarray, hot: np.ndarray | bool) -> np.ndarray:
    out = np.zeros(len(key), PLACE)
    out["group"], out["first"], out["windows"], out["anchor"], out["settled"], out["hot"] = mix(key), first, count, anchor, settled, hot
    return out


def _twice(low: np.ndarray, high: np.ndarray, doc: np.ndarray, start: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, heads, again) of windows sorted by hash: where equal ones begin, and whether they stand in two places or are known to.

    A place that comes twice, from a repeated row, is one place.
    """
    order = np.lexsort((start, doc, low, high))
    low, high, doc, start = low[order], high[order], doc[order], start[order]
    new = np.ones(len(order), bool)
    new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    other = new.copy()
    other[1:] |= (doc[1:] != doc[:-1]) | (start[1:] != start[:-1])
    heads = np.flatnonzero(new)
    if not len(heads):
        return order, heads, np.zeros(0, bool)
    return order, heads, (np.add.reduceat(other.astype(np.int64), heads) > 1) | np.logical_or.reduceat(known[order], heads)


def _anchored(window: int, gram: int, keys: list[int], size: int, few: int):
    """Blocks of (id, text) to (key, blob): anchors with hashes of their surroundings.

    One place of each kind goes to the anchor's partition. What a block settles by itself and
    the places of anchors that are hot in it go to partitions dealt by id.
    """
    parts = len(keys)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in blocks(batches, size):
            ids, raws = sorted_rows([r for r in rows if len(r[1]) >= window])
            texts = Texts(raws)
            start = inside(texts.ends, len(texts.raw), window) if len(raws) else np.zeros(0, np.int64)
            if not len(start):
                continue
            sums = prefix(byte_numbers(5, False)[texts.raw])
            n = len(texts.raw) - gram + 1
            grams = between(sums, np.arange(n), np.arange(gram, n + gram), 6)
            anchor = sliding_least(grams, window - gram + 1)[start].astype(np.int64)
            doc = np.searchsorted(texts.ends, start, side="right")
            head = np.ones(len(start), bool)
            head[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
            heads = np.flatnonzero(head)
            count = np.diff(np.concatenate([heads, [len(start)]]))
            anchor, doc, start = anchor[heads], doc[heads], start[heads]
            around = between(sums, start, start + count - 1 + window, 7) ^ mix(((anchor - start) << 20 | count).astype(U), 8)
            key = grams[anchor]
            first, anchor = start - np.concatenate([[0], texts.ends[:-1]])[doc], anchor - start
            order, heads, again = _twice(around, key, ids[doc], first, np.zeros(len(key), bool))
            same = order[np.repeat(again, np.diff(np.concatenate([heads, [len(order)]])))]
            owner, spans = _merged(ids[doc[same]], first[same], first[same] + count[same] - 1 + window)
            key, doc, around, first, count, anchor = (x[order[heads]] for x in (key, doc, around, first, count, anchor))
            new_key = np.concatenate([[True], key[1:] != key[:-1]])
            hot = (np.bincount(np.cumsum(new_key) - 1) > few)[np.cumsum(new_key) - 1]
            owned, places = ids[doc[hot]], _places(key[hot], first[hot], count[hot], anchor[hot], again[hot], True)
            go = np.flatnonzero(~hot | new_key)  # of a hot anchor one place, as a sign
            key, doc, around, first, count, anchor, flag = (x[go] for x in (key, doc, around, first, count, anchor, again + 2 * hot))
            deal, deal_spans, deal_places = (_dealt(to, parts) for to in ((key % U(parts)).astype(np.int64), owner % parts, owned % parts))
            out = []
            for p in range(parts):
                mine, of_spans, of_places = deal[p], deal_spans[p], deal_places[p]
                if len(mine) + len(of_spans) + len(of_places):
                    used, local = np.unique(doc[mine], return_inverse=True)
                    out.append((keys[p], pack([
                        ("<i8", ids[used]), (fitting(local), local), *split48(key[mine] // U(parts)), ("<u8", around[mine]), (fitting(first[mine]), first[mine]), ("<u2", count[mine]), ("<u2", anchor[mine]), ("u1", flag[mine]),
                        ("<i8", owner[of_spans]), ("u1", spans[of_spans].view("u1")), ("<i8", owned[of_places]), ("u1", places[of_places].view("u1")),
                    ])))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary())], names=["key", "blob"])

    return run


def _rows_of(doc: np.ndarray, items: np.ndarray, column: str) -> pa.RecordBatch:
    """A row (id, spans, places) for each document, one of the two filled."""
    order = np.argsort(doc, kind="stable")
    doc, items = doc[order], items[order]
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
    raw, ends = items.tobytes(), np.concatenate([first, [len(doc)]]) * items.dtype.itemsize
    blobs = pa.array([raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())
    none = pa.nulls(len(first), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(doc[first]), *([blobs, none] if column == "spans" else [none, blobs])], names=["id", "spans", "places"])


def _spans(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.zeros(len(start), SPAN)
    out["start"], out["end"] = start, end
    return out


def _met(window: int, many: int):
    """Blobs of one partition to (id, spans, places): what equal surroundings settle, and what must be compared."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [unpack(blob.as_py()) for batch in batches for blob in batch.column(1)]
        if not held:
            return
        yield _rows_of(np.concatenate([h[9] for h in held]), np.concatenate([h[10].view(SPAN) for h in held]), "spans")
        yield _rows_of(np.concatenate([h[11] for h in held]), np.concatenate([h[12].view(PLACE) for h in held]), "places")
        doc = np.concatenate([h[0][h[1]] for h in held])
        key = np.concatenate([join48(h[2], h[3]) for h in held])
        around = np.concatenate([h[4] for h in held])
        first, count, anchor, flag = (np.concatenate([h[k].astype(np.int64) for h in held]) for k in (5, 6, 7, 8))
        del held
        order, heads, settled = _twice(around, key, doc, first, flag & 1 > 0)
        if not len(heads):
            return
        size = np.diff(np.concatenate([heads, [len(order)]]))
        some = order[np.repeat(settled, size)]
        yield _rows_of(doc[some], _spans(first[some], first[some] + count[some] - 1 + window), "spans")
        marked = np.logical_or.reduceat(flag[order] > 1, heads)
        one = order[heads]
        group = np.cumsum(np.concatenate([[True], key[one][1:] != key[one][:-1]])) - 1
        kinds = np.bincount(group)
        marked, open_ = (np.bincount(group, weights=x)[group] > 0 for x in (marked, ~settled))
        go = marked | (kinds[group] > 1) & open_  # one of each kind, where there are several and one is open
        one = one[go]
        yield _rows_of(doc[one], _places(key[one], first[one], count[one], anchor[one], settled[go], (marked | (kinds[group] > many))[go]), "places")

    return run


def _cut_out(window: int, keys: list[int]):
    """(id, text, places) to (key, blob): the bytes around each place, and the hashes of its windows where the group is hot."""
    parts = len(keys)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[int, list] = {}
            hot: list[tuple] = []
            held = hashed = 0
            for i, text, places in zip(*batch.columns, strict=True):
                raw = text.as_py().encode()
                places = np.frombuffer(b"".join(places.as_py()), PLACE)
                places = places[places["first"].astype(np.int64) + places["windows"] - 1 + window <= len(raw)]
                to = (places["group"] % parts).astype(np.int64)
                for p, at, n, place in zip(to.tolist(), places["first"].tolist(), places["windows"].tolist(), places, strict=True):
                    piece = raw[at : at + n - 1 + window]
                    if place["hot"]:
                        hot.append((i.as_py(), at, piece))
                        hashed += n
                    else:
                        out.setdefault(p, []).append((i.as_py(), place, piece))
                    held += n + window
                    if held > 8_000_000 or hashed > HASHED:
                        yield _blobs(out, hot, window, keys)
                        out, hot, held, hashed = {}, [], 0, 0
            yield _blobs(out, hot, window, keys)

    return run


def _hashed(hot: list[tuple], window: int, parts: int) -> list[list[tuple[str, np.ndarray]]]:
    """For each partition the arrays of (id, start, bytes): one window of each kind, by hash, and spans of those settled here, by id."""
    texts = Texts([h[2] for h in hot])
    count = np.diff(texts.ends, prepend=0) - window + 1
    piece = np.repeat(np.arange(len(hot)), count)
    step = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)
    at = np.concatenate([[0], texts.ends])[piece] + step
    low, high = (between(prefix(byte_numbers(salt, False)[texts.raw]), at, at + window, salt) for salt in (9, 10))
    doc = np.array([h[0] for h in hot], np.int64)[piece]
    start = np.array([h[1] for h in hot], np.int64)[piece] + step
    order, heads, again = _twice(low, high, doc, start, np.zeros(len(doc), bool))
    settled = order[np.repeat(again, np.diff(np.concatenate([heads, [len(order)]])))]
    owner, spans = _merged(doc[settled], start[settled], start[settled] + window)
    low, high, doc, start = (x[order[heads]] for x in (low, high, doc, start))
    out = []
    for mine, theirs in zip(_dealt((high % U(parts)).astype(np.int64), parts), _dealt(owner % parts, parts), strict=True):
        used, local = np.unique(doc[mine], return_inverse=True)
        out.append(
            [("<i8", used), (fitting(local), local), *split48(high[mine] // U(parts)), ("<u8", low[mine]), (fitting(start[mine]), start[mine]), ("u1", again[mine]), ("<i8", owner[theirs]), ("u1", spans[theirs].view("u1"))]
        )
    return out


def _blobs(out: dict[int, list], hot: list[tuple], window: int, keys: list[int]) -> pa.RecordBatch:
    windows = _hashed(hot, window, len(keys)) if hot else [[]] * len(keys)
    rows = []
    for p in range(len(keys)) if hot else out:
        members = out.get(p, [])
        rows.append((keys[p], pack([("<i8", np.array([m[0] for m in members], np.int64)), ("u1", np.array([m[1] for m in members], PLACE).view("u1")), ("<u4", np.array([len(m[2]) for m in members], np.int64)), ("u1", np.frombuffer(b"".join(m[2] for m in members), np.uint8)), *windows[p]])))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["key", "blob"])


def _matched(held: list[list[np.ndarray]], window: int) -> Iterator[pa.RecordBatch]:
    """(id, spans, null) of the windows that went by hash, and of those settled on the way."""
    held = [h for h in held if len(h) > 4]
    if not held:
        return
    doc = np.concatenate([h[4][h[5]] for h in held])
    high = np.concatenate([join48(h[6], h[7]) for h in held])
    low, known = np.concatenate([h[8] for h in held]), np.concatenate([h[10] for h in held]).astype(bool)
    start = np.concatenate([h[9].astype(np.int64) for h in held])
    order, heads, again = _twice(low, high, doc, start, known)
    found = order[np.repeat(again, np.diff(np.concatenate([heads, [len(order)]])))]
    yield _rows_of(*_merged(doc[found], start[found], start[found] + window), "spans")
    yield _rows_of(np.concatenate([h[11] for h in held]), np.concatenate([h[12].view(SPAN) for h in held]), "spans")


def _sorted(window: int, shallow: int):
    """Blobs of one partition to (id, spans, null): the open surroundings sorted and compared, windows of hot groups matched."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [unpack(blob.as_py()) for batch in batches for blob in batch.column(1)]
        yield from _matched(held, window)
        held = [h for h in held if len(h[0])]
        if not held:
            return
        ids = np.concatenate([h[0] for h in held])
        places = np.concatenate([h[1].view(PLACE) for h in held])
        texts = []
        for h in held:
            raw, ends = h[3].tobytes(), np.cumsum(h[2].astype(np.int64)).tolist()
            texts += [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        del held
        # a repeated row has brought its places twice
        own = list({(g, i, f, t): k for k, (g, i, f, t) in enumerate(zip(places["group"].tolist(), ids.tolist(), places["first"].tolist(), texts, strict=True))}.values())
        ids, places, texts = ids[own], places[own], [texts[k] for k in own]
        anchor = places["anchor"].astype(np.int64)
        by = np.argsort(places["group"], kind="stable")
        group = np.empty(len(by), np.int64)
        group[by] = np.concatenate([[0], np.cumsum(places["group"][by][1:] != places["group"][by][:-1])])
        right = deep_shallow(group, [t[a:] for t, a in zip(texts, anchor.tolist(), strict=True)], shallow)
        left = deep_shallow(group, [t[:a][::-1] for t, a in zip(texts, anchor.tolist(), strict=True)], shallow)
        lefts = anchor
        rights = np.fromiter(map(len, texts), np.int64, len(texts)) - anchor
        cuts = np.searchsorted(group[right[0]], np.arange(group.max() + 2))
        doc, start, end = [], [], []
        local = np.empty(len(texts), np.int64)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            members = right[0][a:b]
            local[members] = np.arange(b - a)
            found = repeated((local[left[0][a:b]], left[1][a:b]), (np.arange(b - a), right[1][a:b]), lefts[members], rights[members], window)
            for i, j, k in found:
                place = places[members[i]]
                if not place["settled"]:
                    middle = int(place["first"]) + int(place["anchor"])
                    doc.append(int(ids[members[i]]))
                    start.append(middle - k)
                    end.append(middle - j + window)
        yield _rows_of(np.array(doc, np.int64), _spans(np.array(start, np.int64), np.array(end, np.int64)), "spans")

    return run


def union(spans: np.ndarray, size: int) -> list[tuple[int, int]]:
    """The maximal runs that spans cover, in order; touching ones are one."""
    if not len(spans):
        return []
    spans = spans[np.argsort(spans["start"], kind="stable")]
    start, reach = spans["start"].astype(np.int64), np.maximum.accumulate(spans["end"].astype(np.int64))
    fresh = np.ones(len(spans), bool)
    fresh[1:] = start[1:] > reach[:-1]
    heads = np.flatnonzero(fresh)
    ends = reach[np.concatenate([heads[1:] - 1, [len(spans) - 1]])]
    return [(a, min(b, size)) for a, b in zip(start[heads].tolist(), ends.tolist(), strict=True) if a < size]


def _kept(as_bytes: bool):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                raw = (text.as_py() or "").encode()
                gone = union(np.frombuffer(b"".join(spans.as_py()), SPAN), len(raw)) if spans.is_valid else []
                kept = b"".join(raw[a:b] for a, b in zip([0, *[g[1] for g in gone]], [*[g[0] for g in gone], len(raw)], strict=True))
                out.append((len(raw), len(raw) - len(kept), len(gone), kept if as_bytes else hashlib.sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in gone]))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary() if as_bytes else pa.string()] + [pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))] * as_bytes
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept" if as_bytes else "kept_sha256"] + ["spans"] * as_bytes
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=False)]], names=names)

    return run


def _marked(docs: DataFrame, window: int, gram: int, block: int, shallow: int, many: int, few: int) -> DataFrame:
    spark = docs.sparkSession
    keys = keyed_partitions(spark, partitions(spark))
    rows = docs.select("doc_id", key_of(F.col("doc_id")).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    out = "id long, spans binary, places binary"
    met = rows.select("id", "text").mapInArrow(_anchored(window, gram, keys, block, few), "key long, blob binary").repartition(len(keys), "key").mapInArrow(_met(window, many), out)
    met = cut(met)
    places = met.where("places is not null").groupBy("id").agg(F.collect_list("places").alias("places"))
    around = rows.join(places, "id").select("id", "text", "places").mapInArrow(_cut_out(window, keys), "key long, blob binary").repartition(len(keys), "key")
    spans = met.where("spans is not null").select("id", "spans").union(around.mapInArrow(_sorted(window, shallow), out).select("id", "spans"))
    return rows.join(spans.groupBy("id").agg(F.collect_list("spans").alias("spans")), "id", "left").select("doc_id", "text", "spans")


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, block: int = BLOCK, shallow: int = SHALLOW, many: int = MANY, few: int = FEW) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary), spans: one row for each input row.

    A byte of the UTF-8 text goes if a string of ``window`` bytes that covers it starts
    anywhere else too, in another document or in the same one; the first occurrence goes
    like the others. ``spans`` are the maximal runs that went. Equal surroundings, and windows
    at an anchor that has more than ``many`` different ones (``few`` in a block), are told by 112 bits of hashes,
    everything else by its bytes.

    Null and empty texts have no bytes; shorter texts than a window lose nothing. A null
    doc_id is an id like others. Repeated rows count as one document, rows of one doc_id
    with different texts as parts of it: a span found in one goes from all. Empty tables
    give no rows. Columns beyond doc_id and text are ignored.
    """
    rows = _marked(docs, window, gram, block, shallow, many, few)
    return rows.mapInArrow(_kept(True), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start:long,end:long>>")


def digests(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, block: int = BLOCK, shallow: int = SHALLOW, many: int = MANY, few: int = FEW) -> DataFrame:
    """As ``dedup``, with the SHA-256 digest of what is kept in place of bytes and spans."""
    rows = _marked(docs, window, gram, block, shallow, many, few)
    return rows.mapInArrow(_kept(False), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
