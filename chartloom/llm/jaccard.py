"""Exact join of documents by Jaccard similarity of their word n-grams, as components of links.

The Jaccard distance is a metric, but nearly all documents are at distance 1 from nearly all
others: pivots drawn from all documents have every document on the boundary of every region.
So documents without a possible partner are set aside first. Of a set's shingles in the order
of their hashes, the first ones, as many as a linked set may lack and a tenth of the set, have
so many in common with each linked set; a set too few of whose first shingles stand in other
sets' links with nothing. What is left is held against all its shingles in the same way, and
is placed at its rarest ones: two linked sets meet in at least one place.

Each place gives its documents a central pivot, and each document takes for its region that of the
pivot it meets most often. Distances to pivots are computed: what lies within the radius is
in one component with the pivot; what lies beyond is on the boundary and goes on to new pivots
of other components, region by region and round by round. In the end only documents that
share a place, lie in different components and may be near, by the triangle inequality from the
pivot of their region and by what is rarer and more frequent than the place, are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom.llm.common import NULL_ID, WORD, cut, key_of, keyed_partitions, lean, partitions
from chartloom.llm.graph import components
from chartloom.llm.hashing import Texts, U, between, blocks, fitting, inside, join48, mix, pack, prefix, split48, unpack

#: Bytes of text handled at once; the share of a set, one in so many, by which its first shingles exceed what a linked set may lack.
BLOCK, TENTH = 6_000_000, 10
#: Rounds of pivots, at most; pairs for each place of a document that are few enough to be compared at once.
ROUNDS, FEW = 6, 2


class Sets:
    """The distinct shingles of some texts: ``values`` sorted within each text, ``of`` the text of each."""

    def __init__(self, texts: list[bytes], k: int):
        words, before = Texts(texts).words(1, lower=True)
        sums = prefix(words)
        start = inside(before, len(words), k)
        of = np.searchsorted(before, start, side="right")
        values = between(sums, start, start + k)
        first = np.concatenate([[0], before[:-1]]) if len(before) else before
        few = np.flatnonzero((before > first) & (before - first < k))
        short = np.concatenate([between(sums, first[[i]], before[[i]], int(before[i] - first[i])) for i in few.tolist()]) if len(few) else np.zeros(0, U)
        values, of = np.concatenate([values, short]), np.concatenate([of, few])
        order = np.lexsort((values, of))
        values, of = values[order], of[order]
        fresh = np.ones(len(values), bool)
        fresh[1:] = (values[1:] != values[:-1]) | (of[1:] != of[:-1])
        self.values, self.of = values[fresh], of[fresh]
        self.sizes = np.bincount(self.of, minlength=len(texts)).astype(np.int64)
        self.names = np.zeros((len(texts), 2), U)  # equal sets have equal names
        for j in (0, 1):
            np.add.at(self.names[:, j], self.of, mix(self.values, 11 + j))
        self.names = mix(self.names + self.sizes[:, None].astype(U))

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a text of each set that is not empty, the set's number for each text or -1, the set's number for each value or -1 if another text has brought it)."""
        _, first, same = np.unique(self.names, axis=0, return_index=True, return_inverse=True)
        chosen = np.sort(first[self.sizes[first] > 0])
        own = np.full(len(self.sizes), -1)
        own[chosen] = np.arange(len(chosen))
        return chosen, own[first[same.ravel()]], own[self.of]


def least_shared(n, num: int, den: int):
    """How many of its ``n`` shingles a set shares at least with each set that it links with."""
    return (n * num + den - 1) // den


def beyond(n):
    """By how many a set's first shingles exceed those that a linked set may lack."""
    return np.maximum(1, n // TENTH)


def first_ones(values: np.ndarray, of: np.ndarray, sizes: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which values (sorted within each set) are among the first shingles of their set.

    Let two sets share ``c`` shingles. Of these the first ``j`` have at most the ``n - c``
    others before them, so they stand among the first ``n - c + j`` of both sets; and ``c``
    is ``least_shared`` or more for either.
    """
    start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return np.arange(len(values)) - start[of] < (sizes - least_shared(sizes, num, den) + beyond(sizes))[of]


_OUT = "kind int, key long, id long, hash long, n long, m long, a binary"
_ARROW = [("key", pa.int64()), ("id", pa.int64()), ("hash", pa.int64()), ("n", pa.int64()), ("m", pa.int64()), ("a", pa.binary())]


def _rows(kind: int, rows: int, **columns) -> pa.RecordBatch:
    """Rows of ``_OUT``; names are pairs of numbers, written as 16 bytes."""
    arrays = [pa.array(np.full(rows, kind, np.int32))]
    for name, arrow in _ARROW:
        x = columns.get(name)
        if x is None:
            arrays.append(pa.nulls(rows, arrow))
        elif arrow == pa.binary():
            arrays.append(pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), rows, [None, pa.py_buffer(np.ascontiguousarray(x).tobytes())]).cast(pa.binary()))
        else:
            arrays.append(pa.array(x.astype(np.uint64).view(np.int64) if x.dtype == U else x.astype(np.int64)))
    return pa.RecordBatch.from_arrays(arrays, names=["kind", *[name for name, _ in _ARROW]])


def _dealt(keys: list[int], to: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(partition, its key, what goes there) for each partition that gets something."""
    order = np.argsort(to, kind="stable")
    cuts = np.searchsorted(to[order], np.arange(len(keys) + 1))
    for p in range(len(keys)):
        yield p, keys[p], order[cuts[p] : cuts[p + 1]]


def _blobs(rows: list[tuple], names: tuple[str, ...] = ("key", "blob")) -> pa.RecordBatch:
    kinds = [*[pa.int64()] * (len(names) - 1), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=list(names))


def _signed(k: int, num: int, den: int, keys: list[int]):
    """Blocks of (id, text hash, text) to (key, blob): documents, sets and first shingles, dealt to partitions.

    A shingle that several sets of the block hold is known to be shared: it is sent once,
    for no set, and counted here. So a frequent shingle brings its partition one entry a block.
    """
    parts = U(len(keys))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in blocks(batches, BLOCK):
            ids = np.array([r[0] for r in rows], np.int64)
            hashes = np.array([r[1] for r in rows], np.int64)
            sets = Sets([r[2] for r in rows], k)
            first, number, of = sets.distinct()
            values, of, sizes = sets.values[of >= 0], of[of >= 0], sets.sizes[first]
            some = first_ones(values, of, sizes, num, den)
            values, of = values[some], of[some]
            order = np.argsort(values, kind="stable")
            values, of = values[order], of[order]
            again = np.zeros(len(values), bool)
            again[1:] = values[1:] == values[:-1]
            several = again.copy()
            several[:-1] |= again[1:]
            credit = np.bincount(of[several], minlength=len(first))
            sent = np.flatnonzero(~again)
            values, of = values[sent], np.where(several[sent], len(first), of[sent])
            by_id = np.lexsort((hashes, ids))
            known = number[by_id] >= 0
            least = np.full(len(first), -1)
            least[number[by_id][known][::-1]] = by_id[known][::-1]  # the first document of each set
            docs = [rows_ for _, _, rows_ in _dealt(keys, (mix((ids ^ hashes).astype(U), 31) % parts).astype(np.int64))]
            classes = [rows_ for _, _, rows_ in _dealt(keys, (sets.names[first, 0] % parts).astype(np.int64))]
            out = []
            for p, key, mine in _dealt(keys, (values % parts).astype(np.int64)):
                doc, class_ = docs[p], classes[p]
                if len(mine) or len(doc) or len(class_):
                    used, local = np.unique(of[mine], return_inverse=True)
                    held = used[used < len(first)]  # the last one may stand for several sets
                    head = least[class_]
                    out.append((key, pack([
                        ("<i8", ids[doc]), ("<i8", hashes[doc]), ("<i8", sets.sizes[doc]), ("<u8", sets.names[doc].ravel()),
                        ("<i8", ids[head]), ("<i8", hashes[head]), ("<i8", sets.sizes[head]), ("<i8", credit[class_]), ("<u8", sets.names[head].ravel()),
                        ("<u8", sets.names[first[held], 0]), *split48(values[mine] // parts), (fitting(local), local),
                    ])))
            yield _blobs(out)

    return run


@lean
def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blobs of one partition to documents (0), sets of a block (1), and how many of a set's first shingles are shared (2)."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        for blob in batch.column(1):
            ids, hashes, sizes, names, own_ids, own_hashes, own_sizes, credit, own_names, *rest = unpack(blob.as_py())
            if len(ids):
                yield _rows(0, len(ids), id=ids, hash=hashes, m=sizes, a=names.reshape(-1, 2))
            if len(own_ids):
                own_names = own_names.reshape(-1, 2)
                yield _rows(1, len(own_ids), key=own_names[:, 0], id=own_ids, hash=own_hashes, n=credit, m=own_sizes, a=own_names)
            held.append(rest)
    if not held:
        return
    shingle = np.concatenate([join48(h[1], h[2]) for h in held])
    # the number of a set, 0 for several
    name = np.concatenate([np.append(h[0], U(0))[h[3]] for h in held])
    del held
    order = np.lexsort((name, shingle))
    shingle, name = shingle[order], name[order]
    fresh = np.ones(len(shingle), bool)
    fresh[1:] = (shingle[1:] != shingle[:-1]) | (name[1:] != name[:-1])
    shingle, name = shingle[fresh], name[fresh]
    new = np.ones(len(shingle), bool)
    new[1:] = shingle[1:] != shingle[:-1]
    group = np.cumsum(new) - 1
    shared = (np.bincount(group) > 1)[group] & (name != 0) if len(group) else new
    found, count = np.unique(name[shared], return_counts=True)
    yield _rows(2, len(found), key=found, n=count)


def _blocked(k: int):
    """(a, text) to (block, blob): names, sizes and shingles of the sets of a block."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        for rows in blocks(batches, BLOCK):
            sets = Sets([r[1] for r in rows], k)
            first, _, of = sets.distinct()
            yield _blobs([(at, pack([("<u8", sets.names[first].ravel()), ("<i8", sets.sizes[first]), ("<u8", sets.values[of >= 0])]))], ("block", "blob"))
            at += 1

    return run


def _counted(keys: list[int]):
    """(block, blob) to (key, block, blob): the shingles of each block, with the number of its sets that hold them."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(*batch.columns, strict=True):
                values, count = np.unique(unpack(blob.as_py())[2], return_counts=True)
                rows = [(key, block.as_py(), pack([("<u8", values[mine]), (fitting(count), count[mine])])) for _, key, mine in _dealt(keys, (values % U(len(keys))).astype(np.int64)) if len(mine)]
                yield _blobs(rows, ("key", "block", "blob"))

    return run


@lean
def _often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one partition to (block, blob): the shingles of each block that two sets or more hold, with their number."""
    held = [(block.as_py(), *unpack(blob.as_py())) for batch in batches for block, blob in zip(batch.column(1), batch.column(2), strict=True)]
    if not held:
        return
    values, back = np.unique(np.concatenate([h[1] for h in held]), return_inverse=True)
    often = np.bincount(back, weights=np.concatenate([h[2] for h in held])).astype(np.int64)[back]
    at = 0
    for block, own, _ in held:
        mine = often[at : at + len(own)]
        at += len(own)
        yield _blobs([(block, pack([("<u8", own[mine > 1]), ("<u4", np.minimum(mine[mine > 1], 2**32 - 1))]))], ("block", "blob"))


_PLACES = "key long, shingle long, size long, core long, rank long, weight long"


def _placed(num: int, den: int):
    """(block, blob, often) to the places of sets: their rarest shingles, as many as a linked set may lack and one more.

    A shingle that no other set holds is in no intersection. A set with too few others (its
    ``core``) is gone. ``rank`` counts the core's rarer shingles; ``weight`` is how many sets
    hold one of the set's shingles on average, in thousandths: the greater, the more central.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, often in zip(batch.column(1), batch.column(2), strict=True):
                names, sizes, values = unpack(blob.as_py())
                some = [unpack(x) for x in often.as_py()]
                known, count = np.concatenate([s[0] for s in some]), np.concatenate([s[1] for s in some]).astype(np.int64)
                order = np.argsort(known)
                known, count = known[order], count[order]
                of = np.repeat(np.arange(len(sizes)), sizes)
                at = np.minimum(np.searchsorted(known, values), len(known) - 1)
                core = known[at] == values if len(known) else np.zeros(len(values), bool)
                values, of, count = values[core], of[core], count[at[core]] if len(known) else count
                cores = np.bincount(of, minlength=len(sizes))
                weight = np.bincount(of, weights=count, minlength=len(sizes)) * 1000 // sizes
                places = cores - least_shared(sizes, num, den) + 1
                order = np.lexsort((values, count, of))
                values, of = values[order], of[order]
                start = np.concatenate([[0], np.cumsum(cores)[:-1]])
                rank = np.arange(len(values)) - start[of]
                chosen = rank < places[of]
                values, of = values[chosen], of[chosen]
                arrays = [names.reshape(-1, 2)[of, 0].view(np.int64), values.view(np.int64), sizes[of], cores[of], rank[chosen], weight[of]]
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in arrays], names=["key", "shingle", "size", "core", "rank", "weight"])

    return run


@lean
def _singled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, blob) to (key, shingles) of each set."""
    for batch in batches:
        for blob in batch.column(1):
            names, sizes, values = unpack(blob.as_py())
            raw, ends = values.tobytes(), (np.cumsum(sizes) * 8).tolist()
            shingles = pa.array([raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(names.reshape(-1, 2)[:, 0].view(np.int64)), shingles], names=["key", "shingles"])


def _compared(num: int, den: int):
    """(a, b, x, y) to (a, b, distance, linked)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far, linked = [], []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), U), np.frombuffer(y.as_py(), U)
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                whole = len(x) + len(y) - shared
                far.append(1 - shared / whole)
                linked.append(den * shared >= num * whole)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(far, pa.float64()), pa.array(linked, pa.bool_())], names=["a", "b", "distance", "linked"])

    return run


def _distances(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of nodes (a, b) with the distance of their sets, and whether they link."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return cut(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_compared(num, den), "a long, b long, distance double, linked boolean"))


def _regions(places: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame | None:
    """(node, component) of the nodes that link with others; None if none does.

    ``places``: node, shingle, size, core, rank, weight; ``sets``: node, shingles.
    """
    radius = 1 - num / den + 1e-9
    home = found = before = None
    open_, left, all_ = _open(places, found)
    for turn in range(ROUNDS):
        if not left:
            return found
        if left <= FEW * all_ or before is not None and left > before / 2:  # new pivots would not part much more
            break
        before = left
        # in a place all documents have one pivot, at first the most central one; those of the pivot's own component have none
        pivot = F.min(F.struct(F.xxhash64("node", F.lit(turn)) if turn else -F.col("weight"), "node", "component")).alias("pivot")
        met = open_.join(open_.groupBy("shingle").agg(pivot), "shingle").where("component <> pivot.component").select("node", F.col("pivot.node").alias("pivot"))
        met = met.groupBy("node", "pivot").agg(F.count(F.lit(1)).alias("met")).groupBy("node").agg(F.max_by("pivot", F.struct("met", "pivot")).alias("b"))
        measured = _distances(met.select(F.col("node").alias("a"), "b"), sets, num, den)
        home = measured if home is None else home.union(measured)
        linked = measured.where("linked").select("a", "b")
        if linked.isEmpty():
            break
        found = components(linked if found is None else linked.union(found.select(F.col("node").alias("a"), F.col("component").alias("b"))))
        open_, left, all_ = _open(places, found)
    if not left:
        return found
    member = open_.select("node", "shingle", "component", "size", "core", "rank")
    if home is not None:  # regions: the nearest pivot of each document, and a pivot's own
        nearest = home.groupBy("a").agg(F.min(F.struct("distance", "b")).alias("r")).select(F.col("a").alias("node"), F.col("r.b").alias("pivot"), F.col("r.distance").alias("away"))
        member = member.join(cut(nearest), "node", "left").withColumns({"pivot": F.coalesce("pivot", "node"), "away": F.coalesce("away", F.lit(0.0))})
    else:
        member = member.withColumns({"pivot": F.col("node"), "away": F.lit(0.0)})
    member = cut(member)
    other = member.select(*[F.col(c).alias(f"b_{c}") for c in member.columns])
    # where two sets first meet, all that they share is still to come
    most = F.least(F.col("core") - F.col("rank"), F.col("b_core") - F.col("b_rank"))
    near = (most * den >= (F.col("size") + F.col("b_size") - most) * num) & ((F.col("pivot") != F.col("b_pivot")) | (F.abs(F.col("away") - F.col("b_away")) <= radius))
    pairs = member.join(other, (F.col("shingle") == F.col("b_shingle")) & (F.col("component") != F.col("b_component")) & (F.col("node") < F.col("b_node")) & near)
    measured = _distances(pairs.select(F.col("node").alias("a"), F.col("b_node").alias("b")).distinct(), sets, num, den)
    linked = measured.where("linked").select("a", "b")
    if linked.isEmpty():
        return found
    return components(linked if found is None else linked.union(found.select(F.col("node").alias("a"), F.col("component").alias("b"))))


def _open(places: DataFrame, found: DataFrame | None) -> tuple[DataFrame, int, int]:
    """(the places where several components meet, pairs of documents of different components in them, all places of documents)."""
    rows = places.withColumn("component", F.col("node"))
    if found is not None:
        rows = places.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    groups = cut(rows.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("shingle").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own")).where("n * n > own"))
    left, all_ = groups.agg(F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("own")) / 2), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    return rows.join(groups.select("shingle"), "shingle"), int(left), int(all_)


def _hashed(docs: DataFrame) -> tuple[Column, Column]:
    """The id and the hash of the text that tell documents of one id apart."""
    return key_of(docs["doc_id"]), F.xxhash64(F.coalesce(docs["text"], F.lit("")))


def join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each input row.

    Words are parted by white space and lower-cased (A-Z). Two documents link when the
    share of distinct k-word shingles that they have in common is num/den or more; with
    fewer words all of them are the one shingle. Exact but for hash collisions: shingles
    have 64 bits, sets 128, and 64 where sets that share shingles are told apart.

    Null and empty texts, and those of white space, have no shingles and link with
    nothing. Repeated rows, also of one doc_id, are documents with equal texts. A null
    doc_id counts as the least; a component that holds it has component_id null. Different
    texts of one doc_id, null or not, are documents of their own and link by their texts
    only; components with the same least doc_id have the same component_id. A text of any
    length is one set, held whole by one task. Empty tables give no rows. Columns beyond
    doc_id and text are ignored.
    """
    doc, _, named = _components(docs, k, num, den)
    out = doc.join(named.drop("main"), "a", "left").withColumn("component", F.coalesce("component", "id"))
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return out.select(real("id").alias("doc_id"), F.col("n").alias("n_shingles"), real("component").alias("component_id"))


def _components(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (id, n, a: the name of their set), classes (a, least, hash), components (a, component, main).

    A class's least document is the one of least id and then least hash of its text. Of a
    component's classes ``main`` names that of least id, and then least name; ``component``
    is its least id.
    """
    spark = docs.sparkSession
    keys = keyed_partitions(spark, partitions(spark))
    key, hash_ = _hashed(docs)
    rows = docs.select(key.alias("id"), hash_.alias("hash"), F.coalesce("text", F.lit("")).alias("text"))
    met = cut(rows.mapInArrow(_signed(k, num, den, keys), "key long, blob binary").repartition(len(keys), "key").mapInArrow(_met, _OUT))
    doc = met.where("kind = 0").select("id", F.col("m").alias("n"), "a")
    classes = met.where("kind = 1").groupBy("a", "key").agg(F.min(F.struct("id", "hash")).alias("first"), F.min("n").alias("n"), F.max("m").alias("size"))
    # a shingle shared within each block that holds the set is counted there, any other one by its partition
    shared = met.where("kind = 2").groupBy("key").agg(F.sum("n").alias("shared"))
    least = F.expr(f"greatest(1, ((size * {num} + {den - 1}) div {den}) div {TENTH})")
    classes = classes.join(shared, "key", "left").withColumn("alive", F.coalesce("shared", F.lit(0)) + F.col("n") >= least)
    classes = cut(classes.select("a", "key", F.col("first.id").alias("least"), F.col("first.hash").alias("hash"), "alive"))
    alive = classes.where("alive").select("a", F.col("least").alias("id"), "hash")
    held = cut(rows.join(alive, ["id", "hash"]).select("a", "text").mapInArrow(_blocked(k), "block long, blob binary"))
    often = held.mapInArrow(_counted(keys), "key long, block long, blob binary").repartition(len(keys), "key").mapInArrow(_often, "block long, blob binary")
    often = often.groupBy("block").agg(F.collect_list("blob").alias("often"))
    places = cut(held.join(often, "block").select("block", "blob", "often").mapInArrow(_placed(num, den), _PLACES).distinct())
    # numbers in the order of least ids, so that a component's least number stands for its least id
    nodes = classes.join(places.select("key").distinct(), "key").select("a", "key", "least")
    nodes = cut(nodes.orderBy("least", "a").withColumn("node", F.monotonically_increasing_id()))
    sets = cut(held.mapInArrow(_singled, "key long, shingles binary").join(nodes.select("key", "node"), "key").select("node", "shingles").dropDuplicates(["node"]))
    found = _regions(cut(places.join(nodes.select("key", "node"), "key").drop("key")), sets, num, den)
    classes = classes.select("a", "least", "hash")
    if found is None:
        return doc, classes, classes.select("a", F.col("least").alias("component"), F.col("a").alias("main"))
    mains = nodes.select(F.col("node").alias("component"), F.col("a").alias("main"), F.col("least").alias("id"))
    linked = found.join(nodes.select("node", "a"), "node").join(mains, "component").select("a", "main", "id")
    named = classes.join(linked, "a", "left").select("a", F.coalesce("id", "least").alias("component"), F.coalesce("main", "a").alias("main"))
    return doc, classes, cut(named)


def distinct(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` less near-duplicates: of each component of links the least doc_id stays.

    Documents without words link with nothing and stay. Different texts of one doc_id, null
    or not, are documents of their own. Of a component's rows of the least doc_id one
    stays: of its least set by name the least hash of the text, then of the whole row.
    Columns may have any names.
    """
    _, classes, named = _components(docs, k, num, den)
    key, hash_ = _hashed(docs)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    words = F.coalesce(F.regexp_like("text", F.lit(WORD)), F.lit(False))
    # the row rides in a struct, so that no column of it meets the names used here
    rows = docs.where(words).select(key.alias("id"), hash_.alias("hash"), F.struct(*columns).alias("row"))
    firsts = classes.join(named, "a").where("a = main").select(F.col("least").alias("id"), "hash")
    rows = rows.join(cut(firsts), ["id", "hash"], "left_semi").withColumn("of_row", F.xxhash64("row"))
    first = F.row_number().over(Window.partitionBy("id", "hash").orderBy("of_row"))
    return rows.withColumn("nr", first).where("nr = 1").select("row.*").unionByName(docs.where(~words))
