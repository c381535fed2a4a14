"""Document fingerprints from closed syncmers of words (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom.llm.common import NULL_ID, key_of, let, partitions, words_of

#: Words of a k-mer, words of its inner substrings, anchors that a fingerprint keeps.
K, S, KEPT = 4, 2, 64


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """The closed syncmers of a text: array of (pos, hash), pos counting words from 0.

    A k-mer is chosen if the least hash of its s-word substrings is that of its first or
    its last one: a test of the k-mer alone, so that equal passages have equal anchors
    whatever stands around them. Texts with words but without a chosen k-mer, as all of
    1 to k-1 words, have one anchor, of all words.
    """
    last = k - s

    def chosen(h: Column) -> Column:
        inner = F.transform(F.sequence(F.lit(0), F.size(h) - s), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(s)]))

        def pick(m: Column) -> Column:
            edge = lambda i: F.least(F.get(m, i), F.get(m, i + last)) <= F.least(*[F.get(m, i + j) for j in range(1, last)], F.get(m, i))
            at = F.filter(F.sequence(F.lit(0), F.size(h) - k), edge)
            return F.transform(at, lambda i: F.struct(i.alias("pos"), F.xxhash64(*[F.get(h, i + j) for j in range(k)]).alias("hash")))

        whole = F.array(F.struct(F.lit(0).alias("pos"), F.xxhash64(h).alias("hash")))
        none = F.filter(whole, lambda x: F.lit(False))
        some = lambda x: F.when(F.size(x) == 0, whole).otherwise(x)
        return F.when(F.size(h) == 0, none).when(F.size(h) < k, whole).otherwise(let(let(inner, pick), some))

    return let(F.transform(words_of(text), lambda w: F.xxhash64(w)), chosen)


def sketch(text: Column, kept: int = KEPT) -> Column:
    """The least ``kept`` distinct anchor hashes, ascending: the fingerprint as numbers."""
    return F.slice(F.array_sort(F.array_distinct(F.transform(anchors(text), lambda a: a.hash))), 1, kept)


def written(marks: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits a number."""
    return F.array_join(F.transform(marks, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def likeness(a: Column, b: Column, kept: int = KEPT) -> Column:
    """Of the least numbers of both sketches together the share that both hold; 1 for two empty ones."""
    both = lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.greatest(F.size(u), F.lit(1))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(let(F.slice(F.array_sort(F.array_union(a, b)), 1, kept), both))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), marks, next_text, next_marks: each document beside the next.

    The next is by ascending doc_id (null first, equal ids by text); after the last comes
    the first. Ids are cut at quantiles into ranges, one window task each; a range's last
    document finds its next in a copy of the following range's first one. A range's
    bounds and first ids, some numbers for each shuffle partition, are all the driver sees.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", key_of(F.col("doc_id")).alias("_k"), text.alias("text"))
    n = 2 * partitions(spark)
    cuts = rows.select(F.percentile_approx("_k", F.array(*[F.lit(i / n) for i in range(1, n)]), F.lit(20 * n)).alias("cuts")).first()["cuts"]
    bounds = F.array(*[F.lit(x).cast("long") for x in sorted(set(cuts or [0]))])
    rows = rows.withColumn("_range", F.size(F.filter(bounds, lambda b: b <= F.col("_k"))))
    firsts = sorted((r["_range"], r["_first"]) for r in rows.groupBy("_range").agg(F.min("_k").alias("_first")).collect())
    rows = rows.withColumn("marks", sketch(F.col("text"))).withColumn("_last", F.lit(0))
    if firsts:
        following = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}
        own = F.create_map(*[F.lit(x).cast("long" if j % 2 == 0 else "int") for pair in following.items() for j, x in enumerate(pair)])
        # of documents with the same id, the first in the order of the windows
        heads = rows.where(F.col("_k").isin([*following]))
        heads = heads.groupBy("_k").agg(F.min(F.struct("text", "doc_id", "marks")).alias("r"))
        heads = heads.select("r.doc_id", "_k", "r.text", F.element_at(own, F.col("_k")).alias("_range"), "r.marks", F.lit(1).alias("_last"))
        rows = rows.unionByName(heads)
    w = Window.partitionBy("_range").orderBy("_last", "_k", "text")
    rows = rows.withColumn("next_text", F.lead("text").over(w)).withColumn("next_marks", F.lead("marks").over(w))
    return rows.where("_last = 0").select("doc_id", "text", "marks", "next_text", "next_marks")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    One row for each input row, of whole texts; the edited text replaces the last quarter
    by the next document's first characters. Null and empty texts have an empty
    fingerprint, and likeness 1 to each other. A table of one row is its own next. Empty
    tables give no rows.
    """
    rows = with_next(docs)
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.col("next_text"), F.lit(1), quarter)))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "marks", sketch(F.col("edited")).alias("edited_marks"), "next_marks")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", written(F.col("marks")).alias("fingerprint"), written(F.col("edited_marks")).alias("edited_fingerprint"),
        likeness(F.col("marks"), F.col("edited_marks")).alias("near_edited"), likeness(F.col("marks"), F.col("next_marks")).alias("near_next"),
    )
