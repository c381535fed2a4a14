"""Mixing sources to target weights by systematic sampling (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chartloom.llm.common import WORD, cut

#: Size classes are 2 % wide; a class of a source has so many cells, each numbered by one task.
CLASSES = 48
SALTS = 16


def sized(docs: DataFrame, *carried: str) -> DataFrame:
    """doc_id, source, size (words; null text: 0) and carried columns."""
    return docs.select("doc_id", "source", *carried, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sources: DataFrame, weights: tuple[int, ...], cap: float) -> DataFrame:
    """source, source_size, target from (source, source_size), one row a source.

    Water-filling: sources in the order of cap-to-weight ratio stop at their cap while
    the level of what is left reaches it; the level is the largest that any prefix gives.
    The windows without keys run over one row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    everything = Window.partitionBy()
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rows = sources.select("source", "source_size", weight.alias("w")).withColumn("most", F.col("source_size") * cap)
    rows = rows.withColumn("ratio", F.col("most") / F.col("w"))
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    weights_left = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    rows = rows.withColumn("level", left / weights_left).withColumn("level", F.max("level").over(everything))
    return rows.select("source", "source_size", F.least("most", F.col("w") * F.col("level")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: float = 3.0, seed: int = 17, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: one row for each input row.

    Each source's expected copies per document are target / source_size, the same for all
    its documents, so the prefix sum up to a document is that rate times its rank. A
    document gets a copy for each integer that the prefix sum, moved by the source's one
    random offset, crosses. Ranks follow (size class, salt, size, doc_id): copies then
    spread over all sizes and the words taken stay near the target. Ranks are made of
    counts by cell plus a number within the cell, so that a source with a third of all
    rows is spread over many tasks.

    Null text has size 0. Null sources are a source, ordered last. Empty tables give no
    rows. Repeated rows are documents of their own. A source without words takes nothing.
    Columns beyond doc_id, text and source are ignored, but for ``carried`` ones.
    """
    cell = ["source", "cls", "salt"]
    rows = sized(docs, *carried).withColumns({"cls": F.floor(F.log(F.col("size") + 1.0) * CLASSES).cast("int"), "salt": F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")})
    rows = cut(rows)
    cells = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    totals = cells.groupBy("source").agg(F.sum("words").alias("source_size"))
    goal = targets(totals, weights, cap).withColumn("u", F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20))
    so_far = Window.partitionBy("source").orderBy("cls", "salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("start", F.coalesce(F.sum("n").over(so_far), F.lit(0)))
    cells = cells.alias("c").join(goal.alias("g"), F.expr("c.source <=> g.source")).select(*[F.col(f"c.{k}").alias(f"c_{k}") for k in cell], "start", "source_size", "target", "u")
    inside = Window.partitionBy(*cell).orderBy("size", "doc_id", *carried)
    ranked = rows.withColumn("rank", F.row_number().over(inside))
    same = F.expr("source <=> c_source AND cls = c_cls AND salt = c_salt")
    out = ranked.join(cells, same).withColumn("rank", F.col("rank") + F.col("start"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    out = out.withColumn("rate", rate)
    crossed = F.floor(F.col("rank") * F.col("rate") + F.col("u")) - F.floor((F.col("rank") - 1) * F.col("rate") + F.col("u"))
    out = out.withColumn("copies", crossed.cast("long"))
    return out.select("doc_id", *carried, "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: float = 3.0, seed: int = 17) -> DataFrame:
    """The documents of the mix, each row as often as it is taken, with the input's columns.

    A hash of the whole row carries the copies back to it; rows equal in every column
    share the copies that they were given together.
    """
    tagged = docs.withColumn("__mix_hash", F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    taken = mix(tagged, weights, cap, seed, ("__mix_hash",)).groupBy("__mix_hash")
    taken = taken.agg(F.sum("copies").alias("__mix_copies"), F.count(F.lit(1)).alias("__mix_equal")).where("__mix_copies > 0")
    tagged = tagged.withColumn("__mix_nr", F.row_number().over(Window.partitionBy("__mix_hash").orderBy("__mix_hash")))
    out = tagged.join(taken, "__mix_hash")
    own = F.floor(F.col("__mix_copies") * F.col("__mix_nr") / F.col("__mix_equal")) - F.floor(F.col("__mix_copies") * (F.col("__mix_nr") - 1) / F.col("__mix_equal"))
    out = out.withColumn("__mix_own", own.cast("int")).where("__mix_own > 0")
    return out.withColumn("__mix_copy", F.explode(F.array_repeat(F.lit(1), F.col("__mix_own")))).select(*[F.col(f"`{c}`") for c in docs.columns])
