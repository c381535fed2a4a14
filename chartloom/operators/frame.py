"""Ordered frames: a DataFrame with a hidden column that carries the rows' order."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The hidden column; it need not be contiguous and never leaves the engine.
ORDER = "_order"


@contextmanager
def exact_names(spark: SparkSession) -> Iterator[None]:
    """Inside, names of columns that differ in case are different, as in the specification; frames made inside keep to it."""
    name = "spark.sql.caseSensitive"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def ordered(df: DataFrame) -> DataFrame:
    """``df`` with the order in which its rows are read, unless it has one."""
    return df if ORDER in df.columns else df.withColumn(ORDER, F.monotonically_increasing_id())


def plain(df: DataFrame, sort: bool = True) -> DataFrame:
    """``df`` in its order, without the hidden column."""
    if ORDER not in df.columns:
        return df
    return (df.orderBy(ORDER) if sort else df).drop(ORDER)


def reordered(df: DataFrame, keys: list[Column]) -> DataFrame:
    """``df`` with the order that sorting by ``keys``, then by the old order, gives.

    A range sort followed by ids that ascend from partition to partition: no row is
    numbered in a single task.
    """
    return df.orderBy(*keys, F.col(ORDER)).withColumn(ORDER, F.monotonically_increasing_id())


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder that the session names (on one machine a temporary one where it names none)."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and context.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="chartloom-"))
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with contiguous numbers from 1 in its order.

    Rows are sorted by range; a partition's number of rows moves the numbers of those
    after it. The table of counts has one row a partition.
    """
    df = cut(reordered(df.drop(name), []))
    part = F.shiftright(F.col(ORDER), 33)
    counts = df.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_part", before.alias("_before"))
    out = df.withColumn("_part", part).join(F.broadcast(counts), "_part")
    number = F.col("_before") + F.col(ORDER).bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return out.withColumn(name, number).drop("_part", "_before")
