"""What the operators of this folder share: word rule, lineage cuts, null-safe keys."""

from __future__ import annotations

import ctypes
import functools
import tempfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that part words, as a Java/Python class body: space and U+0009..U+000D.
SPACES = r"\x20\x09-\x0D"
WORD = rf"[^{SPACES}]+"
#: Stands for a null doc_id wherever ids are compared, so null sorts first.
NULL_ID = -(2**63)
#: What a worker remembers from task to task, by name, and how to drop it.
HELD: dict[str, Callable[[], None]] = {}


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder that the session names, and read from there.

    A lost executor then costs a read, not the computation. Only where no folder is
    configured and all runs on one machine (tests) a temporary one is set.

    The frame read back has no estimate of its size: a checkpoint keeps that of its plan,
    which multiplies with every join and takes minutes to compute after a few dozen rounds.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and context.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="chartloom-checkpoint-"))
    written = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(written.queryExecution().toRdd(), written.schema(), False), spark)


def forget(holds: str = "") -> None:
    """Drops what this process remembers, but for what ``holds`` names."""
    for name, drop in HELD.items():
        if name != holds:
            drop()


def lean(run, holds: str = ""):
    """``run``, a generator over Arrow batches, that hands freed memory back to the system at its end.

    Python workers live on for other tasks and other stages, and the allocators of C and Arrow keep what
    a task has freed: the executor would pay for the largest task of each worker all the time. What
    tasks of other kinds have left in ``HELD`` goes at the start; what ``holds`` names stays for the next task.
    """

    @functools.wraps(run)
    def wrapped(batches):
        forget(holds)
        try:
            yield from run(batches)
        finally:
            forget(holds)
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:  # glibc alone has it
                trim(0)

    return wrapped


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def key_of(doc_id: Column) -> Column:
    """A document's id as a key that joins and sorts null like a value."""
    return F.coalesce(doc_id.cast("long"), F.lit(NULL_ID))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), rf"[{SPACES}]+"), lambda w: w != "")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keyed_partitions(spark: SparkSession, n: int) -> list[int]:
    """For each of ``n`` partitions a key that ``repartition(n, key)`` sends to it.

    Rows packed by partition then spread evenly, where the keys 0..n-1 would collide.
    """
    found: dict[int, int] = {}
    step = 0
    while len(found) < n:
        some = spark.range(step, step + 16 * n, 1, 1).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("at"))
        for at, key in some.groupBy("at").agg(F.min("id").alias("id")).collect():
            found.setdefault(at, key)
        step += 16 * n
    return [found[i] for i in range(n)]
