"""What the text operators share: shared work folders, reading tables, null-safe text, bitmaps of keys."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
BITMAP_BITS = 1 << 24


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a session with one machine (a local master) gets a folder of its own; any other is refused, as a
    machine's own folder is another one on each machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not found and not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not found:
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(found)
    return found.rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, for tables that cut lineage."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def landed(df: DataFrame, name: str) -> DataFrame:
    """Write df below the shared folder and read it back: the lineage ends there and survives lost executors."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_batches(spark: SparkSession) -> None:
    """Texts go to Python in batches of so many rows and about so many bytes at most, whichever comes first.

    One longer text is a batch of its own. The settings are the session's and are only ever lowered: a plan reads them
    when it runs, which is after the operator has returned it."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    now = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    if now != f"{BATCH_BYTES}b":
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run over a task's batches, behind which the worker gives back to the machine what it no longer uses.

    Workers outlive their tasks, and the allocators of Arrow and of the C library keep what is freed; the next stage would
    find it taken."""

    def own(batches: Iterator) -> Iterator:
        yield from run(batches)
        import pyarrow as pa

        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
        if trim is not None:
            trim(0)

    return own


def shielded(call: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For calls that give back rows of their first argument: its columns may have any names.

    Operators name what they need in between with two leading underscores. Columns of the caller that begin so have other
    names during the call and their own ones again behind it; where a column that the call adds has such a name, it gets
    `_1` behind it. Names of columns among the arguments are followed."""

    @functools.wraps(call)
    def shield(docs: DataFrame, *args, **more) -> DataFrame:
        own = [c for c in docs.columns if c.startswith("__")]
        if not own:
            return call(docs, *args, **more)
        head = "caller"
        while any(c.startswith(head) for c in docs.columns):
            head += "_"
        away = {c: f"{head}{i}" for i, c in enumerate(own)}
        follow = lambda x: away.get(x, x) if isinstance(x, str) else [follow(v) for v in x] if isinstance(x, list) else x
        out = call(docs.withColumnsRenamed(away), *map(follow, args), **{k: follow(v) for k, v in more.items()})
        out = out.withColumnsRenamed({c: f"{c}_1" for c in out.columns if c in away})
        return out.withColumnsRenamed({new: c for c, new in away.items()})

    return shield


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(column: str | Column) -> Column:
    """Null counts as empty."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit(""))


def key_bitmap(keys: DataFrame, key: Column, name: str) -> DataFrame:
    """One row, bits: array<long> of BITMAP_BITS bits in all, one set for each key (a long). Its size doesn't grow with keys."""
    slot = F.pmod(key, F.lit(BITMAP_BITS))
    bit = F.expr("shiftleft(1L, cast(pmod(__slot, 64) as int))")
    own = keys.select(slot.alias("__slot")).select(F.floor(F.col("__slot") / 64).alias("word"), bit.alias("bits"))
    words = own.groupBy("word").agg(F.bit_or("bits").alias("bits"))
    every = keys.sparkSession.range(BITMAP_BITS // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    full = words.union(every).groupBy("word").agg(F.bit_or("bits").alias("bits"))  # BITMAP_BITS / 64 rows
    return landed(full.agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("x")).select(F.col("x.bits").alias("bits")), name)


def in_bitmap(bitmap: DataFrame, key: Column) -> Column:
    """Whether the bit of key is set: true for all keys of the bitmap, and for few others while it is sparse."""
    slot = F.pmod(key, F.lit(BITMAP_BITS))
    word = F.element_at(bitmap.scalar(), (F.floor(slot / 64) + 1).cast("int"))
    return F.getbit(word, F.pmod(slot, F.lit(64)).cast("int")) == 1
