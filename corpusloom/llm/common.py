"""Helpers shared by the training-data operators.

Only bounded things reach the driver from here: heavy-hitter keys (at most
``HOT_KEYS``) and single numbers.  Lineage is cut with reliable checkpoints in
the folder the session names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

#: The most frequent keys that a skew-safe lookup resolves by broadcast.  After
#: they are taken out, no key holds more than 1/HOT_KEYS of the rows.
HOT_KEYS = 1000
#: Rows of a side whose size was counted and that is then broadcast; longer
#: sides take a shuffled join.
BROADCAST_ROWS = 400_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's checkpoint folder; set one only where none is named and all runs in one process."""
    shared_dir(spark)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Have Spark drop the files of shuffles that nothing refers to any more, and of checkpoints too.

    Spark does so after a collection of the driver's heap, which may be half an
    hour away; long chains of jobs would hold all their shuffles until then.
    Checkpoints go only in sessions with spark.cleaner.referenceTracking.cleanCheckpoints.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def trim() -> None:
    """Give a Python worker's freed memory back to the system.

    Workers outlive their tasks and are handed from stage to stage; what one
    stage freed would otherwise stay with the process beside what the next needs.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of Arrow batches that begins and ends with ``trim``: what a task freed does not stay beside the next one's needs."""

    def tidy(batches: Iterator) -> Iterator:
        trim()
        yield from run(batches)
        trim()

    return tidy


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sized_join(big: DataFrame, small: DataFrame, on, how: str, rows: int | None = None) -> DataFrame:
    """Join that broadcasts ``small`` only after counting it (a materialised frame)."""
    n = small.count() if rows is None else rows
    return big.join(F.broadcast(small) if n <= BROADCAST_ROWS else small, on, how)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for further columns, none of which ``df`` has (in any case)."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


def keyed(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with a ``key`` for each row, unique and in the order of doc_id (without one: last).

    It is doc_id itself unless a row has none or shares it; then rows are
    numbered (equal ids by their texts), and written before use.
    """
    again = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count("*").alias("n")).filter("doc_id is null or n > 1")
    if again.isEmpty():
        return docs.withColumn(key, F.col("doc_id").cast("long"))
    (nth,) = fresh(docs, "nth")
    order = (F.asc_nulls_last(F.col("doc_id").cast("long")), F.xxhash64("text"), F.col(nth))
    rows = docs.withColumn(nth, F.monotonically_increasing_id()).orderBy(*order).drop(nth)
    return cut(rows.withColumn(key, F.monotonically_increasing_id()))


def skew_safe_lookup(rows: DataFrame, table: DataFrame, key: str, weight: str) -> DataFrame:
    """Left join of ``rows`` to ``table`` (unique in ``key``) that no hot key can stall.

    ``weight`` is the table's column of how many of the rows hold the key.  The
    HOT_KEYS heaviest keys are broadcast (a bound that does not grow with the
    data) and the others, each at most 1/HOT_KEYS of the rows, are shuffled.
    A null key finds nothing.
    """
    hot = table.orderBy(F.desc(weight), key).limit(HOT_KEYS)
    values = [c for c in table.columns if c != key]
    near = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    found = near.filter("_hot").select(*rows.columns, *values)
    rest = near.filter("_hot is null").select(*rows.columns)
    return found.unionByName(rest.join(table, key, "left").select(*rows.columns, *values))


def crc_mod(column: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod`` (the split of the contracts)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % mod


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
