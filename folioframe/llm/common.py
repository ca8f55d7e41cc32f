"""What the operators of this subpackage share: reading tables, cutting lineage, bounded filters, graph components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import folioframe
from folioframe.lineage import cut, shared_folder

#: Functions for Python workers travel with their code, so that executors need not have this library installed.
cloudpickle.register_pickle_by_value(folioframe)

#: White space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def is_training_row(id_col: str = "doc_id") -> Column:
    """Rows that models may learn from: crc32 of the id as text, modulo 4, is not 2. A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 != 2


def uniform(*parts) -> Column:
    """A number in (0, 1) that depends on ``parts`` alone."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 12).cast("double") + F.lit(0.5)) * F.lit(2.0**-52)


def chosen(name: str, key: Column, most: int, count: int) -> Column:
    """Whether a hash picks the row: about ``most`` of ``count`` rows, at any count, and all where there are no more."""
    return F.lit(True) if count <= most else uniform(F.lit(name), key) < most / count


def bitmap(keys: DataFrame, key: Column, bits: int) -> DataFrame:
    """Rows (__word, __mask) of a ``2 ** bits`` bit map of the hashed keys: no more than ``2 ** (bits - 6)`` rows of 12 bytes."""
    at = keys.select(F.pmod(F.xxhash64(key), F.lit(1 << bits)).alias("__at"))
    return at.groupBy(F.expr("cast(shiftright(__at, 6) as int)").alias("__word")).agg(F.expr("bit_or(shiftleft(1L, cast(__at % 64 as int)))").alias("__mask"))


def marked(rows: DataFrame, key: Column, words: DataFrame, bits: int, name: str) -> DataFrame:
    """``rows`` with a boolean column: whether the bitmap may hold ``key``. False means that it surely doesn't."""
    at = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    out = rows.withColumn("__at", at).withColumn("__word", F.expr("cast(shiftright(__at, 6) as int)"))
    out = out.join(F.broadcast(words), "__word", "left")
    return out.withColumn(name, F.expr("coalesce(shiftright(__mask, cast(__at % 64 as int)) & 1L, 0L) = 1L")).drop("__word", "__at", "__mask")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of the long ``edges`` (a, b): rows (node, root), where root is the least node of the component.

    Alternates the large-star and small-star steps: each is one pre-aggregated minimum by node and one join on the node,
    so that no node's neighbours meet in one task. The number of rounds grows with the logarithm of the size.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut(large.filter("a <> b").distinct())
        least = cut(edges.groupBy("a").agg(F.min("b").alias("m")))
        small = edges.join(least, "a").select("b", "m").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no convergence in {rounds} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return cut(edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots))


def stored(df: DataFrame, name: str = "table", *by: str) -> tuple[DataFrame, str]:
    """``df`` written as Parquet, in a folder for each value of ``by``, to the shared checkpoint folder and read again, and where it lies."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table that ``stored`` wrote."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def tidy(step: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A step over data frames that hands its memory back when a task ends, as workers stay for tasks of other steps."""

    def run(frames: Iterator) -> Iterator:
        yield from step(frames)
        gc.collect()
        pyarrow.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # there is no malloc_trim but in the GNU C library
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run
