"""Uniform shuffle into shards of exact sizes through a hypergeometric communication matrix."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioframe.llm.common import cut, table, text_of


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many good ones are among ``draws`` from ``good + bad``; exact for any size (numpy's own stops at 10**9)."""
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, draws)) if good + bad else 0
    total, low, high = good + bad, max(0, draws - bad), min(good, draws)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    spread = math.ceil(12 * math.sqrt(draws * (good / total) * (bad / total) * ((total - draws) / max(1, total - 1)))) + 12
    k = np.arange(max(low, mode - spread), min(high, mode + spread), dtype=np.float64)
    steps = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    weights = np.exp(logs - logs.max()).cumsum()
    return int(max(low, mode - spread) + np.searchsorted(weights, rng.random() * weights[-1], side="right"))


def communication_matrix(counts: list[int], shard_sizes: list[int], seed: int) -> np.ndarray:
    """Rows each partition sends to each shard: a draw of what a uniform permutation of all rows would give."""
    rng, left = np.random.default_rng(seed), [int(x) for x in shard_sizes]
    out = np.zeros((len(counts), len(shard_sizes)), dtype=np.int64)
    for i, n in enumerate(counts):
        rest, total = int(n), sum(left)
        for j in range(len(left)):
            total -= left[j]
            out[i, j] = rest if j == len(left) - 1 else hypergeometric(rng, left[j], total, rest)
            rest -= int(out[i, j])
        left = [a - int(b) for a, b in zip(left, out[i], strict=True)]
    return out


def matrix_rows(counts: DataFrame, shard_sizes: list[int], parts: int, seed: int) -> DataFrame:
    """Rows (__part, __ends): for each partition, the running sums of the rows that it sends to the shards.

    ``counts`` has (__part, count). The matrix is drawn in two steps, as a draw for a group of partitions and then draws
    within the group are one draw for all: the driver draws the rows of groups of about the root of the number of
    partitions, and a task draws the rows of each group's partitions. So neither holds more than that many matrix rows.
    """
    width = max(1, math.isqrt(max(0, parts - 1)) + 1)
    grouped = counts.withColumn("__group", F.floor(F.col("__part") / width).cast("int"))
    sums = sorted((r[0], r[1]) for r in grouped.groupBy("__group").agg(F.sum("count")).collect())
    drawn = {g: row.tolist() for (g, _), row in zip(sums, communication_matrix([n for _, n in sums], shard_sizes, seed), strict=True)}

    def within(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        group, frame = int(key[0]), frame.sort_values("__part")
        rows = communication_matrix(frame["count"].tolist(), drawn[group], seed + 1 + group)
        return pd.DataFrame({"__part": frame["__part"].to_numpy(), "__ends": [row.cumsum() for row in rows]})

    return grouped.groupBy("__group").applyInPandas(within, "__part int, __ends array<long>")


def shard_rows(docs: DataFrame, shards: int = 24, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", rows_per_sort: int = 100_000) -> DataFrame:
    """One row for each row of ``docs``: id, size (UTF-8 bytes plus 8; null text: 8), text_crc32, shard, slot.

    Shard sizes differ by one row at most, every arrangement is equally likely for a given seed's hash, and slots run from
    0 without gaps. Input splits are the partitions. Rows are permuted within their partition by a hash of seed, id and
    text, cut into the drawn counts (``matrix_rows``), exchanged, and permuted again by a second hash. The second
    permutation sorts by ranges of that hash of about ``rows_per_sort`` rows, so no task holds a shard. Rows equal in id
    and text are interchangeable. Other columns are ignored; an empty table gives an empty result.
    """
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("__id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(text_of(text_col).cast("binary")).alias("text_crc32"),
        F.spark_partition_id().alias("__part"),
        F.xxhash64(F.lit(seed), F.col(id_col), text).alias("__r"),
    )
    rows = cut(rows)
    counts = cut(rows.groupBy("__part").count())
    n, last = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("__part"), F.lit(-1))).first()
    ends = cut(matrix_rows(counts, [n // shards + (j < n % shards) for j in range(shards)], last + 1, seed))
    rank = F.row_number().over(Window.partitionBy("__part").orderBy("__r", "__id"))
    rows = rows.withColumn("__rank", rank).join(ends, "__part")
    rows = rows.withColumn("shard", F.expr("cast(size(filter(__ends, x -> x < __rank)) as int)"))
    ranges = max(1, math.ceil(n / shards / rows_per_sort), min(math.ceil(n / 2_000), math.ceil(last / shards) + 1))
    again = F.xxhash64(F.lit(seed + 1), F.col("__r"), F.col("__rank"), F.col("__part"))
    rows = cut(rows.select("__id", "size", "text_crc32", "shard", again.alias("__r")).withColumn("__range", F.expr(f"cast(shiftrightunsigned(__r, 1) / {2.0**63} * {ranges} as int)")))
    starts = rows.groupBy("shard", "__range").count()
    starts = starts.withColumn("__start", F.sum("count").over(Window.partitionBy("shard").orderBy("__range")) - F.col("count")).drop("count")
    rows = rows.withColumn("__rank", F.row_number().over(Window.partitionBy("shard", "__range").orderBy("__r", "__id")))
    out = rows.join(starts, ["shard", "__range"])
    return out.select(F.col("__id").alias(id_col), "size", "text_crc32", "shard", (F.col("__start") + F.col("__rank") - 1).alias("slot"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard and slot of every document, by the law ``rows``."""
    out = shard_rows(table(spark, sf_dir, "documents"))
    return out.withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int"))
