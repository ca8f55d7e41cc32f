"""Exact deduplication by progressive refinement: length, then prefix hash, then the hash of the whole content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm.common import bitmap, cut, marked, table, text_of


def surviving_prefixes(docs: DataFrame, text_col: str = "text", prefix_chars: int = 64, bits: int = 22) -> DataFrame:
    """A bitmap (rows __word, __mask) of the (length, prefix hash) pairs that more than one text has.

    Level 1 counts rows by length and marks the lengths of more than one row. Level 2 counts the marked rows by length and
    prefix hash. Both levels are pre-aggregated counts, so a hot length or prefix costs one row a task.
    """
    keys = docs.select(F.octet_length(text_of(text_col)).alias("__len"), F.xxhash64(F.substring(text_of(text_col), 1, prefix_chars)).alias("__prefix"))
    pairs = cut(keys.groupBy("__len", "__prefix").agg(F.count("*").alias("__n")))
    lengths = pairs.groupBy("__len").agg(F.sum("__n").alias("__n")).filter("__n > 1")
    pairs = marked(pairs, F.col("__len"), bitmap(lengths, F.col("__len"), bits), bits, "__hit").filter("__hit AND __n > 1")
    return cut(bitmap(pairs, F.struct("__len", "__prefix"), bits))


def _refined(docs: DataFrame, words: DataFrame, id_col: str, text_col: str, prefix_chars: int, bits: int, digest: bool) -> DataFrame:
    """Rows (__id, __sha, __n, __keep, __kept); __sha is null where the text was not hashed, which proves it unique."""
    rows = docs.select(F.col(id_col).alias("__id"), text_of(text_col).alias("__text"))
    rows = rows.withColumn("__len", F.octet_length("__text")).withColumn("__prefix", F.xxhash64(F.substring("__text", 1, prefix_chars)))
    rows = marked(rows, F.struct("__len", "__prefix"), words, bits, "__hit")
    full = F.sha2(F.col("__text").cast("binary"), 256)
    rows = rows.withColumn("__sha", F.when(F.lit(digest) | F.col("__hit"), full)).withColumn("__row", F.monotonically_increasing_id())
    rows = cut(rows.select("__id", "__len", "__hit", "__sha", "__row"))
    groups = rows.filter("__hit").groupBy("__len", "__sha").agg(F.count("*").alias("__n"), F.max(F.struct("__id", "__row")).alias("__best"))
    groups = cut(groups.filter("__n > 1").withColumnRenamed("__sha", "__key"))
    key = F.when(F.col("__hit"), F.col("__sha")).otherwise(F.concat(F.lit("-"), F.col("__row").cast("string")))
    out = rows.withColumn("__key", key).join(groups, ["__key", "__len"], "left")
    keep = F.when(F.col("__n").isNull(), F.col("__id")).otherwise(F.col("__best.__id"))
    return out.select("__id", "__sha", F.coalesce("__n", F.lit(1)).cast("long").alias("__n"), keep.alias("__keep"), F.coalesce(F.col("__row") == F.col("__best.__row"), F.lit(True)).alias("__kept"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64, bits: int = 22, digest: bool = False) -> DataFrame:
    """One row for each row of ``docs``: id, keep_id, group_size, kept (and text_sha256 of every row if ``digest``).

    Rows are alike if their texts are equal byte for byte; a null text counts as empty. Of a group, the row with the
    largest id stays (null ids are below all others); of rows that also share that id, exactly one. The whole content is
    hashed only for rows whose (length, prefix hash) survives; survival is read from a bitmap of ``2 ** bits`` bits, a
    broadcast of at most ``2 ** (bits - 6)`` rows. A bit that is set by chance only costs a hash: groups are formed by
    length and SHA-256. Other columns of ``docs`` are ignored, whatever their names. An empty table gives an empty result.
    """
    out = _refined(docs, surviving_prefixes(docs, text_col, prefix_chars, bits), id_col, text_col, prefix_chars, bits, digest)
    columns = [F.col("__id").alias(id_col), F.col("__keep").alias("keep_id"), F.col("__n").alias("group_size"), F.col("__kept").alias("kept")]
    return out.select(*columns, *([F.col("__sha").alias("text_sha256")] if digest else []))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64, bits: int = 22) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of equal texts, the row with the largest id.

    Of rows that share both id and text one stays, any of them if their other columns differ. Here too only rows whose
    (length, prefix hash) survives are hashed; the others have no hash and so match no row that goes.
    """
    words = surviving_prefixes(docs, text_col, prefix_chars, bits)
    copies = _refined(docs, words, id_col, text_col, prefix_chars, bits, False).filter("__n > 1")
    fates = cut(copies.groupBy("__id", "__sha").agg(F.bool_or("__kept").alias("__stays"), F.count("*").alias("__rows")).filter("NOT __stays OR __rows > 1"))
    pair = F.struct(F.octet_length(text_of(text_col)).alias("__len"), F.xxhash64(F.substring(text_of(text_col), 1, prefix_chars)).alias("__prefix"))
    rows = marked(docs, pair, words, bits, "__hit").withColumn("__hash", F.when(F.col("__hit"), F.sha2(text_of(text_col).cast("binary"), 256)))
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__sha"))
    out = rows.join(fates, same, "left_anti").select(*docs.columns)
    repeated = fates.filter("__stays")
    if repeated.isEmpty():
        return out
    return out.unionByName(rows.join(repeated, same, "left_semi").dropDuplicates([id_col, "__hash"]).select(*docs.columns))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document the one of its group of equal texts that stays, and the hash of its text."""
    return exact_dedup(table(spark, sf_dir, "documents"), digest=True)


OP1_SQL = """
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
