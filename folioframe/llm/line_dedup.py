"""Line deduplication over levelled sorted runs of line hashes that are compacted periodically."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm.common import LOWER, SPACES, UPPER, bitmap, cut, marked, remove, shared_folder, stored, table, text_of

_TO_LOWER = str.maketrans(UPPER, LOWER)


def lowered(line: Column) -> Column:
    """``line`` with A-Z in lower case; of lines that are all ASCII ``lower`` changes just these, and does it faster."""
    return F.when(F.octet_length(line) == F.char_length(line), F.lower(line)).otherwise(F.translate(line, UPPER, LOWER))


def line_keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """Rows (__id, __key): the 128-bit hashes of the long lines' keys, once for each document."""
    lines = docs.select(F.col(id_col).alias("__id"), F.explode(F.split(text_of(text_col), "\n")).alias("__line"))
    lines = lines.filter(F.char_length("__line") >= min_chars).select("__id", F.trim("__line", F.lit(SPACES)).alias("__line"))
    lines = lines.filter(F.char_length("__line") >= min_chars)
    return lines.select("__id", F.unhex(F.md5(lowered(F.col("__line")).cast("binary"))).alias("__key")).distinct()


class LineRuns:
    """Runs of (key, documents, largest id), each bucketed by key and sorted by it, in levels.

    Batches must come in descending order of ids. ``add`` merge-joins a batch with the runs: a key that no run knows is
    novel, and as all later batches have smaller ids, its largest id in this batch is the largest of all; it is written
    down once, in ``__top``. A known key only carries what it adds, with a null ``__top``. So each key has one row with a
    top over all runs. When a level has ``fan_in`` runs, they are merged into one of the next level before the next batch.

    Runs are tables of the session's catalog whose files lie in the shared checkpoint folder: a lost executor costs
    nothing, and a join with a run moves only the batch. ``close`` drops them.
    """

    def __init__(self, spark: SparkSession, fan_in: int = 4):
        self.spark, self.fan_in, self.levels = spark, fan_in, []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def runs(self) -> list[tuple[str, str]]:
        """Name and path of every run."""
        return [run for level in self.levels for run in level]

    def _write(self, rows: DataFrame) -> tuple[str, str]:
        name = f"line_run_{uuid.uuid4().hex}"
        path = f"{shared_folder(self.spark)}/{name}"
        rows.write.bucketBy(self.buckets, "__key").sortBy("__key").option("path", path).saveAsTable(name)
        return name, path

    def merged(self, runs: list[tuple[str, str]] | None = None) -> DataFrame:
        """One row a key: the documents that hold it and the largest id among them.

        Read as files, since Spark 4.1 takes a union of bucketed tables for bucketed but doesn't bring their buckets together.
        """
        runs = self.runs() if runs is None else runs
        schema = self.spark.table(runs[0][0]).schema
        rows = self.spark.read.schema(schema).parquet(*[path for _, path in runs])
        return rows.groupBy("__key").agg(F.sum("__docs").alias("__docs"), F.first("__top", ignorenulls=True).alias("__top"))

    def _compact(self) -> None:
        for k, level in enumerate(self.levels):
            if len(level) >= self.fan_in:
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(self._write(self.merged(level)))
                self.levels[k] = []
                self._drop(level)

    def add(self, batch: DataFrame) -> DataFrame:
        """Adds the distinct (__id, __key) rows of documents below all ids so far; returns the run that they become."""
        self._compact()
        rows = batch.groupBy("__key").agg(F.count("*").alias("__docs"), F.max(F.struct("__id")).alias("__top"))
        known = F.lit(False)
        for k, (name, _) in enumerate(self.runs()):
            founders = self.spark.table(name).filter("__top IS NOT NULL").select("__key", F.lit(True).alias(f"__known{k}"))
            rows = rows.join(founders.hint("merge"), "__key", "left")
            known = known | F.col(f"__known{k}").isNotNull()
        run = self._write(rows.select("__key", "__docs", F.when(~known, F.col("__top")).alias("__top")))
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(run)
        return self.spark.table(run[0])

    def _drop(self, runs: list[tuple[str, str]]) -> None:
        for name, path in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove(self.spark, path)

    def close(self) -> None:
        self._drop(self.runs())
        self.levels = []


def batch_bounds(docs: DataFrame, id_col: str, first_docs: int, growth: int) -> list[int]:
    """Ids, in descending order, at which batches end: the first has about ``first_docs`` rows, all so far grow by ``growth``.

    So the runs that a batch meets are never much larger than it, and the number of batches grows with the logarithm of
    the table.
    """
    n = docs.count()
    shares, size = [], first_docs
    while size < n:
        shares.append(1.0 - size / n)
        size *= growth
    if not shares:
        return []
    found = docs.select(F.percentile_approx(F.col(id_col), shares, 10_000).alias("q")).first()["q"] or []
    return sorted({int(x) for x in found}, reverse=True)


def _batch_of(bounds: list[int], column: str) -> Column:
    """0 for ids above the first bound, and one more for each bound that isn't below the id; null ids are in the last."""
    out = F.lit(len(bounds))
    for k, bound in reversed(list(enumerate(bounds))):
        out = F.when(F.col(column) > bound, F.lit(k)).otherwise(out)
    return out


def lines_gone(keys: DataFrame, frequent: DataFrame, bits: int) -> DataFrame:
    """Rows (__doc, __gone): for each document that loses lines, the hashes of their keys.

    Lines whose key a bitmap of ``2 ** bits`` bits doesn't hold go first. Keys held by more than the mean number of
    documents a shuffle partition are fewer than there are partitions, so these are broadcast; the rest has no hot key.
    """
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    maybe = marked(keys, F.col("__key"), bitmap(frequent, F.col("__key"), bits), bits, "__hit").filter("__hit").drop("__hit")
    mean = max(1, (frequent.agg(F.sum("__docs")).first()[0] or 0) // parts)
    hot = F.col("__docs") > mean
    by_key = frequent.select("__key", F.col("__top.__id").alias("__top_id"), hot.alias("__hot"))
    broadcast = F.broadcast(by_key.filter("__hot").drop("__hot").withColumnRenamed("__top_id", "__hot_id").withColumn("__is_hot", F.lit(True)))
    maybe = cut(maybe.join(broadcast, "__key", "left"))
    hot_lines = maybe.filter("__is_hot").select("__id", "__key", F.col("__hot_id").alias("__top_id"))
    others = maybe.filter("__is_hot IS NULL").select("__id", "__key").join(by_key.filter("NOT __hot").drop("__hot"), "__key")
    gone = hot_lines.unionByName(others).filter(~F.col("__id").eqNullSafe(F.col("__top_id")))
    return gone.groupBy(F.col("__id").alias("__doc")).agg(F.collect_list("__key").alias("__gone"))


def _kept(text: str, dropped: set[bytes]) -> tuple[str, int, int]:
    lines = text.split("\n")
    kept = [x for x in lines if hashlib.md5(x.strip(SPACES).translate(_TO_LOWER).encode()).digest() not in dropped]
    return "\n".join(kept), len(lines), len(lines) - len(kept)


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 40,
    min_docs: int = 5,
    first_docs: int = 512,
    growth: int = 16,
    fan_in: int = 4,
    bits: int = 24,
) -> DataFrame:
    """One row for each row of ``docs``: id, kept_text, n_lines, n_dropped.

    A line's key is the line without white space at both ends, A-Z in lower case. Keys of at least ``min_chars`` code
    points that at least ``min_docs`` documents hold lose all lines except in the largest id that holds them. Documents
    are told apart by their numeric id: rows that share an id are one document (also rows without an id, which rank below
    all others) and keep or lose a line together. Null and empty texts are one empty line. Other columns are ignored. An
    empty table gives an empty result.

    Documents reach the runs in batches of descending ids, whose sizes grow with what came before (``batch_bounds``).
    Only documents that a bitmap of ids marks as losing lines are shuffled, to meet their lost keys, and go to Python one
    text at a time; all others pass as they are.
    """
    spark = docs.sparkSession
    bounds = batch_bounds(docs, id_col, first_docs, growth)
    keys = line_keys(docs, id_col, text_col, min_chars).withColumn("__batch", _batch_of(bounds, "__id"))
    keys, path = stored(keys, "line-keys", "__batch")
    runs = LineRuns(spark, fan_in)
    for k in range(len(bounds) + 1):
        runs.add(keys.filter(F.col("__batch") == k).select("__id", "__key"))
    frequent = cut(runs.merged().filter(F.col("__docs") >= min_docs))
    runs.close()
    gone = cut(lines_gone(keys.select("__id", "__key"), frequent, bits))
    remove(spark, path)

    rows = docs.select(F.col(id_col).alias("__id"), text_of(text_col).alias("__text"))
    rows = marked(rows, F.col("__id"), bitmap(gone, F.col("__doc"), bits), bits, "__hit")
    lines = F.size(F.split("__text", "\n")).cast("long")
    whole = rows.filter("NOT __hit").select("__id", F.col("__text").alias("kept_text"), lines.alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
    meet = rows.filter("__hit").join(gone, F.col("__id").eqNullSafe(F.col("__doc")), "left").select("__id", "__text", "__gone")

    def kept(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [_kept(t, set(g) if g is not None else set()) for t, g in zip(frame["__text"], frame["__gone"], strict=True)]
            columns = list(zip(*out, strict=True)) or [[], [], []]
            yield pd.DataFrame({"__id": frame["__id"], "kept_text": columns[0], "n_lines": columns[1], "n_dropped": columns[2]})

    kind = dict(docs.dtypes)[id_col]
    cleaned = meet.mapInPandas(kept, f"__id {kind}, kept_text string, n_lines long, n_dropped long")
    return whole.unionByName(cleaned).withColumnRenamed("__id", id_col)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 40 or more code points that 5 or more documents hold stay in one: counts and the hash of what is kept."""
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP10_SQL = """
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i
    FROM documents
), keyed AS (
    SELECT doc_id, i, line,
           translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), frequent AS (
    SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (
    SELECT k.*, f.key IS NOT NULL AND k.doc_id <> f.top AS gone FROM keyed k LEFT JOIN frequent f USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
