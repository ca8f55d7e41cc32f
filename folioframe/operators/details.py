"""Book details found in the front matter: title, author, year, ISBN and subtitle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions import text as T
from folioframe.functions.patterns import trimmed


def detect_details(blocks: DataFrame) -> DataFrame:
    """One row a document with front matter: title, author, copyright_year, isbn, subtitle.

    The author comes from a by-line, else the copyright notice, else the next short line under the title; the subtitle is
    another short line under it. Each finding is a minimum over the document's front matter, all in one partitioning.
    """
    whole = Window.partitionBy("doc_id")
    front = blocks.filter(F.col("role").isin("frontMatterTitle", "frontMatter", "copyright") & ~F.col("is_empty")).select("doc_id", "idx", "role", "text", "word_count")
    t = trimmed(F.col("text"))
    blank_null = lambda c: F.when(c != "", c)
    rows = front.select(
        "doc_id", "idx", "word_count", (F.col("role") == "frontMatterTitle").alias("is_title"), (F.col("role") != "copyright").alias("opening"), T.cleaned(F.col("text")).alias("line"), T.cleaned(F.regexp_extract(t, T.BY_LINE, 1)).alias("by_line"), T.cleaned(F.regexp_extract(t, T.COPYRIGHT_NAME, 1)).alias("notice_name"),
        F.coalesce(blank_null(F.regexp_extract("text", T.YEAR, 1)), blank_null(F.regexp_extract("text", T.YEAR, 2))).alias("year"), T.read_isbn(F.col("text")).alias("number"), (~t.rlike(T.NOT_A_NAME) & (F.col("word_count") > 0)).alias("plain"), t.rlike(T.BY_LINE).alias("is_by_line"),
    )

    def first(value: str, when: Column) -> Column:
        """The value of the first line for which ``when`` holds and the value isn't null."""
        return F.min(F.when(when & F.col(value).isNotNull(), F.struct("idx", F.col(value).alias("v")))).over(whole)["v"]

    opening, notice = F.col("opening"), ~F.col("opening")
    rows = rows.select("*", F.min(F.when(F.col("is_title"), F.col("idx"))).over(whole).alias("title_idx"), first("line", F.col("is_title")).alias("title"), F.coalesce(first("by_line", opening), first("notice_name", notice)).alias("named"), first("year", notice).alias("copyright_year"), first("number", notice).alias("isbn"))
    under = F.coalesce(F.col("idx") > F.col("title_idx"), F.lit(False)) & opening & F.col("plain")
    rows = rows.withColumn("author", F.coalesce("named", first("line", under & (F.col("word_count") <= 8))))
    other = F.coalesce(F.col("line") != F.col("author"), F.lit(False)) & ~F.col("is_by_line")
    rows = rows.withColumn("sub", first("line", under & other & (F.col("word_count") <= 15)))
    subtitle = F.when(~F.col("sub").eqNullSafe(F.col("title")), F.col("sub"))
    return rows.groupBy("doc_id").agg(*[F.first(c).alias(n) for n, c in (("title", F.col("title")), ("author", F.col("author")), ("copyright_year", F.col("copyright_year")), ("isbn", F.col("isbn")), ("subtitle", subtitle))])
