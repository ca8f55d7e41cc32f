"""Manuscripts derived from a table of plain texts, for tables that hold no paragraphs of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def manuscript_blocks(docs: DataFrame) -> DataFrame:
    """Paragraphs (doc_id, idx, text, centered) of manuscripts with headings, scene breaks and blanks between the lines.

    Line i of a text is prose at place 4i + 2. Before every ninth line comes a centred heading, whose wording goes by the
    id; after some lines come a scene break or a blank. Every row of a line is made in one generator, so the only shuffle
    is the one by document that numbers the paragraphs.
    """
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "line"))
    return number_blocks(lines.select("doc_id", F.inline(F.filter(F.array(*_rows()), lambda r: r["ord"].isNotNull())).alias("ord", "text", "centered")))


def _rows() -> list:
    i, doc = F.col("i"), F.col("doc_id")
    prefixes = F.array(*map(F.lit, ("Chapter ", "CHAPTER ", "", "Capítulo ", "Kapitel ")))
    number = F.floor(i / 9) + F.when((doc % 7 == 0) & (i > 18), 1).otherwise(0)
    heading = F.concat(F.get(prefixes, (doc % 5).cast("int")), number.cast("string"))
    row = lambda when, place, text, centered: F.struct(F.when(when, i * 4 + place).alias("ord"), text.alias("text"), F.lit(centered).alias("centered"))
    return [
        row((i > 0) & (i % 9 == 0), 0, heading, True),
        row(i % 5 == 3, 1, F.lit("* * *"), True),
        row(F.lit(True), 2, F.col("line"), False),
        row(i % 4 == 1, 3, F.lit(""), False),
    ]


def number_blocks(rows: DataFrame) -> DataFrame:
    """Numbers the paragraphs of each document from 0 by ``ord``, which goes."""
    idx = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")) - 1
    return rows.withColumn("idx", idx).drop("ord")


def formatted_blocks(blocks: DataFrame) -> DataFrame:
    """The paragraphs with formatting of every kind that packages hold, spread by remainders of idx and doc_id.

    Plain texts have none of it: breaks, styles, outline levels, indents, lists, bold, pictures, tables and underlining.
    """
    idx, doc = F.col("idx"), F.col("doc_id")
    at = lambda n, k: (idx + doc) % n == k
    styles = F.array(*map(F.lit, ("Heading 1", "heading 3", "Title", "Subtitle", "Block Quotation")))
    named, level, table, picture = (idx * 3 + doc) % 29, (idx * 5 + doc) % 31, at(23, 7), at(33, 10)
    return blocks.select(
        "*",
        F.when(table, "table").otherwise("paragraph").alias("kind"),
        F.when(named.between(1, 5), F.get(styles, (named - 1).cast("int"))).alias("style_name"),
        F.when(level.between(1, 2), level - 1).cast("int").alias("outline_level"),
        F.when((idx + 2 * doc) % 13 == 3, 720).alias("left_indent_twips"),
        F.when(idx % 2 == 0, 360).otherwise(0).alias("first_line_indent_twips"),
        at(17, 4).alias("page_break_before"),
        at(19, 5).alias("leading_page_break"),
        at(37, 6).alias("trailing_page_break"),
        F.when(at(41, 8), "nextPage").alias("section_break_type"),
        at(21, 9).alias("has_numbering"),
        at(10, 2).alias("all_bold"),
        (picture & ~table).alias("has_image"),
        F.when(picture & ~table, 4000 + idx % 9 * 900).cast("int").alias("image_width_twips"),
        F.when(picture & ~table, 100 + idx % 4 * 80).cast("int").alias("image_min_dpi"),
        F.when(table, 5000 + idx % 7 * 900).cast("int").alias("table_width_twips"),
        F.when(idx % 9 == 4, 1).otherwise(0).cast("int").alias("underlined_runs"),
        F.when(idx % 12 == 7, 2).otherwise(0).cast("int").alias("footnote_refs"),
    )
