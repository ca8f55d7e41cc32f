"""Lines picked for a reviewer: the review list, first lines of a role, what stands around a line, and sample pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How many rows of the review list are shown.
REVIEW_ROWS = 2500
#: Sample pages that list the first lines of roles: section, roles, lines.
LISTS = (("titlePage", ("frontMatterTitle", "frontMatter"), 8), ("copyright", ("copyright",), 10), ("partTitle", ("partTitle",), 2), ("body", ("body",), 9))
#: Sample pages around the first line of a role: section, roles, lines before and after.
SCENES = (
    ("chapter", ("chapterTitle", "partTitle"), 0, 5),
    ("subheading", ("subheading",), 2, 2),
    ("sceneBreak", ("sceneBreak",), 2, 2),
    ("blockQuote", ("blockQuote",), 2, 2),
    ("listItem", ("listItem",), 2, 3),
)


def is_drawable() -> Column:
    """Whether a paragraph shows anything: text or a picture."""
    return (F.col("kind") == "paragraph") & (~F.col("is_empty") | F.col("has_image"))


def is_interesting(sure: float = 0.6) -> Column:
    """Whether a reviewer should see the paragraph: any role but plain text, and plain text of doubtful role."""
    plain = F.col("role").isin("empty", "body", "bodyFirst")
    return (F.col("role") != "pageBreak") & (~plain | (F.col("confidence") < sure))


def review_rows(blocks: DataFrame, limit: int = REVIEW_ROWS) -> DataFrame:
    """The first ``limit`` interesting paragraphs of each document."""
    rows = blocks.filter(is_interesting())
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("idx"))
    return rows.withColumn("__place", place).filter(F.col("__place") <= limit).drop("__place")


def first_lines(blocks: DataFrame, roles: tuple[str, ...], limit: int) -> DataFrame:
    """The first ``limit`` drawable paragraphs of each document with one of ``roles``."""
    rows = blocks.filter(is_drawable() & F.col("role").isin(*roles))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("idx"))
    return rows.withColumn("__place", place).filter(F.col("__place") <= limit).drop("__place")


def lines_around(blocks: DataFrame, targets: Column, before: int, after: int) -> DataFrame:
    """Rows (doc_id, idx, near_idx) for each target: the drawable paragraphs with content next to it on both sides."""
    w = Window.partitionBy("doc_id").orderBy("idx")
    rows = blocks.filter(is_drawable() & ~F.col("role").isin("empty", "pageBreak"))
    near = [F.lag("idx", k).over(w) for k in range(before, 0, -1)] + [F.lead("idx", k).over(w) for k in range(1, after + 1)]
    rows = rows.withColumn("__near", F.array(*near)).filter(targets)
    return rows.select("doc_id", "idx", F.explode("__near").alias("near_idx")).filter("near_idx IS NOT NULL")


def sample_pages(blocks: DataFrame) -> DataFrame:
    """Rows (doc_id, section, ord, idx, role): the lines of each sample page that a document can fill.

    All pages are picked in one partitioning: ranks of the lists, and for each scene the rank of its first line among the
    paragraphs with content. A chapter's blanks (``chapter_sink``) are not lines and are added where it is drawn.
    """
    by_doc = Window.partitionBy("doc_id")
    in_order = by_doc.orderBy("idx")
    rows = blocks.filter(is_drawable())
    content = ~F.col("role").isin("empty", "pageBreak")
    so_far = lambda c: F.sum(c.cast("int")).over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__n", F.when(content, so_far(content)))
    lines = []
    for section, roles, limit in LISTS:
        held = F.col("role").isin(*roles)
        rows = rows.withColumn(f"__{section}", F.when(held, so_far(held)))
        lines.append(F.when(F.col(f"__{section}") <= limit, F.struct(F.lit(section).alias("section"), (F.col(f"__{section}") - 1).cast("int").alias("ord"))))
    for section, roles, before, after in SCENES:
        rows = rows.withColumn(f"__{section}", F.min(F.when(F.col("role").isin(*roles), F.col("__n"))).over(by_doc))
        away = F.col("__n") - F.col(f"__{section}")
        lines.append(F.when(away.between(-before, after), F.struct(F.lit(section).alias("section"), away.cast("int").alias("ord"))))
    picked = F.filter(F.array(*lines), lambda x: x.isNotNull())
    return rows.select("doc_id", "idx", "role", F.inline(picked)).select("doc_id", "section", "ord", "idx", "role")


def ordered_checks(checks: DataFrame) -> DataFrame:
    """The report's rows with position: 1 for the first, the gravest first and otherwise in the rules' order."""
    return checks.withColumn("position", F.row_number().over(Window.partitionBy("doc_id").orderBy("rank", "place")))
