"""Built-in designs as tables, and a sample manuscript."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.functions.geometry import GUTTER_IN, designs

# The styles that every built-in design has, with what sets each apart from the body.
STYLES = (
    ("Normal", None, None, None), ("BookBody", "body", "both", 0.3), ("BookFirst", "bodyFirst", "both", 0.0), ("ChapterTitle", "chapterTitle", "center", 0.0), ("ChapterSubtitle", "chapterSubtitle", "center", 0.0), ("PartTitle", "partTitle", "center", 0.0), ("Subhead", "subheading", "left", 0.0),
    ("SceneBreak", "sceneBreak", "center", 0.0), ("BlockQuote", "blockQuote", "both", 0.0), ("ListItem", "listItem", "left", 0.0), ("BookTitle", "frontMatterTitle", "center", 0.0), ("FrontMatter", "frontMatter", "left", 0.0), ("Copyright", "copyright", "left", 0.0),
)
# End of fixed values.


def template_styles(spark: SparkSession) -> DataFrame:
    """Rows (design_id, ord, style_id, role, alignment, first_line_twips, font, half_points, line): 13 for each of 20 designs."""
    kinds = spark.createDataFrame([(i, *s) for i, s in enumerate(STYLES)], "ord int, style_id string, role string, alignment string, indent_in double")
    rows = designs(spark).join(F.broadcast(kinds))
    align = F.when((F.col("alignment") == "both") & ~F.col("justified"), "left").otherwise(F.col("alignment"))
    return rows.select("design_id", "ord", "style_id", "role", align.alias("alignment"), F.round(F.col("indent_in") * 1440).cast("int").alias("first_line_twips"), "font", F.round(F.col("points") * 2).cast("int").alias("half_points"), F.round(F.col("spacing") * 240).cast("int").alias("line"))


def template_pages(spark: SparkSession) -> DataFrame:
    """Rows (design_id, width_twips, height_twips, margins in twips): the page of each built-in design."""
    twips = lambda c: F.round(c * 1440).cast("int")
    return designs(spark).select("design_id", twips(F.col("width_in")).alias("width_twips"), twips(F.col("height_in")).alias("height_twips"), twips(F.col("top_in")).alias("margin_top"), twips(F.col("outside_in")).alias("margin_outside"), twips(F.lit(GUTTER_IN)).alias("gutter"), "sink_before", "sink_after", "mark")


def sample_manuscript(spark: SparkSession) -> DataFrame:
    """A small book (doc_id, idx, text, centered): opening pages and two chapters of four paragraphs and a scene break each."""
    prose = "This paragraph stands for the text of a book, long enough to be read as prose and short enough to be typed by hand in a sample."
    front = [("A Sample Book", True), ("A Novel", True), ("by A. Writer", True), ("Copyright © 2024 A. Writer", False), ("All rights reserved.", False), ("First edition", False)]
    chapter = lambda n: [(f"Chapter {n}", True), (prose, False), (prose, False), ("* * *", True), (prose, False), (prose, False)]
    lines = [*front, *chapter(1), *chapter(2)]
    return spark.createDataFrame([(1, i, *line) for i, line in enumerate(lines)], "doc_id long, idx int, text string, centered boolean")
