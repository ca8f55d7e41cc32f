"""The analysis of manuscripts: from paragraphs to roles and a row of counts for each document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.functions import patterns as P
from folioframe.operators.classify import classify, with_context
from folioframe.operators.facts import paragraph_facts
from folioframe.operators.structure import needs_review, structural_passes

HEADING_LIKE = ("chapterTitle", "partTitle", "chapterSubtitle", "subheading", "frontMatterTitle", "sceneBreak")


def analyze_blocks(blocks: DataFrame) -> DataFrame:
    """Paragraphs with facts, context, role, confidence and reasons. One shuffle by document carries all windows."""
    out = structural_passes(classify(with_context(paragraph_facts(blocks))))
    return out.withColumn("role", F.col("auto_role"))


def counted(blocks: DataFrame) -> DataFrame:
    """Adds what summaries count in the text: quotes, spaces and contents_heading. With these the text itself can go."""
    count = lambda pattern: F.regexp_count("text", F.lit(pattern))
    return blocks.select("*", count("[\"']").alias("quotes"), count(" {2,}").alias("spaces"), P.is_contents_heading(F.col("text")).alias("contents_heading"))


def summarize(blocks: DataFrame) -> DataFrame:
    """One row a document: the counts that reports and options read."""
    blocks = blocks if "quotes" in blocks.columns else counted(blocks)
    is_role = lambda *r: F.col("auto_role").isin(*r)
    paragraph = (F.col("kind") == "paragraph") & ~F.col("is_empty")
    count = lambda c: F.count(F.when(c, 1))
    total = lambda when, c: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0))
    return blocks.groupBy("doc_id").agg(
        F.sum("word_count").alias("words"), count(paragraph).alias("paragraphs"), count(is_role("chapterTitle")).alias("chapters"), count(is_role("partTitle")).alias("parts"), count(is_role("sceneBreak")).alias("scene_breaks"),
        count(F.col("kind") == "table").alias("tables"), count(F.col("has_image")).alias("images"), F.sum("footnote_refs").alias("notes"), F.min("body_start").alias("body_start"), F.coalesce(F.bool_or("contents_heading"), F.lit(False)).alias("has_contents"),
        total(paragraph, "quotes").alias("straight_quotes"), total(paragraph, "spaces").alias("double_spaces"), total(paragraph & ~is_role(*HEADING_LIKE), "underlined_runs").alias("underlined_runs"),
        count(needs_review("auto_role")).alias("uncertain"), count(F.col("image_min_dpi") < 300).alias("blurry"), count(F.col("image_min_dpi") >= 300).alias("sharp"), F.min("image_min_dpi").alias("worst_dpi"),
    )
