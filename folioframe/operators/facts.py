"""Facts about paragraphs: what their text and formatting show, before any judgement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions import patterns as P

#: Columns that a source may leave out, with their types and what then holds.
DEFAULTS = {
    "kind": ("string", "paragraph"), "style_id": ("string", None), "style_name": ("string", None), "outline_level": ("int", None), "alignment": ("string", None), "left_indent_twips": ("int", None), "first_line_indent_twips": ("int", None),
    "page_break_before": ("boolean", False), "leading_page_break": ("boolean", False), "trailing_page_break": ("boolean", False), "section_break_type": ("string", None), "has_numbering": ("boolean", False),
    "all_bold": ("boolean", False), "all_italic": ("boolean", False), "runs_caps": ("boolean", False), "centered": ("boolean", False), "has_image": ("boolean", False), "has_footnote": ("boolean", False), "has_hyperlink": ("boolean", False),
    "image_width_twips": ("int", None), "image_min_dpi": ("int", None), "table_width_twips": ("int", None), "underlined_runs": ("int", 0), "footnote_refs": ("int", 0),
}


def paragraph_facts(blocks: DataFrame) -> DataFrame:
    """Adds the derived facts to (doc_id, idx, text, ...): trimmed, word_count, is_empty, all_caps, has_tab_indent and so on.

    Each pattern is evaluated once, as a column that all later rules read. heading_case is judged for up to twelve words,
    as no rule asks for more.
    """
    out = blocks.select("*", *[F.lit(value).cast(kind).alias(name) for name, (kind, value) in DEFAULTS.items() if name not in blocks.columns])
    out = out.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("trimmed", P.trimmed(F.col("text")))
    t, is_table = F.col("trimmed"), F.col("kind") == "table"
    out = out.withColumn("__line", F.regexp_replace("trimmed", f"[{P.WS}]+", " "))
    out = out.withColumn("word_count", F.when(t == "", F.lit(0)).otherwise(F.length("__line") - F.length(F.replace("__line", F.lit(" "))) + 1))
    return out.select(
        *[c for c in out.columns if c != "__line"],
        F.length("trimmed").alias("char_count"), ((t == "") & ~is_table).alias("is_empty"),
        (F.col("runs_caps") | ((t == F.upper(t)) & t.rlike("[A-Z]"))).alias("all_caps"), F.col("text").rlike(r"^[\t ]+\S").alias("has_tab_indent"),
        F.when(is_table, "[table]").otherwise(P.preview(F.col("__line"), is_collapsed=True)).alias("preview"),
        P.is_scene_break(t, True).alias("is_ornament"), P.label_kind(t, True).alias("label"), P.number_confidence(t, True).alias("number_conf"), P.looks_like_copyright(t, True).alias("is_copyright"),
        ((F.col("word_count") <= 12) & P.is_heading_case(t, True)).alias("heading_case"), P.ends_like_sentence(t, True).alias("ends_sentence"),
    )


def structural_marker() -> Column:
    """Whether style or text declares a division outright."""
    named = F.coalesce(F.col("style_name"), F.lit("")).rlike(r"(?i)^heading\s*1$") | F.coalesce(F.col("outline_level") == 0, F.lit(False))
    return (F.col("kind") == "paragraph") & (named | F.col("label").isNotNull() | F.coalesce(F.col("number_conf") >= 0.7, F.lit(False)))


def is_design_heading() -> Column:
    """Heading-like on the design side: by outline, style, label, or a number that is centred or bold."""
    by_style = F.coalesce(F.col("outline_level") <= 2, F.lit(False)) | F.coalesce(F.col("style_name"), F.lit("")).rlike(r"(?i)^heading\s*[1-3]$")
    by_text = (F.col("word_count") <= 12) & (F.col("label").isNotNull() | (F.col("number_conf").isNotNull() & (F.col("centered") | F.col("all_bold"))))
    return by_style | by_text
