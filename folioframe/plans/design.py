"""The profile of a design: from a package to one row of what a book in its look needs to know."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.operators import profile as Pr
from folioframe.operators import styles as Y
from folioframe.operators.facts import paragraph_facts
from folioframe.sources import docx as X


def assemble_profile(facts: DataFrame, styles: DataFrame, roles: DataFrame, sections: DataFrame, heads: DataFrame, settings: DataFrame) -> DataFrame:
    """One row a design. ``facts`` are its paragraphs with their effective style_id, ``styles`` its resolved styles.

    Everything is joined on doc_id; no side is broadcast, as each has a row for every design.
    """
    by_role = roles.groupBy("doc_id").agg(*[F.max(F.when(F.col("role") == r, F.col("style_id"))).alias(f"{n}_style") for r, n in (("body", "body"), ("bodyFirst", "first"), ("chapterTitle", "chapter"))])
    of = lambda name, *columns: styles.select("doc_id", F.col("style_id").alias(f"{name}_style"), *[F.col(c).alias(f"{name}_{c}") for c in columns])
    out = settings.join(by_role, "doc_id", "left")
    out = out.join(of("body", "first_line_indent_twips", "alignment"), ["doc_id", "body_style"], "left")
    out = out.join(of("first", "first_line_indent_twips"), ["doc_id", "first_style"], "left")
    out = out.join(of("chapter", "page_break_before"), ["doc_id", "chapter_style"], "left").withColumnRenamed("chapter_page_break_before", "style_breaks")
    chapters = out.select("doc_id", "chapter_style", "style_breaks")
    texts = facts.groupBy("doc_id").agg(F.count(F.when(~F.col("is_empty"), 1)).alias("paragraphs"))
    parts = (Y.chapter_sink(facts, chapters), Y.starts_on_new_page(facts, chapters), Pr.section_profile(sections), Pr.header_profile(heads), texts)
    for part in parts:
        out = out.join(part, "doc_id", "left")
    out = out.fillna(False, ["has_headers", "has_footers", "has_page_numbers", "odd_page"]).fillna(0, ["before", "after", "section_count", "paragraphs"])
    out = out.withColumn("new_page", F.coalesce("new_page", F.lit(True))).withColumn("header_texts", F.coalesce("header_texts", F.array().cast("array<string>")))
    out = out.withColumn("first_no_indent", Pr.first_no_indent(F.col("body_first_line_indent_twips"), F.col("first_style"), F.col("first_first_line_indent_twips")))
    out = out.withColumn("justified", F.coalesce(F.col("body_alignment") == "both", F.lit(False)))
    return out.withColumn("warnings", Pr.profile_warnings())


def design_profile(packages: DataFrame) -> DataFrame:
    """The profiles of packages (doc_id, content); packages that can't be read have none (``docx.parts`` says why)."""
    paragraphs, styles = X.paragraphs(packages), X.styles(packages)
    resolved = Y.resolve_styles(styles)
    facts = paragraph_facts(Y.styled_paragraphs(paragraphs, X.runs(packages), styles))
    roles = Pr.detect_roles(resolved, Pr.style_votes(facts, resolved))
    default = resolved.filter("is_default AND type = 'paragraph'").groupBy("doc_id").agg(F.min_by("style_id", "ord").alias("__default"))
    facts = facts.filter("kind = 'paragraph'").join(default, "doc_id", "left").withColumn("style_id", F.coalesce("style_id", "__default"))
    return assemble_profile(facts, resolved, roles, X.sections(packages), X.heads(packages), X.settings(packages))
