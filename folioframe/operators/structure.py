"""Structural passes over classified paragraphs. Each is a new role column from windows over (doc_id, idx)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.operators.classify import before, in_order

OPENERS = ("chapterTitle", "partTitle", "chapterSubtitle", "subheading", "sceneBreak", "pageBreak")


def _to(df: DataFrame, change: Column, role: str | Column, why: str) -> DataFrame:
    """Rows where ``change`` holds get the role and one more reason."""
    role = F.lit(role) if isinstance(role, str) else role
    change = F.coalesce(change, F.lit(False))
    return df.withColumn("__c", change).withColumn("auto_role", F.when(F.col("__c"), role).otherwise(F.col("auto_role"))).withColumn("reasons", F.when(F.col("__c"), F.concat("reasons", F.array(F.lit(why)))).otherwise(F.col("reasons"))).drop("__c")


def _page_break() -> Column:
    return F.col("page_break_before") | F.col("leading_page_break")


def split_front_matter(df: DataFrame) -> DataFrame:
    """Adds body_start, null without a heading; what stands before it becomes front matter, its first title-like line the title."""
    heading = F.col("auto_role").isin("chapterTitle", "partTitle")
    start = F.coalesce(F.min(F.when(heading & F.col("structural_marker"), F.col("idx"))).over(Window.partitionBy("doc_id")), F.min(F.when(heading, F.col("idx"))).over(Window.partitionBy("doc_id")))
    df = df.withColumn("body_start", start)
    front = (F.col("idx") < F.col("body_start")) & ~F.col("auto_role").isin("empty", "pageBreak") & (F.col("kind") != "table")
    titled = F.col("auto_role").isin("frontMatterTitle", "subheading", "chapterSubtitle") | ((F.col("word_count") <= 12) & (F.col("idx") <= 2))
    df = df.withColumn("__front", F.coalesce(front, F.lit(False)))
    df = df.withColumn("__title", F.min(F.when(F.col("__front") & titled, F.col("idx"))).over(Window.partitionBy("doc_id")))
    first = F.col("__front") & F.coalesce(F.col("idx") == F.col("__title"), F.lit(False))
    df = df.withColumn("__first", first)
    df = _to(df, F.col("__first"), "frontMatterTitle", "first line like a title ahead of the chapters")
    df = _to(df, F.col("__front") & ~F.col("__first"), "frontMatter", "ahead of the chapters")
    df = _to(df, F.col("body_start").isNull() & (F.col("auto_role") == "frontMatterTitle"), "chapterTitle", "the book has no other heading")
    return df.drop("__front", "__title", "__first")


def mark_copyright_pages(df: DataFrame) -> DataFrame:
    """Front matter of a page with any copyright marker becomes copyright; pages end at page breaks."""
    front = F.coalesce(F.col("idx") < F.col("body_start"), F.lit(False))
    breaks = ((F.col("auto_role") == "pageBreak") | _page_break()).cast("int")
    df = df.withColumn("__page", F.sum(breaks).over(in_order().rowsBetween(Window.unboundedPreceding, 0))).withColumn("__front", front)
    marker = F.col("__front") & (F.col("kind") == "paragraph") & ~F.col("is_empty") & F.col("is_copyright")
    any_marker = F.max(marker).over(Window.partitionBy("doc_id", "__page"))
    df = df.withColumn("__any", any_marker)
    change = F.col("__front") & F.col("__any") & F.col("auto_role").isin("frontMatter", "frontMatterTitle")
    return _to(df, change, "copyright", "shares its page with a rights notice").drop("__page", "__front", "__any")


def fold_subtitles(df: DataFrame) -> DataFrame:
    """A short heading right after a chapter title, on the same page, becomes its subtitle.

    A folded title can't fold the next: in a run of foldable rows only the odd ones are folded.
    """
    skipped = F.col("auto_role").isin("empty", "pageBreak")
    df = df.withColumn("__skip", skipped).withColumn("__last_break", F.max(F.when(F.col("auto_role") == "pageBreak", F.col("idx"))).over(before()))
    among = Window.partitionBy("doc_id", "__skip").orderBy("idx")
    df = df.withColumn("__prev", F.lag("auto_role").over(among)).withColumn("__prev_idx", F.lag("idx").over(among))
    heading = F.col("auto_role").isin("chapterTitle", "partTitle") | ((F.col("auto_role") == "subheading") & (F.col("confidence") < F.lit(0.7)))
    same = ~F.coalesce(F.col("__last_break") > F.col("__prev_idx"), F.lit(False)) & ~_page_break() & ~F.col("structural_marker")
    can = F.coalesce(~F.col("__skip") & (F.col("__prev") == "chapterTitle") & same & heading & (F.col("word_count") <= 12), F.lit(False))
    df = df.withColumn("__can", can)
    df = df.withColumn("__run", F.sum((~F.col("__can")).cast("int")).over(among.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("__at", F.sum(F.col("__can").cast("int")).over(Window.partitionBy("doc_id", "__skip", "__run").orderBy("idx")))
    df = _to(df, F.col("__can") & (F.col("__at") % 2 == 1), "chapterSubtitle", "next line of the page after its chapter title")
    return df.drop("__skip", "__last_break", "__prev", "__prev_idx", "__can", "__run", "__at")


def open_sections(df: DataFrame) -> DataFrame:
    """The first body paragraph after something that opens a section becomes bodyFirst: the last event carried forward."""
    event = F.when(F.col("kind") == "table", 0).when(F.col("auto_role").isin(*OPENERS), 1).when(F.col("auto_role").isin("body", "bodyFirst", "frontMatter"), 0)
    df = df.withColumn("__open", F.coalesce(F.last(event, ignorenulls=True).over(before()), F.lit(1)))
    return _to(df, (F.col("auto_role") == "body") & (F.col("__open") == 1), "bodyFirst", "first prose after a heading or break").drop("__open")


def structural_passes(df: DataFrame) -> DataFrame:
    """All passes in their order."""
    for step in (split_front_matter, mark_copyright_pages, fold_subtitles, open_sections):
        df = step(df)
    return df


def effective_roles(blocks: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Adds role: the override (doc_id, idx, role) of a paragraph, else its own role."""
    if overrides is None:
        return blocks.withColumn("role", F.col("auto_role"))
    chosen = overrides.groupBy("doc_id", "idx").agg(F.max("role").alias("role"))
    return blocks.join(chosen, ["doc_id", "idx"], "left").withColumn("role", F.coalesce("role", "auto_role"))


def needs_review(role: str = "role") -> Column:
    return (F.col("confidence") < F.lit(0.6)) & ~F.col(role).isin("body", "empty")


def empty_chapters_and_stranded_breaks(blocks: DataFrame) -> DataFrame:
    """Rows (doc_id, idx, preview, problem): chapters without text and scene breaks with nothing on one side.

    A break that lacks both sides comes twice, once for each.
    """
    role = F.when(F.col("kind") == "table", "body").otherwise(F.col("role"))
    rows = blocks.select("doc_id", "idx", "preview", role.alias("role")).filter(~F.col("role").isin("empty", "pageBreak", "chapterSubtitle"))
    what = F.when(F.col("role").isin("chapterTitle", "partTitle"), "title").when(F.col("role") == "sceneBreak", "break").otherwise("text")
    rows = rows.withColumn("what", what).withColumn("before", F.lag("what").over(in_order())).withColumn("after", F.lead("what").over(in_order()))
    ends = lambda c: F.coalesce(F.col(c) == "title", F.lit(True))
    problems = F.array(
        F.when((F.col("role") == "chapterTitle") & ends("after"), "empty-chapter"),
        F.when((F.col("what") == "break") & F.col("before").isin("title", "break"), "stranded-break"),
        F.when((F.col("what") == "break") & ends("after"), "stranded-break"),
    )
    return rows.select("doc_id", "idx", "preview", F.explode(F.filter(problems, lambda p: p.isNotNull())).alias("problem"))


def numbered_chapters(titles: DataFrame) -> DataFrame:
    """Of chapter titles (doc_id, idx, text): those with a number, with parsed, number, ordinal and new text."""
    from folioframe.functions.numbers import with_parsed_title

    # The row number keeps the filter above the parser: pushed below it, it would hold the whole parser again.
    rows = with_parsed_title(titles).withColumn("__row", F.monotonically_increasing_id()).filter("parsed IS NOT NULL AND __row >= 0").drop("__row")
    return rows.withColumn("number", F.col("parsed.number")).withColumn("ordinal", F.row_number().over(in_order()))


def retitle(numbered: DataFrame, style: str = "keep", renumber: bool = True) -> DataFrame:
    """Rows (doc_id, idx, old, new) of the titles that a style, or numbering in order, changes."""
    from folioframe.functions.numbers import format_chapter_title

    number = F.col("ordinal") if renumber else F.col("number")
    rows = numbered.select("doc_id", "idx", F.col("text").alias("old"), format_chapter_title(F.col("parsed"), style, number).alias("new"))
    return rows.filter("new <> old")


def check_numbers(numbered: DataFrame) -> DataFrame:
    """One row a document: numbered, duplicates, gaps, out_of_order, mixed.

    A number is a duplicate if an earlier chapter has it; a gap is a number between neighbours that no chapter so far has;
    a chapter is out of order if its number is lower than the one before.
    """
    w = in_order()
    n = F.col("number")
    rows = numbered.select("doc_id", "idx", "number", F.col("parsed.form").alias("form"), F.col("parsed.label").isNotNull().alias("labelled"))
    rows = rows.withColumn("prev", F.lag("number").over(w)).withColumn("seen", F.collect_set("number").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    missing = F.when(n > F.col("prev") + 1, F.array_except(F.sequence(F.col("prev") + 1, n - 1), F.col("seen"))).otherwise(F.array().cast("array<int>"))
    rows = rows.select("doc_id", "idx", "number", "form", "labelled", F.array_contains("seen", n).alias("dup"), (n < F.col("prev")).alias("low"), missing.alias("missing"))
    listed = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x["v"])
    item = lambda v: F.struct("idx", v.alias("v"))
    return rows.groupBy("doc_id").agg(
        F.count("*").alias("numbered"),
        F.array_distinct(listed(F.when(F.col("dup"), item(n)))).alias("duplicates"),
        F.array_distinct(F.flatten(listed(item(F.col("missing"))))).alias("gaps"),
        listed(F.when(F.col("low"), item(n))).alias("out_of_order"),
        ((F.count("*") > 1) & ((F.count_distinct("form") > 1) | (F.count_distinct("labelled") > 1))).alias("mixed"),
    )
