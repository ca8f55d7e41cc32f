"""Styles: inheritance, lookups and how paragraphs take their properties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.lineage import cut
from folioframe.sources.docx import STYLE_COLUMNS

NAMES = [c.strip().split(" ")[0] for c in STYLE_COLUMNS.split(",")]
BOOLEANS = [c.strip().split(" ")[0] for c in STYLE_COLUMNS.split(",") if c.strip().endswith("boolean")]


def resolve_styles(styles: DataFrame) -> DataFrame:
    """Styles with inherited properties, the nearest value of the chain, then the document defaults, and depth: how many
    others a style is based on, directly or not.

    A boolean that is on anywhere in the chain is on: a derived style can't turn it off. A style that is based on itself,
    directly or not, ends its chain where it would repeat. Of several styles with one id the last of the file counts.
    """
    rows = styles.filter("doc_id IS NOT NULL AND style_id IS NOT NULL")
    kept = ["based_on", "style_name", "type", "is_default", "next", *NAMES]
    rows = rows.groupBy("doc_id", "style_id").agg(F.max(F.struct("ord", *kept)).alias("s")).select("doc_id", "style_id", "s.*")
    found = _inherited(cut(rows.withColumn("__size", F.lit(1).cast("long")).withColumn("__least", F.col("style_id"))))
    base = styles.filter("type = 'defaults'").select("doc_id", *[F.col(c).alias(f"__{c}") for c in NAMES])
    found = found.join(base, "doc_id", "left")
    merged = [F.coalesce(F.greatest(F.coalesce(c, F.lit(False)), F.coalesce(f"__{c}", F.lit(False)))).alias(c) if c in BOOLEANS else F.coalesce(c, f"__{c}").alias(c) for c in NAMES]
    return found.select("doc_id", "style_id", *merged, "style_name", "type", "ord", "is_default", "next", (F.col("__size") - 1).cast("int").alias("depth"))


def _inherited(own: DataFrame) -> DataFrame:
    """``own`` with the properties of whole chains, and in __size how many styles these hold.

    Chains that end are followed first. In the rest, which run into circles, the styles that others point at after a walk
    round are the circles; each of those holds its whole circle, and the styles that lead there end at it.
    """
    ended, circling = _followed(own.filter("based_on IS NOT NULL"), own.filter("based_on IS NULL"))
    if circling is None:
        return ended
    on = circling.select("doc_id", F.col("based_on").alias("style_id")).distinct()
    ring = circling.join(on, ["doc_id", "style_id"], "left_semi").drop("__size")
    ring = ring.join(ring.groupBy("doc_id", "__least").agg(F.count("*").alias("__size")), ["doc_id", "__least"])
    ring = cut(ring.withColumn("based_on", F.lit(None).cast("string")).select(own.columns))
    rest = own.join(circling.select("doc_id", "style_id"), ["doc_id", "style_id"], "left_semi")
    tails, _ = _followed(rest.join(on, ["doc_id", "style_id"], "left_anti"), ring)
    return ended.unionByName(tails)


def _followed(active: DataFrame, ended: DataFrame, few: int = 10_000) -> tuple[DataFrame, DataFrame | None]:
    """The styles whose chains end, and those whose chains run into circles, or None.

    A row covers the first styles of its chain and points at the next one by based_on; ``ended`` ones point nowhere. In each
    round it takes over what that one covers, which doubles its reach, so there are as many rounds as the longest chain
    doubles. While chains that end are unfinished, each round finishes some; when none does, what is left runs in circles,
    and has been all round once its reach is the number of such styles. Up to ``few`` styles pointed at are broadcast, as
    then many rows point at one.
    """
    reach, before = 1, None
    while True:
        n, targets = active.groupBy("doc_id", "based_on").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
        if not n:
            return ended, None
        if n == before and reach >= active.groupBy("doc_id").count().agg(F.max("count")).first()[0]:
            return ended, active
        others = active.unionByName(ended).select("doc_id", F.col("style_id").alias("based_on"), F.struct("based_on", "__size", "__least", *NAMES).alias("__to"))
        if targets <= few:
            others = F.broadcast(others.join(F.broadcast(active.select("doc_id", "based_on").distinct()), ["doc_id", "based_on"], "left_semi"))
        more = {"based_on": F.col("__to.based_on"), "__size": F.col("__size") + F.coalesce("__to.__size", F.lit(0)), "__least": F.least("__least", "__to.__least")}
        more |= {c: (F.greatest if c in BOOLEANS else F.coalesce)(c, f"__to.{c}") for c in NAMES}
        rows = cut(active.join(others, ["doc_id", "based_on"], "left").withColumns(more).select(active.columns))
        active, ended = rows.filter("based_on IS NOT NULL"), ended.unionByName(rows.filter("based_on IS NULL"))
        reach, before = reach * 2, n


def normalized_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"[\s_-]", "")


def style_by_names(styles: DataFrame, names: list[str]) -> DataFrame:
    """For each document the paragraph style that bears the earliest of the names: (doc_id, style_id)."""
    wanted = F.array(*[F.lit(n.lower().replace(" ", "").replace("-", "").replace("_", "")) for n in names])
    rows = styles.filter("type = 'paragraph'").withColumn("__at", F.array_position(wanted, normalized_name(F.col("style_name")))).filter("__at > 0")
    return rows.groupBy("doc_id").agg(F.min_by("style_id", F.struct("__at", "ord")).alias("style_id"))


def style_by_pattern(styles: DataFrame, usage: DataFrame, pattern: str, taken: DataFrame | None = None) -> DataFrame:
    """For each document the most used paragraph style whose name or id fits the pattern, the first in file order on ties."""
    rows = styles.filter((F.col("type") == "paragraph") & (F.col("style_name").rlike(pattern) | F.col("style_id").rlike(pattern)))
    rows = rows.join(taken.select("doc_id", "style_id"), ["doc_id", "style_id"], "left_anti") if taken is not None else rows
    rows = rows.join(usage, ["doc_id", "style_id"], "left")
    order = Window.partitionBy("doc_id").orderBy(F.coalesce("uses", F.lit(0)).desc(), "ord")
    return rows.withColumn("__n", F.row_number().over(order)).filter("__n = 1").select("doc_id", "style_id")


def style_usage(blocks: DataFrame, styles: DataFrame) -> DataFrame:
    """Rows (doc_id, style_id, uses, first_idx): non-empty paragraphs of each style, the default style for those without."""
    default = styles.filter("is_default AND type = 'paragraph'").groupBy("doc_id").agg(F.min_by("style_id", "ord").alias("__default"))
    rows = blocks.filter("NOT is_empty AND kind = 'paragraph'").join(default, "doc_id", "left")
    return rows.groupBy("doc_id", F.coalesce("style_id", "__default").alias("style_id")).agg(F.count("*").alias("uses"), F.min("idx").alias("first_idx"))


def top_style(usage: DataFrame) -> DataFrame:
    """The most used style of each document; the first to occur wins ties."""
    return usage.filter("style_id IS NOT NULL").groupBy("doc_id").agg(F.max_by("style_id", F.struct("uses", -F.col("first_idx"))).alias("style_id"))


def styled_paragraphs(paragraphs: DataFrame, runs: DataFrame, styles: DataFrame) -> DataFrame:
    """Paragraphs with their effective properties: what is set directly, else by the style (or the default style).

    A paragraph is all bold (italic, in capitals) if every run with text is: by itself, by its character style, or by the
    paragraph's style; without such runs it isn't.
    """
    resolved = resolve_styles(styles)
    default = resolved.filter("is_default AND type = 'paragraph'").groupBy("doc_id").agg(F.min_by("style_id", "ord").alias("__default"))
    by_style = resolved.select("doc_id", F.col("style_id").alias("__style"), F.col("style_name"), *[F.col(c).alias(f"__{c}") for c in NAMES])
    rows = paragraphs.join(default, "doc_id", "left").withColumn("__style", F.coalesce("style_id", "__default")).join(by_style, ["doc_id", "__style"], "left")
    marks = resolved.select("doc_id", F.col("style_id"), *[F.col(c).alias(f"__{c}") for c in ("bold", "italic", "caps", "underline")])
    texts = runs.filter(F.trim("text") != "").join(marks, ["doc_id", "style_id"], "left")
    texts = texts.join(rows.select("doc_id", "idx", *[F.col(f"__{c}").alias(f"__p_{c}") for c in ("bold", "italic", "caps")]), ["doc_id", "idx"])
    every = lambda c: F.bool_and(F.coalesce(c, F.when(F.col(f"__{c}"), True), f"__p_{c}", F.lit(False)))
    lines = F.coalesce("underline", F.lit(False)) | F.coalesce(F.col("__underline") & F.col("underline").isNull(), F.lit(False))
    marks = texts.groupBy("doc_id", "idx").agg(every("bold").alias("all_bold"), every("italic").alias("all_italic"), every("caps").alias("runs_caps"), F.count(F.when(lines, 1)).cast("int").alias("underlined_runs"))
    rows = rows.join(marks, ["doc_id", "idx"], "left")
    either = lambda c: F.coalesce(c, f"__{c}").alias(c)
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    keep = [c for c in paragraphs.columns if c not in ("outline_level", "alignment", "left_indent_twips", "first_line_indent_twips", "page_break_prop", "has_numbering")]
    return rows.select(
        *keep, "style_name", either("outline_level"), either("alignment"), either("left_indent_twips"), either("first_line_indent_twips"), F.coalesce(F.col("page_break_prop") | F.coalesce("__page_break_before", F.lit(False)), F.lit(False)).alias("page_break_before"),
        (F.col("has_numbering") | F.coalesce("__has_numbering", F.lit(False))).alias("has_numbering"), (F.coalesce("alignment", "__alignment") == "center").alias("__c"), no("all_bold"), no("all_italic"), no("runs_caps"), F.coalesce("underlined_runs", F.lit(0)).alias("underlined_runs"),
    ).withColumn("centered", F.coalesce("__c", F.lit(False))).drop("__c")


def dominant_language(runs: DataFrame, defaults: DataFrame) -> DataFrame:
    """The language that most text is tagged with: (doc_id, lang); untagged text counts for the default (doc_id, lang)."""
    rows = runs.join(defaults.withColumnRenamed("lang", "__default"), "doc_id", "left").withColumn("lang", F.coalesce("lang", "__default"))
    sums = rows.filter("lang IS NOT NULL").groupBy("doc_id", "lang").agg(F.sum(F.length("text")).alias("w"), F.min(F.struct("idx", "run")).alias("first"))
    best = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("w").desc(), "first"))
    return sums.withColumn("__n", best).filter("__n = 1 AND w > 0").select("doc_id", "lang")


def section_index(paragraphs: DataFrame) -> DataFrame:
    """Adds section: how many sections end before the paragraph; the paragraph that carries a break is its section's last."""
    before = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return paragraphs.withColumn("section", F.coalesce(F.sum(F.col("section_break_type").isNotNull().cast("int")).over(before), F.lit(0)))


def body_section(sections: DataFrame) -> DataFrame:
    """The section whose numbering restarts in arabic figures, the first such, else the last: (doc_id, ord)."""
    arabic = F.col("page_start").isNotNull() & F.coalesce("page_format", F.lit("decimal")).isin("decimal")
    return sections.groupBy("doc_id").agg(F.coalesce(F.min(F.when(arabic, F.col("ord"))), F.max("ord")).alias("ord"))


def in_chapter_style(facts: DataFrame, chapters: DataFrame) -> DataFrame:
    """Paragraphs with pos (0, 1, ... in order) and titled: whether their style is the design's chapter style.

    ``facts`` has the effective style_id; ``chapters`` has one row a design: doc_id, chapter_style (null where there is none)
    and style_breaks, whether that style itself starts a page.
    """
    pos = F.row_number().over(Window.partitionBy("doc_id").orderBy("idx")) - 1
    rows = facts.withColumn("pos", pos).join(chapters.select("doc_id", "chapter_style"), "doc_id")
    return rows.withColumn("titled", F.coalesce(F.col("style_id") == F.col("chapter_style"), F.lit(False)))


def chapter_sink(facts: DataFrame, chapters: DataFrame) -> DataFrame:
    """(doc_id, before, after) of every design in ``chapters``: the usual number of blanks in the chapter style around titles.

    Of equally usual numbers the larger; 0 without titles. A title's blanks are those between it and the nearest paragraph
    that isn't a blank in that style; at the end of the text they are counted up to it.
    """
    w = Window.partitionBy("doc_id").orderBy("pos")
    rows = in_chapter_style(facts, chapters)
    other = F.when(~(F.col("is_empty") & F.col("titled")), F.col("pos"))
    rows = rows.withColumn("__prev", F.last(other, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("__next", F.first(other, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    rows = rows.withColumn("__end", F.max("pos").over(Window.partitionBy("doc_id")) + 1)
    before = F.col("pos") - F.coalesce("__prev", F.lit(-1)) - 1
    after = F.coalesce("__next", "__end") - F.col("pos") - 1
    titles = rows.filter("titled AND NOT is_empty").select("doc_id", before.alias("before"), after.alias("after"))
    usual = lambda c: titles.groupBy("doc_id", c).count().groupBy("doc_id").agg(F.max_by(c, F.struct("count", c)).alias(c))
    out = chapters.select("doc_id").join(usual("before"), "doc_id", "left").join(usual("after"), "doc_id", "left")
    return out.select("doc_id", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))


def starts_on_new_page(facts: DataFrame, chapters: DataFrame, least: float = 0.6) -> DataFrame:
    """(doc_id, new_page) of every design: whether its chapter style, or most titles in it, start a page.

    A title starts one by its own break, as the first paragraph with text, or if the one before it holds a page break or
    ends a section. Without titles there is no evidence, and chapters start a page.
    """
    solid = F.when(~F.col("is_empty"), F.struct(F.col("trailing_page_break") | F.col("leading_page_break") | F.col("section_break_type").isNotNull()))
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = in_chapter_style(facts, chapters).withColumn("__prev", F.last(solid, ignorenulls=True).over(w))
    starts = F.col("page_break_before") | F.col("leading_page_break") | F.col("__prev").isNull() | F.coalesce(F.col("__prev.col1"), F.lit(False))
    share = rows.filter("titled AND NOT is_empty").groupBy("doc_id").agg(F.avg(starts.cast("double")).alias("__share"))
    out = chapters.join(share, "doc_id", "left")
    by_style = F.col("chapter_style").isNotNull() & F.coalesce("style_breaks", F.lit(False))
    return out.select("doc_id", (by_style | F.coalesce(F.col("__share") >= F.lit(least), F.lit(True))).alias("new_page"))


def styles_by_usage(styles: DataFrame, usage: DataFrame) -> DataFrame:
    """Styles with uses and place: 1 for the most used style of each design, names in order of code points on ties."""
    rows = styles.join(usage.select("doc_id", "style_id", "uses"), ["doc_id", "style_id"], "left").withColumn("uses", F.coalesce("uses", F.lit(0)))
    order = Window.partitionBy("doc_id").orderBy(F.col("uses").desc(), "style_name", "ord")
    return rows.withColumn("place", F.row_number().over(order))


def equivalent_styles(used: DataFrame, styles: DataFrame, usage: DataFrame, pattern: str) -> DataFrame:
    """Styles (doc_id, style_id) of notes with new_style: themselves where the design has them, else its style of that kind.

    The design's style is the most used one whose name or id fits ``pattern``; without one new_style is null, and goes.
    """
    known = styles.filter("style_id IS NOT NULL").select("doc_id", "style_id").distinct().withColumn("__known", F.lit(True))
    other = style_by_pattern(styles, usage, pattern).withColumnRenamed("style_id", "__other")
    rows = used.join(known, ["doc_id", "style_id"], "left").join(other, "doc_id", "left")
    return rows.withColumn("new_style", F.when(F.col("__known"), F.col("style_id")).otherwise(F.col("__other"))).drop("__known", "__other")
