"""Units, page sizes and estimates of length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Units, sizes in inches, margins by length, designs.
TWIPS_PER_INCH, EMU_PER_INCH, EMU_PER_TWIP = 1440, 914400, 635
CHARS_PER_WORD, CHAR_WIDTH_RATIO, DEFAULT_SPACING, TYPICAL_WORDS = 6.5, 0.5, 1.15, 80_000
KNOWN_SIZES = (
    ("US Letter", 8.5, 11.0), ("A4", 8.27, 11.69), ("A5", 5.83, 8.27), ("US Legal", 8.5, 14.0), ("Mass market", 4.25, 6.87), ("Pocket", 5.0, 8.0), ("Digest", 5.5, 8.5), ("Trade paperback", 6.0, 9.0), ("US Trade", 6.14, 9.21), ("Royal", 6.69, 9.61),
    ("Executive", 7.0, 10.0), ("Crown quarto", 7.44, 9.69), ("Small square", 8.5, 8.5), ("Novella", 5.0, 7.0), ("Comic", 6.63, 10.25), ("KDP 5.06 x 7.81", 5.06, 7.81), ("KDP 5.25 x 8", 5.25, 8.0), ("KDP 7.5 x 9.25", 7.5, 9.25), ("KDP 8 x 10", 8.0, 10.0),
)
SIZE_TOLERANCE = 0.03
GUTTER_BY_PAGES = ((150, 0.375), (300, 0.5), (500, 0.625), (700, 0.75))
GUTTER_BEYOND = 0.875
TRIMS = (("6x9", 6.0, 9.0, 0.8, 0.65), ("5.5x8.5", 5.5, 8.5, 0.75, 0.6), ("5.25x8", 5.25, 8.0, 0.75, 0.6), ("5x8", 5.0, 8.0, 0.7, 0.55), ("a5", 8391 / 1440, 11906 / 1440, 0.75, 0.6))
LOOKS = (("classic", "Garamond", 11.5, 1.15, True, 6, 2, "* * *"), ("modern", "Georgia", 10.5, 1.25, True, 4, 2, "§"), ("minimal", "Cambria", 11.0, 1.2, False, 3, 1, "·"), ("largePrint", "Georgia", 16.0, 1.3, False, 3, 2, "* * *"))
GUTTER_IN = 0.5
# End of fixed values.


def inches(twips: Column) -> Column:
    return twips / F.lit(float(TWIPS_PER_INCH))


def inch_label(twips: Column) -> Column:
    """Inches to two places, without zeros at the end."""
    return F.regexp_replace(F.format_string("%.2f", F.round(inches(twips), 2)), r"\.?0+$", "")


def line_spacing(value: Column, rule: Column, points: Column) -> Column:
    usual = F.lit(DEFAULT_SPACING)
    return F.when(value.isNull() | (value <= 0) | (points <= 0), usual).when(rule.isin("exact", "atLeast"), value / F.lit(20.0) / points).otherwise(value / F.lit(240.0))


def estimate_pages(width: Column, height: Column, points: Column, spacing: Column, words: Column) -> Column:
    """Pages of a text block in inches, or null where they can't be told."""
    word_width = F.lit(CHARS_PER_WORD * CHAR_WIDTH_RATIO) * (points / F.lit(72.0))
    per_page = (width / word_width) * (height / ((points * spacing) / F.lit(72.0)))
    fine = (width > 0) & (height > 0) & (points > 0) & (words > 0) & (per_page > 0)
    return F.when(fine, F.greatest(F.lit(1), F.floor(words / per_page + F.lit(0.5)).cast("int")))


def gutter_needed(pages: Column) -> Column:
    out = F.lit(GUTTER_BEYOND)
    for most, width in reversed(GUTTER_BY_PAGES):
        out = F.when(pages <= most, F.lit(width)).otherwise(out)
    return out


def known_sizes(spark: SparkSession) -> DataFrame:
    rows = [(i, *s) for i, s in enumerate(KNOWN_SIZES)]
    return spark.createDataFrame(rows, "ord int, label string, width_in double, height_in double")


def describe_sizes(pages: DataFrame) -> DataFrame:
    """Adds size_label to (width_twips, height_twips): the first known size within the tolerance, by a range join on 19 rows."""
    sizes = known_sizes(pages.sparkSession)
    near = (F.abs(F.col("width_in") - inches(F.col("width_twips"))) <= F.lit(SIZE_TOLERANCE)) & (F.abs(F.col("height_in") - inches(F.col("height_twips"))) <= F.lit(SIZE_TOLERANCE))
    distinct = pages.select("width_twips", "height_twips").distinct()
    first = distinct.join(F.broadcast(sizes), near, "left").groupBy("width_twips", "height_twips").agg(F.min_by("label", "ord").alias("__label"))
    dims = F.concat(inch_label(F.col("width_twips")), F.lit('" x '), inch_label(F.col("height_twips")), F.lit('"'))
    named = F.when(F.col("__label").isNotNull(), F.concat(dims, F.lit(" ("), F.col("__label"), F.lit(")"))).otherwise(dims)
    return pages.join(first, ["width_twips", "height_twips"]).withColumn("size_label", named).drop("__label")


def designs(spark: SparkSession) -> DataFrame:
    """The built-in designs: every trim with every look, 20 rows."""
    rows = [(f"{t[0]}-{k[0]}", *t, *k) for t in TRIMS for k in LOOKS]
    return spark.createDataFrame(rows, "design_id string, trim string, width_in double, height_in double, top_in double, outside_in double, look string, font string, points double, spacing double, justified boolean, sink_before int, sink_after int, mark string")


def design_pages(words: DataFrame, designs_: DataFrame) -> DataFrame:
    """Rows (doc_id, design_id, pages): the estimated length of each document (doc_id, words) in each of the designs."""
    width = F.col("width_in") - F.col("outside_in") * 2 - F.lit(GUTTER_IN)
    height = F.col("height_in") - F.col("top_in") * 2
    lined = designs_.select("design_id", width.alias("__w"), height.alias("__h"), "points", "spacing")
    return words.select("doc_id", "words").join(F.broadcast(lined)).select("doc_id", "design_id", estimate_pages(F.col("__w"), F.col("__h"), F.col("points"), F.col("spacing"), F.col("words")).alias("pages"))
