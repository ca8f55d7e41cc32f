"""Scalar functions against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from folioframe.functions import geometry as G
from folioframe.functions import numbers as N
from folioframe.functions import patterns as P
from folioframe.functions import text as T


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").select("i", f(F.col("t")).alias("v"))
    return [r["v"] for r in rows.orderBy("i").collect()]


@pytest.mark.parametrize("f,cases", [
    (P.is_scene_break, {"***": True, "* * *": True, "#": True, "---": True, "--": False, "": False, "a*": False, " ❦ ": True, "*" * 10: False}),
    (P.label_kind, {"Chapter 4": "chapter", "Part One": "part", "CAPÍTULO 3": "chapter", "Chapters": None, "Prologue": "frontMatter", "Epilog": "backMatter", "Copyright 2020": None, "Notes": "backMatter", "": None}),
    (P.number_confidence, {"7": 0.85, "VII": 0.7, "I": 0.35, "Twenty-One": 0.7, "mix": 0.7, "Nineteen Eighty-Four": None, "1234": None, "": None, "7.": 0.85}),
    (P.looks_like_copyright, {"Copyright © 2020 A": True, "© 2021": True, "all rights reserved.": True, "first light": False, "ISBN 978": True}),
    (P.is_heading_case, {"The Meeting of the Two": True, "the meeting": False, "ALL CAPS": True, "": False, "3": False, "A Day in the life of men": False}),
    (P.ends_like_sentence, {"Done.": True, "Done.”": True, "Done": False, "What?)": True, "Well…": True, "a,": False}),
    (P.is_contents_heading, {"Contents:": True, "TABLE OF CONTENTS": True, "Índice": True, "Contents of a box": False}),
    (P.count_words, {"a  b\tc": 3, "": 0, "   ": 0, "one": 1}),
    (P.collapsed, {"  a \t b\n": "a b", " x y": "x y"}),
    (P.is_placeholder, {"Lorem ipsum dolor": True, "[Your Name]": True, "TK": True, "tk": False, "Type here": True}),
    (T.check_isbn, {"978-0-306-40615-7": "ok", "0-306-40615-2": "ok", "080442957X": "ok", "9780306406158": "checksum", "123": "length"}),
    (T.read_isbn, {"ISBN 978-0-306-40615-7": "978-0-306-40615-7", "ISBN: 123": None, "no": None}),
    (T.lead_in_length, {"It was the best of times": 15, "Stop. Now go on": 5, "": 0, "“Stop!” he said again": 7, "one two": 7}),
    (T.smarten, {'"Hi," it\'s -- well': "“Hi,” it’s—well", "a--b--c": "a—b--c", "...": "…", "'Tis": "‘Tis", "a---b": "a—b"}),
    (T.output_name, {"Novel.DOCX": "Novel (formatted).docx", "Novel": "Novel (formatted).docx"}),
    (T.running_head_detail, {"BOOK TITLE": "title", "[Your Name]": "author", "By Author Name": "author", "Subtitle": "subtitle", "My Book": None}),
    (T.normalize_path, {"/a/./b/../c": "a/c", "a/b": "a/b", "../x": "x"}),
    (T.escape_xml, {'a<b>&"': "a&lt;b&gt;&amp;&quot;"}),
    (N.words_value, {"One Hundred and Two": 102, "twenty one": 21, "One Twenty": None, "Seven": 7, "foo": None, "Hundred": 100}),
    (N.roman_value, {"XIV": 14, "CCCXCIX": 399, "I": 1}),
])
def test_column(spark, f, cases):
    assert column(spark, list(cases), f) == list(cases.values())


@pytest.mark.parametrize("title,want", [
    ("Chapter 7", ("Chapter", 7, "digits", "")), ("CHAPTER SEVEN", ("CHAPTER", 7, "words", "")), ("VII", (None, 7, "roman", "")), ("7. The Meeting", (None, 7, "digits", "The Meeting")), ("One Day More", None), ("I Am Legend", None), ("3rd", None), ("Chapters 3", None),
    ("Chapter One Hundred and Two", ("Chapter", 102, "words", "")), ("MIX", None), ("Kapitel 4: Wald", ("Kapitel", 4, "digits", "Wald")), ("", None), ("Chapter", None), ("Nineteen Eighty-Four", None),
])
def test_parse_title(spark, title, want):
    got = N.with_parsed_title(spark.createDataFrame([(title,)], "text string")).first()["parsed"]
    assert (got and (got["label"], got["number"], got["form"], got["rest"])) == want


@pytest.mark.parametrize("title,style,number,want", [
    ("CHAPTER SEVEN", "keep", 21, "CHAPTER TWENTY-ONE"), ("Capítulo 3", "chapterWords", 4, "Capítulo 4"), ("VII: End", "keep", 9, "IX: End"), ("7", "chapterDigits", 8, "Chapter 8"), ("Chapter 2", "words", 3, "Three"), ("Chapter 100", "digits", 5, "5"),
])
def test_format_title(spark, title, style, number, want):
    rows = N.with_parsed_title(spark.createDataFrame([(title,)], "text string"))
    assert rows.select(N.format_chapter_title(F.col("parsed"), style, F.lit(number)).alias("v")).first()["v"] == want


def test_sizes_and_pages(spark):
    pages = spark.createDataFrame([(7920, 12240), (1000, 2000)], "width_twips int, height_twips int")
    assert {r["size_label"] for r in G.describe_sizes(pages).collect()} == {'5.5" x 8.5" (Digest)', '0.69" x 1.39"'}
    assert G.designs(spark).count() == 20
    x = spark.range(1).select(G.estimate_pages(F.lit(4.0), F.lit(7.0), F.lit(11.0), F.lit(1.15), F.lit(80000.0)).alias("a"), G.estimate_pages(F.lit(0.0), F.lit(7.0), F.lit(11.0), F.lit(1.15), F.lit(1.0)).alias("b"), G.line_spacing(F.lit(300), F.lit("exact"), F.lit(10.0)).alias("c")).first()
    assert x["a"] == 249 and x["b"] is None and x["c"] == 1.5
