"""Every manuscript query with SQL gives DuckDB's rows on the smallest tables."""

import os
import re

import pytest

from folioframe.catalog import ORACLES, QUERIES
from folioframe.operators.details import detect_details
from tests.helpers import normal, oracle

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    got, want = QUERIES[name](spark, SF).toPandas(), oracle(ORACLES[name], SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


def test_greedy_rebinding_takes_each_paragraph_once(spark):
    rows = QUERIES["greedy_choices"](spark, SF).toPandas()
    bound = rows.dropna(subset=["idx"])
    assert len(bound) and not bound.duplicated(["doc_id", "idx"]).any()


def typeset(text):
    """Dashes, ellipses and quotes as the rules have them, character by character."""
    out = text
    for a, b in ((r"(\S)---(\S)", "\\1—\\2"), (r"(\S)--(\S)", "\\1—\\2"), (" -- ", "—"), (r"\.\.\.", "…")):
        out = re.sub(a, b, out)
    made = []
    for prev, c in zip(["", *out], out, strict=False):
        opens = prev == "" or prev.isspace() or prev in "([{<—–“‘-"
        made.append({'"': "“" if opens else "”", "'": "‘" if opens else "’"}.get(c, c))
    return "".join(made)


def test_typographic_paragraphs_keeps_those_with_quotes(spark, tmp_path):
    lines = ['"Hi," she said -- "it\'s me."', "'Tis the dogs' day...", 'He said ("no") -- \'"Never," he said\'', 'plain--words', 'x\u00a0"y" [\'z\']', '"', "''", 'é\'s 7\'s "', '😀"a" \u3000\'b\'']
    spark.createDataFrame([(i, "\n".join(lines[i:] + lines[:i])) for i in range(9)] + [(9, None)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "raw"))
    next((tmp_path / "raw").glob("part-*")).rename(tmp_path / "documents.parquet")
    got, want = QUERIES["typographic_paragraphs"](spark, str(tmp_path)).toPandas(), oracle(ORACLES["typographic_paragraphs"], str(tmp_path))
    assert normal(got) == normal(want)
    source = [r["text"] for r in QUERIES["manuscript_paragraphs"](spark, str(tmp_path)).collect() if r["text"].strip()]
    assert sum("'" in t or '"' in t for t in source) >= 70
    assert sorted(got["text"]) == sorted(map(typeset, source))


def test_details_read_the_copyright_notice(spark, tmp_path):
    notices = ["Copyright © 2019 by Ann Lee.", "Copyright (c) 2020, Bo Day", "All rights reserved.\nISBN 978-0-306-40615-7\n© 2021 Cy Fox", "ISBN: 12345678\n2018 by the sea\nISBN-10: 080442957X", "No word of it"]
    docs = [(i, "\n".join([*x.split("\n"), "The Long Night", "Dee Ray", "A tale of the north", *["It went on like this for a long while, and nobody said a word about it."] * 12])) for i, x in enumerate(notices)]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "raw"))
    next((tmp_path / "raw").glob("part-*")).rename(tmp_path / "documents.parquet")
    got, want = QUERIES["front_matter_details"](spark, str(tmp_path)).toPandas(), oracle(ORACLES["front_matter_details"], str(tmp_path))
    assert normal(got) == normal(want)
    found = {r["doc_id"]: (r["author"], r["copyright_year"], r["isbn"]) for r in QUERIES["front_matter_details"](spark, str(tmp_path)).collect()}
    assert found[0] == ("Ann Lee", "2019", None) and found[1] == ("Bo Day", "2020", None) and found[2] == ("Cy Fox", "2021", "978-0-306-40615-7") and found[3][1:] == ("2018", "080442957X")
    named = {r["doc_id"]: r["author"] for r in QUERIES["book_details"](spark, str(tmp_path)).collect()}
    assert named == {k: v[0] for k, v in found.items()} and named[0] == "Ann Lee"


def test_details_of_a_title_page_and_a_copyright_page(spark):
    rows = [(1, 0, "frontMatterTitle", "The Long Night"), (1, 1, "frontMatter", "A tale of the north"), (1, 2, "copyright", "© 2020 Ann Lee"), (1, 3, "copyright", "ISBN 0-306-40615-2"), (2, 0, "frontMatterTitle", "Day"), (2, 1, "frontMatter", "by Bo Day"), (2, 2, "copyright", "Copyright 2018 Cy Fox")]
    blocks = spark.createDataFrame([(*r, len(r[3].split()), False) for r in rows], "doc_id long, idx int, role string, text string, word_count int, is_empty boolean")
    out = {r["doc_id"]: tuple(r)[1:] for r in detect_details(blocks).select("doc_id", "title", "author", "copyright_year", "isbn", "subtitle").collect()}
    assert out == {1: ("The Long Night", "Ann Lee", "2020", "0-306-40615-2", "A tale of the north"), 2: ("Day", "Bo Day", "2018", None, None)}


def test_style_inheritance_of_more_than_a_million_pairs(spark, tmp_path):
    spark.range(80_000).withColumnRenamed("id", "c_custkey").coalesce(1).write.parquet(str(tmp_path / "raw"))
    next((tmp_path / "raw").glob("part-*")).rename(tmp_path / "customer.parquet")
    got, want = QUERIES["style_inheritance"](spark, str(tmp_path)).toPandas(), oracle(ORACLES["style_inheritance"], str(tmp_path))
    assert (want["depth"] + 1).sum() > 1_000_000
    assert normal(got) == normal(want)
