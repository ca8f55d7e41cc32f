"""Profiles of designs from packages, proofs and warnings."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from folioframe.operators import compose as C
from folioframe.operators import profile as Pr
from folioframe.operators import proofs as V
from folioframe.plans.design import design_profile
from folioframe.sources import docx as X

W = f'xmlns:w="{X.W}" xmlns:r="{X.R}"'
LONG = "The harbour lay still that morning and the boats kept to their moorings while an old man counted the gulls upon the wall, one after another, until noon."


def package(body, styles="", header="", settings="", main=None):
    out = io.BytesIO()
    rel = lambda i, kind, target: f'<Relationship Id="{i}" Type="{X.R}/{kind}" Target="{target}"/>'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", f'<Types xmlns="{X.TYPES}"/>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{X.RELS}">{rel("rId1", "officeDocument", "word/document.xml")}</Relationships>')
        z.writestr("word/_rels/document.xml.rels", f'<Relationships xmlns="{X.RELS}">{rel("rId1", "styles", "styles.xml")}{rel("rId2", "header", "header1.xml")}{rel("rId3", "footer", "footer1.xml")}{rel("rId4", "settings", "settings.xml")}</Relationships>')
        z.writestr("word/document.xml", main if main is not None else f"<w:document {W}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f"<w:styles {W}>{styles}</w:styles>")
        z.writestr("word/header1.xml", f"<w:hdr {W}><w:p><w:r><w:t>{header}</w:t></w:r></w:p></w:hdr>")
        z.writestr("word/footer1.xml", f'<w:ftr {W}><w:p><w:fldSimple w:instr=" PAGE "><w:r><w:t>12</w:t></w:r></w:fldSimple></w:p></w:ftr>')
        z.writestr("word/settings.xml", f"<w:settings {W}>{settings}</w:settings>")
    return bytearray(out.getvalue())


def para(text, style=None, extra=""):
    style = f'<w:pStyle w:val="{style}"/>' if style else ""
    return f"<w:p><w:pPr>{style}{extra}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"


STYLES = (
    '<w:style w:type="paragraph" w:styleId="N" w:default="1"><w:name w:val="Normal"/></w:style>'
    '<w:style w:type="paragraph" w:styleId="T"><w:name w:val="Main Text"/><w:pPr><w:ind w:firstLine="360"/><w:jc w:val="both"/></w:pPr></w:style>'
    '<w:style w:type="paragraph" w:styleId="H"><w:name w:val="Chapter Title"/><w:pPr><w:outlineLvl w:val="0"/></w:pPr></w:style>'
)
SECTION = '<w:sectPr><w:headerReference w:type="default" r:id="rId2"/><w:footerReference w:type="even" r:id="rId3"/><w:type w:val="oddPage"/><w:pgSz w:w="8640" w:h="12960"/></w:sectPr>'


@pytest.fixture(scope="module")
def packages(spark):
    chapter = "<w:p><w:pPr><w:pStyle w:val='H'/></w:pPr></w:p>" * 2 + para("Chapter 1", "H") + para(LONG, "T") + para(LONG, "T")
    rows = [
        (1, package(chapter + chapter.replace("1", "2") + SECTION, STYLES, "THE  LONG NIGHT", "<w:autoHyphenation/>")),
        (2, package(para("just a line"), "", "Page 4")),
        (3, package("", main="<w:document broken")),
        (4, package("", main=f"<w:document {W}/>")),
        (5, bytearray(b"no package")),
    ]
    return spark.createDataFrame(rows, "doc_id long, content binary")


def test_profiles_of_packages(packages):
    got = {r["doc_id"]: r for r in design_profile(packages).collect()}
    assert set(got) == {1, 2}
    a, b = got[1], got[2]
    assert (a["body_style"], a["chapter_style"], a["before"], a["after"], a["new_page"]) == ("T", "H", 2, 0, False)
    assert (a["has_headers"], a["has_footers"], a["has_page_numbers"], a["header_texts"], a["odd_page"], a["section_count"]) == (True, True, True, ["THE LONG NIGHT"], True, 1)
    assert (a["hyphenates"], a["justified"], a["first_no_indent"], a["has_notes"], a["width_twips"]) == (True, True, True, False, 8640)
    assert a["warnings"] == ["running heads hold words that the book will show"]
    assert (b["has_headers"], b["section_count"], b["new_page"], b["before"]) == (False, 0, True, 0)
    assert b["warnings"][0] == "no page size, so US Letter" and b["warnings"][-1] == "little sample text, so roles go by names"


def test_references_to_headers(packages):
    rows = [(r["section"], r["kind"], r["side"], r["part"], r["has_page_number"]) for r in X.heads(packages.filter("doc_id = 1")).orderBy("ord").collect()]
    assert rows == [(0, "header", "default", "word/header1.xml", False), (0, "footer", "even", "word/footer1.xml", True)]


def test_packages_that_cannot_be_read_are_rows_with_errors(packages):
    errors = {r["doc_id"]: r["error"] for r in X.parts(packages).filter("error IS NOT NULL").collect()}
    assert errors == {3: X.NO_BODY, 4: X.NO_BODY, 5: X.NOT_ZIP}
    assert X.paragraphs(packages.filter("doc_id >= 3")).count() == X.sections(packages.filter("doc_id >= 3")).count() == 0


def blocks(spark, rows):
    return spark.createDataFrame([(1, i, "paragraph", role, role == "empty" or image, image, 0.9) for i, (role, image) in enumerate(rows)], "doc_id long, idx int, kind string, role string, is_empty boolean, has_image boolean, confidence double")


def test_pictures_without_text_are_drawn(spark):
    df = blocks(spark, [("frontMatter", True), ("empty", False), ("chapterTitle", False), ("empty", True), ("bodyFirst", False), ("listItem", False), ("body", False), ("body", False), ("body", False), ("body", False)])
    pages = {}
    for r in V.sample_pages(df).orderBy("section", "ord").collect():
        pages.setdefault(r["section"], []).append((r["ord"], r["idx"]))
    assert pages["titlePage"] == [(0, 0)] and pages["chapter"] == [(0, 2), (1, 4), (2, 5), (3, 6), (4, 7), (5, 8)]
    assert pages["listItem"] == [(-2, 2), (-1, 4), (0, 5), (1, 6), (2, 7), (3, 8)] and "sceneBreak" not in pages
    assert [r["idx"] for r in V.first_lines(df, ("body",), 2).collect()] == [6, 7]
    assert {(r["idx"], r["near_idx"]) for r in V.lines_around(df, F.col("role") == "chapterTitle", 2, 1).collect()} == {(2, 0), (2, 4)}
    assert sorted(r["idx"] for r in V.review_rows(df, 2).collect()) == [0, 2]


def test_closings_and_contents(spark):
    df = blocks(spark, [("frontMatterTitle", False), ("frontMatter", False), ("copyright", False), ("copyright", False), ("empty", False), ("frontMatter", False), ("chapterTitle", False), ("copyright", False)])
    assert [(r["idx"], r["v_align"]) for r in C.front_closings(df).orderBy("idx").collect()] == [(3, "bottom")]
    assert [(r["idx"], r["v_align"]) for r in C.front_closings(df, {"copyright": "top", "frontMatterTitle": "center"}).orderBy("idx").collect()] == [(0, "center"), (3, "top")]
    assert C.contents_place(df).first()["after_idx"] == 5
    assert C.contents_place(blocks(spark, [("chapterTitle", False)])).first()["after_idx"] == -1
    assert C.contents_place(blocks(spark, [("frontMatter", False), ("copyright", False)])).first()["after_idx"] == 1


def test_warnings_come_once(spark):
    row = spark.range(1)
    out = row.select(Pr.all_warnings(Pr.warnings((F.lit(True), "a"), (F.lit(None).cast("boolean"), "b")), F.lit(None).cast("array<string>"), Pr.warnings((F.lit(True), "c"), (F.lit(True), "a"))).alias("w"))
    assert out.first()["w"] == ["a", "c"]


def test_runs_keep_their_emphasis(spark):
    from folioframe.operators import packages as K

    plan = spark.createDataFrame(
        [(1, 0, 0, "Chapter 1", None), (1, 1, 1, "It was “late”, and she knew.", 6), (1, 2, None, "§", None), (1, 3, 3, "", None)],
        "doc_id long, out_ord int, source_idx int, text string, lead_in int",
    )
    runs = spark.createDataFrame(
        [(1, 0, 0, "Chapter I", True, None, None), (1, 1, 0, " \t", None, None, None), (1, 1, 1, "\tIt", None, True, None), (1, 1, 2, ' was "', None, None, None), (1, 1, 3, "late", None, None, True), (1, 1, 4, '", and she knew.', None, None, None)],
        "doc_id long, idx int, run int, text string, bold boolean, italic boolean, underline boolean",
    )
    out = K.written_runs(plan, runs, {"smart": True}).orderBy("out_ord", "run", "part").collect()
    assert [(r["out_ord"], r["text"], r["bold"], r["italic"], r["small_caps"]) for r in out] == [
        (0, "Chapter 1", False, False, False),
        (1, "It", False, True, True),
        (1, " was", False, False, True),
        (1, " “", False, False, False),
        (1, "late", False, True, False),
        (1, "”, and she knew.", False, False, False),
        (2, "§", False, False, False),
    ]
    xml = {r["out_ord"]: r["xml"] for r in K.runs_xml(K.written_runs(plan, runs, {"smart": True, "underline_to_italic": False})).collect()}
    assert xml[1].startswith('<w:r><w:rPr><w:i/><w:smallCaps/></w:rPr><w:t xml:space="preserve">It</w:t></w:r>') and '<w:u w:val="single"/></w:rPr><w:t xml:space="preserve">late' in xml[1]
    plain = K.written_runs(plan, runs, {"smart": True, "keep_emphasis": False})
    assert not plain.filter("bold OR italic OR underline").count()
