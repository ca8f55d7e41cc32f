"""Profiles of designs, package tables, templates and streams."""

from pyspark.sql import functions as F

from folioframe.operators import packages as K
from folioframe.operators import profile as Pr
from folioframe.operators.facts import paragraph_facts
from folioframe.plans.analyze import analyze_blocks
from folioframe.sources import templates
from folioframe.streaming.drafts import watch_drafts

PROSE = "The rain had been falling on the harbour since morning and nobody in the little town could say when it would stop again, or why it had begun."


def design(spark, styles, paragraphs):
    rows = [(1, i, s, n, "paragraph", nxt, i == 0, lvl, left) for i, (s, n, nxt, lvl, left) in enumerate(styles)]
    styles = spark.createDataFrame(rows, "doc_id long, ord int, style_id string, style_name string, type string, next string, is_default boolean, outline_level int, left_indent_twips int")
    facts = paragraph_facts(spark.createDataFrame([(1, i, t, s) for i, (s, t) in enumerate(paragraphs)], "doc_id long, idx int, text string, style_id string"))
    return {r["role"]: r["style_id"] for r in Pr.detect_roles(styles, Pr.style_votes(facts, styles)).collect()}


def test_roles_by_name_and_by_vote(spark):
    styles = [("N", "Normal", None, None, None), ("T", "Main Text", None, None, None), ("F", "Opener Text", None, None, None), ("H", "My Heading", "F", 0, None), ("S", "Ornaments", None, None, None), ("Q", "Inset", None, None, 720), ("C", "Copyright Line", None, None, None), ("U", "Heading 2", None, 1, None)]
    book = [("H", "Chapter 1"), ("F", PROSE), ("T", PROSE), ("T", PROSE), ("T", PROSE), ("S", "* * *"), ("Q", "A short inset"), ("H", "Chapter 2"), ("F", PROSE), ("T", PROSE), ("T", PROSE)]
    got = design(spark, styles, book)
    assert got == {"body": "T", "chapterTitle": "H", "sceneBreak": "S", "blockQuote": "Q", "copyright": "C", "subheading": "U", "bodyFirst": "F", "frontMatter": "F"}


def test_near_tie_follows_the_next_style(spark):
    styles = [("N", "Normal", None, None, None), ("A", "Text A", "B", None, None), ("B", "Text B", "B", None, None)]
    assert design(spark, styles, [("A", PROSE), ("A", PROSE), ("B", PROSE)])["body"] == "B"
    assert design(spark, styles, [("A", PROSE), ("A", PROSE), ("A", PROSE), ("B", PROSE)])["body"] == "A"
    assert design(spark, styles, [("A", "short")])["body"] == "N"


def test_alignment_options_and_heads(spark):
    facts = spark.createDataFrame([(1, 0, "t", "nextPage", False), (1, 1, "c", None, False), (1, 2, "c", "nextPage", False)], "doc_id long, idx int, style_id string, section_break_type string, is_empty boolean")
    sections = spark.createDataFrame([(1, 0, "center"), (1, 1, "bottom")], "doc_id long, ord int, v_align string")
    roles = spark.createDataFrame([(1, "frontMatterTitle", "t"), (1, "copyright", "c")], "doc_id long, role string, style_id string")
    assert {r["role"]: r["v_align"] for r in Pr.role_alignment(facts, sections, roles).collect()} == {"frontMatterTitle": "center", "copyright": "bottom"}
    profile = spark.createDataFrame([(1, False, True, True, True, False, True, False, 2)], "doc_id long, odd_page boolean, new_page boolean, first_no_indent boolean, has_headers boolean, hyphenates boolean, justified boolean, has_contents boolean, chapters int")
    assert tuple(Pr.suggest_options(profile).first())[1:] == ("newPage", True, True, True, True)
    heads = spark.createDataFrame([(1, "h1", "BOOK TITLE", 0), (1, "h2", "Author Name", 1), (1, "h3", "Mine", 2), (1, "h4", "12", 3), (1, "h5", "Mine", 4), (1, "h6", " Page  3", 5), (1, "h7", "Mine", 6)], "doc_id long, part string, text string, ord int")
    details = spark.createDataFrame([(1, "Night", "Ann Lee", "")], "doc_id long, title string, author string, subtitle string")
    assert {r["part"]: r["new_text"] for r in Pr.running_heads(heads, details).collect()} == {"h1": "NIGHT", "h2": "Ann Lee", "h3": "Mine", "h4": "12", "h5": "Mine", "h6": " Page  3", "h7": "Mine"}
    assert Pr.header_words(heads).first()["header_texts"] == ["BOOK TITLE", "Author Name", "Mine"]


def test_package_tables(spark):
    edges = spark.createDataFrame([(1, "rId3", "img", "a.png", None, 0), (1, "x", "img", "b.png", None, 1)], "doc_id long, rel_id string, type string, target string, target_mode string, ord int")
    new = spark.createDataFrame([(1, "img", "a.png", None, 0), (1, "img", "c.png", None, 1), (1, "img", "c.png", None, 2), (1, "link", "u", "External", 3), (1, "link", "u", "External", 4)], "doc_id long, type string, target string, target_mode string, ord int")
    assert [r["rel_id"] for r in K.add_relationships(edges, new).orderBy("ord").collect()] == ["rId3", "rId4", "rId4", "rId5", "rId6"]
    types = spark.createDataFrame([(1, "Default", "xml", "t")], "doc_id long, kind string, key string, content_type string")
    assert K.ensure_content_types(types, types.unionByName(types.withColumn("key", F.lit("png")))).count() == 2
    used, taken = spark.createDataFrame([(1, 5, 0), (1, 2, 1), (1, 5, 2), (1, 0, 3)], "doc_id long, old_id int, ord int"), spark.createDataFrame([(1, 7)], "doc_id long, id int")
    assert {r["old_id"]: r["new_id"] for r in K.merged_numbers(used, taken).collect()} == {5: 8, 2: 9}
    runs = spark.createDataFrame([(1, 0, 0, "It was"), (1, 0, 1, " the best"), (1, 1, 0, "No cut")], "doc_id long, idx int, run int, text string")
    cut = K.split_runs(runs, spark.createDataFrame([(1, 0, 10)], "doc_id long, idx int, at int")).orderBy("idx", "run", "part").collect()
    assert [(r["text"], r["is_lead"]) for r in cut] == [("It was", True), (" the", True), (" best", False), ("No cut", False)]
    marks = spark.createDataFrame([(True, None, True)], "bold boolean, italic boolean, underline boolean")
    assert tuple(K.kept_emphasis(marks).first()) == (True, True, False)
    files = spark.createDataFrame([("a.docx", 1, 1, "t", 0), ("a.docx", 2, 1, "t", 1), ("a.docx", 1, 1, "t", 2)], "name string, size int, mtime int, type string, ord int")
    assert [r["label"] for r in K.remembered_names(files).orderBy("ord").collect()] == ["a.docx", "a.docx (2)"]
    images = spark.createDataFrame([(1, 0, 600, 300, 1828800, 914400), (1, 0, 100, 100, 914400, 914400), (1, 1, 0, 1, 1, 1)], "doc_id long, idx int, width_px int, height_px int, cx int, cy int")
    assert [tuple(r) for r in K.worst_resolution(images).collect()] == [(1, 0, 100)]


def test_templates_and_sample(spark):
    assert templates.template_styles(spark).count() == 260
    page = templates.template_pages(spark).filter("design_id = '6x9-classic'").first()
    assert (page["width_twips"], page["height_twips"], page["gutter"]) == (8640, 12960, 720)
    roles = [r["role"] for r in analyze_blocks(templates.sample_manuscript(spark)).orderBy("idx").collect()]
    assert roles[:6] == ["copyright"] * 6 and roles[6:] == ["chapterTitle", "bodyFirst", "body", "sceneBreak", "bodyFirst", "body"] * 2


def test_stream_of_drafts(spark, tmp_path):
    docs = spark.createDataFrame([(1, "\n".join([PROSE] * 12)), (2, "short")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    seen = []
    query = watch_drafts(spark, str(tmp_path / "in"), "doc_id long, text string", str(tmp_path / "state"), lambda rows, n: seen.append(rows.groupBy("doc_id").count().collect()), once=True)
    query.awaitTermination(120)
    assert {r["doc_id"]: r["count"] for batch in seen for r in batch} == {1: 18, 2: 1}
