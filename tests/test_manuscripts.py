"""Whole manuscripts: role sequences, reports, plans and packages."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from folioframe.operators import choices as H
from folioframe.operators import compose as C
from folioframe.operators import preflight as R
from folioframe.operators import structure as S
from folioframe.operators import styles as Y
from folioframe.plans.analyze import analyze_blocks
from folioframe.sources import docx as X

LESS = "It was said that a < b in the harbour town, and nobody there had ever asked why."
PROSE = "The rain had been falling on the harbour since morning and nobody in the little town could say when it would stop again."


def blocks(spark, lines, **columns):
    rows = [(1, i, *(line if isinstance(line, tuple) else (line, False))) for i, line in enumerate(lines)]
    return spark.createDataFrame(rows, "doc_id long, idx int, text string, centered boolean")


def roles(spark, lines):
    return [r["role"] for r in analyze_blocks(blocks(spark, lines)).orderBy("idx").collect()]


def test_unstyled_manuscript(spark):
    lines = [("Chapter 1", True), ("The Harbour", True), PROSE, PROSE, "", ("#", True), PROSE, "Chapter Two", PROSE]
    assert roles(spark, lines) == ["chapterTitle", "chapterSubtitle", "bodyFirst", "body", "empty", "sceneBreak", "bodyFirst", "chapterTitle", "bodyFirst"]


def test_front_matter_and_copyright(spark):
    lines = [("A Long Night", True), "Copyright © 2020 Ann Lee", "Harbour Press", ("Chapter 1", True), PROSE]
    got = roles(spark, lines)
    assert got[:3] == ["copyright"] * 3 and got[3:] == ["chapterTitle", "bodyFirst"]


def test_no_chapters_and_empty_documents(spark):
    assert roles(spark, [PROSE, PROSE]) == ["bodyFirst", "body"]
    assert roles(spark, [""]) == ["empty"]
    assert analyze_blocks(blocks(spark, [])).count() == 0


def number_report(titles):
    """The sequence check in plain Python, one title after another."""
    dups, gaps, low, seen, prev = [], [], [], set(), None
    for n in titles:
        if n in seen and n not in dups:
            dups.append(n)
        seen.add(n)
        if prev is not None and n < prev:
            low.append(n)
        if prev is not None:
            gaps += [m for m in range(prev + 1, n) if m not in seen and m not in gaps]
        prev = n
    return dups, gaps, low


def test_chapter_numbers_against_plain_python(spark):
    rng = random.Random(1)
    books = {d: [rng.randint(1, 9) for _ in range(rng.randint(1, 8))] for d in range(60)}
    rows = [(d, i, f"Chapter {n}") for d, ns in books.items() for i, n in enumerate(ns)]
    got = S.check_numbers(S.numbered_chapters(spark.createDataFrame(rows, "doc_id long, idx int, text string"))).collect()
    assert {r["doc_id"]: (r["duplicates"], r["gaps"], r["out_of_order"]) for r in got} == {d: number_report(ns) for d, ns in books.items()}


def folded(seq):
    """Which titles become subtitles, walking the sequence."""
    seq = list(seq)
    for i, r in enumerate(seq):
        if r == "chapterTitle":
            j = next((j for j in range(i + 1, len(seq)) if seq[j] != "empty"), None)
            if j is not None and seq[j] == "chapterTitle":
                seq[j] = "chapterSubtitle"
    return seq


def test_subtitles_alternate(spark):
    rng = random.Random(2)
    books = {d: [rng.choice(["chapterTitle", "chapterTitle", "body", "empty"]) for _ in range(12)] for d in range(40)}
    rows = [(d, i, r) for d, seq in books.items() for i, r in enumerate(seq)]
    df = spark.createDataFrame(rows, "doc_id long, idx int, auto_role string").select("*", F.lit(0.9).alias("confidence"), F.lit(2).alias("word_count"), F.array().cast("array<string>").alias("reasons"), *[F.lit(False).alias(c) for c in ("page_break_before", "leading_page_break", "structural_marker")])
    got = {}
    for r in S.fold_subtitles(df).orderBy("doc_id", "idx").collect():
        got.setdefault(r["doc_id"], []).append(r["auto_role"])
    assert got == {d: folded(seq) for d, seq in books.items()}


def test_stranded_breaks_and_empty_chapters(spark):
    seq = ["chapterTitle", "sceneBreak", "body", "sceneBreak", "sceneBreak", "body", "chapterTitle", "empty", "chapterTitle", "body", "sceneBreak"]
    df = spark.createDataFrame([(1, i, r, "p", "paragraph") for i, r in enumerate(seq)], "doc_id long, idx int, role string, preview string, kind string")
    got = sorted((r["problem"], r["idx"]) for r in S.empty_chapters_and_stranded_breaks(df).collect())
    assert got == [("empty-chapter", 6), ("stranded-break", 1), ("stranded-break", 4), ("stranded-break", 10)]


def test_preflight_ids(spark):
    a = analyze_blocks(blocks(spark, [("Chapter 1", True), PROSE + ' "x"', ("Chapter 3", True), "Insert your text.  Now", PROSE]))
    got = R.preflight(a, {"has_page_numbers": False, "header_texts": ("BOOK TITLE", "My own words")}, {"isbn": "123", "copyright_page": True, "title": "T"})
    levels = {r["id"]: r["level"] for r in got.collect()}
    assert levels == {
        "chapters": "ready", "chapter-numbers": "check", "placeholder-text": "attention", "headers-updated": "ready", "header-text": "check", "page-numbers": "attention", "gutter-ok": "ready", "too-short": "attention", "isbn": "attention", "straight-quotes": "check", "double-spaces": "check",
    }
    assert R.worst_level(got).first()["level"] == "attention"


def test_output_plan_breaks_and_sections(spark):
    a = analyze_blocks(blocks(spark, [("Chapter 1", True), PROSE, "", ("Chapter 2", True), PROSE]))
    styles = F.create_map(*[F.lit(x) for k in ("body", "chapterTitle") for x in (k, k)])
    plan = C.output_plan(a, styles, {"blanks_before": 1, "blanks_after": 0, "renumber": True, "number_style": "chapterWords", "lead_in": True}).orderBy("out_ord").collect()
    assert [(r["role"], r["break_before"], r["text"][:11]) for r in plan] == [("filler", False, ""), ("chapterTitle", False, "Chapter One"), ("bodyFirst", False, PROSE[:11]), ("filler", True, ""), ("chapterTitle", False, "Chapter Two"), ("bodyFirst", False, PROSE[:11])]
    assert plan[2]["lead_in"] == len("The rain had been")
    odd = C.output_plan(a, styles, {"chapter_start": "oddPage"}).filter("section IS NOT NULL").collect()
    assert [(r["section"]["type"], r["section"]["restarts_numbers"]) for r in odd] == [("oddPage", True)]


def package(document, styles=None):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", f'<w:document xmlns:w="{X.W}"><w:body>{document}</w:body></w:document>')
        if styles:
            z.writestr("word/styles.xml", f'<w:styles xmlns:w="{X.W}">{styles}</w:styles>')
    return out.getvalue()


def test_packages_round_trip(spark):
    doc = package(
        '<w:p><w:pPr><w:pStyle w:val="H"/></w:pPr><w:r><w:t>Prologue</w:t></w:r></w:p><w:p><w:r><w:t>It was said that a &lt; b in the harbour town, and nobody there had ever asked why.</w:t></w:r><w:del><w:r><w:t>gone</w:t></w:r></w:del></w:p><w:sdt><w:sdtContent><w:p><w:r><w:br w:type="page"/></w:r></w:p></w:sdtContent></w:sdt>'
        '<w:tbl><w:tblPr><w:tblW w:w="900" w:type="dxa"/></w:tblPr></w:tbl><w:sectPr><w:pgSz w:w="7920" w:h="12240"/></w:sectPr>',
        '<w:style w:type="paragraph" w:styleId="H"><w:name w:val="heading 1"/><w:basedOn w:val="B"/></w:style><w:style w:type="paragraph" w:styleId="B"><w:name w:val="B"/><w:basedOn w:val="H"/><w:rPr><w:b/></w:rPr></w:style>',
    )
    packages = spark.createDataFrame([(1, doc), (2, b"nothing")], "doc_id long, content binary")
    assert {r["error"] for r in X.parts(packages).collect()} == {None, X.NOT_ZIP}
    facts = Y.styled_paragraphs(X.paragraphs(packages), X.runs(packages), X.styles(packages))
    got = analyze_blocks(facts).orderBy("idx").collect()
    assert [r["role"] for r in got] == ["chapterTitle", "bodyFirst", "pageBreak", "table"]
    assert got[0]["all_bold"] and got[1]["text"] == LESS and got[3]["table_width_twips"] == 900
    plan = C.output_plan(analyze_blocks(facts), F.create_map(F.lit("body"), F.lit("Text")), {"remove_empty": True})
    again = X.paragraphs(X.new_packages(plan)).orderBy("idx").collect()
    assert [r["text"] for r in again] == ["Prologue", LESS]
    assert X.sections(packages).first()["width_twips"] == 7920


def walked(styles):
    """Of each style (doc_id, style_id): bold, size and depth by a walk along its chain; of equal ids the last counts."""
    of, out = {(d, s): (up, bold, size) for d, _, s, up, bold, size in styles if d is not None and s is not None}, {}
    for d, s in of:
        chain, at = [], s
        while (d, at) in of and at not in chain:
            chain.append(at)
            at = of[d, at][0]
        sizes = [of[d, c][2] for c in chain if of[d, c][2] is not None]
        out[d, s] = (any(of[d, c][1] for c in chain), sizes[0] if sizes else None, len(chain) - 1)
    return out


def test_style_chains_of_any_length_and_shape(spark):
    rng = random.Random(5)
    style = lambda d, i, s, up: (d, i, s, up, rng.choice([None, None, None, True, False]), rng.choice([None, None, 20 + i % 50]))
    rows = [style(1, i, f"s{i}", f"s{i - 1}" if i else None) for i in range(300)]  # one chain longer than 100
    rows += [style(2, i, f"s{i}", f"s{(i + 1) % 150}") for i in range(150)]  # one circle
    rows += [style(2, 150 + i, f"t{i}", f"t{i - 1}" if i else "s7") for i in range(90)]  # what leads into it
    rows += [style(3, i, f"s{i}", f"s{rng.randrange(60)}" if i % 7 else None) for i in range(55)]  # trees, circles and ids that aren't there
    rows += [style(4, 0, "a", "a"), style(4, 1, "b", "a"), style(4, 2, "c", "nowhere"), style(4, 3, "d", "c"), style(4, 4, "d", "b"), style(4, 5, None, "a"), style(None, 6, "a", "b")]
    rows += [style(d, i, f"s{i}", f"s{rng.randrange(12)}") for d in range(5, 45) for i in range(12)]
    frame = spark.createDataFrame(rows, "doc_id long, ord int, style_id string, based_on string, bold boolean, half_points int")
    kinds = dict(c.strip().split(" ") for c in X.STYLE_COLUMNS.split(","))
    frame = frame.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items() if c not in frame.columns}).withColumns({"style_name": F.col("style_id"), "type": F.lit("paragraph"), "next": F.lit(None).cast("string"), "is_default": F.lit(False)})
    got = Y.resolve_styles(frame).collect()
    want = walked(rows)
    assert len(got) == len(want)
    assert {(r["doc_id"], r["style_id"]): (r["bold"], r["half_points"], r["depth"]) for r in got} == want
    assert max(w[2] for w in want.values()) == 299 and want[2, "t89"][2] == 239


def test_pixel_sizes():
    assert X.pixel_size(b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")) == (640, 480)
    assert X.pixel_size(b"GIF89a" + (10).to_bytes(2, "little") + (20).to_bytes(2, "little")) == (10, 20)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + (30).to_bytes(2, "big") + (40).to_bytes(2, "big") + b"\0" * 8
    assert X.pixel_size(jpeg) == (40, 30) and X.pixel_size(b"plain text") is None


def test_choices(spark):
    good = '{"format":"other-choices","version":2,"options":{"chapterStart":"oddPage","hyphenate":"no","renumberChapters":true},"overrides":[{"text":"a b","role":"body","index":3},{"text":"x","role":"nope"},{"text":"a  b","role":"empty"}]}'
    rows = H.parse_choices(spark.createDataFrame([(1, good), (2, "junk"), (3, good.replace("other-", "unknown-"))], "doc_id long, json string"), tag="other-choices").orderBy("doc_id").collect()
    assert rows[0]["chapterStart"] == "oddPage" and rows[0]["hyphenate"] is True and rows[0]["renumberChapters"] is True
    assert [(o["text"], o["role"], o["index"]) for o in rows[0]["overrides"]] == [("a b", "body", 3), ("a  b", "empty", -1)]
    assert all(r["is_choices"] is False and r["overrides"] is None for r in rows[1:])
    drafts = spark.createDataFrame([(1, 0, "a b", "body"), (1, 4, " a  b ", "body"), (1, 2, "c", "body")], "doc_id long, idx int, text string, auto_role string")
    saved = spark.createDataFrame([(1, 0, "a b", "empty", 3), (1, 1, "a b", "body", 3), (1, 2, "a b", "body", 3)], "doc_id long, ord int, text string, role string, index int")
    got = {r["ord"]: (r["idx"], r["changes"]) for r in H.rebind(saved, drafts).collect()}
    assert got == {0: (4, True), 1: (0, False), 2: (None, False)}


def test_rebinding_against_plain_python(spark):
    rng = random.Random(4)
    drafts = [(d, i, rng.choice(["a", "b", "c d", ""]), rng.choice(["body", "empty"])) for d in range(15) for i in range(14)]
    saved = [(d, k, rng.choice(["a", " c  d", "b", "new", ""]), rng.choice(["body", "empty"]), rng.randint(-1, 15)) for d in range(15) for k in range(8)]
    want, taken = {}, set()
    for d, k, text, role, at in saved:
        free = [(abs(i - at), i, r) for e, i, t, r in drafts if e == d and " ".join(text.split()) == " ".join(t.split()) != "" and (d, i) not in taken]
        best = min(free, default=None)
        want[d, k] = (best and best[1], bool(best and best[2] != role))
        taken.add((d, best[1])) if best else None
    got = H.rebind(spark.createDataFrame(saved, "doc_id long, ord int, text string, role string, index int"), spark.createDataFrame(drafts, "doc_id long, idx int, text string, auto_role string")).collect()
    assert {(r["doc_id"], r["ord"]): (r["idx"], r["changes"]) for r in got} == want


def sunk(spark, counts, style="C"):
    seq = [r for n in counts for r in ([("", "C")] * n + [("Title", "C"), ("text", "B"), ("", "B")])]
    facts = spark.createDataFrame([(1, i, not t, s) for i, (t, s) in enumerate(seq)] + [(2, 0, False, "B")], "doc_id long, idx int, is_empty boolean, style_id string")
    chapters = spark.createDataFrame([(1, style, False), (2, None, None)], "doc_id long, chapter_style string, style_breaks boolean")
    return {r["doc_id"]: (r["before"], r["after"]) for r in Y.chapter_sink(facts, chapters).collect()}


@pytest.mark.parametrize("counts,want", [([3, 3, 1], 3), ([1, 2, 2, 1], 2)])
def test_chapter_sink_prefers_the_larger(spark, counts, want):
    assert sunk(spark, counts) == {1: (want, 0), 2: (0, 0)}


def test_chapter_sink_counts_blanks_of_its_style_up_to_the_end(spark):
    facts = spark.createDataFrame([(1, 0, True, "B"), (1, 1, True, "C"), (1, 2, False, "C"), (1, 3, True, "C"), (1, 4, True, "C")], "doc_id long, idx int, is_empty boolean, style_id string")
    chapters = spark.createDataFrame([(1, "C", False)], "doc_id long, chapter_style string, style_breaks boolean")
    assert tuple(Y.chapter_sink(facts, chapters).first()) == (1, 1, 2)


def test_chapters_start_pages_by_style_by_breaks_or_without_evidence(spark):
    rows = [(1, 0, False, "C", False, False, False, None), (1, 1, False, "B", False, False, True, None), (1, 2, True, "B", False, False, False, None), (1, 3, False, "C", False, False, False, None), (1, 4, False, "C", False, False, False, None), (1, 5, False, "C", False, False, False, None)]
    rows += [(2, *r[1:]) for r in rows] + [(3, 0, False, "B", False, False, False, None)]
    facts = spark.createDataFrame(rows, "doc_id long, idx int, is_empty boolean, style_id string, page_break_before boolean, leading_page_break boolean, trailing_page_break boolean, section_break_type string")
    chapters = spark.createDataFrame([(1, "C", False), (2, "C", True), (3, "C", None), (4, None, None)], "doc_id long, chapter_style string, style_breaks boolean")
    assert {r["doc_id"]: r["new_page"] for r in Y.starts_on_new_page(facts, chapters).collect()} == {1: False, 2: True, 3: True, 4: True}
