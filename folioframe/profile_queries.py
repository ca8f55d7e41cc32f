"""Registered queries of design profiles, warnings, proofs and placement, and their SQL."""

from __future__ import annotations

import itertools
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe import oracle as O
from folioframe.design_queries import _STYLED, _styled, _table
from folioframe.operators import choices as H
from folioframe.operators import compose as C
from folioframe.operators import preflight as R
from folioframe.operators import profile as Pr
from folioframe.operators import proofs as V
from folioframe.operators import styles as Y
from folioframe.plans.analyze import summarize
from folioframe.queries import _CHECKS, _PREFLIGHT, _REPORT, _analysed, query

_places = itertools.count()
_PLACED = re.sub(r"\{'id'", lambda m: f"{{'place': {next(_places)}, 'id'", _CHECKS).replace("doc_id, id, level, rank FROM", "doc_id, place, id, level, rank FROM")


@query(_REPORT + f" SELECT doc_id, id, level, row_number() OVER (PARTITION BY doc_id ORDER BY rank, place) AS position FROM ({_PLACED})")
def ordered_checks(spark, sf_dir):
    return V.ordered_checks(R.preflight(_analysed(spark, sf_dir), None, _PREFLIGHT)).select("doc_id", "id", "level", "position")


@query(
    O.ROLES
    + """ SELECT doc_id, idx, role FROM (SELECT doc_id, idx, role, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS n FROM roles
    WHERE role NOT IN ('empty', 'body', 'bodyFirst', 'pageBreak') OR (role <> 'pageBreak' AND confidence < 6e-1)) WHERE n <= 5"""
)
def review_list_start(spark, sf_dir):
    """The review list with a limit of 5 rows a document in the place of 2,500, which these documents don't reach."""
    return V.review_rows(_analysed(spark, sf_dir), 5).select("doc_id", "idx", "role")


@query(
    O.ROLES
    + """, shown AS (SELECT doc_id, idx, role, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS n FROM roles WHERE NOT is_empty
    ), lists AS (SELECT l.*, section, row_number() OVER (PARTITION BY doc_id, section ORDER BY idx) - 1 AS ord, most FROM shown l
        JOIN (VALUES ('titlePage', 'frontMatterTitle', 8), ('titlePage', 'frontMatter', 8), ('copyright', 'copyright', 10), ('partTitle', 'partTitle', 2), ('body', 'body', 9)) v(section, wanted, most) ON wanted = role
    ), scenes AS (SELECT doc_id, section, before, after, min(n) AS hit FROM shown
        JOIN (VALUES ('chapter', 'chapterTitle', 0, 5), ('chapter', 'partTitle', 0, 5), ('subheading', 'subheading', 2, 2), ('sceneBreak', 'sceneBreak', 2, 2), ('blockQuote', 'blockQuote', 2, 2), ('listItem', 'listItem', 2, 3)) v(section, wanted, before, after) ON wanted = role GROUP BY ALL)
    SELECT doc_id, section, ord, idx, role FROM lists WHERE ord < most UNION ALL SELECT l.doc_id, section, n - hit, idx, role FROM shown l JOIN scenes s ON s.doc_id = l.doc_id AND n BETWEEN hit - before AND hit + after"""
)
def sample_pages(spark, sf_dir):
    return V.sample_pages(_analysed(spark, sf_dir))


@query(
    _STYLED
    + """, names AS (SELECT * FROM (SELECT DISTINCT doc_id FROM facts), (VALUES ('S0', 'Base'), ('S1', 'Chapter Head'), ('S2', 'Scene Break'), ('N', 'Plain')) v(style_id, style_name))
    SELECT doc_id, style_id, coalesce(uses, 0) AS uses, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(uses, 0) DESC, style_name) AS place FROM names LEFT JOIN uses USING (doc_id, style_id)"""
)
def style_places(spark, sf_dir):
    facts, styles = _styled(spark, sf_dir)
    return Y.styles_by_usage(styles, Y.style_usage(facts, styles)).select("doc_id", "style_id", "uses", "place")


def _heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    texts = F.array(F.lit("Page 3"), F.lit(" 12 "), F.lit("  THE   LONG\tNIGHT "), F.col("o_orderpriority"), F.lit(""), F.lit("Page One"), F.lit("page7"))
    rows = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), key.alias("ord"), F.get(texts, (key % 7).cast("int")).alias("text"), F.when(key % 3 == 0, "footer").otherwise("header").alias("kind"))
    return rows.withColumn("has_page_number", F.col("ord") % 7 < 2)


_HEADS = """WITH heads AS (SELECT o_custkey AS doc_id, o_orderkey AS ord, trim(regexp_replace(['Page 3', ' 12 ', '  THE   LONG' || chr(9) || 'NIGHT ', o_orderpriority, '', 'Page One', 'page7'][o_orderkey % 7 + 1], '\\s+', ' ', 'g')) AS text, o_orderkey % 3 = 0 AS foot, o_orderkey % 7 < 2 AS numbered FROM orders
    ), words AS (SELECT doc_id, text, min(ord) AS ord FROM heads WHERE text <> '' AND NOT regexp_matches(text, '(?i)^(page\\s*)?[0-9]+$') GROUP BY ALL
    ), listed AS (SELECT doc_id, string_agg(text, '|' ORDER BY ord) AS header_texts FROM words GROUP BY doc_id)"""


@query(_HEADS + " SELECT doc_id, bool_or(NOT foot) AS has_headers, bool_or(foot) AS has_footers, bool_or(numbered) AS has_page_numbers, coalesce(any_value(header_texts), '') AS header_texts FROM heads LEFT JOIN listed USING (doc_id) GROUP BY doc_id")
def header_profiles(spark, sf_dir):
    return Pr.header_profile(_heads(spark, sf_dir)).withColumn("header_texts", F.array_join("header_texts", "|"))


@query(
    """SELECT o_custkey AS doc_id, count(*) AS section_count, bool_or(o_orderstatus = 'F') AS odd_page, arg_max(o_orderkey * 2, o_orderkey) AS width_twips, arg_max(o_orderkey * 3, o_orderkey) AS height_twips,
    arg_max(o_orderkey % 7, o_orderkey) AS gutter, arg_max(o_orderkey % 11, o_orderkey) AS margin_left FROM orders GROUP BY o_custkey"""
)
def section_profiles(spark, sf_dir):
    key = F.col("o_orderkey")
    page = [(key * 2).alias("width_twips"), (key * 3).alias("height_twips"), (key % 7).alias("gutter"), (key % 11).alias("margin_left")]
    kind = F.when(F.col("o_orderstatus") == "F", "oddPage").otherwise("nextPage")
    return Pr.section_profile(_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), key.alias("ord"), kind.alias("type"), *page))


@query(
    """SELECT c_custkey AS id, coalesce(CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 5 * 90 END, 0) > 0 AND (c_custkey % 4 = 0 OR coalesce(CASE WHEN c_custkey % 7 > 0 THEN c_custkey % 6 * 60 - 120 END, 0) <= 0) AS first_no_indent FROM customer"""
)
def openings_without_indent(spark, sf_dir):
    k = F.col("c_custkey")
    rows = _table(spark, sf_dir, "customer")
    body, first = F.when(k % 3 > 0, k % 5 * 90), F.when(k % 7 > 0, k % 6 * 60 - 120)
    return rows.select(k.alias("id"), Pr.first_no_indent(body, F.when(k % 4 > 0, "First"), first).alias("first_no_indent"))


@query(
    O.ROLES
    + """, sums AS (SELECT doc_id, count(*) FILTER (confidence < 6e-1 AND role NOT IN ('body', 'empty')) AS uncertain, count(*) FILTER (role = 'chapterTitle') AS chapters, count(*) FILTER (NOT is_empty) AS paragraphs FROM roles GROUP BY doc_id)
    SELECT doc_id, concat_ws('|', CASE WHEN uncertain > 0 THEN uncertain || ' paragraphs of doubtful role' END, CASE WHEN chapters = 0 AND paragraphs > 40 THEN 'a long text without chapter titles' END) AS warnings FROM sums"""
)
def warnings_of_manuscripts(spark, sf_dir):
    return summarize(_analysed(spark, sf_dir)).select("doc_id", F.array_join(Pr.manuscript_warnings(), "|").alias("warnings"))


@query(
    """WITH designs AS (SELECT c_custkey AS doc_id, c_custkey % 2 > 0 AS sized, c_custkey % 3 > 0 AS body, c_custkey % 5 AS heads, c_custkey % 4 AS sections, c_custkey % 7 > 0 AS chapter, c_custkey % 11 AS paragraphs, c_custkey % 13 = 0 AS again FROM customer)
    SELECT doc_id, concat_ws('|', CASE WHEN NOT sized THEN 'no page size, so US Letter' END, CASE WHEN NOT body THEN 'no style for the text' END, CASE WHEN heads > 0 THEN 'running heads hold words that the book will show' END,
    CASE WHEN sections > 1 THEN sections || ' sections: opening pages follow the first, the text follows the last' END, CASE WHEN NOT chapter THEN 'no chapter style, so bold centred text' END, CASE WHEN paragraphs < 5 THEN 'little sample text, so roles go by names' END,
    CASE WHEN again AND body THEN 'no style for the text' END) AS warnings FROM designs"""
)
def warnings_of_designs(spark, sf_dir):
    k = F.col("c_custkey")
    rows = _table(spark, sf_dir, "customer").select(
        k.alias("doc_id"),
        (k % 2 > 0).alias("has_page_size"),
        F.when(k % 3 > 0, "Body").alias("body_style"),
        F.array_repeat(F.lit("x"), (k % 5).cast("int")).alias("header_texts"),
        (k % 4).alias("section_count"),
        F.when(k % 7 > 0, "Chapter").alias("chapter_style"),
        (k % 11).alias("paragraphs"),
    )
    again = Pr.warnings((k % 13 == 0, "no style for the text"))
    return rows.withColumn("c_custkey", F.col("doc_id")).select("doc_id", F.array_join(Pr.all_warnings(Pr.profile_warnings(), again), "|").alias("warnings"))


@query(
    O.ROLES
    + """, written AS (SELECT doc_id, idx, role, min(CASE WHEN role NOT IN ('frontMatterTitle', 'frontMatter', 'copyright') THEN idx END) OVER (PARTITION BY doc_id) AS body FROM roles WHERE role <> 'empty'
    ), front AS (SELECT doc_id, idx, role, lead(role) OVER (PARTITION BY doc_id ORDER BY idx) AS next FROM written WHERE body IS NULL OR idx < body)
    SELECT doc_id, idx, role, CASE role WHEN 'frontMatterTitle' THEN 'center' ELSE 'bottom' END AS v_align FROM front WHERE role <> next AND role IN ('frontMatterTitle', 'copyright')"""
)
def front_closings(spark, sf_dir):
    return C.front_closings(_analysed(spark, sf_dir), {"frontMatterTitle": "center"})


@query(
    O.ROLES
    + """, written AS (SELECT doc_id, idx, min(CASE WHEN role NOT IN ('frontMatterTitle', 'frontMatter', 'copyright') THEN idx END) OVER (PARTITION BY doc_id) AS body FROM roles WHERE role <> 'empty')
    SELECT doc_id, coalesce(max(idx) FILTER (body IS NULL OR idx < body), -1) AS after_idx FROM written GROUP BY doc_id"""
)
def contents_places(spark, sf_dir):
    return C.contents_place(_analysed(spark, sf_dir))


@query(
    O.ROLES
    + """ SELECT doc_id, '{"doc_id":' || doc_id || ',"words":' || sum(word_count) || ',"paragraphs":' || count(*) FILTER (NOT is_empty) || ',"chapters":' || count(*) FILTER (role = 'chapterTitle') || ',"parts":' || count(*) FILTER (role = 'partTitle')
    || ',"scene_breaks":' || count(*) FILTER (role = 'sceneBreak') || '}' AS json FROM roles GROUP BY doc_id"""
)
def analysis_json(spark, sf_dir):
    """The summary of each manuscript as JSON, as ``DataFrame.write.json`` and ``write.text`` store it."""
    rows = summarize(_analysed(spark, sf_dir))
    return rows.select("doc_id", F.to_json(F.struct("doc_id", "words", "paragraphs", "chapters", "parts", "scene_breaks")).alias("json"))


_SIDED = """WITH heads AS (SELECT o_custkey AS doc_id, o_orderkey AS ord, 'rId' || o_orderkey % 4 AS rel_id, ['default', 'even', 'first'][o_orderkey // 4 % 3 + 1] AS side, CASE WHEN o_orderkey % 4 = 3 THEN 'footer' ELSE 'header' END AS kind,
    CASE WHEN o_orderkey % 5 > 0 THEN 'Head ' || o_orderkey ELSE ' ' END AS text, o_orderkey % 7 = 0 AS has_page_number FROM orders
    ), sides AS (SELECT doc_id, rel_id, arg_min(side, ord) AS side FROM heads WHERE kind = 'header' GROUP BY ALL)"""


def _sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return _table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("doc_id"),
        key.alias("ord"),
        F.concat(F.lit("rId"), (key % 4).cast("string")).alias("rel_id"),
        F.get(F.array(F.lit("default"), F.lit("even"), F.lit("first")), (F.floor(key / 4) % 3).cast("int")).alias("side"),
        F.when(key % 4 == 3, "footer").otherwise("header").alias("kind"),
        F.when(key % 5 > 0, F.concat(F.lit("Head "), key.cast("string"))).otherwise(" ").alias("text"),
        (key % 7 == 0).alias("has_page_number"),
    )


@query(_SIDED + " SELECT * FROM sides")
def head_sides(spark, sf_dir):
    return Pr.head_sides(_sided(spark, sf_dir))


@query(
    _SIDED
    + """ SELECT h.doc_id, h.ord, CASE WHEN h.kind = 'header' AND s.side IN ('even', 'default') AND NOT has_page_number AND trim(text) <> '' THEN CASE s.side WHEN 'even' THEN 'Ann Lee' ELSE 'Night' END ELSE text END AS new_text
    FROM heads h LEFT JOIN sides s USING (doc_id, rel_id)"""
)
def heads_by_side(spark, sf_dir):
    heads = _sided(spark, sf_dir)
    return Pr.rewritten_heads(heads, heads, "custom", "Ann Lee ", "Night").select("doc_id", "ord", "new_text")


@query(
    _STYLED
    + """, used AS (SELECT DISTINCT doc_id, ['S1', 'FootnoteText', 'N'][idx % 3 + 1] AS style_id FROM facts
    ), best AS (SELECT doc_id, CASE WHEN coalesce(max(uses) FILTER (style_id = 'S1'), 0) >= coalesce(max(uses) FILTER (style_id = 'S2'), 0) THEN 'S1' ELSE 'S2' END AS style_id FROM facts LEFT JOIN uses USING (doc_id) GROUP BY doc_id)
    SELECT u.doc_id, u.style_id, CASE WHEN u.style_id = 'FootnoteText' THEN b.style_id ELSE u.style_id END AS new_style FROM used u JOIN best b USING (doc_id)"""
)
def note_styles(spark, sf_dir):
    facts, styles = _styled(spark, sf_dir)
    used = facts.select("doc_id", F.get(F.array(F.lit("S1"), F.lit("FootnoteText"), F.lit("N")), F.col("idx") % 3).alias("style_id")).distinct()
    return Y.equivalent_styles(used, styles, Y.style_usage(facts, styles).drop("first_idx"), "(?i)chapter|break")


@query(
    _REPORT
    + """ SELECT doc_id, id FROM (SELECT doc_id, unnest([{'id': 'chapter-numbers-renumbered', 'on': numbers >= 2}, {'id': 'straight-quotes-on', 'on': quotes > 0}, {'id': 'double-spaces-on', 'on': spaces > 0}], recursive := true) FROM report) WHERE "on" """
)
def checks_of_mended_habits(spark, sf_dir):
    """What the report says where numbers, quotes and spaces are being mended."""
    options = _PREFLIGHT | {"renumber": True, "smart_typography": True, "collapse_spaces": True}
    checks = R.preflight(_analysed(spark, sf_dir), None, options)
    return checks.filter("id = 'chapter-numbers-renumbered' OR id LIKE '%-on'").select("doc_id", "id")


_FILES = """WITH files AS (SELECT o_orderkey AS doc_id, '{"format":"' || CASE WHEN o_orderkey % 10 > 0 THEN 'tag' ELSE 'other' END || '","options":{"bookDetails":{"title":' || ['"Night"', '7', 'null', '"A B"'][o_orderkey % 4 + 1] || ',"isbn":"' || o_custkey || '","extra":1},"extraSections":{"contents":'
    || ['true', 'false', '"true"'][o_orderkey % 3 + 1] || '},"runningHeads":{"mode":' || ['"custom"', '"loud"', '3', '"leave"'][o_custkey % 4 + 1] || ',"verso":' || ['"Left"', 'false'][o_custkey % 2 + 1] || '},"roleStyles":{"body":' || ['"Text"', 'null', '5'][o_custkey % 3 + 1]
    || ',"poem":"P"},"sceneBreakText":' || ['"* * *"', 'null', '[]'][o_orderkey % 3 + 1] || ',"chapterSpaceBefore":' || ['4', '-1', '2.5', '"3"', 'null'][o_orderkey % 5 + 1] || '}}' AS json FROM orders)"""


def _choice_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    one = lambda n, *values: F.get(F.array(*map(F.lit, values)), n.cast("int"))
    parts = (
        F.lit('{"format":"'),
        F.when(key % 10 > 0, "tag").otherwise("other"),
        F.lit('","options":{"bookDetails":{"title":'),
        one(key % 4, '"Night"', "7", "null", '"A B"'),
        F.lit(',"isbn":"'),
        cust.cast("string"),
        F.lit('","extra":1},"extraSections":{"contents":'),
        one(key % 3, "true", "false", '"true"'),
        F.lit('},"runningHeads":{"mode":'),
        one(cust % 4, '"custom"', '"loud"', "3", '"leave"'),
        F.lit(',"verso":'),
        one(cust % 2, '"Left"', "false"),
        F.lit('},"roleStyles":{"body":'),
        one(cust % 3, '"Text"', "null", "5"),
        F.lit(',"poem":"P"},"sceneBreakText":'),
        one(key % 3, '"* * *"', "null", "[]"),
        F.lit(',"chapterSpaceBefore":'),
        one(key % 5, "4", "-1", "2.5", '"3"', "null"),
        F.lit("}}"),
    )
    return _table(spark, sf_dir, "orders").select(key.alias("doc_id"), F.concat(*parts).alias("json"))


@query(
    _FILES
    + """, kinds AS (SELECT *, json_extract(json, '$.options') AS o, json_extract_string(json, '$.format') = 'tag' AS known FROM files)
    SELECT doc_id, CASE WHEN known THEN CASE WHEN json_type(o, '$.bookDetails.title') = 'VARCHAR' THEN json_extract_string(o, '$.bookDetails.title') ELSE '' END END AS title, CASE WHEN known THEN json_extract_string(o, '$.bookDetails.isbn') END AS isbn, CASE WHEN known THEN '' END AS author,
    CASE WHEN known THEN coalesce(json_type(o, '$.extraSections.contents') = 'BOOLEAN' AND json_extract_string(o, '$.extraSections.contents') = 'true', FALSE) END AS contents,
    CASE WHEN known THEN CASE WHEN json_extract_string(o, '$.runningHeads.mode') IN ('auto', 'custom', 'leave') THEN json_extract_string(o, '$.runningHeads.mode') ELSE 'auto' END END AS mode,
    CASE WHEN known THEN CASE WHEN json_type(o, '$.runningHeads.verso') = 'VARCHAR' THEN 'Left' ELSE '' END END AS verso,
    CASE WHEN known THEN CASE json_type(o, '$.roleStyles.body') WHEN 'VARCHAR' THEN 'body=Text' WHEN 'NULL' THEN 'body=-' ELSE '' END END AS role_styles,
    CASE WHEN known AND json_type(o, '$.sceneBreakText') = 'VARCHAR' THEN json_extract_string(o, '$.sceneBreakText') END AS scene_break,
    CASE WHEN known AND json_type(o, '$.chapterSpaceBefore') IN ('BIGINT', 'UBIGINT') AND json_extract_string(o, '$.chapterSpaceBefore') NOT LIKE '-%' THEN json_extract_string(o, '$.chapterSpaceBefore')::BIGINT END AS space_before FROM kinds"""
)
def nested_choices(spark, sf_dir):
    rows = H.nested_options(_choice_files(spark, sf_dir), tag="tag")
    styles = F.array_join(F.transform("role_styles", lambda x: F.concat(x["role"], F.lit("="), F.coalesce(x["style_id"], F.lit("-")))), ",")
    columns = ("details.title", "details.isbn", "details.author", "sections.contents", "heads.mode", "heads.verso")
    return rows.select("doc_id", *columns, styles.alias("role_styles"), "scene_break", "space_before")
