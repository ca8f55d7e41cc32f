"""Registered queries of the manuscript operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioframe import oracle as O
from folioframe.functions import geometry as G
from folioframe.functions import numbers as N
from folioframe.functions import patterns as P
from folioframe.functions import text as T
from folioframe.operators import choices as H
from folioframe.operators import compose as C
from folioframe.operators import details as D
from folioframe.operators import preflight as R
from folioframe.operators import proofs as V
from folioframe.operators import structure as S
from folioframe.operators import styles as Y
from folioframe.operators.classify import classify, with_context
from folioframe.operators.facts import paragraph_facts
from folioframe.plans.analyze import analyze_blocks, summarize
from folioframe.sources.derive import manuscript_blocks, read_documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manuscript_blocks(read_documents(spark, sf_dir))


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_facts(_blocks(spark, sf_dir))


def _analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze_blocks(_blocks(spark, sf_dir))


@query(O.BLOCKS + " SELECT doc_id, idx, text, centered FROM blocks")
def manuscript_paragraphs(spark, sf_dir):
    return _blocks(spark, sf_dir)


@query(O.FACTS + " SELECT doc_id, idx, word_count, char_count, is_empty, all_caps, preview FROM facts")
def paragraph_shape(spark, sf_dir):
    return _facts(spark, sf_dir).select("doc_id", "idx", "word_count", "char_count", "is_empty", "all_caps", "preview")


@query(O.FACTS + " SELECT doc_id, idx, text FROM facts WHERE is_ornament")
def scene_break_lines(spark, sf_dir):
    return _facts(spark, sf_dir).filter("is_ornament").select("doc_id", "idx", "text")


@query(O.FACTS + " SELECT doc_id, idx, label FROM facts WHERE label IS NOT NULL")
def division_labels(spark, sf_dir):
    return _facts(spark, sf_dir).filter("label IS NOT NULL").select("doc_id", "idx", "label")


@query(O.FACTS + " SELECT doc_id, idx, number_conf FROM facts WHERE number_conf IS NOT NULL")
def standalone_numbers(spark, sf_dir):
    return _facts(spark, sf_dir).filter("number_conf IS NOT NULL").select("doc_id", "idx", "number_conf")


@query(O.FACTS + " SELECT doc_id, idx, is_copyright, is_placeholder, heading_case, ends_sentence FROM facts WHERE NOT is_empty")
def line_traits(spark, sf_dir):
    rows = _facts(spark, sf_dir).filter("NOT is_empty")
    return rows.select("doc_id", "idx", "is_copyright", P.is_placeholder(F.col("text")).alias("is_placeholder"), P.is_heading_case(F.col("text")).alias("heading_case"), "ends_sentence")


@query(O.CONTEXT + " SELECT doc_id, idx, broken_before, blank_before, is_first_block, median_prose_words FROM context")
def paragraph_context(spark, sf_dir):
    return with_context(_facts(spark, sf_dir)).select("doc_id", "idx", "broken_before", "blank_before", "is_first_block", "median_prose_words")


@query(O.SCORED + " SELECT doc_id, idx, heading_score, role0 AS auto_role, confidence, structural_marker FROM core")
def first_pass_roles(spark, sf_dir):
    return classify(with_context(_facts(spark, sf_dir))).select("doc_id", "idx", "heading_score", "auto_role", "confidence", "structural_marker")


@query(O.ROLES + " SELECT doc_id, idx, role1 AS auto_role, body_start FROM split")
def front_matter_split(spark, sf_dir):
    return S.split_front_matter(classify(with_context(_facts(spark, sf_dir)))).select("doc_id", "idx", "auto_role", "body_start")


@query(O.ROLES + " SELECT doc_id, idx, role2 AS auto_role FROM pages WHERE idx < body_start")
def copyright_pages(spark, sf_dir):
    rows = S.mark_copyright_pages(S.split_front_matter(classify(with_context(_facts(spark, sf_dir)))))
    return rows.filter("idx < body_start").select("doc_id", "idx", "auto_role")


@query(O.ROLES + " SELECT doc_id, idx, role FROM roles")
def paragraph_roles(spark, sf_dir):
    return _analysed(spark, sf_dir).select("doc_id", "idx", "role")


@query(O.ROLES + " SELECT role, count(*) AS paragraphs, sum(word_count)::BIGINT AS words, avg(confidence) AS confidence FROM roles GROUP BY role")
def role_counts(spark, sf_dir):
    return _analysed(spark, sf_dir).groupBy("role").agg(F.count("*").alias("paragraphs"), F.sum("word_count").alias("words"), F.avg("confidence").alias("confidence"))


@query(
    O.ROLES
    + f""" SELECT doc_id, sum(word_count)::BIGINT AS words, count(*) FILTER (NOT is_empty) AS paragraphs, count(*) FILTER (role = 'chapterTitle') AS chapters, count(*) FILTER (role = 'partTitle') AS parts, count(*) FILTER (role = 'sceneBreak') AS scene_breaks,
    min(body_start) AS body_start, bool_or(length(trimmed) BETWEEN 1 AND 40 AND {O.matches("trimmed", f"(?i)^({'|'.join(P.CONTENTS_HEADINGS)})[:.]*$")}) AS has_contents,
    coalesce(sum(length(regexp_replace(text, '[^"'']', '', 'g'))) FILTER (NOT is_empty), 0)::BIGINT AS straight_quotes, coalesce(sum(len(regexp_extract_all(text, ' {{2,}}'))) FILTER (NOT is_empty), 0)::BIGINT AS double_spaces,
    count(*) FILTER (confidence < 6e-1 AND role NOT IN ('body', 'empty')) AS uncertain FROM roles GROUP BY doc_id"""
)
def manuscript_summary(spark, sf_dir):
    return summarize(_analysed(spark, sf_dir)).select("doc_id", "words", "paragraphs", "chapters", "parts", "scene_breaks", "body_start", "has_contents", "straight_quotes", "double_spaces", "uncertain")


@query(O.ROLES + " SELECT doc_id, idx, role, confidence, preview FROM roles WHERE role <> 'pageBreak' AND (role NOT IN ('empty', 'body', 'bodyFirst') OR confidence < 6e-1)")
def review_list(spark, sf_dir):
    return _analysed(spark, sf_dir).filter(V.is_interesting()).select("doc_id", "idx", "role", "confidence", "preview")


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysed(spark, sf_dir).filter("role = 'chapterTitle'").select("doc_id", "idx", "text")


@query(O.NUMBERED + " SELECT doc_id, idx, number, ordinal FROM numbered")
def chapter_numbers(spark, sf_dir):
    return S.numbered_chapters(_titles(spark, sf_dir)).select("doc_id", "idx", "number", "ordinal")


@query(
    O.NUMBERED
    + """, dups AS (SELECT doc_id, count(DISTINCT number) AS n FROM (SELECT doc_id, number, row_number() OVER (PARTITION BY doc_id, number ORDER BY idx) AS k FROM numbered) WHERE k > 1 GROUP BY doc_id
    ), gaps AS (SELECT doc_id, count(DISTINCT m) AS n FROM (SELECT doc_id, idx, unnest(range(prev + 1, number)) AS m FROM numbered WHERE number > prev + 1) g WHERE NOT EXISTS (SELECT 1 FROM numbered b WHERE b.doc_id = g.doc_id AND b.idx < g.idx AND b.number = g.m) GROUP BY doc_id
    ) SELECT x.doc_id, count(*) AS numbered, coalesce(any_value(d.n), 0) AS duplicates, coalesce(any_value(g.n), 0) AS gaps, count(*) FILTER (number < prev) AS out_of_order,
        count(*) > 1 AND count(DISTINCT label_text <> '') > 1 AS mixed
    FROM numbered x LEFT JOIN dups d USING (doc_id) LEFT JOIN gaps g USING (doc_id) GROUP BY x.doc_id"""
)
def chapter_number_report(spark, sf_dir):
    rows = S.check_numbers(S.numbered_chapters(_titles(spark, sf_dir)))
    size = lambda c: F.size(c).cast("long").alias(c)
    return rows.select("doc_id", "numbered", size("duplicates"), size("gaps"), size("out_of_order"), "mixed")


@query(
    O.NUMBERED
    + ", "
    + O.WORDS
    + """ SELECT doc_id, idx, text AS old, CASE WHEN label_text IN ('Capítulo', 'Kapitel') THEN label_text || ' ' || ordinal WHEN label_text = 'CHAPTER' THEN 'CHAPTER ' || upper(words) ELSE 'Chapter ' || words END AS new
    FROM numbered JOIN number_words ON n = ordinal
    WHERE CASE WHEN label_text IN ('Capítulo', 'Kapitel') THEN label_text || ' ' || ordinal WHEN label_text = 'CHAPTER' THEN 'CHAPTER ' || upper(words) ELSE 'Chapter ' || words END <> text"""
)
def renumbered_titles(spark, sf_dir):
    return S.retitle(S.numbered_chapters(_titles(spark, sf_dir)), "chapterWords", True)


@query(
    O.ROLES
    + """, seen AS (SELECT doc_id, idx, preview, role, CASE WHEN role IN ('chapterTitle', 'partTitle') THEN 'title' WHEN role = 'sceneBreak' THEN 'break' ELSE 'text' END AS what FROM roles WHERE role NOT IN ('empty', 'pageBreak', 'chapterSubtitle')
    ), around AS (SELECT *, lag(what) OVER w AS before, lead(what) OVER w AS after FROM seen WINDOW w AS (PARTITION BY doc_id ORDER BY idx))
    SELECT doc_id, idx, preview, 'empty-chapter' AS problem FROM around WHERE role = 'chapterTitle' AND (after = 'title' OR after IS NULL)
    UNION ALL SELECT doc_id, idx, preview, 'stranded-break' FROM around WHERE what = 'break' AND before IN ('title', 'break')
    UNION ALL SELECT doc_id, idx, preview, 'stranded-break' FROM around WHERE what = 'break' AND (after = 'title' OR after IS NULL)"""
)
def stranded_lines(spark, sf_dir):
    return S.empty_chapters_and_stranded_breaks(_analysed(spark, sf_dir))


_CHECKS = """
    SELECT doc_id, id, level, rank FROM (
      SELECT doc_id, unnest([
        {'id': 'no-chapters', 'level': 'attention', 'rank': 0, 'on': chapters = 0}, {'id': 'chapters', 'level': 'ready', 'rank': 2, 'on': chapters > 0},
        {'id': 'chapter-numbers', 'level': 'check', 'rank': 1, 'on': numbers >= 2 AND (duplicates > 0 OR gaps > 0 OR low > 0)},
        {'id': 'uncertain', 'level': 'check', 'rank': 1, 'on': uncertain > 0}, {'id': 'placeholder-text', 'level': 'attention', 'rank': 0, 'on': fillers > 0}, {'id': 'page-numbers-ok', 'level': 'ready', 'rank': 2, 'on': TRUE},
        {'id': 'gutter', 'level': 'check', 'rank': 1, 'on': pages IS NOT NULL AND 1656 / 1440 + 1e-2 < need}, {'id': 'gutter-ok', 'level': 'ready', 'rank': 2, 'on': pages IS NOT NULL AND 1656 / 1440 + 1e-2 >= need},
        {'id': 'too-short', 'level': 'attention', 'rank': 0, 'on': pages < 24}, {'id': 'too-long', 'level': 'attention', 'rank': 0, 'on': pages > 828},
        {'id': 'empty-chapters', 'level': 'check', 'rank': 1, 'on': empties > 0}, {'id': 'stranded-scene-breaks', 'level': 'check', 'rank': 1, 'on': strays > 0},
        {'id': 'straight-quotes', 'level': 'check', 'rank': 1, 'on': quotes > 0}, {'id': 'double-spaces', 'level': 'check', 'rank': 1, 'on': spaces > 0}, {'id': 'blank-pages', 'level': 'check', 'rank': 1, 'on': TRUE},
        {'id': 'duplicate-front', 'level': 'attention', 'rank': 0, 'on': fronts > 0}], recursive := true) FROM report) WHERE "on" """
_REPORT = (
    O.NUMBERED
    + """, seen AS (SELECT doc_id, idx, role, CASE WHEN role IN ('chapterTitle', 'partTitle') THEN 'title' WHEN role = 'sceneBreak' THEN 'break' ELSE 'text' END AS what FROM roles WHERE role NOT IN ('empty', 'pageBreak', 'chapterSubtitle')
    ), around AS (SELECT *, lag(what) OVER w AS before, lead(what) OVER w AS after FROM seen WINDOW w AS (PARTITION BY doc_id ORDER BY idx)
    ), strays AS (SELECT doc_id, count(*) FILTER (role = 'chapterTitle' AND (after = 'title' OR after IS NULL)) AS empties, count(*) FILTER (what = 'break' AND (before IN ('title', 'break') OR after = 'title' OR after IS NULL)) AS strays FROM around GROUP BY doc_id
    ), orders AS (SELECT x.doc_id, count(*) AS numbers, count(*) - count(DISTINCT number) AS duplicates, count(*) FILTER (number < prev) AS low,
        count(*) FILTER (number > prev + 1 AND NOT EXISTS (SELECT 1 FROM numbered b WHERE b.doc_id = x.doc_id AND b.idx < x.idx AND b.number = x.number - 1)) AS gaps FROM numbered x GROUP BY x.doc_id
    ), sums AS (SELECT doc_id, count(*) FILTER (role = 'chapterTitle') AS chapters, count(*) FILTER (confidence < 6e-1 AND role NOT IN ('body', 'empty')) AS uncertain, count(*) FILTER (NOT is_empty AND is_placeholder) AS fillers,
        sum(length(regexp_replace(text, '[^"'']', '', 'g'))) FILTER (NOT is_empty) AS quotes, sum(len(regexp_extract_all(text, ' {2,}'))) FILTER (NOT is_empty) AS spaces, count(*) FILTER (role IN ('frontMatterTitle', 'copyright')) AS fronts, sum(word_count) AS words FROM roles GROUP BY doc_id
    ), report AS (SELECT *, CASE WHEN pages <= 150 THEN 0.375e0 WHEN pages <= 300 THEN 5e-1 WHEN pages <= 500 THEN 0.625e0 WHEN pages <= 700 THEN 0.75e0 ELSE 0.875e0 END AS need FROM (
        SELECT s.*, coalesce(empties, 0) AS empties, coalesce(strays, 0) AS strays, coalesce(numbers, 0) AS numbers, coalesce(duplicates, 0) AS duplicates, coalesce(gaps, 0) AS gaps, coalesce(low, 0) AS low,
          CASE WHEN words > 0 THEN greatest(1, floor(words::DOUBLE / (((6048 / 1440)::DOUBLE / (325e-2 * (115e-1 / 72e0))) * ((10656 / 1440)::DOUBLE / ((115e-1 * (276 / 240e0)) / 72e0))) + 5e-1)) END AS pages
        FROM sums s LEFT JOIN strays USING (doc_id) LEFT JOIN orders USING (doc_id)))"""
)
_PREFLIGHT = {"chapter_start": "oddPage", "title_page": True, "title": "A Title"}


@query(_REPORT + _CHECKS)
def preflight_checks(spark, sf_dir):
    return R.preflight(_analysed(spark, sf_dir), None, _PREFLIGHT).select("doc_id", "id", "level", "rank")


@query(_REPORT + f" SELECT doc_id, ['attention', 'check', 'ready'][min(rank) + 1] AS level FROM ({_CHECKS}) GROUP BY doc_id")
def preflight_worst_level(spark, sf_dir):
    return R.worst_level(R.preflight(_analysed(spark, sf_dir), None, _PREFLIGHT))


@query(
    O.ROLES
    + """, front AS (SELECT *, regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '[.,;]+$', '') AS cleaned FROM roles WHERE role IN ('frontMatterTitle', 'frontMatter') AND NOT is_empty
    ), heads AS (SELECT doc_id, min(idx) AS title_idx, arg_min(cleaned, idx) AS title FROM front WHERE role = 'frontMatterTitle' GROUP BY doc_id
    ), plain AS (SELECT f.* FROM front f JOIN heads h USING (doc_id) WHERE f.idx > h.title_idx AND word_count > 0 AND cleaned <> '' AND NOT regexp_matches(trimmed, '(?i)^(a novel|a memoir|a story|stories|copyright|all rights|first edition|isbn|printed|published|www\\.|http)')
    ), authors AS (SELECT doc_id, arg_min(cleaned, idx) AS author FROM plain WHERE word_count <= 8 GROUP BY doc_id
    ), bylines AS (SELECT doc_id, arg_min(regexp_replace(trim(regexp_extract(trimmed, '(?i)^(?:by|written by)\\s+(.{2,80})$', 1)), '[.,;]+$', ''), idx) AS author FROM front WHERE regexp_matches(trimmed, '(?i)^(?:by|written by)\\s+(.{2,80})$') GROUP BY doc_id
    ), named AS (SELECT DISTINCT f.doc_id, h.title, coalesce(b.author, CASE WHEN h.title IS NOT NULL THEN a.author END) AS author FROM front f LEFT JOIN heads h USING (doc_id) LEFT JOIN authors a USING (doc_id) LEFT JOIN bylines b USING (doc_id)
    ), subs AS (SELECT p.doc_id, arg_min(cleaned, idx) AS subtitle FROM plain p JOIN named n USING (doc_id) WHERE n.author IS NOT NULL AND word_count <= 15 AND cleaned <> n.author AND NOT regexp_matches(trimmed, '(?i)^(?:by|written by)\\s+(.{2,80})$') GROUP BY p.doc_id)
    SELECT n.doc_id, n.title, n.author, CASE WHEN s.subtitle IS DISTINCT FROM n.title THEN s.subtitle END AS subtitle FROM named n LEFT JOIN subs s USING (doc_id)"""
)
def book_details(spark, sf_dir):
    return D.detect_details(_analysed(spark, sf_dir)).select("doc_id", "title", "author", "subtitle")


_NOT_A_NAME = "'(?i)^(a novel|a memoir|a story|stories|copyright|all rights|first edition|isbn|printed|published|www\\.|http)'"
_BY_LINE = "'(?i)^(?:by|written by)\\s+(.{2,80})$'"
_NOTICE_YEAR = "'(?i)(?:©|\\(c\\)|copyright)\\s*(?:©\\s*)?(\\d{4})|\\b(\\d{4})\\s*(?:by\\b)'"
_NOTICE_NAME = "'(?i)(?:©|\\(c\\)|copyright)\\s*(?:©\\s*)?\\d{4}\\s*,?\\s*(?:by\\s+)?(.{2,80}?)\\s*$'"
_NOTICE_ISBN = "'\\bISBN(?:-1[03])?:?\\s*((?:97[89][-\\s]?)?\\d[\\d\\-\\s]{7,20}[\\dXx])'"


def _tidied(x: str) -> str:
    return f"nullif(regexp_replace({O.collapse(x)}, '[.,;]+$', ''), '')"


@query(
    O.ROLES
    + f""", matter AS (SELECT doc_id, idx, role, word_count, trimmed, {_tidied("text")} AS line, {_tidied(f"regexp_extract(trimmed, {_BY_LINE}, 1)")} AS by_line, {_tidied(f"regexp_extract(trimmed, {_NOTICE_NAME}, 1)")} AS name,
        coalesce(nullif(regexp_extract(text, {_NOTICE_YEAR}, 1), ''), nullif(regexp_extract(text, {_NOTICE_YEAR}, 2), '')) AS year, regexp_replace(regexp_extract(text, {_NOTICE_ISBN}, 1), '\\s+', '', 'g') AS number
        FROM roles WHERE role IN ('frontMatterTitle', 'frontMatter', 'copyright') AND NOT is_empty
    ), said AS (SELECT doc_id, min(idx) FILTER (role = 'frontMatterTitle') AS title_idx, arg_min(line, idx) FILTER (role = 'frontMatterTitle') AS title,
        coalesce(arg_min(by_line, idx) FILTER (role <> 'copyright'), arg_min(name, idx) FILTER (role = 'copyright')) AS named, arg_min(year, idx) FILTER (role = 'copyright') AS copyright_year,
        arg_min(number, idx) FILTER (role = 'copyright' AND length(regexp_replace(number, '[^0-9Xx]', '', 'g')) IN (10, 13)) AS isbn FROM matter GROUP BY doc_id
    ), under AS (SELECT l.* FROM matter l JOIN said USING (doc_id) WHERE idx > title_idx AND role <> 'copyright' AND word_count > 0 AND NOT regexp_matches(trimmed, {_NOT_A_NAME})
    ), written AS (SELECT s.*, coalesce(named, (SELECT arg_min(line, idx) FROM under u WHERE u.doc_id = s.doc_id AND word_count <= 8)) AS author FROM said s
    ), subs AS (SELECT u.doc_id, arg_min(line, idx) AS sub FROM under u JOIN written USING (doc_id) WHERE line <> author AND word_count <= 15 AND NOT regexp_matches(trimmed, {_BY_LINE}) GROUP BY u.doc_id)
    SELECT w.doc_id, title, author, copyright_year, isbn, CASE WHEN sub IS DISTINCT FROM title THEN sub END AS subtitle FROM written w LEFT JOIN subs USING (doc_id)"""
)
def front_matter_details(spark, sf_dir):
    """The details with the year and ISBN of the copyright notice, which the SQL of ``book_details`` doesn't read."""
    return D.detect_details(_analysed(spark, sf_dir)).select("doc_id", "title", "author", "copyright_year", "isbn", "subtitle")


@query(
    O.ROLES
    + """ SELECT doc_id, role, idx FROM (SELECT doc_id, role, idx, row_number() OVER (PARTITION BY doc_id, role ORDER BY idx) AS n FROM roles WHERE NOT is_empty) WHERE n <= 4"""
)
def first_lines_by_role(spark, sf_dir):
    rows = _analysed(spark, sf_dir).filter(V.is_drawable()).withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "role").orderBy("idx")))
    return rows.filter("n <= 4").select("doc_id", "role", "idx")


@query(
    O.ROLES
    + """, drawn AS (SELECT doc_id, idx, role, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS n FROM roles WHERE NOT is_empty)
    SELECT a.doc_id, a.idx, b.idx AS near_idx FROM drawn a JOIN drawn b ON a.doc_id = b.doc_id AND b.n BETWEEN a.n - 2 AND a.n + 2 AND b.n <> a.n WHERE a.role = 'chapterTitle'"""
)
def lines_around_titles(spark, sf_dir):
    return V.lines_around(_analysed(spark, sf_dir), F.col("role") == "chapterTitle", 2, 2)


_STYLES = ("body", "bodyFirst", "chapterTitle", "sceneBreak")


def _styles() -> Column:
    return F.create_map(*[F.lit(x) for k in _STYLES for x in (k, f"Book {k}")])


_PLAN = {"number_style": "keep", "blanks_before": 3, "blanks_after": 1, "scene_break": "§"}
_PLAN_SQL = (
    O.ROLES
    + """, kept AS (SELECT doc_id, idx, role, text, word_count, bool_or(role <> 'empty') OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS content FROM roles
    ), written AS (SELECT doc_id, idx, role, text, word_count, coalesce(content, FALSE) AND role IN ('chapterTitle', 'partTitle') AS breaks, unnest(CASE WHEN role IN ('chapterTitle', 'partTitle') THEN range(5) ELSE [3] END) AS k FROM kept WHERE role <> 'empty'
    ), plan AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY idx, k) - 1 AS out_ord, CASE WHEN k = 3 THEN idx END AS source_idx, CASE WHEN k = 3 THEN role ELSE 'filler' END AS role,
        CASE WHEN k <> 3 THEN 'Book chapterTitle' WHEN role IN ('chapterTitle', 'partTitle', 'chapterSubtitle', 'frontMatterTitle') THEN 'Book chapterTitle' WHEN role = 'subheading' THEN NULL
             WHEN role = 'sceneBreak' THEN 'Book sceneBreak' WHEN role IN ('bodyFirst', 'frontMatter') THEN 'Book bodyFirst' ELSE 'Book body' END AS style_id,
        breaks AND k = 0 AS break_before, CASE WHEN k <> 3 THEN '' WHEN role = 'sceneBreak' THEN '§' ELSE text END AS text, CASE WHEN k = 3 THEN word_count ELSE 0 END AS word_count FROM written)"""
)


@query(_PLAN_SQL + " SELECT doc_id, out_ord, source_idx, role, style_id, break_before, text FROM plan")
def output_paragraphs(spark, sf_dir):
    return C.output_plan(_analysed(spark, sf_dir), _styles(), _PLAN).select("doc_id", "out_ord", "source_idx", "role", "style_id", "break_before", "text")


@query(
    _PLAN_SQL
    + """ SELECT p.doc_id, count(*) AS paragraphs_written, count(*) FILTER (role = 'chapterTitle') AS chapters, count(*) FILTER (role = 'partTitle') AS parts, count(*) FILTER (role = 'sceneBreak') AS scene_breaks, sum(p.word_count)::BIGINT AS words, any_value(b.n) AS blanks_removed
    FROM plan p JOIN (SELECT doc_id, count(*) FILTER (role = 'empty') AS n FROM roles GROUP BY doc_id) b USING (doc_id) GROUP BY p.doc_id"""
)
def output_stats(spark, sf_dir):
    blocks = _analysed(spark, sf_dir)
    return C.plan_stats(C.output_plan(blocks, _styles(), _PLAN), blocks).drop("tables")


@query(O.ROLES + f" SELECT doc_id, idx, {O.collapse('text')} AS entry FROM roles WHERE role IN ('chapterTitle', 'partTitle') AND NOT is_empty")
def contents_entries(spark, sf_dir):
    return C.contents_entries(_analysed(spark, sf_dir))


@query(
    O.FACTS
    + f""" SELECT doc_id, idx, length(CASE WHEN regexp_extract(lead, '^\\s*[^\\s.!?;:,—–][^.!?;:,—–]*[.!?;:,—–][”’"'')]*') <> '' THEN regexp_extract(lead, '^\\s*[^\\s.!?;:,—–][^.!?;:,—–]*[.!?;:,—–][”’"'')]*') ELSE lead END) AS chars
    FROM (SELECT doc_id, idx, regexp_extract(text, '^\\s*(?:\\S+\\s+){{0,3}}\\S+') AS lead FROM facts WHERE NOT is_empty)"""
)
def lead_in_lengths(spark, sf_dir):
    return _facts(spark, sf_dir).filter("NOT is_empty").select("doc_id", "idx", T.lead_in_length(F.col("text")).cast("long").alias("chars"))


@query(
    O.FACTS
    + """ SELECT doc_id, idx, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(\\S)---(\\S)', '\\1—\\2', 'g'), '(\\S)--(\\S)', '\\1—\\2', 'g'), ' -- ', '—', 'g'), '\\.\\.\\.', '…', 'g') AS text
    FROM facts WHERE NOT is_empty AND NOT regexp_matches(text, '["'']')"""
)
def typographic_text(spark, sf_dir):
    rows = _facts(spark, sf_dir).filter(~F.col("is_empty") & ~F.col("text").rlike("[\"']"))
    return rows.select("doc_id", "idx", T.smarten(F.col("text")).alias("text"))


@query(
    O.FACTS
    + f""", dashed AS (SELECT doc_id, idx, regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(\\S)---(\\S)', '\\1—\\2', 'g'), '(\\S)--(\\S)', '\\1—\\2', 'g'), ' -- ', '—', 'g'), '\\.\\.\\.', '…', 'g'), '(?s).') AS c FROM facts WHERE NOT is_empty
    ), pairs AS (SELECT doc_id, idx, unnest(range(1, len(c) + 1)) AS i, unnest(c) AS mark, unnest(list_concat([''], c[:-2])) AS prev FROM dashed
    ), curled AS (SELECT doc_id, idx, i, prev = '' OR regexp_matches(prev, '[{O.WS}(\\[{{<—–“‘-]') AS opens, mark, prev FROM pairs)
    SELECT doc_id, idx, string_agg(CASE WHEN mark = '"' THEN CASE WHEN opens THEN '“' ELSE '”' END WHEN mark = '''' THEN CASE WHEN opens AND NOT regexp_matches(prev, '[A-Za-z0-9]') THEN '‘' ELSE '’' END ELSE mark END, '' ORDER BY i) AS text FROM curled GROUP BY doc_id, idx"""
)
def typographic_paragraphs(spark, sf_dir):
    """All paragraphs with text, those with quotes too, which ``typographic_text`` and its SQL leave out."""
    return _facts(spark, sf_dir).filter("NOT is_empty").select("doc_id", "idx", T.smarten(F.col("text")).alias("text"))


@query(
    """WITH pages AS (SELECT o_orderkey AS id, (4 + o_orderkey % 9 / 2.0)::DOUBLE AS w, (6 + o_orderkey % 13 / 2.0)::DOUBLE AS h, (o_custkey % 90000 + 100)::DOUBLE AS words FROM orders)
    SELECT id, greatest(1, floor(words / ((w / (325e-2 * (11e0 / 72e0))) * (h / ((11e0 * 115e-2) / 72e0))) + 5e-1))::INTEGER AS pages FROM pages"""
)
def page_estimates(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    d = lambda c: c.cast("double")
    width, height, words = d(F.col("o_orderkey") % 9 / 2 + 4), d(F.col("o_orderkey") % 13 / 2 + 6), d(F.col("o_custkey") % 90000 + 100)
    return o.select(F.col("o_orderkey").alias("id"), G.estimate_pages(width, height, F.lit(11.0), F.lit(1.15), words).alias("pages"))


@query("SELECT o_orderkey AS id, CASE WHEN o_custkey % 1000 <= 150 THEN 0.375e0 WHEN o_custkey % 1000 <= 300 THEN 5e-1 WHEN o_custkey % 1000 <= 500 THEN 0.625e0 WHEN o_custkey % 1000 <= 700 THEN 0.75e0 ELSE 0.875e0 END AS inches FROM orders")
def gutter_by_pages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), G.gutter_needed(F.col("o_custkey") % 1000).alias("inches"))


_SIZES = "(VALUES " + ", ".join(f"({i}, {O.q(n)}, {w}::DOUBLE, {h}::DOUBLE)" for i, (n, w, h) in enumerate(G.KNOWN_SIZES)) + ") AS s(ord, label, w, h)"


@query(
    f"""WITH pages AS (SELECT DISTINCT 7000 + p_partkey % 60 * 100 AS wt, 10000 + p_size * 120 AS ht FROM part), named AS (
    SELECT wt, ht, arg_min(label, ord) AS label FROM pages LEFT JOIN {_SIZES} ON abs(w - wt / 1440e0) <= 3e-2 AND abs(h - ht / 1440e0) <= 3e-2 GROUP BY wt, ht)
    SELECT wt AS width_twips, ht AS height_twips, regexp_replace(printf('%.2f', round(wt / 1440e0, 2)), '\\.?0+$', '') || '" x ' || regexp_replace(printf('%.2f', round(ht / 1440e0, 2)), '\\.?0+$', '') || '"' || CASE WHEN label IS NULL THEN '' ELSE ' (' || label || ')' END AS size_label FROM named"""
)
def page_size_names(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    pages = part.select((F.lit(7000) + F.col("p_partkey") % 60 * 100).alias("width_twips"), (F.lit(10000) + F.col("p_size") * 120).alias("height_twips")).distinct()
    return G.describe_sizes(pages).select("width_twips", "height_twips", "size_label")


@query(
    O.ROLES
    + ", designs AS (SELECT t.id || '-' || k.id AS design_id, t.w - 2 * t.o - 5e-1 AS w, t.h - 2 * t.v AS h, k.p, k.s FROM (VALUES ('6x9', 6e0, 9e0, 8e-1, 65e-2), ('5.5x8.5', 55e-1, 85e-1, 75e-2, 6e-1), ('5.25x8', 525e-2, 8e0, 75e-2, 6e-1), ('5x8', 5e0, 8e0, 7e-1, 55e-2), ('a5', 8391 / 1440e0, 11906 / 1440e0, 75e-2, 6e-1)) t(id, w, h, v, o), (VALUES ('classic', 115e-1, 115e-2), ('modern', 105e-1, 125e-2), ('minimal', 11e0, 12e-1), ('largePrint', 16e0, 13e-1)) k(id, p, s))"
    + " SELECT doc_id, design_id, greatest(1, floor(words / ((w / (325e-2 * (p / 72e0))) * (h / ((p * s) / 72e0))) + 5e-1))::INTEGER AS pages FROM (SELECT doc_id, sum(word_count)::DOUBLE AS words FROM roles GROUP BY doc_id HAVING sum(word_count) > 0) d, designs"
)
def pages_by_design(spark, sf_dir):
    words = _analysed(spark, sf_dir).groupBy("doc_id").agg(F.sum("word_count").cast("double").alias("words")).filter("words > 0")
    return G.design_pages(words, G.designs(spark))


@query(
    """WITH k AS (SELECT c_custkey AS id, lpad(CAST(c_custkey * 7919 % 1000000000 AS VARCHAR), 9, '0') AS nine FROM customer), d AS (SELECT id, '978' || nine || CAST(id % 10 AS VARCHAR) AS isbn, nine FROM k)
    SELECT id, isbn, CASE WHEN list_sum(list_transform(range(13), lambda i: CAST(isbn[i + 1] AS INTEGER) * CASE WHEN i % 2 = 0 THEN 1 ELSE 3 END)) % 10 = 0 THEN 'ok' ELSE 'checksum' END AS verdict,
        CASE WHEN id % 11 = 10 THEN 'length' WHEN (list_sum(list_transform(range(9), lambda i: CAST(nine[i + 1] AS INTEGER) * (10 - i))) + id % 11) % 11 = 0 THEN 'ok' ELSE 'checksum' END AS verdict10 FROM d"""
)
def isbn_checks(spark, sf_dir):
    key = F.col("c_custkey")
    nine = F.lpad((key * 7919 % 1000000000).cast("string"), 9, "0")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(key.alias("id"), F.concat(F.lit("978"), nine, (key % 10).cast("string")).alias("isbn"), F.concat(nine, (key % 11).cast("string")).alias("ten"))
    return rows.select("id", "isbn", T.check_isbn(F.col("isbn")).alias("verdict"), T.check_isbn(F.col("ten")).alias("verdict10"))


@query(
    """WITH n AS (SELECT DISTINCT o_custkey % 3999 + 1 AS n FROM orders)
    SELECT n, repeat('M', n // 1000) || ['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'][n // 100 % 10 + 1] || ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][n // 10 % 10 + 1] || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][n % 10 + 1] AS roman, n AS value FROM n"""
)
def roman_numerals(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_custkey") % 3999 + 1).alias("n")).distinct()
    return n.withColumn("roman", N.roman_numeral(F.col("n"))).withColumn("value", N.roman_value(F.col("roman")).cast("long"))


@query(
    "WITH "
    + O.WORDS
    + """, n AS (SELECT DISTINCT o_custkey % 999 + 1 AS n FROM orders)
    SELECT a.n, CASE WHEN a.n < 100 THEN w.words WHEN a.n % 100 = 0 THEN h.words || ' Hundred' ELSE h.words || ' Hundred and ' || w.words END AS words, a.n AS value
    FROM n a LEFT JOIN number_words w ON w.n = a.n % 100 LEFT JOIN number_words h ON h.n = a.n // 100"""
)
def numbers_in_words(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_custkey") % 999 + 1).alias("n")).distinct()
    return n.withColumn("words", N.number_in_words(F.col("n"))).withColumn("value", N.words_value(F.col("words")).cast("long"))


@query(
    """WITH RECURSIVE s AS (SELECT c_custkey AS id, CASE WHEN c_custkey > 1 THEN c_custkey // 2 END AS up, c_custkey % 3 = 0 AS bold, CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 40 END AS size FROM customer),
    c AS (SELECT id, id AS at, up, 0 AS depth FROM s UNION ALL SELECT c.id, s.id, s.up, depth + 1 FROM c JOIN s ON s.id = c.up)
    SELECT c.id::VARCHAR AS style_id, bool_or(bold) AS bold, arg_min(size, depth) FILTER (size IS NOT NULL)::INTEGER AS half_points, max(depth)::INTEGER AS depth FROM c JOIN s ON s.id = c.at GROUP BY c.id"""
)
def style_inheritance(spark, sf_dir):
    key = F.col("c_custkey")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    kinds = {c.strip().split(" ")[0]: c.strip().split(" ")[1] for c in Y.STYLE_COLUMNS.split(",")}
    own = {"bold": key % 3 == 0, "half_points": F.when(key % 5 == 0, (key % 40).cast("int"))}
    props = [own.get(n, F.lit(None).cast(k)).alias(n) for n, k in kinds.items()]
    styles = rows.select(
        F.lit(1).cast("long").alias("doc_id"), key.cast("int").alias("ord"), key.cast("string").alias("style_id"), key.cast("string").alias("style_name"), F.lit("paragraph").alias("type"), F.when(key > 1, F.floor(key / 2).cast("string")).alias("based_on"),
        F.lit(None).cast("string").alias("next"), (key == 1).alias("is_default"), *props,
    )
    return Y.resolve_styles(styles).select("style_id", "bold", "half_points", "depth")


@query(
    O.BLOCKS
    + f""", keyed AS (SELECT doc_id, idx, {O.collapse("text")} AS key FROM blocks), saved AS (SELECT doc_id, idx + doc_id % 3 AS pos, key, idx AS ord FROM keyed WHERE key <> '')
    SELECT doc_id, ord, arg_min(k.idx, abs(k.idx - pos) * 1000000 + k.idx) AS idx FROM saved JOIN keyed k USING (doc_id, key) GROUP BY doc_id, ord"""
)
def rebound_choices(spark, sf_dir):
    blocks = _blocks(spark, sf_dir).withColumn("auto_role", F.lit("body"))
    saved = blocks.select("doc_id", F.col("idx").alias("ord"), "text", F.lit("empty").alias("role"), (F.col("idx") + F.col("doc_id") % 3).alias("index"))
    return H.nearest_matches(saved, blocks).select("doc_id", "ord", "idx")


@query()
def greedy_choices(spark, sf_dir):
    blocks = _blocks(spark, sf_dir).withColumn("auto_role", F.lit("body"))
    saved = blocks.select("doc_id", F.col("idx").alias("ord"), "text", F.lit("empty").alias("role"), (F.col("idx") + F.col("doc_id") % 3).alias("index"))
    return H.rebind(saved, blocks)


@query(
    """WITH d AS (SELECT c_custkey AS doc_id, 'Book ' || c_custkey AS title, c_name AS author, CASE WHEN c_custkey % 2 = 0 THEN '2024' ELSE '' END AS y, CASE WHEN c_custkey % 3 = 0 THEN 'For X' || chr(10) || '  ' || chr(10) || 'and Y' ELSE '' END AS dedication FROM customer)
    SELECT doc_id, section, line, text FROM (
      SELECT doc_id, 'titlePage' AS section, 0 AS line, title AS text FROM d UNION ALL SELECT doc_id, 'titlePage', 1, author FROM d
      UNION ALL SELECT doc_id, 'copyrightPage', 0, 'Copyright © ' || trim(y || ' ' || author) FROM d
      UNION ALL SELECT doc_id, 'dedication', 0, 'For X' FROM d WHERE dedication <> '' UNION ALL SELECT doc_id, 'dedication', 1, 'and Y' FROM d WHERE dedication <> '')"""
)
def generated_pages(spark, sf_dir):
    key, empty = F.col("c_custkey"), F.lit("")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        key.alias("doc_id"), F.concat(F.lit("Book "), key.cast("string")).alias("title"), empty.alias("subtitle"), F.col("c_name").alias("author"), F.when(key % 2 == 0, "2024").otherwise("").alias("copyright_year"), empty.alias("publisher"), empty.alias("isbn"),
        F.when(key % 3 == 0, "For X\n  \nand Y").otherwise("").alias("dedication"), *[empty.alias(c) for c in ("also_by", "epigraph", "acknowledgments", "about_the_author", "bibliography")], F.array(F.lit("titlePage"), F.lit("copyrightPage"), F.lit("dedication")).alias("sections"),
    )
    return C.generated_matter(rows).select("doc_id", "section", "line", "text")
