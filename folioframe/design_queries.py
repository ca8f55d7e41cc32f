"""Registered queries of designs, styles, sections, packages and choices, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe import oracle as O
from folioframe.functions import geometry as G
from folioframe.functions import text as T
from folioframe.operators import choices as H
from folioframe.operators import compose as C
from folioframe.operators import packages as K
from folioframe.operators import profile as Pr
from folioframe.operators import structure as S
from folioframe.operators import styles as Y
from folioframe.operators.facts import paragraph_facts
from folioframe.queries import _PLAN, _PLAN_SQL, _analysed, _blocks, _styles, query
from folioframe.sources import docx as X
from folioframe.sources import templates


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _styled_with_breaks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Paragraphs of three styles with breaks of all kinds, and their designs: every fifth without a chapter style."""
    idx = F.col("idx")
    facts = _facts_of(_blocks(spark, sf_dir)).withColumn("style_id", F.concat(F.lit("S"), (((idx + F.col("doc_id")) % 3)).cast("string")))
    facts = facts.withColumn("style_id", F.when(F.col("is_empty") & (idx % 4 > 0), "S1").otherwise(F.col("style_id")))
    facts = facts.withColumn("page_break_before", idx % 4 == 2).withColumn("leading_page_break", idx % 6 == 1).withColumn("trailing_page_break", idx % 7 == 3)
    facts = facts.withColumn("section_break_type", F.when(idx % 11 == 5, "nextPage"))
    chapters = facts.select("doc_id").distinct().select("doc_id", F.when(F.col("doc_id") % 5 > 0, "S1").alias("chapter_style"), (F.col("doc_id") % 8 == 1).alias("style_breaks"))
    return facts, chapters


def _facts_of(blocks: DataFrame) -> DataFrame:
    return paragraph_facts(blocks).drop("style_id", "page_break_before", "leading_page_break", "trailing_page_break", "section_break_type")


_BROKEN = (
    O.FACTS
    + """, broken AS (SELECT doc_id, idx, is_empty, CASE WHEN is_empty AND idx % 4 > 0 THEN 'S1' ELSE 'S' || ((idx + doc_id) % 3) END AS style, idx % 4 = 2 OR idx % 6 = 1 AS own, idx % 6 = 1 OR idx % 7 = 3 OR idx % 11 = 5 AS ends FROM facts
    ), designs AS (SELECT DISTINCT doc_id, doc_id % 5 > 0 AS has_style, doc_id % 8 = 1 AS style_breaks FROM facts)"""
)


@query(
    _BROKEN
    + """, marked AS (SELECT b.*, is_empty AND style = 'S1' AND has_style AS blank, NOT is_empty AND style = 'S1' AND has_style AS title FROM broken b JOIN designs USING (doc_id)
    ), sunk AS (SELECT doc_id, title, idx - coalesce(max(CASE WHEN NOT blank THEN idx END) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) - 1 AS before,
        coalesce(min(CASE WHEN NOT blank THEN idx END) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), count(*) OVER (PARTITION BY doc_id)) - idx - 1 AS after FROM marked
    ), b AS (SELECT doc_id, arg_max(before, c * 1000 + before) AS before FROM (SELECT doc_id, before, count(*) AS c FROM sunk WHERE title GROUP BY ALL) GROUP BY doc_id
    ), a AS (SELECT doc_id, arg_max(after, c * 1000 + after) AS after FROM (SELECT doc_id, after, count(*) AS c FROM sunk WHERE title GROUP BY ALL) GROUP BY doc_id)
    SELECT doc_id, coalesce(before, 0) AS before, coalesce(after, 0) AS after FROM designs LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id)"""
)
def chapter_sinks(spark, sf_dir):
    return Y.chapter_sink(*_styled_with_breaks(spark, sf_dir))


@query(
    _BROKEN
    + """, solid AS (SELECT *, lag(ends) OVER (PARTITION BY doc_id ORDER BY idx) AS prev_ends FROM broken WHERE NOT is_empty
    ), shares AS (SELECT doc_id, avg(CASE WHEN own OR prev_ends IS NULL OR prev_ends THEN 1e0 ELSE 0e0 END) AS share FROM solid JOIN designs USING (doc_id) WHERE has_style AND style = 'S1' GROUP BY doc_id)
    SELECT doc_id, (has_style AND style_breaks) OR coalesce(share >= 6e-1, TRUE) AS new_page FROM designs LEFT JOIN shares USING (doc_id)"""
)
def chapters_on_new_pages(spark, sf_dir):
    return Y.starts_on_new_page(*_styled_with_breaks(spark, sf_dir))


@query(O.BLOCKS + " SELECT doc_id, idx, coalesce(sum(CASE WHEN text = '* * *' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS section FROM blocks")
def section_ordinals(spark, sf_dir):
    return Y.section_index(_blocks(spark, sf_dir).withColumn("section_break_type", F.when(F.col("text") == "* * *", "nextPage"))).select("doc_id", "idx", "section")


@query("SELECT o_custkey AS doc_id, coalesce(min(o_orderkey) FILTER (o_orderstatus = 'F' AND o_orderpriority <> '3-MEDIUM'), max(o_orderkey)) AS ord FROM orders GROUP BY o_custkey")
def body_sections(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("ord"), F.when(F.col("o_orderstatus") == "F", 1).alias("page_start"), F.when(F.col("o_orderpriority") == "3-MEDIUM", "lowerRoman").alias("page_format"))
    return Y.body_section(rows)


def _styled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    blocks = _blocks(spark, sf_dir).withColumn("style_id", F.when(F.col("idx") % 4 > 0, F.concat(F.lit("S"), ((F.col("idx") + F.col("doc_id")) % 3).cast("string"))))
    names = ("Base", "Chapter Head", "Scene Break", "Plain")
    kinds = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit("N" if i == 3 else f"S{i}").alias("style_id"), F.lit(n).alias("style_name"), F.lit(i == 3).alias("is_default")) for i, n in enumerate(names)])
    styles = blocks.select("doc_id").distinct().select("doc_id", F.inline(kinds)).select("*", F.lit("paragraph").alias("type"), F.lit(None).cast("string").alias("next"), F.lit(None).cast("int").alias("outline_level"), F.lit(None).cast("int").alias("left_indent_twips"))
    return paragraph_facts(blocks), styles


_STYLED = O.FACTS + ", styled AS (SELECT *, CASE WHEN idx % 4 > 0 THEN 'S' || ((idx + doc_id) % 3) ELSE 'N' END AS style_id FROM facts), uses AS (SELECT doc_id, style_id, count(*) AS uses, min(idx) AS first_idx FROM styled WHERE NOT is_empty GROUP BY ALL)"


@query(_STYLED + " SELECT * FROM uses")
def style_usage(spark, sf_dir):
    return Y.style_usage(*_styled(spark, sf_dir))


@query(_STYLED + " SELECT doc_id, arg_max(style_id, uses * 100000 - first_idx) AS style_id FROM uses GROUP BY doc_id")
def most_used_styles(spark, sf_dir):
    return Y.top_style(Y.style_usage(*_styled(spark, sf_dir)))


@query(_STYLED + " SELECT doc_id, CASE WHEN max(uses) FILTER (style_id = 'S1') >= coalesce(max(uses) FILTER (style_id = 'S2'), 0) OR max(uses) FILTER (style_id = 'S2') IS NULL THEN 'S1' ELSE 'S2' END AS style_id FROM uses GROUP BY doc_id")
def styles_by_pattern(spark, sf_dir):
    facts, styles = _styled(spark, sf_dir)
    return Y.style_by_pattern(styles, Y.style_usage(facts, styles).drop("first_idx"), "(?i)chapter|break")


@query(O.BLOCKS + " SELECT DISTINCT doc_id, 'S1' AS style_id FROM blocks")
def styles_by_name(spark, sf_dir):
    return Y.style_by_names(_styled(spark, sf_dir)[1], ["Body Text", "chapter-head", "Plain"])


@query()
def design_roles(spark, sf_dir):
    facts, styles = _styled(spark, sf_dir)
    return Pr.detect_roles(styles, Pr.style_votes(facts, styles))


@query(
    """WITH runs AS (SELECT l_orderkey AS doc_id, coalesce(CASE l_returnflag WHEN 'R' THEN 'fr' WHEN 'A' THEN 'de' END, 'en') AS lang, l_quantity::BIGINT AS n, l_partkey * 100 + l_linenumber AS place FROM lineitem),
    sums AS (SELECT doc_id, lang, sum(n) AS w, min(place) AS place FROM runs GROUP BY ALL)
    SELECT doc_id, arg_max(lang, w * 1000000000 - place) AS lang FROM sums WHERE w > 0 GROUP BY doc_id"""
)
def dominant_languages(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem")
    lang = F.when(F.col("l_returnflag") == "R", "fr").when(F.col("l_returnflag") == "A", "de")
    runs = rows.select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("idx"), F.col("l_linenumber").alias("run"), lang.alias("lang"), F.expr("repeat('x', cast(l_quantity as int))").alias("text"))
    return Y.dominant_language(runs, runs.select("doc_id").distinct().withColumn("lang", F.lit("en")))


@query(
    """WITH used AS (SELECT l_orderkey AS doc_id, l_suppkey AS old_id, min(l_linenumber * 100000 + l_partkey) AS place FROM lineitem WHERE l_suppkey > 0 GROUP BY ALL)
    SELECT u.doc_id, old_id, coalesce(o_custkey, 0) + row_number() OVER (PARTITION BY u.doc_id ORDER BY place, old_id) AS new_id FROM used u LEFT JOIN orders ON o_orderkey = u.doc_id"""
)
def merged_note_ids(spark, sf_dir):
    used = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_suppkey").alias("old_id"), (F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("ord"))
    return K.merged_numbers(used, _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("id")))


@query(
    """WITH old AS (SELECT o_custkey AS doc_id, 'rId' || (o_orderkey % 50) AS rel_id, o_orderstatus AS type, o_orderpriority AS target, o_orderkey AS ord FROM orders WHERE o_orderkey % 2 = 0),
    new AS (SELECT o_custkey AS doc_id, o_orderstatus AS type, o_orderpriority AS target, CASE WHEN o_orderkey % 5 = 0 THEN 'External' END AS target_mode, o_orderkey AS ord FROM orders WHERE o_orderkey % 2 = 1),
    known AS (SELECT doc_id, type, target, arg_min(rel_id, ord) AS rel_id FROM old GROUP BY ALL), top AS (SELECT doc_id, max(CAST(substring(rel_id, 4) AS INTEGER)) AS top FROM old GROUP BY doc_id),
    fresh AS (SELECT n.*, CASE WHEN target_mode IS NULL THEN min(ord) FILTER (target_mode IS NULL) OVER (PARTITION BY n.doc_id, n.type, n.target) ELSE ord END AS lead FROM new n LEFT JOIN known k ON k.doc_id = n.doc_id AND k.type = n.type AND k.target = n.target WHERE target_mode IS NOT NULL OR k.rel_id IS NULL)
    SELECT f.doc_id, 'rId' || (coalesce(top, 0) + dense_rank() OVER (PARTITION BY f.doc_id ORDER BY lead)) AS rel_id, type, target, target_mode, ord FROM fresh f LEFT JOIN top t ON t.doc_id = f.doc_id
    UNION ALL SELECT n.doc_id, k.rel_id, n.type, n.target, NULL, n.ord FROM new n JOIN known k ON k.doc_id = n.doc_id AND k.type = n.type AND k.target = n.target WHERE target_mode IS NULL"""
)
def added_relationships(spark, sf_dir):
    key = F.col("o_orderkey")
    rows = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.concat(F.lit("rId"), (key % 50).cast("string")).alias("rel_id"), F.col("o_orderstatus").alias("type"), F.col("o_orderpriority").alias("target"), F.when((key % 2 == 1) & (key % 5 == 0), "External").alias("target_mode"), key.alias("ord"))
    return K.add_relationships(rows.filter("ord % 2 = 0"), rows.filter("ord % 2 = 1").drop("rel_id"))


@query("SELECT DISTINCT p_size AS doc_id, 'Default' AS kind, p_brand AS key, CASE WHEN p_brand IN (SELECT p_brand FROM part q WHERE q.p_size = p.p_size AND q.p_partkey % 2 = 0) THEN 'old' ELSE 'new' END AS content_type FROM part p")
def ensured_content_types(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    make = lambda rows, kind: rows.select(F.col("p_size").alias("doc_id"), F.lit("Default").alias("kind"), F.col("p_brand").alias("key"), F.lit(kind).alias("content_type"))
    return K.ensure_content_types(make(part.filter("p_partkey % 2 = 0"), "old").distinct(), make(part, "new"))


@query(
    O.BLOCKS
    + """, runs AS (SELECT doc_id, i AS run, line AS text, coalesce(sum(length(line)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM lines),
    cut AS (SELECT doc_id, run, text, least(greatest(40 + doc_id % 100 - f, 0), length(text))::INTEGER AS n FROM runs)
    SELECT doc_id, run, 0 AS part, substring(text, 1, n) AS text, TRUE AS is_lead FROM cut WHERE n > 0 UNION ALL SELECT doc_id, run, 1, substring(text, n + 1), FALSE FROM cut WHERE n < length(text)"""
)
def split_text_runs(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    runs = docs.select("doc_id", F.lit(0).alias("idx"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("run", "text"))
    return K.split_runs(runs, docs.select("doc_id", F.lit(0).alias("idx"), (F.lit(40) + F.col("doc_id") % 100).cast("int").alias("at"))).drop("idx")


@query("SELECT p_name AS name, p_size AS size, p_brand AS type, ord, CASE WHEN n = 1 THEN p_name ELSE p_name || ' (' || n || ')' END AS label FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY ord) AS n FROM (SELECT p_name, p_size, p_brand, min(p_partkey) AS ord FROM part GROUP BY ALL))")
def remembered_files(spark, sf_dir):
    files = _table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.lit(0).alias("mtime"), F.col("p_brand").alias("type"), F.col("p_partkey").alias("ord"))
    return K.remembered_names(files).drop("mtime")


@query("SELECT l_orderkey AS doc_id, l_linenumber AS idx, floor(min(least(l_partkey / (l_quantity * 100000 / 914400e0), l_suppkey / (l_extendedprice * 10 / 914400e0))) + 5e-1)::INTEGER AS min_dpi FROM lineitem WHERE l_partkey > 0 AND l_suppkey > 0 AND l_quantity > 0 AND l_extendedprice > 0 GROUP BY ALL")
def picture_resolution(spark, sf_dir):
    return K.worst_resolution(_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("idx"), F.col("l_partkey").alias("width_px"), F.col("l_suppkey").alias("height_px"), (F.col("l_quantity") * 100000).alias("cx"), (F.col("l_extendedprice") * 10).alias("cy")))


@query(
    """WITH c AS (SELECT c_custkey AS id, c_custkey % 7 AS k FROM customer)
    SELECT id AS doc_id, k <> 6 AS is_choices, CASE WHEN k <> 6 THEN CASE WHEN k = 0 THEN 1 ELSE k END END::INTEGER AS version, CASE WHEN k <> 6 THEN CASE WHEN k = 1 THEN 'oddPage' ELSE 'newPage' END END AS chapter_start, CASE WHEN k <> 6 THEN k = 2 END AS renumber, CASE WHEN k <> 6 THEN CASE WHEN k = 3 THEN 1 ELSE 2 END END::BIGINT AS overrides FROM c"""
)
def parsed_choices(spark, sf_dir):
    key, k = F.col("c_custkey"), F.col("c_custkey") % 7
    start = F.when(k == 1, '"oddPage"').when(k == 4, "7").otherwise('"sideways"')
    items = F.when(k == 3, '{"text": "a", "role": "king"}').otherwise('{"text": "a", "role": "body", "index": 4}')
    json = F.concat(F.lit('{"format": "'), F.when(k == 6, "other").otherwise(H.FORMAT), F.lit('", "version": '), F.when(k == 0, '"x"').otherwise(k.cast("string")), F.lit(', "options": {"chapterStart": '), start, F.lit(', "renumberChapters": '), F.when(k == 2, "true").otherwise('"yes"'), F.lit('}, "overrides": ['), items, F.lit(', {"text": "b", "role": "empty"}]}'))
    rows = H.parse_choices(_table(spark, sf_dir, "customer").select(key.alias("doc_id"), json.alias("json")))
    return rows.select("doc_id", "is_choices", "version", F.col("chapterStart").alias("chapter_start"), F.col("renumberChapters").alias("renumber"), F.when(F.col("is_choices"), F.size("overrides")).cast("long").alias("overrides"))


@query(O.BLOCKS + f" SELECT doc_id, idx, {O.collapse('text')} AS text, 'body' AS role FROM blocks WHERE {O.collapse('text')} <> ''")
def serialized_overrides(spark, sf_dir):
    blocks = _blocks(spark, sf_dir)
    return H.serialize_overrides(blocks.select("doc_id", "idx", F.lit("body").alias("role")), blocks)


@query(O.ROLES + " SELECT role, count(*) AS n FROM (SELECT CASE WHEN text = '* * *' THEN 'blockQuote' ELSE role END AS role FROM roles) GROUP BY role")
def roles_with_overrides(spark, sf_dir):
    blocks = _analysed(spark, sf_dir).drop("role")
    return S.effective_roles(blocks, _blocks(spark, sf_dir).filter("text = '* * *'").select("doc_id", "idx", F.lit("blockQuote").alias("role"))).groupBy("role").agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 2 = 0 THEN 'oddPage' WHEN c_custkey % 3 = 0 THEN 'newPage' ELSE 'continuous' END AS chapter_start, c_custkey % 5 = 0 AS first_no_indent, c_custkey % 7 = 0 AS opener_no_header, c_custkey % 3 = 0 OR c_custkey % 5 = 0 AS hyphenate, c_custkey % 11 <> 0 AND c_custkey % 4 > 1 AS contents FROM customer")
def suggested_options(spark, sf_dir):
    k = F.col("c_custkey")
    return Pr.suggest_options(_table(spark, sf_dir, "customer").select(k.alias("doc_id"), (k % 2 == 0).alias("odd_page"), (k % 3 == 0).alias("new_page"), (k % 5 == 0).alias("first_no_indent"), (k % 7 == 0).alias("has_headers"), (k % 3 == 0).alias("hyphenates"), (k % 5 == 0).alias("justified"), (k % 11 == 0).alias("has_contents"), (k % 4).alias("chapters")))


@query("SELECT c_custkey AS doc_id, 'p' AS part, ['BOOK TITLE', '[Your Name]', 'Subtitle', 'My own head', 'Book Title'][c_custkey % 5 + 1] AS text, CASE c_custkey % 5 WHEN 0 THEN upper(c_mktsegment || ' x') WHEN 1 THEN c_name WHEN 4 THEN c_mktsegment || ' x' ELSE ['', '', 'Subtitle', 'My own head', ''][c_custkey % 5 + 1] END AS new_text FROM customer")
def rewritten_heads(spark, sf_dir):
    rows, k = _table(spark, sf_dir, "customer"), F.col("c_custkey")
    heads = rows.select(k.alias("doc_id"), F.lit("p").alias("part"), F.get(F.array(*map(F.lit, ("BOOK TITLE", "[Your Name]", "Subtitle", "My own head", "Book Title"))), (k % 5).cast("int")).alias("text"))
    return Pr.running_heads(heads, rows.select(k.alias("doc_id"), F.concat("c_mktsegment", F.lit(" x")).alias("title"), F.col("c_name").alias("author"), F.lit("").alias("subtitle")))


@query(
    "SELECT t.id || '-' || k.id AS design_id, s.ord, s.style_id, CASE WHEN s.a = 'both' AND NOT k.j THEN 'left' ELSE s.a END AS alignment, CASE WHEN s.style_id = 'BookBody' THEN 432 WHEN s.style_id <> 'Normal' THEN 0 END AS first_line_twips, k.font, k.hp AS half_points, k.line FROM (VALUES "
    + ", ".join(f"({O.q(t[0])})" for t in G.TRIMS)
    + ") t(id), (VALUES ('classic', 'Garamond', 23, 276, TRUE), ('modern', 'Georgia', 21, 300, TRUE), ('minimal', 'Cambria', 22, 288, FALSE), ('largePrint', 'Georgia', 32, 312, FALSE)) k(id, font, hp, line, j), (VALUES "
    + ", ".join(f"({i}, {O.q(s[0])}, {O.q(s[2]) if s[2] else 'NULL'})" for i, s in enumerate(templates.STYLES))
    + ") s(ord, style_id, a)"
)
def built_in_styles(spark, sf_dir):
    return templates.template_styles(spark).drop("role")


@query(_PLAN_SQL + " SELECT doc_id, out_ord AS idx, text, style_id FROM plan")
def written_packages(spark, sf_dir):
    packages = X.new_packages(C.output_plan(_analysed(spark, sf_dir), _styles(), _PLAN))
    return X.paragraphs(packages).select("doc_id", "idx", "text", "style_id")


@query("SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'word/media/' || p_brand WHEN 1 THEN 'media/' || p_brand WHEN 2 THEN 'docs/' || p_brand ELSE 'word/' || p_brand END AS target FROM part")
def resolved_targets(spark, sf_dir):
    k, b = F.col("p_partkey"), F.col("p_brand")
    target = F.when(k % 4 == 0, F.concat(F.lit("media/"), b)).when(k % 4 == 1, F.concat(F.lit("../media/./"), b)).when(k % 4 == 2, F.concat(F.lit("/docs/x/../"), b)).otherwise(b)
    return _table(spark, sf_dir, "part").select(k.alias("id"), T.resolve_target(F.lit("word/document.xml"), target).alias("target"))
