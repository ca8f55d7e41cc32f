"""DuckDB SQL for the queries, written apart from the column expressions that they check."""

from __future__ import annotations

from folioframe.functions import patterns as P

WS = P.WS


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def matches(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {q(pattern)})"


def any_of(column: str, patterns: tuple[str, ...]) -> str:
    return "(" + " OR ".join(matches(column, p) for p in patterns) + ")"


def trim(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^[{WS}]+|[{WS}]+$')}, '', 'g')"


def collapse(x: str) -> str:
    return trim(f"regexp_replace({x}, {q(f'[{WS}]+')}, ' ', 'g')")


def opens(words: tuple[str, ...]) -> str:
    return matches("trimmed", f"(?i)^(?:{'|'.join(words)})(?:$|[^\\pL\\pN])")


def listed(words: list[str]) -> str:
    return "[" + ", ".join(map(q, words)) + "]"


_dense = f"regexp_replace(trimmed, {q(f'[{WS}]+')}, '', 'g')"
_number = trim(f"regexp_replace(trimmed, {q('[.:—–-]+$')}, '')")
_words = f"regexp_split_to_array(lower({_number}), {q(f'[{WS}-]+')})"
_case = f"list_filter(regexp_split_to_array(trimmed, {q(f'[{WS}]+')}), lambda w: regexp_matches(w, '[A-Za-z]'))"
_significant = f"list_filter({_case}, lambda w, i: i = 1 OR NOT list_contains({listed(P.MINOR_WORDS.split())}, lower(w)))"

BLOCKS = """
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents
), made AS (
    SELECT doc_id, 4 * i AS ord, ['Chapter ', 'CHAPTER ', '', 'Capítulo ', 'Kapitel '][doc_id % 5 + 1] || CAST(i // 9 + CASE WHEN doc_id % 7 = 0 AND i > 18 THEN 1 ELSE 0 END AS VARCHAR) AS text, TRUE AS centered FROM lines WHERE i > 0 AND i % 9 = 0
    UNION ALL SELECT doc_id, 4 * i + 1, '* * *', TRUE FROM lines WHERE i % 5 = 3
    UNION ALL SELECT doc_id, 4 * i + 2, line, FALSE FROM lines
    UNION ALL SELECT doc_id, 4 * i + 3, '', FALSE FROM lines WHERE i % 4 = 1
), blocks AS (
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS idx, text, centered FROM made
)"""

FACTS = (
    BLOCKS
    + f""", trims AS (SELECT *, {trim("text")} AS trimmed FROM blocks), facts AS (
    SELECT *, trimmed = '' AS is_empty,
      CASE WHEN trimmed = '' THEN 0 ELSE len(regexp_split_to_array(trimmed, {q(f"[{WS}]+")})) END AS word_count,
      length(trimmed) AS char_count, trimmed = upper(trimmed) AND regexp_matches(trimmed, '[A-Z]') AS all_caps,
      CASE WHEN length({collapse("text")}) > 140 THEN substring({collapse("text")}, 1, 139) || '…' ELSE {collapse("text")} END AS preview,
      length(trimmed) BETWEEN 1 AND 24 AND length({_dense}) <= 9 AND (regexp_matches({_dense}, {q(f"^[{P._class(P.STRONG_ORNAMENTS)}]+$")}) OR (regexp_matches({_dense}, {q(f"^[{P._class(P.WEAK_ORNAMENTS)}]+$")}) AND length({_dense}) >= 3)) AS is_ornament,
      CASE WHEN {opens(P.PART_WORDS)} THEN 'part' WHEN {opens(P.CHAPTER_WORDS)} THEN 'chapter' WHEN {opens(P.FRONT_WORDS)} THEN 'frontMatter' WHEN {opens(P.BACK_WORDS)} THEN 'backMatter' END AS label,
      CASE WHEN {_number} = '' OR length({_number}) > 40 THEN NULL WHEN regexp_matches({_number}, '^[0-9]{{1,3}}$') THEN 85e-2 WHEN lower({_number}) = 'i' THEN 35e-2
           WHEN regexp_matches({_number}, '(?i)^[ivxlcdm]+$') THEN 7e-1 WHEN len({_words}) <= 2 AND len(list_filter({_words}, lambda w: NOT list_contains({listed(P.number_words())}, w))) = 0 THEN 7e-1 END AS number_conf,
      length(trimmed) BETWEEN 1 AND 600 AND {any_of("trimmed", P.COPYRIGHT_MARKERS)} AS is_copyright,
      {any_of("text", P.PLACEHOLDERS)} AS is_placeholder,
      trimmed <> '' AND ((trimmed = upper(trimmed) AND regexp_matches(trimmed, '[A-Z]')) OR
        (len({_significant}) > 0 AND len(list_filter({_significant}, lambda w: regexp_matches(w, '^[^a-z]*[A-Z]'))) / len({_significant}) >= 8e-1)) AS heading_case,
      regexp_matches(trimmed, {q("[.!?…][\"'”’)\\]]?$")}) AS ends_sentence
    FROM trims
)"""
)

CONTEXT = (
    FACTS
    + """, prose AS (
    SELECT doc_id, list_sort(list(word_count))[count(*) // 2 + 1] AS median_prose_words FROM facts WHERE NOT is_empty AND word_count >= 12 GROUP BY doc_id
), context AS (
    SELECT f.*, FALSE AS broken_before,
      coalesce(lag(is_empty) OVER w, FALSE) AS blank_before,
      max(CASE WHEN NOT is_empty THEN idx END) OVER (PARTITION BY f.doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NULL AS is_first_block,
      coalesce(median_prose_words, 0) AS median_prose_words
    FROM facts f LEFT JOIN prose USING (doc_id) WINDOW w AS (PARTITION BY f.doc_id ORDER BY idx)
)"""
)

SCORED = (
    CONTEXT
    + """, scored AS (
    SELECT *, greatest(0e0, 0e0
      + (CASE WHEN label IN ('chapter', 'part') THEN 5e-1 WHEN label IS NOT NULL THEN 42e-2 ELSE 0e0 END)
      + (CASE WHEN number_conf IS NOT NULL THEN 4e-1 * number_conf + 12e-2 ELSE 0e0 END)
      + 0e0
      + (CASE WHEN is_first_block THEN 8e-2 ELSE 0e0 END)
      + (CASE WHEN word_count <= 3 THEN 14e-2 WHEN word_count <= 8 THEN 1e-1 WHEN word_count <= 12 THEN 2e-2 WHEN word_count > 15 THEN -6e-1 ELSE -2e-1 END)
      + (CASE WHEN centered THEN 16e-2 ELSE 0e0 END)
      + 0e0
      + (CASE WHEN all_caps AND word_count <= 12 THEN 1e-1 ELSE 0e0 END)
      + (CASE WHEN NOT ends_sentence THEN 1e-1 WHEN word_count > 5 THEN -28e-2 ELSE 0e0 END)
      + (CASE WHEN heading_case AND word_count <= 12 THEN 8e-2 ELSE 0e0 END)
      + (CASE WHEN blank_before THEN 5e-2 ELSE 0e0 END)
      + (CASE WHEN median_prose_words > 0 AND word_count > 0 AND word_count < median_prose_words / 6 THEN 6e-2 ELSE 0e0 END)
      + (CASE WHEN regexp_matches(trimmed, '^["''“‘]') THEN -35e-2 ELSE 0e0 END)
      + (CASE WHEN regexp_matches(trimmed, '[,;:]$') THEN -3e-1 ELSE 0e0 END)) AS heading_score
    FROM context
), core AS (
    SELECT *, (label IS NOT NULL OR coalesce(number_conf >= 7e-1, FALSE)) AS structural_marker,
      CASE WHEN is_empty THEN 'empty' WHEN is_ornament THEN 'sceneBreak' WHEN is_copyright AND word_count <= 60 THEN 'body'
           WHEN heading_score >= 55e-2 THEN CASE WHEN label = 'part' THEN 'partTitle' ELSE 'chapterTitle' END
           WHEN heading_score >= 38e-2 AND word_count <= 8 AND NOT ends_sentence THEN 'subheading' ELSE 'body' END AS role0,
      CASE WHEN is_empty THEN 1e0 WHEN is_ornament THEN 95e-2 WHEN is_copyright AND word_count <= 60 THEN 8e-1
           WHEN heading_score >= 55e-2 THEN least(95e-2, heading_score) WHEN heading_score >= 38e-2 AND word_count <= 8 AND NOT ends_sentence THEN heading_score
           WHEN heading_score > 3e-1 THEN 6e-1 ELSE 9e-1 END AS confidence
    FROM scored
)"""
)

ROLES = (
    SCORED
    + """, starts AS (
    SELECT doc_id, coalesce(min(idx) FILTER (role0 IN ('chapterTitle', 'partTitle') AND structural_marker), min(idx) FILTER (role0 IN ('chapterTitle', 'partTitle'))) AS body_start FROM core GROUP BY doc_id
), fronts AS (
    SELECT c.*, body_start, coalesce(idx < body_start, FALSE) AND role0 <> 'empty' AS is_front FROM core c JOIN starts USING (doc_id)
), titles AS (
    SELECT doc_id, min(idx) AS title_idx FROM fronts WHERE is_front AND (role0 = 'subheading' OR (word_count <= 12 AND idx <= 2)) GROUP BY doc_id
), split AS (
    SELECT f.*, CASE WHEN is_front AND idx = title_idx THEN 'frontMatterTitle' WHEN is_front THEN 'frontMatter' ELSE role0 END AS role1 FROM fronts f LEFT JOIN titles USING (doc_id)
), notices AS (
    SELECT doc_id, bool_or(is_copyright) AS has_notice FROM split WHERE idx < body_start AND NOT is_empty GROUP BY doc_id
), pages AS (
    SELECT s.*, CASE WHEN has_notice AND role1 IN ('frontMatter', 'frontMatterTitle') THEN 'copyright' ELSE role1 END AS role2 FROM split s LEFT JOIN notices USING (doc_id)
), following AS (
    SELECT doc_id, idx, lag(role2) OVER (PARTITION BY doc_id ORDER BY idx) = 'chapterTitle' AND NOT structural_marker AND word_count <= 12
      AND (role2 IN ('chapterTitle', 'partTitle') OR (role2 = 'subheading' AND confidence < 7e-1)) AS can FROM pages WHERE role2 <> 'empty'
), runs AS (
    SELECT doc_id, idx, coalesce(can, FALSE) AS can, sum(CASE WHEN coalesce(can, FALSE) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY idx) AS run FROM following
), folds AS (
    SELECT doc_id, idx, can AND row_number() OVER (PARTITION BY doc_id, run, can ORDER BY idx) % 2 = 1 AS fold FROM runs
), folded AS (
    SELECT p.*, CASE WHEN fold THEN 'chapterSubtitle' ELSE role2 END AS role3 FROM pages p LEFT JOIN folds USING (doc_id, idx)
), events AS (
    SELECT *, max(CASE WHEN role3 IN ('chapterTitle', 'partTitle', 'chapterSubtitle', 'subheading', 'sceneBreak') THEN idx * 2 + 1 WHEN role3 IN ('body', 'frontMatter') THEN idx * 2 END)
      OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS event FROM folded
), roles AS (
    SELECT *, CASE WHEN role3 = 'body' AND (event IS NULL OR event % 2 = 1) THEN 'bodyFirst' ELSE role3 END AS role FROM events
)"""
)

NUMBERED = (
    ROLES
    + f""", parsed AS (
    SELECT doc_id, idx, text, TRY_CAST(regexp_extract(trimmed, '([0-9]+)$', 1) AS INTEGER) AS number,
      regexp_extract(trimmed, '^(\\pL+) ', 1) AS label_text
    FROM roles WHERE role = 'chapterTitle' AND regexp_matches(trimmed, {q("^(?:(?:Chapter|CHAPTER|Capítulo|Kapitel) )?[0-9]{1,3}$")})
), numbered AS (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS ordinal, lag(number) OVER (PARTITION BY doc_id ORDER BY idx) AS prev FROM parsed
)"""
)

#: Numbers below a thousand in words, for joins.
WORDS = """number_words AS (
    SELECT n, CASE WHEN n < 20 THEN ones[n] WHEN n % 10 = 0 THEN tens[n // 10] ELSE tens[n // 10] || '-' || ones[n % 10] END AS words FROM (
        SELECT unnest(range(1, 100)) AS n, ['One','Two','Three','Four','Five','Six','Seven','Eight','Nine','Ten','Eleven','Twelve','Thirteen','Fourteen','Fifteen','Sixteen','Seventeen','Eighteen','Nineteen'] AS ones,
               ['Ten','Twenty','Thirty','Forty','Fifty','Sixty','Seventy','Eighty','Ninety'] AS tens))"""
