"""Typography, names, identifiers and other scalar functions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioframe.functions.patterns import WS, collapsed, trimmed

# Wording that a design's running heads use for what goes there, and lines that are no names.
HEAD_TITLE = r"(?i)^\[?\s*(your\s+)?(book\s*)?title\s*(goes\s*here)?\s*\]?$"
HEAD_AUTHOR = r"(?i)^\[?\s*(by\s+)?(your\s+|the\s+)?(author('s)?\s*)?name\s*(goes\s*here)?\s*\]?$|^\[?\s*author\s*\]?$"
HEAD_SUBTITLE = r"(?i)^\[?\s*(book\s*)?subtitle\s*(goes\s*here)?\s*\]?$"
NOT_A_NAME = r"(?i)^(a novel|a memoir|a story|stories|copyright|all rights|first edition|isbn|printed|published|www\.|http)"
YEAR = r"(?i)(?:©|\(c\)|copyright)\s*(?:©\s*)?(\d{4})|\b(\d{4})\s*(?:by\b)"
BY_LINE = r"(?i)^(?:by|written by)\s+(.{2,80})$"
COPYRIGHT_NAME = r"(?i)(?:©|\(c\)|copyright)\s*(?:©\s*)?\d{4}\s*,?\s*(?:by\s+)?(.{2,80}?)\s*$"
ISBN = r"\bISBN(?:-1[03])?:?\s*((?:97[89][-\s]?)?[\d][\d\-\s]{7,20}[\dXx])"
OPENS_QUOTE = f"[{WS}(\\[{{<—–“‘\\-]"
# End of fixed values.


def check_isbn(raw: Column) -> Column:
    """ok, checksum or length."""
    d = F.upper(F.regexp_replace(raw, f"[{WS}-]", ""))
    at = lambda i: F.substr(d, i, F.lit(1))
    places = lambda n: F.sequence(F.lit(1), F.lit(n))
    thirteen = F.aggregate(places(13), F.lit(0), lambda s, i: s + F.coalesce(at(i).try_cast("int"), F.lit(0)) * F.when(i % 2 == 1, 1).otherwise(3))
    ten = F.aggregate(places(10), F.lit(0), lambda s, i: s + F.when(at(i) == "X", 10).otherwise(F.coalesce(at(i).try_cast("int"), F.lit(0))) * (F.lit(11) - i))
    verdict = lambda ok: F.when(ok, "ok").otherwise("checksum")
    return F.when(d.rlike("^[0-9]{13}$"), verdict(thirteen % 10 == 0)).when(d.rlike("^[0-9]{9}[0-9X]$"), verdict(ten % 11 == 0)).otherwise("length")


def read_isbn(text: Column) -> Column:
    """The ISBN in a line as typed but for spaces, or null."""
    value = F.regexp_replace(trimmed(F.regexp_extract(text, ISBN, 1)), r"\s+", "")
    return F.when(F.length(F.regexp_replace(value, "[^0-9Xx]", "")).isin(10, 13), value)


def cleaned(text: Column) -> Column:
    """Collapsed, without the full stops, commas or semicolons at its end; null if nothing is left."""
    t = F.regexp_replace(collapsed(text), "[.,;]+$", "")
    return F.when(t != "", t)


def lead_in_length(text: Column) -> Column:
    """Characters of the first four words at most, cut after the first punctuation and closing marks."""
    lead = F.regexp_extract(text, r"^\s*(?:\S+\s+){0,3}\S+", 0)
    cut = F.regexp_extract(lead, r"^\s*[^\s.!?;:,—–][^.!?;:,—–]*[.!?;:,—–][”’\"')]*|^\s*[.!?;:,—–](?![\s\S]*)", 0)
    opens = F.regexp_extract(lead, r"^\s*[.!?;:,—–]", 0) != ""
    return F.when(lead == "", 0).when((cut != "") & ~opens, F.length(cut)).otherwise(F.length(lead))


def smarten(text: Column, before: Column | None = None) -> Column:
    """Dashes, ellipses and curly quotes. ``before`` is the last character of the run before; null at a paragraph's start.

    Quotes are told apart by the character before as typed: one that doesn't open goes first, and closing marks, like
    typed ones, open nothing, so what is left then opens.
    """
    t = F.regexp_replace(text, r"(\S)---(\S)", "$1—$2")
    t = F.regexp_replace(t, r"(\S)--(\S)", "$1—$2")
    t = F.regexp_replace(F.regexp_replace(t, " -- ", "—"), r"\.\.\.", "…")
    if before is not None:
        before = F.coalesce(before, F.lit(" "))
        t = F.concat(before, t)
    for mark, closing in (('"', "”"), ("'", "’")):
        t = F.regexp_replace(t, f"(?<=[^{OPENS_QUOTE[1:]}){mark}", closing)
    t = F.translate(t, "\"'", "“‘")
    return t if before is None else F.substr(t, F.length(before) + 1)


def collapse_spaces(text: Column) -> Column:
    return F.regexp_replace(text, " {2,}", " ")


def strip_manual_indent(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\t ]+", "")


def match_case(original: Column, replacement: Column) -> Column:
    letters = F.regexp_replace(original, "[^A-Za-z]", "")
    return F.when((F.length(letters) > 1) & (letters == F.upper(letters)), F.upper(replacement)).otherwise(replacement)


def text_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\r?\n"), trimmed), lambda x: x != "")


def escape_xml(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def output_name(name: Column) -> Column:
    return F.concat(F.regexp_replace(name, r"(?i)\.docx$", ""), F.lit(" (formatted).docx"))


def running_head_detail(text: Column) -> Column:
    """Which detail a running head's placeholder stands for: title, author, subtitle or null."""
    t = trimmed(text)
    return F.when(t.rlike(HEAD_TITLE), "title").when(t.rlike(HEAD_AUTHOR), "author").when(t.rlike(HEAD_SUBTITLE), "subtitle")


def has_page_field(instruction: Column) -> Column:
    return instruction.rlike(r"(?i)\bPAGE\b")


def normalize_path(path: Column) -> Column:
    """A part's path without "." and with ".." taken back; the root slash goes."""
    step = lambda out, p: F.when(p.isin("", "."), out).when(p == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(p)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def resolve_target(owner: Column, target: Column) -> Column:
    """The part that a relationship of ``owner`` points at."""
    folder = F.regexp_replace(owner, "[^/]*$", "")
    return normalize_path(F.when(target.startswith("/"), target).otherwise(F.concat(folder, target)))
