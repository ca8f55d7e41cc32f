"""Chapter numbers: reading them from titles and writing them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions.patterns import collapsed

# How numbers are spelled and which words label a chapter.
ONES = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
LABEL = r"chapter|chap\.?|ch\.?|section|interlude|episode|canto|scene|cap[íi]tulo|cap\.?|chapitre|kapitel|kap\.?|capitolo|hoofdstuk"
ENGLISH_LABEL = r"chapter|chap\.?|ch\.?|section|interlude|episode|canto|scene|part"
ROMAN = "M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})"
# End of fixed values.

_VALUES = {w: i for i, w in enumerate(ONES, 1)} | {w: 10 * i for i, w in enumerate(TENS, 2)}


def roman_value(text: Column) -> Column:
    """Value of a roman numeral in capitals: a smaller sign before a larger one is taken off."""
    pairs = (("M", 1000), ("D", 500), ("C", 100), ("L", 50), ("X", 10), ("V", 5), ("I", 1))
    value = lambda c: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in pairs for x in p]), c), F.lit(0))
    signs = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), value)
    return F.aggregate(F.reverse(signs), F.struct(F.lit(0).alias("total"), F.lit(0).alias("after")), lambda a, v: F.struct(F.when(v < a["after"], a["total"] - v).otherwise(a["total"] + v).alias("total"), v.alias("after")), lambda a: a["total"])


def words_value(text: Column) -> Column:
    """Value of an English number in words below 1000 or so ("One Hundred and Two"); null if the words don't make one."""
    known = F.create_map(*[F.lit(x) for p in _VALUES.items() for x in p])
    words = F.filter(F.split(F.lower(text), r"[\s-]+"), lambda w: (w != "") & (w != "and"))
    bad = F.lit(-1)

    def step(total: Column, w: Column) -> Column:
        v = F.coalesce(F.element_at(known, w), bad)
        clash = ((total % 100 != 0) & (total % 10 != 0) & (v < 10)) | ((total % 100 != 0) & (v >= 10))
        return F.when(total == bad, bad).when(w == "hundred", F.when(total == 0, F.lit(100)).otherwise(total * 100)).when((v == bad) | clash, bad).otherwise(total + v)

    total = F.aggregate(words, F.lit(0), step)
    return F.when(total > 0, total)


def number_in_words(n: Column) -> Column:
    """21 as "Twenty-One"; numbers outside 1 to 999 as digits."""
    ones, tens = F.array(*[F.lit(w.capitalize()) for w in ONES]), F.array(*[F.lit(w.capitalize()) for w in TENS])
    n = n.cast("int")
    hundreds, rest = F.floor(n / 100).cast("int"), n % 100
    below = F.when(rest < 20, F.get(ones, rest - 1)).otherwise(F.concat(F.get(tens, F.floor(rest / 10).cast("int") - 2), F.when(rest % 10 > 0, F.concat(F.lit("-"), F.get(ones, rest % 10 - 1))).otherwise("")))
    top = F.concat(F.get(ones, hundreds - 1), F.lit(" Hundred"))
    words = F.when(hundreds == 0, below).when(rest == 0, top).otherwise(F.concat(top, F.lit(" and "), below))
    return F.when((n <= 0) | (n >= 1000), n.cast("string")).otherwise(words)


def roman_numeral(n: Column) -> Column:
    """Roman numeral of 1 to 3999; other numbers as digits."""
    n = n.cast("int")

    def digit(unit: int, one: str, five: str, ten: str) -> Column:
        signs = ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten]
        return F.get(F.array(*map(F.lit, signs)), F.floor(n / unit).cast("int") % 10)

    return F.when((n <= 0) | (n >= 4000), n.cast("string")).otherwise(F.concat(digit(1000, "M", "", ""), digit(100, "C", "D", "M"), digit(10, "X", "L", "C"), digit(1, "I", "V", "X")))


def with_parsed_title(titles: DataFrame, text: str = "text") -> DataFrame:
    """Adds parsed, a struct (label, label_gap, number, form, number_text, separator, rest, caps), null without a number.

    The label, if any, ends where a space or the title ends. The number is digits, a roman numeral below 400 or the longest
    run of up to three words that reads as a number. Without a label only punctuation may stand between the number and
    more text. Each step is a column of its own, so that no pattern is evaluated twice.
    """
    c, rest_of = F.col, lambda x, n: F.substr(x, n + 1)
    steps: list[tuple[str, Column]] = [
        ("__t", collapsed(c(text))),
        ("__found", F.regexp_extract("__t", f"^(?iu:{LABEL})", 0)),
        ("__gap", F.when(F.substr("__t", F.length("__found") + 1, F.lit(1)) == " ", " ").otherwise("")),
        ("__label", F.when((c("__found") != "") & ((c("__gap") != "") | (F.length("__found") == F.length("__t"))), c("__found"))),
        ("__after", F.when(c("__label").isNotNull(), rest_of(c("__t"), F.length("__label") + F.length("__gap"))).otherwise(c("__t"))),
        ("__digits", F.regexp_extract("__after", "^[0-9]{1,3}", 0)),
        ("__roman", F.regexp_extract("__after", f"^(?=[IVXLCDM]){ROMAN}(?![A-Za-z])", 0)),
        ("__roman_value", F.when(c("__roman") != "", roman_value(c("__roman")))),
        ("__token", F.regexp_extract("__after", r"^[A-Za-z]+(?:[\s-]+(?:and[\s-]+)?[A-Za-z]+){0,2}", 0)),
        ("__prefixes", F.filter(F.array(*[F.regexp_extract("__token", rf"^[A-Za-z]+(?:[\s-]+[A-Za-z]+){{{n}}}(?![A-Za-z])", 0) for n in (4, 3, 2, 1, 0)]), lambda x: x != "")),
        ("__values", F.transform("__prefixes", words_value)),
        ("__at", F.filter(F.transform("__values", lambda v, i: F.when(v.isNotNull(), i)), lambda i: i.isNotNull())),
        ("__words", F.get("__prefixes", F.get("__at", F.lit(0)))),
        ("__form", F.when(c("__digits") != "", "digits").when(c("__roman_value") < 400, "roman").when(c("__words").isNotNull(), "words")),
        ("__text", F.when(c("__form") == "digits", c("__digits")).when(c("__form") == "roman", c("__roman")).otherwise(c("__words"))),
        ("__number", F.when(c("__form") == "digits", c("__digits").try_cast("int")).when(c("__form") == "roman", c("__roman_value")).otherwise(F.get("__values", F.get("__at", F.lit(0))))),
        ("__tail", rest_of(c("__after"), F.length("__text"))),
        ("__separator", F.regexp_extract("__tail", r"^(\s*[:.—–\-]+\s*|\s+)", 0)),
        ("__rest", rest_of(c("__tail"), F.length("__separator"))),
        ("__letters", F.regexp_replace(F.concat(F.coalesce("__label", F.lit("")), F.when(c("__form") == "words", c("__text")).otherwise("")), "[^A-Za-z]", "")),
    ]
    out = titles
    for name, column in steps:
        out = out.withColumn(name, column)
    more = c("__rest") != ""
    refused = (more & (c("__separator") == "")) | (more & c("__label").isNull() & ~c("__separator").rlike(r"[:.—–\-]")) | ((c("__form") == "digits") & c("__tail").rlike("(?i)^[a-z]"))
    parsed = F.struct(
        c("__label").alias("label"), F.when(c("__label").isNotNull(), c("__gap")).otherwise("").alias("label_gap"), c("__number").alias("number"), c("__form").alias("form"), c("__text").alias("number_text"), c("__separator").alias("separator"), c("__rest").alias("rest"),
        ((c("__letters") != "") & (c("__letters") == F.upper("__letters"))).alias("caps"),
    )
    return out.withColumn("parsed", F.when(c("__form").isNotNull() & ~F.coalesce(refused, F.lit(False)), parsed)).drop(*[n for n, _ in steps])


def format_chapter_title(parsed: Column, style: str | Column, number: Column) -> Column:
    """The title with ``number``, in a style: keep, chapterWords, chapterDigits, words or digits."""
    style = F.lit(style) if isinstance(style, str) else style
    labelled = parsed["label"].isNotNull()
    wants = style.isin("chapterWords", "chapterDigits") | ((style == "keep") & labelled)
    english = ~labelled | parsed["label"].rlike(f"(?i)^({ENGLISH_LABEL})$")
    form = F.when(style == "keep", parsed["form"]).when(style.isin("chapterWords", "words") & english, "words").otherwise("digits")
    words = F.when(parsed["caps"], F.upper(number_in_words(number))).otherwise(number_in_words(number))
    text = F.when(form == "digits", number.cast("string")).when(form == "roman", roman_numeral(number)).otherwise(words)
    word = F.coalesce(parsed["label"], F.when(parsed["caps"], "CHAPTER").otherwise("Chapter"))
    label = F.when(wants, F.concat(word, F.when(parsed["label_gap"] == "", " ").otherwise(parsed["label_gap"]))).otherwise("")
    return F.concat(label, text, parsed["separator"], parsed["rest"])
