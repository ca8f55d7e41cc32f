"""Text shapes of manuscript paragraphs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as scripts on the web see it: more than the ASCII characters.
WS = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"

# The characters and words below decide what a line is read as.
STRONG_ORNAMENTS = "*#~•·◆❖❦§✻✽⁂✦★☆✧❉‡†"
WEAK_ORNAMENTS = "-–—_=+."

PART_WORDS = ("part", "volume", "book", "parte", "partie", "teil", "deel", "libro", "livre", "buch", "tomo", "tome", "boek")
CHAPTER_WORDS = (
    "chapter", r"chap\.?", r"ch\.?", "section", "interlude", "episode", "canto", "scene", "cap[íi]tulo", r"cap\.?", "chapitre", "kapitel", r"kap\.?", "capitolo", "hoofdstuk", "secci[óo]n", "sezione", "abschnitt",
    "interludio", "intermède", "zwischenspiel", "episodio", "épisode", "episódio", "aflevering", "escena", "scène", "szene",
)
FRONT_WORDS = (
    "title page", "half title", "contents", "table of contents", "dedication", "epigraph", "foreword", "preface", "introduction", "prologue", "author[’']?s note", "a note (?:on|from)", "praise for",
    "portada", "portadilla", "[íi]ndice", "contenido", "tabla de contenidos?", "dedicatoria", "ep[íi]grafe", "pr[óo]logo", "prefacio", "introducci[óo]n", "nota del autor", "nota de la autora",
    "page de titre", "table des mati[èe]res", "sommaire", "d[ée]dicace", "[ée]pigraphe", "pr[ée]face", "avant-propos", "note de l[’']auteur",
    "titelseite", "inhalt", "inhaltsverzeichnis", "widmung", "motto", "vorwort", "einleitung", "einf[üu]hrung", "prolog", "anmerkung des autors",
    "frontespizio", "indice", "sommario", "dedica", "epigrafe", "prefazione", "introduzione", "prologo", "nota dell[’']autore",
    "folha de rosto", "sum[áa]rio", "dedicat[óo]ria", "pref[áa]cio", "introdu[çc][ãa]o", "nota do autor", "nota da autora",
    "titelpagina", "inhoud", "inhoudsopgave", "opdracht", "voorwoord", "inleiding", "proloog", "woord vooraf",
)
BACK_WORDS = (
    "epilogue", "afterword", "appendix", "appendices", "glossary", "notes?", "endnotes", "bibliography", "works cited", "further reading", "index", "acknowledge?ments?", "about the author", "also by", "discussion questions", "reading group guide", "colophon",
    "ep[íi]logo", "ap[ée]ndices?", "glosario", "notas", "bibliograf[íi]a", "agradecimientos", "sobre (?:el|la) autora?", "acerca (?:del|de la) autora?", "tambi[ée]n de", "otros libros de",
    "[ée]pilogue", "postface", "annexes?", "glossaire", "bibliographie", "remerciements", "[àa] propos de l[’']auteur", "du m[êe]me auteur",
    "epilog", "nachwort", "anhang", "glossar", "anmerkungen", "literaturverzeichnis", "danksagung", "[üu]ber (?:den|die) autor(?:in)?", "vom selben autor",
    "epilogo", "postfazione", "appendice", "glossario", "note", "bibliografia", "ringraziamenti", "sull[’']autore", "sull[’']autrice", "dello stesso autore",
    "posf[áa]cio", "ap[êe]ndices?", "gloss[áa]rio", "agradecimentos", "sobre (?:o|a) autora?", "do mesmo autor",
    "epiloog", "nawoord", "bijlagen?", "verklarende woordenlijst", "noten", "bibliografie", "dankwoord", "over de auteur", "van dezelfde auteur",
)
NUMBER_WORDS = {
    "en": "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred",
    "es": "uno una dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciséis dieciseis diecisiete dieciocho diecinueve veinte veintiuno veintidós veintidos treinta cuarenta cincuenta",
    "fr": "un une deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante",
    "de": "eins zwei drei vier fünf fuenf sechs sieben acht neun zehn elf zwölf zwoelf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn zwanzig dreißig dreissig vierzig fünfzig",
    "it": "due tre quattro cinque sei sette otto nove dieci undici dodici tredici quattordici quindici sedici diciassette diciotto diciannove venti trenta quaranta cinquanta",
    "pt": "um dois duas três quatro cinco seis sete oito nove dez onze doze treze catorze quinze dezesseis dezasseis dezessete dezassete dezoito dezenove dezanove vinte trinta quarenta cinquenta",
    "nl": "een één twee drie vier vijf zes zeven acht negen tien elf twaalf dertien veertien vijftien zestien zeventien achttien negentien twintig dertig veertig vijftig",
}
COPYRIGHT_MARKERS = (
    r"(?i)copyright\s*(©|\(c\))?\s*\d{4}", r"©\s*\d{4}", r"(?i)\ball rights reserved\b", r"(?i)\bISBN\b", r"(?i)\bfirst (edition|printing|published)\b", r"(?i)\bprinted in\b",
    r"(?i)\bno part of this (book|publication)\b", r"(?i)\blibrary of congress\b", r"(?i)\bcataloguing[- ]in[- ]publication\b",
)
PLACEHOLDERS = (
    r"(?i)\binsert (your |chapter |dedication|acknowledg)", r"(?i)\blorem ipsum\b", r"(?i)\[(your|book|author|title|insert)[^\]]*\]", r"(?i)\b(chapter|book|author) (name|title) (goes )?here\b",
    r"(?i)\btype (your|here)\b", r"(?i)\bxxx-xxx\b", r"(?i)\btemplate id\b", r"(?i)\bplaceholder\b", r"\bTK\b",
)
MINOR_WORDS = "a an and as at but by for in nor of on or the to up with from over into"
CONTENTS_HEADINGS = (
    "table of contents", "contents( page)?", "[íi]ndice( de contenidos?)?", "tabla de contenidos?", "contenido", "table des mati[èe]res", "sommaire", "inhalt", "inhaltsverzeichnis", "indice", "sum[áa]rio", "inhoud", "inhoudsopgave",
)
# End of fixed values.


def number_words() -> list[str]:
    return sorted({w for words in NUMBER_WORDS.values() for w in words.split()})


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{WS}]+|[{WS}]+$", "")


def collapsed(text: Column) -> Column:
    """The fingerprint of a text: runs of white space as one space, none at the ends."""
    return trimmed(F.regexp_replace(text, f"[{WS}]+", " "))


def count_words(text: Column) -> Column:
    t = trimmed(text)
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, f"[{WS}]+")))


def preview(text: Column, most: int = 140, is_collapsed: bool = False) -> Column:
    t = text if is_collapsed else collapsed(text)
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most - 1), F.lit("…"))).otherwise(t)


def _class(chars: str) -> str:
    return "".join("\\" + c if c in r"\]^-[&*+.#" else c for c in chars)


def is_scene_break(text: Column, is_trimmed: bool = False) -> Column:
    """Strong ornaments alone, or at least three weak ones; short either way."""
    t = text if is_trimmed else trimmed(text)
    dense = F.regexp_replace(t, f"[{WS}]+", "")
    only = lambda chars: dense.rlike(f"^[{_class(chars)}]+$")
    return F.length(t).between(1, 24) & (F.length(dense) <= 9) & (only(STRONG_ORNAMENTS) | (only(WEAK_ORNAMENTS) & (F.length(dense) >= 3)))


def label_kind(text: Column, is_trimmed: bool = False) -> Column:
    """part, chapter, frontMatter or backMatter: the first kind with a word that opens the line and ends there; else null."""
    t = text if is_trimmed else trimmed(text)
    opens = lambda words: t.rlike(rf"(?iu)^(?:{'|'.join(words)})(?![\p{{L}}\p{{N}}])")
    return F.when(opens(PART_WORDS), "part").when(opens(CHAPTER_WORDS), "chapter").when(opens(FRONT_WORDS), "frontMatter").when(opens(BACK_WORDS), "backMatter")


def number_confidence(text: Column, is_trimmed: bool = False) -> Column:
    """How sure it is that a line is nothing but a number; null if it isn't one."""
    t = trimmed(F.regexp_replace(text if is_trimmed else trimmed(text), r"[.:—–-]+$", ""))
    words = F.split(F.lower(t), f"[{WS}-]+")
    known = F.array(*map(F.lit, number_words()))
    spelled = (F.size(words) <= 2) & F.forall(words, lambda w: F.array_contains(known, w))
    return (
        F.when((t == "") | (F.length(t) > 40), F.lit(None).cast("double"))
        .when(t.rlike(r"^[0-9]{1,3}$"), 0.85)
        .when(t.rlike("(?i)^i$"), 0.35)
        .when(t.rlike("(?i)^[ivxlcdm]+$"), 0.7)
        .when(spelled, 0.7)
    )


def _any(text: Column, patterns: tuple[str, ...]) -> Column:
    """Whether any pattern is found: those that ignore case in one search, the others in another."""
    groups = [(flag, [p.removeprefix("(?i)") for p in patterns if p.startswith("(?i)") == bool(flag)]) for flag in ("(?i)", "")]
    found = [text.rlike(flag + "|".join(f"(?:{p})" for p in ps)) for flag, ps in groups if ps]
    return found[0] | found[1] if len(found) > 1 else found[0]


def looks_like_copyright(text: Column, is_trimmed: bool = False) -> Column:
    t = text if is_trimmed else trimmed(text)
    return F.length(t).between(1, 600) & _any(t, COPYRIGHT_MARKERS)


def is_placeholder(text: Column) -> Column:
    return _any(text, PLACEHOLDERS)


def is_heading_case(text: Column, is_trimmed: bool = False) -> Column:
    """All capitals, or at least four in five of the words that matter start with one."""
    t = text if is_trimmed else trimmed(text)
    words = F.filter(F.split(t, f"[{WS}]+"), lambda w: w.rlike("[A-Za-z]"))
    minor = F.array(*map(F.lit, MINOR_WORDS.split()))
    significant = F.filter(words, lambda w, i: (i == 0) | ~F.array_contains(minor, F.lower(w)))
    capital = F.size(F.filter(significant, lambda w: w.rlike("^[^a-z]*[A-Z]")))
    share = F.when(F.size(significant) > 0, capital / F.size(significant) >= F.lit(0.8)).otherwise(False)
    return (t != "") & (((t == F.upper(t)) & t.rlike("[A-Z]")) | share)


def ends_like_sentence(text: Column, is_trimmed: bool = False) -> Column:
    return (text if is_trimmed else trimmed(text)).rlike("[.!?…][\"'”’)\\]]?$")


def is_contents_heading(text: Column) -> Column:
    t = trimmed(F.regexp_replace(collapsed(text), "[:.]+$", ""))
    return F.length(t).between(1, 40) & t.rlike(f"(?iu)^({'|'.join(CONTENTS_HEADINGS)})$")
