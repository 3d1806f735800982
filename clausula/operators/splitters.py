"""Arrays of sentences to arrays of more sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausula.functions import lexicon as L
from clausula.functions.base import CUT, ELLIPSIS, ITEM, PERIOD, Text, col, cut, each, let

_FUNCTION = "|".join([*L.FUNCTION_WORDS, *L.JOINING_WORDS])
_ENDING = L.any_of(L.ENDING)
#: A title before a name, seen from the front.
_TITLE_AHEAD = rf"(?:{'|'.join(L.TITLES)})\."


def detect(c: Text) -> Column:
    """Sentence candidates of a masked text: more rather than fewer, since the mergers repair."""
    opening, three = r"""["'(\[]*""", f"{PERIOD} ?{PERIOD} ?{PERIOD}"
    text = col(c)
    kept = rf"""(?<![\s"'(\[]{_ENDING})(?<!^{_ENDING})(?<!\b[A-HJ-Z]\.)"""
    text = F.regexp_replace(text, F.lit(rf"""((?:[.?!]|{ELLIPSIS}\.)["')\]]*){kept}\s+(?={opening}(?:[\p{{Lu}}\p{{Lt}}0-9{ITEM}]|{three}))"""), F.lit("$1" + CUT))
    text = F.regexp_replace(text, F.lit(rf"\s+(?={ITEM})"), F.lit(CUT))
    return cut(text, f"({CUT})", "$1")


def split_question_exclamation(sentences: Column) -> Column:
    """After ? or ! before a capital."""
    return each(sentences, lambda s: cut(s, r"([?!])\s+(?=[A-Z])"))


def split_quote_closing(sentences: Column) -> Column:
    """After a quotation mark that closes a sentence, before a capital."""
    return each(sentences, lambda s: cut(s, rf"""((?:[.?!]|{PERIOD}{{3}})["'])\s+(?=[A-Z])"""))


def split_ellipsis(sentences: Column) -> Column:
    """After three dots before a capital other than I."""
    return each(sentences, lambda s: cut(s, rf"(?<!{PERIOD})({PERIOD}{{3}})\s+(?=[A-HJ-Z])"))


def split_unicode_bullets(c: Text) -> Column:
    """A text with two bullets or more, before each; others as one part."""
    return let(col(c), lambda t: F.when(F.regexp_count(t, F.lit(f"[{L.BULLETS}]")) >= 2, cut(t, rf"\s*(?=[{L.BULLETS}])", CUT)).otherwise(F.array(t)))


def split_abbreviation(sentences: Column) -> Column:
    """After an abbreviation that can end a sentence, before a capital, unless its surroundings say that it goes on."""
    country = L.any_of(L.COUNTRIES)
    company = rf"(?:{'|'.join(L.COMPANIES)})\."
    measure = rf"(?:{'|'.join(L.MEASURES)})\."
    goes_on = [
        rf"(?<=\b{country})\s+(?=(?:{'|'.join(L.INSTITUTIONS)})\b)",
        rf"(?<=\b{country})\s+(?={country})",
        rf"(?<=^{company})\s+|(?<=[(—–]\s{{0,1}}{company})\s+|(?<=\b(?i:{_FUNCTION})\s{company})\s+|(?<=\b[a-z]{{1,30}}\s{company})\s+",
        rf"(?<=^(?i:{measure}))\s+|(?<=[:;]\s(?i:{measure}))\s+|(?<=\b(?i:{'|'.join(w for w in [*L.FUNCTION_WORDS, *L.JOINING_WORDS] if w not in ('a', 'an', 'the'))})\s(?i:{measure}))\s+",
        r"(?<=\bin ext\.)\s+",
        rf"(?<=[ap]\.m\.|[AP]\.M\.)\s+(?=(?:{'|'.join(L.WEEKDAYS)})\b(?:[.?!,]|\s*\z|\s+(?:and|or|but|nor)\b))",
        rf"(?i:(?<=^(?:at|by|the|around|about|until|before|after)\s\d[^\n]{{0,12}}[ap]\.m\.))\s+(?={_TITLE_AHEAD})",
    ]

    def one(s: Column) -> Column:
        held = s
        for rule in goes_on:
            held = F.regexp_replace(held, F.lit(rf"(?=\s+[A-Z])(?:{rule})(?=[A-Z])"), F.lit("\x02"))
        held = F.regexp_replace(held, F.lit(rf"(?=\s+[A-Z])(?<={_ENDING})\s+(?=[A-Z])"), F.lit(CUT))
        held = F.regexp_replace(held, F.lit(r"\.\s+(?=(?:q\.e\.d|Q\.E\.D)\.\s*\z)"), F.lit("." + CUT))
        parts = cut(F.translate(held, "\x02", " "), f"({CUT})", "$1")
        return F.when(s.rlike(r"\.\s+[A-Zq]"), parts).otherwise(F.array(s))  # most sentences have nothing to decide

    return each(sentences, one)


def split_list_items(sentences: Column) -> Column:
    """Before item marks; what leads into the first item with a colon stays with it."""
    return each(sentences, lambda s: cut(s, rf"(?<!:)\s+(?={ITEM})", CUT))
