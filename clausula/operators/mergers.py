"""Arrays of sentences to arrays of fewer sentences. Patterns of one line are fixed values of the rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausula.functions import lexicon as L
from clausula.functions.base import ELLIPSIS, PERIOD, fold_pairs, joined_where, let, rx, scan

_DOTS = rf"(?:{PERIOD} ?{PERIOD} ?{PERIOD}|{ELLIPSIS})"


def merge_ellipsis(sentences: Column) -> Column:
    """Three dots and a small letter go on; so does a conjunction after an ellipsis before I."""

    def absorb(a: Column, b: Column) -> Column:
        goes_on = a.rlike(rf"{_DOTS}\s*\z") & b.rlike(r"^[a-z]")
        joined = a.rlike(_DOTS) & a.rlike(r"(?i)\b(?:but|and|or|yet|so|nor|for)\s*\z") & b.rlike(r"^I\b")
        return F.when(goes_on, b).when(joined, rx(b, r"(?<!\.)\.\z", ""))

    return fold_pairs(sentences, absorb)


def merge_unclosed_quotes(sentences: Column) -> Column:
    """A sentence with an open double quotation mark takes over the following ones until it closes."""

    def step(acc: Column, s: Column) -> Column:
        def count(mark: str) -> Column:
            return F.regexp_count(s, F.lit(mark)).cast("int")

        straight, curly = (acc["straight"] + count('"')) % 2, acc["curly"] + count("“") - count("”")
        open_ = (straight == 1) | (curly > 0)
        return F.struct(F.when(open_, straight).otherwise(F.lit(0)).alias("straight"), F.when(open_, curly).otherwise(F.lit(0)).alias("curly"))

    def joined(all_: Column) -> Column:
        start = F.struct(F.lit(0).alias("straight"), F.lit(0).alias("curly"))
        # whether a quotation is open before each sentence is whether the one before it goes on
        before = scan(all_, start, step, lambda acc, s: F.array((acc["straight"] == 1) | (acc["curly"] > 0)), "boolean")
        return joined_where(all_, F.concat(F.slice(before, 2, F.size(before)), F.array(F.lit(False))))

    return let(sentences, lambda s: F.when(F.size(s) < 2, s).otherwise(joined(s)))


#: Ends of a sentence that take over what follows: always; unless an article and a small letter follow; a number first; small letters and digits only.
_B = r"(?:^|[^\p{L}\p{N}_])"
_ALWAYS = [*L.TITLES, *L.PLACES, *L.DATES, *L.FIRMS, *L.UNITS, *L.LATIN, *L.DOTTED, *L.PHRASES, *L.SCIENCES, *L.GRAMMAR, *L.EDITING, "Sec"]
_GUARDED = [w for w in [*L.NUMBERED, *L.GUARDED_LATIN, *L.MEASURES] if w not in ("no", "nos")]
#: Longer than any abbreviation: what stands before cannot matter.
_REACH = 40


def _ends(words: list[str]) -> str:
    return rf"(?iu){_B}{L.any_of(words)}\.\z"


def _last(sentence: Column, words: int = 1) -> Column:
    """The end of a sentence: its last words, and of these the last characters."""
    return F.right(F.substring_index(sentence, " ", -words), F.lit(_REACH * words))


def merge_abbreviations(sentences: Column) -> Column:
    """Sentences that end in an abbreviation which does not end one, joined with what follows, again and again."""
    numbered, guarded = _ends([w for w in L.NUMBERED if w not in ("no", "nos")]), _ends(_GUARDED)
    always, phrases = _ends([w for w in _ALWAYS if " " not in w]), _ends([w for w in _ALWAYS if " " in w])
    suffix = L.any_of([*L.COMPANIES, *L.SUFFIXES])
    company, alone = rf"(?iu){_B}{suffix}\.\z", rf"(?iu)^{suffix}\.\z"
    led = rf"(?iu)(?:[:;—–]\s?|{_B}(?:{'|'.join(L.FUNCTION_WORDS)})\s){suffix}\.\z"
    number = r"^\d[\d\-–]*\.(?=\s+[A-Z]|\s*\z)"
    inner_no = r"(?i)(?:(?<!no)\s+no|(?<!nos)\s+nos)\.\z"
    title = rf"^(?:{'|'.join(L.TITLES)})\.\z"

    def takes_number(a: Column, b: Column) -> Column:
        last = _last(a, 2)
        return b.rlike(number) & (last.rlike(numbered) | last.rlike(inner_no))

    def bracket(a: Column, b: Column) -> Column:
        return b.contains(")") & a.rlike(r"\([^)]*\z")

    def article(b: Column) -> Column:
        return b.rlike(r"^(?:The|A|An)\s+[a-z]")

    def after_number(a: Column, b: Column) -> Column:
        """An abbreviation with its number, and a small letter."""
        return b.rlike(r"^[a-z]") & a.rlike(r"[A-Za-z]\. \d+\.?\z")

    def clause(a: Column, b: Column) -> Column:
        """; or : before an abbreviation, unless that is a title and a name."""
        first = F.substring_index(b, " ", 1)
        known = first.rlike(always) | first.rlike(guarded) | first.rlike(r"(?i)^nos?\.\z")
        return a.rlike(r"[;:]\.*\z") & known & ~(first.rlike(title) & b.rlike(r"^\S+\s+\p{Lu}"))

    def clean(a: Column) -> Column:
        """Without a period that only the detector or wide spacing has put there."""
        return F.when(a.rlike(r"[,;.]\.\z"), rx(rx(a, r"([,;])\.\z", "$1"), r"(?<!\.)\.\.\z", ".")).otherwise(a)

    def absorb(raw: Column, b: Column) -> Column:
        def chosen(a: Column, last: Column) -> Column:
            two, guard = _last(a, 2), article(b)
            several = b.rlike(r"^.+\s.+\z")
            known = (
                F.when(takes_number(a, b), F.regexp_extract(b, number, 0))
                .when(last.rlike(guarded) & ~guard, b)
                .when(a.rlike(r"^no\.\z|(?i)^nos\.\z") & several, b)
                .when((a == "No.") & b.rlike(r"^[a-z0-9].+\s.+\z"), b)
                .when(two.rlike(inner_no) & ~guard, b)
                .when(last.rlike(always), b)
                .when(last.rlike(company) & b.rlike(r"^[a-z0-9]"), b)
                .when((last == "v.") & a.contains(" ") & b.rlike(r"^\p{Lu}"), b)
                .when(a.rlike(alone) | two.rlike(led), b)
                .when(two.rlike(phrases), b)
                .when(two.rlike(r"(?i)(?:^|\s)et\s+al\.\z") & ~guard, b)
            )
            return F.when(bracket(a, b) | after_number(a, b), b).when(a.rlike(r"\.\z"), known).when(clause(a, b), b)

        return let(clean(raw), lambda a: let(_last(a), lambda last: F.coalesce(chosen(a, last), F.when(clause(raw, b), b))))

    def rest(a: Column, b: Column) -> Column:
        return F.when(takes_number(clean(a), b) & ~bracket(a, b), rx(b, number, "")).otherwise("")

    def left(a: Column, b: Column) -> Column:
        return F.when(after_number(a, b) & ~bracket(a, b), rx(a, r"(?<=\d)\.\z", "")).when(clause(a, b), rx(a, r"\.+\z", "")).otherwise(clean(a))

    def apart(all_: Column) -> Column:
        """A small abbreviation after a sentence's end, which belongs to the following sentence, by itself."""
        small = [w for w in [*_ALWAYS, *_GUARDED] if " " not in w and "." not in w and len(w) > 1]
        free, any_ = (rf"\.\s+(?=[a-z])(?iu){L.any_of(words)}\.\z" for words in ([w for w in small if w in _ALWAYS], small))

        def one(s: Column, i: Column) -> Column:
            following = F.get(all_, i + 1)
            moves = s.rlike(r"\.\s+[a-z][^\s.]+\.\z") & following.isNotNull() & (s.rlike(free) | (s.rlike(any_) & ~article(following)))
            return F.when(moves, F.array(rx(s, r"\s+\S+\z", ""), F.regexp_extract(s, r"(\S+)\z", 1))).otherwise(F.array(s))

        return F.flatten(F.transform(all_, one))

    return fold_pairs(let(sentences, apart), absorb, rest, chain=True, left=left)


def merge_attribution(sentences: Column) -> Column:
    """A closed quotation and what its speaker does."""
    return fold_pairs(sentences, lambda a, b: F.when(a.rlike(r"""[.?!]["']\s*\z""") & b.rlike(r"^[a-z]"), b))


def merge_title_name(sentences: Column) -> Column:
    """A title and the name after it, up to the name's ! or ?."""
    name = r"^[A-Z][A-Za-z-]*[?!]+\.?"
    title = rf"(?i)(?:{'|'.join(L.NAME_TITLES)})\.\z"
    return fold_pairs(sentences, lambda a, b: F.when(a.rlike(title) & b.rlike(name), F.regexp_extract(b, name, 0)), lambda a, b: rx(b, name, ""), chain=True)


def merge_numbered_title(sentences: Column) -> Column:
    """Headings such as Part 8., joined with their number, and with what follows unless that is a short title itself."""
    heading = "|".join(L.HEADINGS)
    number = r"^(?:\d+|[IVXLCDM]+|[A-Za-z])\.(?=\s|\z)"
    short = r"^(?:[A-Z][\w'-]*|the|on|a|at|to|for|in|an|of)(?:\s+(?:[A-Z][\w'-]*|the|on|a|at|to|for|in|an|of)){0,3}[.?!]?\z"

    def absorb(a: Column, b: Column) -> Column:
        alone = a.rlike(rf"^(?:{heading})\s+(?:\d+|[IVXLCDM]+|[A-Za-z])\.\z") & ~a.rlike(r"^Week\s") & ~b.rlike(short)
        bracket = a.rlike(rf"\b(?:{heading})\s+(?:\d+|[IVXLCDM]+|[A-Za-z])\.\z") & b.rlike(r"^[(\[{<]")
        ends = a.rlike(rf"\b(?:{heading})\z") & b.rlike(number)
        return F.when(alone | bracket, b).when(ends, F.regexp_extract(b, number, 0))

    def rest(a: Column, b: Column) -> Column:
        return F.when(a.rlike(rf"\b(?:{heading})\z") & b.rlike(number), rx(b, number, "")).otherwise("")

    return fold_pairs(sentences, absorb, rest)


def merge_parenthetical(sentences: Column) -> Column:
    """A bracket that ends like a sentence, and the small letter after it."""
    return fold_pairs(sentences, lambda a, b: F.when(a.rlike(r"[.?!]\)\.?\z") & b.rlike(r"^[a-z]"), b), left=lambda a, b: rx(a, r"(\.\))\.\z", "$1"))


def merge_leading_ellipsis(sentences: Column) -> Column:
    """A sentence of dots alone becomes the start of the next one, or the end of the last."""
    alone = r"^\s*\.\s*\.\s*\.\s*\.?\s*\z"
    led = fold_pairs(sentences, lambda a, b: F.when(a.rlike(alone) & ~b.rlike(alone), b))
    return fold_pairs(led, lambda a, b: F.when(b.rlike(alone) & ~a.rlike(alone), b), chain=True)
