"""Hard-wrapped e-text to paragraphs, and sentences to dialog and quotation groups. Each takes time in proportion to its input, or little more."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausula.functions import lexicon as L
from clausula.functions.base import CUT, INNER_CUT, Text, col, let, rx, scan, strip
from clausula.functions.text import dehyphenate, quote_count

MAX_GROUP = 20


def unwrap_hard_wrapped(c: Text) -> Column:
    """Lines of a paragraph in one, words that a line end divides whole, and single blank lines inside a sentence or a quotation dropped."""

    def state(started: Column, blanks: Column, ended: Column, odd: Column) -> Column:
        return F.struct(started.alias("started"), blanks.alias("blanks"), ended.alias("ended"), odd.alias("odd"))

    def blank(line: Column) -> Column:
        return line.rlike(r"^\s*\z")

    def joins(acc: Column, line: Column) -> Column:
        """Whether a line goes on in the paragraph before it."""
        inside = (acc["blanks"] == 1) & ((~acc["ended"] & line.rlike(r"^\s*[a-z]")) | (acc["odd"] == 1))
        return (acc["blanks"] == 0) | inside

    def step(acc: Column, line: Column) -> Column:
        core, marks = rx(line, r"""["')\]”’\s]+\z""", ""), (quote_count(line) + F.regexp_count(line, F.lit("[“”]"))).cast("int")
        ended, same = core.rlike(r"[.?!]\z"), acc["started"] & joins(acc, line)
        after = state(F.lit(True), F.lit(0), F.when(same & (core == ""), acc["ended"]).otherwise(ended), F.when(same, (acc["odd"] + marks) % 2).otherwise(marks % 2))
        return F.when(blank(line), state(acc["started"], acc["blanks"] + 1, acc["ended"], acc["odd"])).otherwise(after)

    def emit(acc: Column, line: Column) -> Column:
        mark = F.when(~acc["started"], F.lit("")).when(joins(acc, line), F.lit("\n")).otherwise(F.lit(CUT))
        return F.when(blank(line), F.array().cast("array<string>")).otherwise(F.array(F.concat(mark, line)))

    def paragraph(block: Column) -> Column:
        lines = F.transform(F.split(dehyphenate(block), "\n"), strip)
        return rx(F.array_join(F.filter(lines, lambda s: s != ""), " "), " {2,}", " ")

    lines = F.split(col(c), r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]")
    start = state(F.lit(False), F.lit(0), F.lit(False), F.lit(0))
    blocks = F.split(F.array_join(scan(lines, start, step, emit), ""), CUT)
    return F.array_join(F.filter(F.transform(blocks, paragraph), lambda p: p != ""), "\n\n")


def group_quoted(sentences: Column, most: int = MAX_GROUP) -> Column:
    """array<array<string>>: sentences that one quotation spans together, at most `most`; others alone."""

    def step(acc: Column, s: Column) -> Column:
        size, open_ = acc["size"] + 1, (acc["open"] + F.regexp_count(s, F.lit('"')).cast("int")) % 2
        close = (open_ == 0) | (size >= most)
        return F.struct(F.when(close, F.lit(0)).otherwise(size).alias("size"), F.when(close, F.lit(0)).otherwise(open_).alias("open"))

    start = F.struct(F.lit(0).alias("size"), F.lit(0).alias("open"))
    marked = scan(sentences, start, step, lambda acc, s: F.array(F.concat(F.when(acc["size"] == 0, F.lit(CUT)).otherwise(F.lit(INNER_CUT)), s)))
    groups = F.transform(F.split(F.substring(F.array_join(marked, ""), 2, 2**31 - 1), CUT), lambda g: F.split(g, INNER_CUT))
    return F.when(F.size(sentences) == 0, F.array().cast("array<array<string>>")).otherwise(groups)


def format_grouped(groups: Text) -> Column:
    """One line for each group."""
    return F.array_join(F.transform(col(groups), lambda g: F.array_join(g, " ")), "\n\n")


def format_dialog(sentences: Column) -> Column:
    """Sentences in paragraphs, one sentence to a line.

    Inside an open quotation a paragraph goes on. A sentence that opens with a quotation mark begins one. Narrative begins
    one after narrative, after a sentence whose quotations are closed, and after one that ends a speaker's turn; after an
    unfinished turn it stays with it.
    """

    def facts(s: Column) -> Column:
        marks = (quote_count(s) + quote_count(s, "'")).cast("int")
        opens = s.rlike(r'^"') | (s.rlike(r"^'") & ~s.rlike(rf"^'(?:\d|(?i:{'|'.join(L.ELISIONS)})(?!\p{{L}}))"))
        tail = F.right(s, F.lit(10))
        turn = tail.rlike(r"""["'][.,!?;: ]*\z""") | (tail.rlike(r"""["'][.,!?][^"']*\z""") & ~F.lower(F.right(s, F.lit(20))).contains("said"))
        return F.struct(s.alias("text"), (marks % 2).alias("odd"), opens.alias("opens"), ((marks > 0) & (marks % 2 == 0)).alias("complete"), turn.alias("turn"))

    def formed(known: Column) -> Column:
        inside = scan(F.transform(known, lambda k: k["odd"]), F.lit(0), lambda acc, odd: (acc + odd) % 2, lambda acc, odd: F.array(acc), "int")

        def line(k: Column, i: Column, open_: Column) -> Column:
            last = F.get(known, i - 1)
            new = k["opens"] | ~last["opens"] | last["complete"] | last["turn"]
            gap = F.when(i == 0, F.lit("")).when((F.get(open_, i) == 0) & new, F.lit("\n\n")).otherwise(F.lit("\n"))
            return F.concat(gap, k["text"])

        return let(inside, lambda open_: F.array_join(F.transform(known, lambda k, i: line(k, i, open_)), ""))

    return let(F.transform(F.filter(F.transform(sentences, strip), lambda s: s != ""), facts), formed)
