"""The rules on sentences of our own, and invariants on the corpus."""

import re

import pytest
from pyspark.sql import functions as F

from clausula.functions import text as T
from clausula.functions.base import unmask
from clausula.operators import documents as D
from clausula.operators import mergers as M
from clausula.operators import splitters as S
from clausula.plans.segment import Options, paragraphs, segment_documents, segment_paragraphs, segmented, sentence_rows

CASES = [
    ("The lamp is on. It is warm.", ["The lamp is on.", "It is warm."]),
    ("Are you in? We are out! Come.", ["Are you in?", "We are out!", "Come."]),
    ("I met Dr. Hale at noon. We spoke.", ["I met Dr. Hale at noon.", "We spoke."]),
    ("See p. 12 and vol. 3 for more. Then rest.", ["See p. 12 and vol. 3 for more.", "Then rest."]),
    ("She lives in the U.K. Do you?", ["She lives in the U.K.", "Do you?"]),
    ("The U.S. Senate met on Monday.", ["The U.S. Senate met on Monday."]),
    ("He works for Lark Inc. They make lamps.", ["He works for Lark Inc.", "They make lamps."]),
    ("It cost $3.50. It was cheap.", ["It cost $3.50.", "It was cheap."]),
    ("Go to https://a.example/x.html. Read it.", ["Go to https://a.example/x.html.", "Read it."]),
    ("Write to ann.lee@mail.example. She will answer.", ["Write to ann.lee@mail.example.", "She will answer."]),
    ('He said, "It is late." She left.', ['He said, "It is late."', "She left."]),
    ('"Go home." he said.', ['"Go home." he said.']),
    ("Ann B. Ford came. Tom left.", ["Ann B. Ford came.", "Tom left."]),
    ("Well ... maybe so. Fine.", ["Well ... maybe so.", "Fine."]),
    ("I never knew.... Then he came.", ["I never knew....", "Then he came."]),
    ("1. Buy milk 2. Buy bread", ["1. Buy milk", "2. Buy bread"]),
    ("1) Buy milk. 2) Buy bread.", ["1) Buy milk.", "2) Buy bread."]),
    ("• One thing. • Another thing.", ["• One thing.", "• Another thing."]),
    ("We shop at Yahoo! every day.", ["We shop at Yahoo! every day."]),
    ("no end here", ["no end here"]),
    ("It stops. and goes on", ["It stops. and goes on."]),
    ("He left (it was late.) and slept.", ["He left (it was late.) and slept."]),
    ("You will find it at N°. 5. Look there.", ["You will find it at N°. 5.", "Look there."]),
]


def test_cases(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "doc_id long, text string").coalesce(1)
    out = {r.doc_id: r.s for r in rows.select("doc_id", F.flatten(segmented("text", Options(split_dialog=False))).alias("s")).collect()}
    wrong = [(t, out[i]) for i, (t, want) in enumerate(CASES) if out[i] != want]
    assert not wrong


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x array<string>" if isinstance(value, list) else "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "f, before, after",
    [
        (T.normalize_quotes, "“a” ‘b’ «c»", "\"a\" 'b' \"c\""),
        (T.dehyphenate, "sta-\n  tion, a--\nb, X-\nY", "station, a--\nb, X-\nY"),
        (T.fix_ocr, "x Iam y witha z", "x I am y with a z"),
        (T.newlines_to_periods, "a;  \nb\nc:\nd", "a;. b c:. d"),
        (T.clean_spacing, "a  b   c", "a. b. c"),
        (T.clean_bullets, "-a.. b. - c. . d  e..", "a. b. c.d e.."),
        (T.post_process, "so;. no? .", "so;  no?"),
        (T.strip_period_after_quote, 'He said "no.".', 'He said "no."'),
        (T.append_period, "no end", "no end."),
        (T.append_period, "an end?\"", "an end?\""),
        (lambda c: unmask(T.mask_all(c)), "See [a. b] at ftp://x.y/z. J. R. R. Moe. Wham! ok...", "See [a. b] at ftp://x.y/z. J. R. R. Moe. Wham! ok..."),
        (D.unwrap_hard_wrapped, "a line\nthat wraps sta-\ntion.\n\nNext one\n\ngoes on.", "a line that wraps station.\n\nNext one goes on."),
    ],
)
def test_text_operators(spark, f, before, after):
    assert one(spark, before, f) == after


@pytest.mark.parametrize(
    "f, before, after",
    [
        (M.merge_attribution, ['"Go."', "he said.", "she left."], ['"Go." he said.', "she left."]),
        (M.merge_parenthetical, ["It (was late.).", "and cold."], ["It (was late.) and cold."]),
        (M.merge_unclosed_quotes, ['He said "a.', "b.", 'c."', "d."], ['He said "a. b. c."', "d."]),
        (M.merge_abbreviations, ["See vol.", "3. Then go."], ["See vol. 3.", "Then go."]),
        (M.merge_abbreviations, ["Meet Dr.", "Lee of St.", "Ives now."], ["Meet Dr. Lee of St. Ives now."]),
        (M.merge_abbreviations, ["He sold Lark Inc.", "We bought it."], ["He sold Lark Inc.", "We bought it."]),
        (M.merge_abbreviations, ["(see there.", "and here) too."], ["(see there. and here) too."]),
        (M.merge_abbreviations, ["Consider pseudohypoparathyroidism—vol.", "3. Then go."], ["Consider pseudohypoparathyroidism—vol. 3.", "Then go."]),
        (M.merge_abbreviations, ["A counterrevolutionary/Dr.", "Lee today."], ["A counterrevolutionary/Dr. Lee today."]),
        (M.merge_abbreviations, ["Yes.", "No.", "Maybe so."], ["Yes.", "No.", "Maybe so."]),
        (M.merge_abbreviations, ["See item no.", "5. Then stop."], ["See item no. 5.", "Then stop."]),
        (M.merge_abbreviations, ["Brown v.", "Black was heard."], ["Brown v. Black was heard."]),
        (M.merge_abbreviations, ["It came early. frag.", "Week 7 has it."], ["It came early.", "frag. Week 7 has it."]),
        (M.merge_abbreviations, ["See p. 88.", "for more."], ["See p. 88 for more."]),
        (M.merge_abbreviations, ["Two agree;.", "cf. Week 3 here."], ["Two agree; cf. Week 3 here."]),
        (M.merge_abbreviations, ["Ask Sgt..", "Hill now."], ["Ask Sgt. Hill now."]),
        (M.merge_title_name, ["Hello Dr.", "Lee! Come."], ["Hello Dr. Lee!", "Come."]),
        (M.merge_numbered_title, ["Part 8.", "it goes on and on here now."], ["Part 8. it goes on and on here now."]),
        (M.merge_leading_ellipsis, [". . .", "So it was.", "..."], [". . . So it was. ..."]),
        (S.split_question_exclamation, ["What? No! ok? yes"], ["What?", "No! ok? yes"]),
        (S.split_quote_closing, ['"A." B "c." d'], ['"A."', 'B "c." d']),
        (S.split_abbreviation, ["He came at 5 p.m. We left. In the U.S. Army"], ["He came at 5 p.m.", "We left. In the U.S. Army"]),
        (D.group_quoted, ['"a.', 'b."', "c."], [['"a.', 'b."'], ["c."]]),
        (D.format_dialog, ['"Hi," he said.', "He sat.", '"Bye.'], '"Hi," he said.\n\nHe sat.\n\n"Bye.'),
    ],
)
def test_list_operators(spark, f, before, after):
    assert one(spark, before, f) == after


def test_dialog_turns(spark):
    assert one(spark, ['"I see," he said,', "and sat down.", "'Tis late.", '"Go', "Then", 'away."', "", " He went. "], D.format_dialog) == '"I see," he said,\n\nand sat down.\n\n\'Tis late.\n\n"Go\nThen\naway."\n\nHe went.'
    assert one(spark, ['"Well" she began to say slowly', "and stopped."], D.format_dialog) == '"Well" she began to say slowly\n\nand stopped.'
    assert one(spark, [], D.format_dialog) == "" and one(spark, [], D.group_quoted) == []


def test_long_paragraphs_take_time_in_proportion(spark):
    import time

    def run(n):
        text = " ".join(f"The cat {i} sat down." for i in range(n))
        began = time.perf_counter()
        assert len(one(spark, text, lambda c: F.flatten(segmented(c)))) == n
        return time.perf_counter() - began

    run(10)
    fixed, few, many = run(10), run(4000), run(16000)
    assert many - fixed < 10 * max(few - fixed, 1)


def test_group_limit(spark):
    assert [len(g) for g in one(spark, ['"a'] + ["b"] * 24, D.group_quoted)] == [20, 1, 1, 1, 1, 1]


def test_nulls_and_empties(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, " \n "), (4, "a\n\n\n\nb.")], "doc_id long, text string")
    out = {r.doc_id: r.paragraphs for r in segment_documents(rows).collect()}
    assert out == {1: None, 2: [], 3: [], 4: [["a"], ["b."]]}
    assert {r.doc_id: r.paragraphs for r in segment_documents(rows, dedupe=True).collect()} == out
    with pytest.raises(Exception, match="Empty Input"):
        segment_documents(rows, Options(strict=True)).collect()
    assert one(spark, "a. B", lambda c: segment_paragraphs(segmented(c))) == ["a. B."]


def test_split_dialog_option(spark):
    text = 'She said, "It rains. We stay." Then she slept.'
    assert one(spark, text, lambda c: F.flatten(segmented(c, Options(split_dialog=False)))) == ['She said, "It rains. We stay."', "Then she slept."]
    assert len(one(spark, text, lambda c: F.flatten(segmented(c)))) == 3


@pytest.mark.parametrize("word", ["Dr", "vol", "cf", "Jan", "approx", "et al", "op. cit", "etc", "Inc"])
@pytest.mark.parametrize("following", ["Smith came", "12 of it", "the end", "lower case"])
def test_abbreviation_grid(spark, word, following):
    """No abbreviation is cut from a small letter or a number, and what is cut loses nothing."""
    text = f"This is {word}. {following} here."
    found = one(spark, text, lambda c: F.flatten(segmented(c)))
    assert " ".join(found) == text
    if following[0].islower():
        assert len(found) == 1


def test_corpus_invariants(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sentence_rows(docs).collect()
    by = {}
    for r in rows:
        by.setdefault((r.doc_id, r.para_idx), []).append((r.sent_idx, r.sentence))
    assert all([i for i, _ in sorted(v)] == list(range(len(v))) for v in by.values())
    assert not [r for r in rows if re.search("[-\x01\x02]|xmonth|^\\s|\\s$", r.sentence)]
    bare = lambda s: re.sub(r"[\s.]", "", s)
    texts = {r.doc_id: r.text for r in docs.collect()}
    short = [d for d in texts if bare(T_plain(texts[d])) != bare("".join(s for k in sorted(by) if k[0] == d for _, s in sorted(by[k])))]
    assert len(short) < 0.05 * len(texts)
    again = sentence_rows(docs.repartition(3)).collect()
    assert sorted(again) == sorted(rows)


def T_plain(text):
    return text.translate(str.maketrans(T.L.DOUBLE_QUOTES + T.L.SINGLE_QUOTES, '"' * len(T.L.DOUBLE_QUOTES) + "'" * len(T.L.SINGLE_QUOTES)))


def test_paragraphs(spark):
    assert one(spark, "a\n\n b \n\n\n\nc\n \nd", paragraphs) == ["a", "b", "c\n \nd"]
