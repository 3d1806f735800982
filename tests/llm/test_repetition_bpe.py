import hashlib
import random

import public_tokenizers
import pytest

from clausula.llm import bpe, repetition

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string, n_words string, kept int"


def brute(text, limits):
    words = (text or "").encode().split()
    n = len(words)
    deepest = [0] * n
    for i in range(n):
        for j in range(i):
            k = 0
            while i + k < n and words[i + k] == words[j + k]:
                k += 1
            deepest[i], deepest[j] = max(deepest[i], k), max(deepest[j], k)
    three, covered = set(), set()
    for i, k in enumerate(deepest):
        if k >= 3:
            three.update(range(i, i + 3))
        if k >= limits.min_words:
            covered.update(range(i, i + k))
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    failed = n < 50 or 100 * len(three) > 50 * n
    longest = max([k for k in deepest if k >= limits.min_words], default=0)
    kept = not failed and len(covered) <= limits.max_covered * n and longest <= limits.max_longest
    return n, sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(three), failed, len(covered), longest, kept


def texts():
    rng = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(30))
    found = ["", None, " \n\t ", "one", "same " * 120, "é|ü# <b>\n\nline\nline\n line", f"{passage} x {passage} y", " ".join(f"u{i}" for i in range(3000)), "a\x1cb c\x0bd " * 30]
    for _ in range(60):
        found.append("".join(rng.choice(["a", "b", "c", "dd", "é"]) + rng.choice([" ", " ", "\n"]) for _ in range(rng.randint(0, 160))))
        found.append(" ".join(f"w{rng.randrange(400)}" for _ in range(rng.randint(40, 120))) + rng.choice(["", f" {passage} {passage}"]))
    return found


@pytest.mark.parametrize("chunk_bytes", [1, 500, 1 << 20])
def test_report_matches_brute_force(spark, chunk_bytes):
    limits = repetition.RepeatLimits(chunk_bytes=chunk_bytes)
    some = texts()
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(some)] + [(None, "no id", None, None), (0, "", "x", 1)], SCHEMA)
    out = repetition.quality_report(frame, limits=limits).collect()
    got = {r.doc_id: tuple(r)[1:] for r in out}
    assert len(out) == len(some) + 2
    for i, text in enumerate(some):
        assert got[i] == brute(text, limits), text
    kept = {r.doc_id for r in repetition.quality_filter(frame, limits=limits).collect()}
    assert kept == {i for i, t in enumerate(some) if brute(t, limits)[-1]}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repetition.quality_report(empty).collect() == [] and repetition.quality_filter(empty).columns == empty.columns
    assert bpe.digest_documents(empty, RANKS, PATTERN).collect() == [] and bpe.encode_documents(empty, RANKS, PATTERN).collect() == []


@pytest.mark.parametrize("piece_chars", [1, 50, 1 << 16])
def test_pieces_and_merges_give_the_librarys_ids(piece_chars):
    own = bpe.ByteBpe(RANKS, PATTERN, piece_chars=piece_chars, long_match=64)
    odd = ["", "a", " " * 500, "x" * 900, "né " * 200, "I'll  go\n\n now'", "é" * 400 + "  \n " + "!" * 300, "漢字" * 100, "tab\t\tand nbsp　end ", "a" * 70 + " b" * 70]
    for text in [t or "" for t in texts()] + odd:
        ids = own.encode(text)
        assert ids == own.library.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_digests(spark):
    library = bpe.ByteBpe(RANKS, PATTERN).library
    some = [*texts(), "word " * 50_000, "y" * 30_000]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(some)] + [(0, "again", None, None)], SCHEMA)
    want = []
    for i, t in [*enumerate(some), (0, "again")]:
        ids = library.encode_ordinary(t) if t and len(t) < 20_000 or t and " " in t else bpe.ByteBpe(RANKS, PATTERN).encode(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(tuple(r) for r in bpe.digest_documents(frame, RANKS, PATTERN).collect()) == sorted(want)
    rows = {(r.doc_id, r.n_tokens): r.token_ids for r in bpe.encode_documents(frame, RANKS, PATTERN).collect()}
    assert all(len(ids) == n for (_, n), ids in rows.items()) and len(rows) == len(want)
