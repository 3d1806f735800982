import json
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from clausula.llm import tokenstore
from clausula.llm.common import shared_dir

FILE = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, file string, nth int"


def texts():
    rng = random.Random(2)
    odd = ["", None, "  \n ", "It's we'll O'Neil's  don't", "ΑΣ ΣΑΣ ß İstanbul", "<|endoftext|>x <|startoftext|> y<|endoftext|>", "é ́a b c", "a​b﻿ \x1c\x1d x\x85y", "漢字 かな 123 4.5%", "🎉🎉 👩‍👩‍👧", "q" * 20_000, "word " * 20_000]
    return odd + [" ".join(rng.choice(["The", "cat's", "naïve", "sat,", "(on)", "mat.", "\t", "\n\n", "x" * rng.randint(1, 30)]) for _ in range(rng.randint(0, 60))) for _ in range(150)]


def test_words_give_the_ids_of_whole_texts():
    tokenizer, some = Tokenizer.from_file(FILE), texts()
    ids, lengths = tokenstore.WordEncoder(FILE).encode([t and t.encode() for t in some], 1)
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == [tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for t in some]


def test_every_plain_character_inside_words():
    tokenizer, encoder = Tokenizer.from_file(FILE), tokenstore.WordEncoder(FILE)
    plain = [c for c in map(chr, range(0x250)) if not tokenstore.plain_pieces(c.encode())[3].any() and not c.isspace()]
    assert encoder.pieces and len(plain) == 94 + 64
    some = ["straße", "GROßE Maße, weiß's"] + [f for c in plain for f in (f"stra{c}e", f"STRA{c}E", f"{c}e", f"e{c}", f"1{c}2", f"a{c}{c}b", f".{c}!", f"it'{c}s")]
    ids, lengths = encoder.encode([t.encode() for t in some])
    found = [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in some]
    assert [t for t, f, w in zip(some, found, want) if f != w] == []


def test_random_plain_and_odd_texts_like_the_library():
    rng, tokenizer, encoder = random.Random(5), Tokenizer.from_file(FILE), tokenstore.WordEncoder(FILE)
    letters = "abESTDMRVLL''''\"!.,?-#19 \n\t\rÄßé×÷ÿ" + "’ \x00\x85́"
    some = ["".join(rng.choice(letters[: rng.choice([10, 30, 35, len(letters)])]) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    ids, lengths = encoder.encode([t.encode() for t in some], 7)
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == [tokenizer.encode(t, add_special_tokens=False).ids + [7] for t in some]
    broken = [b"a\xc3", b"\xc3 b", b"x\xbf", b"\xff'\xc3\xa9", b"it's \xc3\xc3\xa9"]
    ids, lengths = encoder.encode(broken)
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == [tokenizer.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids for t in broken]


def test_other_tokenizers_get_texts_whole(tmp_path):
    with open(FILE, encoding="utf-8") as source:
        about = json.load(source)
    about["normalizer"] = None
    (tmp_path / "cased.json").write_text(json.dumps(about))
    encoder, tokenizer = tokenstore.WordEncoder(str(tmp_path / "cased.json")), Tokenizer.from_file(str(tmp_path / "cased.json"))
    assert not encoder.pieces
    ids, _ = encoder.encode([b"The CAT's"])
    assert ids.tolist() == tokenizer.encode("The CAT's", add_special_tokens=False).ids


def test_round_trip(spark):
    tokenizer, some = Tokenizer.from_file(FILE), texts()
    rows = [(i * 3, t, "f", 1) for i, t in enumerate(some)] + [(3, "again", None, None), (3, "again", None, None), (None, "no id", None, None)]
    random.Random(1).shuffle(rows)
    out = tokenstore.round_trip(spark.createDataFrame(rows, SCHEMA), FILE).collect()
    want = []
    for key, text, _, _ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        want.append((key, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.n_tokens, r.ids_crc32)) for r in out)
    at = 0
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    keys = [(-1 if r.doc_id is None else r.doc_id) for r in sorted(out, key=lambda r: r.start)]
    assert keys == sorted(keys)


def test_empty_and_absent(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert tokenstore.round_trip(empty, FILE).collect() == []
    folder = shared_dir(spark, "t")
    tokenstore.write_store(spark.range(500).selectExpr("id doc_id", "'x' text"), folder, FILE, 1, keys_per_index=64)
    found = tokenstore.lookup(spark.range(400, 700).selectExpr("id", "0L nth"), folder).collect()
    assert {r.id for r in found if r.file is not None} == set(range(400, 500)) and len(found) == 300


def test_perfect_hash():
    rng = np.random.default_rng(3)
    first = rng.integers(0, 2**64, 5000, dtype=np.uint64)
    first[1] = first[0]
    second = rng.integers(0, 2**64, 5000, dtype=np.uint64)
    function, end = tokenstore.PerfectHash.load(memoryview(tokenstore.PerfectHash.build(first, second).dump()))
    assert sorted(function.slots(first, second).tolist()) == list(range(5000))
