import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark import cloudpickle

from clausula.llm import eftrie, queries
from clausula.llm.common import crc_bucket

SCHEMA = "doc_id long, text string, score string, n int"


def brute(rows, order, least=1, discount=0.75):
    """Probabilities from plain dictionaries."""
    tokens = [(t or "").encode().lower().split() + [b"\n"] for _, t in rows]
    train = [t for (i, _), t in zip(rows, tokens) if i is not None and zlib.crc32(str(i).encode()) % 10]
    grams = [Counter() for _ in range(order + 1)]
    for t in train:
        padded = [b"\n", *t]
        for k in range(1, len(padded)):
            grams[1][padded[k],] += 1
            for n in range(2, order + 1):
                if k - n + 1 >= 0:
                    grams[n][tuple(padded[k - n + 1 : k + 1])] += 1
    total, size = sum(grams[1].values()), len(grams[1])
    kept = [None, grams[1]] + [{g: c for g, c in grams[n].items() if c >= least} for n in range(2, order + 1)]
    left = [Counter() for _ in range(order + 1)]
    for n in range(2, order + 1):
        for g, c in kept[n].items():
            left[n][g[:-1]] += (c - discount) / kept[n - 1][g[:-1]]

    def p(gram):
        if len(gram) == 1:
            return (grams[1][gram] + 0.1) / (total + 0.1 * (size + 1))
        n = len(gram)
        own = (kept[n][gram] - discount) / kept[n - 1][gram[:-1]] if gram in kept[n] else 0
        return own + (1 - left[n][gram[:-1]]) * p(gram[1:])

    out = []
    for (i, _), t in zip(rows, tokens):
        padded = [b"\n", *t]
        score = sum(math.log10(p(tuple(padded[max(0, k - order + 1) : k + 1]))) for k in range(1, len(padded)))
        out.append((i, len(t), sum((w,) in grams[1] for w in t), total, sum(math.log10(p((w,))) for w in t), score))
    return out


def corpus(n=300, seed=6):
    rng = random.Random(seed)
    words = ["The", "cat", "sat", "on", "mat", "é", "dog", "ran", "to", "a"] + [f"w{i}" for i in range(60)]
    follow = {w: rng.sample(words, 4) for w in words}
    rows = []
    for i in range(n):
        w, text = rng.choice(words), []
        for _ in range(rng.randint(0, 40)):
            text.append(w)
            w = rng.choice(follow[w]) if rng.random() < 0.8 else rng.choice(words)
        rows.append((i, " ".join(text)))
    return rows + [(n, None), (n + 1, ""), (n + 2, "the CAT sat " * 3000), (None, "cat unseen-word"), (3, rows[3][1]), (3, rows[3][1])]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_match_brute_force(spark, order):
    rows = corpus()
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).repartition(3)
    out = eftrie.model_scores(frame, crc_bucket("doc_id", 10) == 0, settings=eftrie.Settings(order=order, chunk_bytes=2000)).collect()
    key = lambda r: (-1 if r[0] is None else r[0], r[1:])
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in out), key=key)
    for g, w in zip(got, sorted(brute(rows, order), key=key), strict=True):
        assert g[:4] == w[:4] and g[4] == pytest.approx(w[4], rel=1e-9) and abs(g[5] - w[5]) < 5e-5 * w[1] + 1e-9
    if order > 1:
        held = [r for r in out if r.held_out]
        assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_registered_query_keeps_what_is_seen_once(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op8_elias_fano_lm(spark, str(tmp_path)).collect()
    key = lambda r: (-1 if r[0] is None else r[0], r[1:])
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in out), key=key)
    for g, w in zip(got, sorted(brute(rows, 3, least=1), key=key), strict=True):
        assert g[:4] == w[:4] and abs(g[5] - w[5]) < 5e-5 * w[1] + 1e-9


def test_segments_opened_once_a_round_by_any_number_of_batches(spark, tmp_path, monkeypatch):
    opened, segment = f"{tmp_path}/opened", eftrie.Trie.segment

    def noted(self, part):
        with open(opened, "a") as out:
            out.write(f"{part}\n")
        return segment(self, part)

    monkeypatch.setattr(eftrie.Trie, "segment", noted)
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in corpus()], SCHEMA).repartition(3)
    cloudpickle.register_pickle_by_value(eftrie)  # so that workers have it with `noted`
    try:
        rows = eftrie.model_scores(frame, crc_bucket("doc_id", 10) == 0, settings=eftrie.Settings(chunk_bytes=500, tokens_per_part=2000)).collect()
    finally:
        cloudpickle.unregister_pickle_by_value(eftrie)
    with open(opened) as lines:
        times = Counter(lines)
    assert len(rows) == len(corpus()) and len(times) > 3 and max(times.values()) <= 3


def test_no_training_and_empty(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert eftrie.model_scores(frame, crc_bucket("doc_id", 10) == 0).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    (row,) = eftrie.model_scores(spark.createDataFrame([(held, "a b", "x", 1)], SCHEMA), crc_bucket("doc_id", 10) == 0).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)


@pytest.mark.parametrize("step", [1, 40, 100_000])
def test_elias_fano(step):
    rng = np.random.default_rng(2)
    values = np.cumsum(rng.integers(0, step + 1, 5000))
    code = eftrie.EliasFano.build(values)
    at = rng.integers(0, 5000, 2000)
    assert (code[at] == values[at]).all() and (code[np.arange(5000)] == values).all()
    same = eftrie.EliasFano.build(np.zeros(3000, np.int64))
    assert (same[np.arange(3000)] == 0).all()
