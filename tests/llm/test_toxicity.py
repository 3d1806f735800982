import random
import zlib

import numpy as np

from clausula.llm import toxicity
from clausula.llm.common import crc_bucket

SCHEMA = "doc_id long, text string, score string, label int"


def corpus(n=1500, seed=4):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        bad = i % 5 == 0
        if bad:
            for _ in range(rng.randint(2, 5)):
                text[rng.randrange(len(text))] = rng.choice(["zzloser", "ZZscum!", "zzsc*um", "you", "zztr4sh" + rng.choice(["en", "er", "e"])])
        docs.append((i, " ".join(text), "s", 1))
        labels.append((i, int(bad)))
    return docs, labels


def test_held_out_accuracy_and_determinism(spark):
    docs, labels = corpus()
    frame, known = spark.createDataFrame(docs + [(5000, None, None, None), (5001, "", None, None), (None, "x", None, None), (5002, "w " * 100_000, None, None), (3, "again", None, None)], SCHEMA), spark.createDataFrame(labels + [(1, None), (None, 1), (9999, 1)], "doc_id long, toxic int")
    out = toxicity.toxic_scores(frame, known).collect()
    assert len(out) == 1505
    truth = dict(labels)
    held = [r for r in out if r.held_out and r.doc_id in truth and not (r.doc_id == 3)]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2 and i != 3}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    again = toxicity.toxic_scores(frame.repartition(7), known.repartition(3)).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again))


def test_held_out_labels_are_not_learned(spark):
    docs, labels = corpus(600)
    frame = spark.createDataFrame(docs, SCHEMA)
    lied = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in labels]
    a = toxicity.toxic_scores(frame, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    b = toxicity.toxic_scores(frame, spark.createDataFrame(lied, "doc_id long, toxic int")).collect()
    assert sorted(a) == sorted(b)


def test_no_labels_and_empty(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    docs = spark.createDataFrame([(1, "a", "s", 1)], SCHEMA)
    assert [(r.score, r.predicted) for r in toxicity.toxic_scores(docs, none).collect()] == [(0.0, 0)]
    assert toxicity.toxic_scores(docs.limit(0), none).collect() == []
    model = toxicity.fit(docs, none, held_out=crc_bucket("doc_id", 4) == 2)
    assert toxicity.drop_toxic(docs, model).collect() == docs.collect()


def test_isotonic_is_ascending():
    rng = np.random.default_rng(0)
    x = rng.random(500)
    at, rate = toxicity.isotonic(x, (rng.random(500) < x).astype(int))
    assert (np.diff(at) >= 0).all() and (np.diff(rate) > 0).all()
    found = toxicity.isotonic(np.array([1.0, 2, 3, 4]), np.array([0, 1, 0, 1]))
    assert found[0].tolist() == [1, 2.5, 4] and found[1].tolist() == [0, 0.5, 1]
