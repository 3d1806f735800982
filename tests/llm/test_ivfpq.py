import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausula.llm import ivfpq

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def data(n, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 16))
    rows = [(i, (centres[i % 6] + 0.3 * rng.normal(size=16)).astype(np.float32).tolist(), 1, "s") for i in range(n)]
    same = rows[3][1]
    return rows + [(n + i, same, 1, "s") for i in range(n // 3)]


def brute(rows, k):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], np.float64)
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = (x * x[i]).sum(axis=1)
        s[ids == ids[i]] = -np.inf
        o = np.lexsort((ids, -s))[:k]
        out[int(ids[i])] = [(int(ids[j]), s[j]) for j in o if s[j] > -np.inf]
    return out


@pytest.mark.parametrize("block_rows", [50, 4096])
def test_recall_and_scores(spark, block_rows):
    rows = data(900)
    odd = [(5000, None, 1, "s"), (5001, [0.0] * 16, 1, "s"), (5002, [float("nan")] + [1.0] * 15, 1, "s"), (5003, [float("inf")] * 16, 1, "s"), (5004, [None] + [1.0] * 15, 1, "s"), (5005, [9.0] * 3, 1, "s"), (None, [9.0] * 16, 1, "s"), (5020, [], 1, "s")]
    shuffled = rows + odd + rows[:3]
    random.Random(1).shuffle(shuffled)
    out = ivfpq.search(spark.createDataFrame(shuffled, SCHEMA), F.col("vec_id") % 20 == 0, settings=ivfpq.Settings(block_rows=block_rows)).collect()
    want, got = brute(rows, 20), {}
    for r in sorted(out, key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(want)
    exact = {(q, i): s for q, found in brute(rows, len(rows)).items() for i, s in found}
    for q, found in got.items():
        assert len(found) == 20 and found == sorted(found, key=lambda x: (-x[1], x[0]))
        assert all(s == pytest.approx(exact[q, i], abs=1e-12) for i, s in found)
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]
    assert np.mean(hits) >= 0.9


def test_few_candidates_and_empty(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0], 1, "s"), (7, [2.0, 1.0], 1, "s"), (8, [2.0, 1.0], 1, "s")], SCHEMA)
    assert [tuple(r) for r in ivfpq.search(few, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 7, 4.0), (0, 2, 8, 4.0)]
    assert ivfpq.search(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0).collect() == []
