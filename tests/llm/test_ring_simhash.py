import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from clausula.llm import ring, simhash

SCHEMA = "doc_id long, text string, fp string, extra int"


def rows(n, seed=0, repeat=0):
    rng = random.Random(seed)
    found = [(i, " ".join(rng.choice(["a", "bb", "ccc", "D", "é"]) for _ in range(rng.randint(0, 12))), "x", 1) for i in range(n)]
    return found + [(7, "same row", "x", 1)] * repeat + [(n + 1, None, None, None), (None, "no id", None, None), (n + 2, "", None, None), (n + 3, "long " * 5000, None, None)]


def filled(keys, r, room):
    """One key after the other."""
    room, found = list(room), {}
    for arc, ticket, row in sorted(keys, key=lambda k: (k[1] % 2**64, k[2])):
        s = next(s for s in r.arcs[arc] if room[s])
        room[s] -= 1
        found[row] = s
    return found


@pytest.mark.parametrize("few", [0, 40, 10_000])
@pytest.mark.parametrize("repeat", [0, 60])
def test_ring_matches_one_by_one_filling(spark, few, repeat):
    docs = spark.createDataFrame(rows(150, repeat=repeat), SCHEMA)
    out = ring.shard_rows(docs, shards=5, virtual=4, few=few).collect()
    counts = Counter(r.shard for r in out)
    assert len(out) == 154 + repeat and max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(r.slot for r in out if r.shard == s) == list(range(n))
    r = ring.Ring(5, 4)
    keys = docs.selectExpr("doc_id", "text", "xxhash64('ticket', doc_id, text) ticket", "xxhash64('place', doc_id) place").collect()
    want = Counter()
    placed = filled([(r.arc(k.place), k.ticket, i) for i, k in enumerate(keys)], r, ring.capacities(len(keys), 5))
    for i, k in enumerate(keys):
        want[k.doc_id, placed[i]] += 1
    assert want == Counter((x.doc_id, x.shard) for x in out)
    assert {x.size for x in out if x.doc_id == 151} == {1} and {x.text_crc32 for x in out if x.doc_id == 151} == {None}


def test_ring_moves_little(spark):
    """Most keys stay where the plain ring puts them."""
    docs = spark.range(4000).selectExpr("id doc_id", "string(id) text")
    out = {x.doc_id: x.shard for x in ring.shard_rows(docs, shards=8, virtual=128).collect()}
    r = ring.Ring(8, 128)
    plain = {k.doc_id: r.arcs[r.arc(k.place)][0] for k in docs.selectExpr("doc_id", "xxhash64('place', doc_id) place").collect()}
    assert sum(out[k] == plain[k] for k in out) > 3000


def test_ring_empty(spark):
    assert ring.shard_rows(spark.createDataFrame([], SCHEMA)).collect() == []


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, ids, distance=2):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                parent[find(i)] = find(j)
    lowest = {}
    for i in range(len(fps)):
        if ids[i] is not None:
            lowest[find(i)] = min(lowest.get(find(i), ids[i]), ids[i])
    return [lowest.get(find(i)) for i in range(len(fps))]


def test_simhash_matches_brute_force(spark):
    data = rows(300, seed=3, repeat=5)
    out = simhash.near_components(spark.createDataFrame(data, SCHEMA)).collect()
    fps = [brute_fingerprint(t) for _, t, _, _ in data]
    want = brute_components(fps, [d[0] for d in data])
    assert Counter((d[0], f"{f:016x}", c) for d, f, c in zip(data, fps, want)) == Counter(tuple(x) for x in out)


@pytest.mark.parametrize("crowd", [64, 3, 0])
def test_links_keep_components(spark, crowd):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for f in list(fps)[:25]:
        for _ in range(12):
            f ^= 1 << rng.randrange(64) | 1 << rng.randrange(64) | (rng.random() < 0.2) << rng.randrange(64)
            fps.add(f)
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    nodes = spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp long, first long")
    roots = {x.node: x.root for x in simhash.components(simhash.links(nodes, crowd=crowd)).collect()}
    want = brute_components([f % 2**64 for f in fps], fps)
    assert [roots.get(f, f) for f in fps] == want


def test_anchors_cover():
    rng = np.random.default_rng(1)
    x = rng.integers(-(2**63), 2**63, 400, dtype=np.int64)
    flip = np.array([1 << int(b) if b < 63 else -(1 << 63) for b in rng.integers(0, 64, 800)], np.int64)
    y = x ^ flip[:400] ^ flip[400:]
    home, row, _ = simhash.anchors(x, 0)
    assert len(home) == 400 and (row == np.arange(400)).all()
    key, row, _ = simhash.anchors(y, 2)
    reached = set(zip(row.tolist(), key.tolist()))
    assert all((i, int(h)) in reached for i, h in enumerate(home))


def test_simhash_empty(spark):
    assert simhash.near_components(spark.createDataFrame([], SCHEMA)).collect() == []
