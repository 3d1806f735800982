import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from clausula.llm import budget

SCHEMA = "doc_id long, text string, lang string, source string"
DOMAIN = "CASE WHEN source LIKE 'web%' THEN 'web' ELSE 'books' END"
WEIGHTS = ({"web": 3.0, "books": 1.0}, {"en": 2.0}, {"web0": 0.5, "web1": 4.0, "print": 0.0})


@pytest.fixture
def mix(spark):
    return budget.Mix(WEIGHTS, 0.6, 2, 17, F.expr(DOMAIN))


def corpus(n=600, seed=3):
    """A hot source, a source of weight nought, wordless texts, nulls in every column, repeated rows and ids."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = "web0" if i % 3 == 0 else rng.choice(["web1", "web2", "novels", "print", None])
        rows.append((i, " ".join("w" for _ in range(rng.randint(0, 40))), rng.choice(["en", "de", None]), source))
    return rows + rows[:20] + [(n, None, "en", "web1"), (None, "a b c", None, None), (None, "a b c", None, None), (5, "another text", "en", "web1"), (n + 1, " \t\n", "de", "novels"), (n + 2, "long " * 50_000, "de", "novels")]


def shares(nodes, total):
    """Water filling one step at a time. nodes: name to (weight, capacity)."""
    given, open_nodes = {k: 0.0 for k in nodes}, {k for k, (w, _) in nodes.items() if w > 0}
    while open_nodes:
        level = total / sum(nodes[k][0] for k in open_nodes)
        full = {k for k in open_nodes if nodes[k][1] <= level * nodes[k][0]}
        if not full:
            return given | {k: level * nodes[k][0] for k in open_nodes}
        for k in full:
            given[k] = nodes[k][1]
            total -= nodes[k][1]
        open_nodes -= full
    return given


def brute(rows, mix):
    """Sorted (doc_id, leaf, leaf budget, epoch) of every copy taken."""
    leaves, tokens = {}, {}
    for key, text, lang, source in rows:
        leaf = ("web" if (source or "").startswith("web") else "books", lang or "", source or "")
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        leaves.setdefault(leaf, []).append((key, n))
        tokens[leaf] = tokens.get(leaf, 0) + n
    capacity = {}
    for leaf, n in tokens.items():
        for depth in (1, 2, 3):
            capacity[leaf[:depth]] = capacity.get(leaf[:depth], 0) + n * mix.max_epochs
    got = {(): float(int(sum(tokens.values()) * mix.budget_share))}
    for depth in (1, 2, 3):
        for parent in {k[: depth - 1] for k in capacity if len(k) == depth}:
            nodes = {k: (mix.weights[depth - 1].get(k[-1], 1.0), capacity[k]) for k in capacity if len(k) == depth and k[:-1] == parent}
            got |= shares(nodes, got[parent])
    out = []
    for leaf, members in leaves.items():
        own = int(got[leaf] + 1e-6)
        whole, part = divmod(own, tokens[leaf]) if tokens[leaf] else (0, 0)
        ordered = {}
        for key, n in members:
            digest = hashlib.md5(f"{mix.seed}:{whole}:{'' if key is None else key}".encode()).hexdigest()
            ordered.setdefault(digest, []).append((key, n))
        before = 0
        for digest in sorted(ordered):
            times = whole + (part > 0 and before < part)
            before += sum(n for _, n in ordered[digest])
            out += [(str(key), *leaf, own, epoch) for key, _ in ordered[digest] for epoch in range(times)]
    return sorted(out)


@pytest.mark.parametrize("share,epochs", [(0.6, 2), (1.0, 1), (1.9, 2), (0.05, 1), (0.0, 2)])
def test_mixture_matches_brute_force(spark, share, epochs):
    mix = budget.Mix(WEIGHTS, share, epochs, 17, F.expr(DOMAIN))
    rows = corpus()
    found = budget.mixture(spark.createDataFrame(rows, SCHEMA), mix).collect()
    assert sorted((str(r.doc_id), r.domain, r.lang, r.source, r.leaf_budget, r.epoch) for r in found) == brute(rows, mix)
    assert (len(found) > 0) == (share > 0)


def test_sql_gives_the_same_rows(spark, mix, tmp_path):
    frame = spark.createDataFrame(corpus(seed=8), SCHEMA)
    frame.write.parquet(f"{tmp_path}/documents")
    found = budget.mixture(frame, mix)
    sql = budget.mixture_sql(f"read_parquet('{tmp_path}/documents/*.parquet')", DOMAIN, mix)
    told = duckdb.sql(f"SELECT {', '.join(found.columns)} FROM ({sql})").fetchall()
    assert sorted(map(str, told)) == sorted(str(tuple(r)) for r in found.collect())


def test_shortage_goes_to_siblings_first():
    """The naive filling itself: what web1 lacks stays with web0, and the other domain gets nothing of it."""
    assert shares({"web0": (1.0, 1000), "web1": (1.0, 10)}, 200.0) == {"web0": 190.0, "web1": 10}
    assert shares({"a": (1.0, 5), "b": (0.0, 50)}, 200.0) == {"a": 5, "b": 0.0}


def test_shortage_in_a_family(spark):
    rows = [(i, "w " * 10, "en", "web0") for i in range(100)] + [(200, "w " * 10, "en", "web1")] + [(300 + i, "w " * 10, "en", "novels") for i in range(100)]
    mix = budget.Mix(({}, {}, {}), 0.5, 1, 17, F.expr(DOMAIN))
    plan = {r.source: r.leaf_budget for r in budget.mixture(spark.createDataFrame(rows, SCHEMA), mix).select("source", "leaf_budget").distinct().collect()}
    assert plan == {"web0": 492, "web1": 10, "novels": 502}


def test_mixed_documents_keep_their_columns(spark, mix):
    rows = [(*r, i, "x") for i, r in enumerate(corpus(200))]
    frame = spark.createDataFrame(rows, SCHEMA + ", budget long, tokens string")
    out = budget.mixed_documents(frame, mix)
    assert out.columns == frame.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(b[0] for b in brute(corpus(200), mix))


def test_clashing_helper_columns(spark, mix):
    rows = [(*r, f"own {i}", i, "k") for i, r in enumerate(corpus(120))]
    frame = spark.createDataFrame(rows, SCHEMA + ", mix__domain string, mix__times long, mix__budget string")
    out = budget.mixed_documents(frame, mix)
    assert out.columns == frame.columns
    taken = out.collect()
    assert sorted(str(r.doc_id) for r in taken) == sorted(b[0] for b in brute(corpus(120), mix))
    assert {tuple(r) for r in taken} <= set(rows)


def test_empty_and_wordless(spark, mix):
    empty = spark.createDataFrame([], SCHEMA)
    assert budget.mixture(empty, mix).collect() == []
    assert budget.mixed_documents(empty, mix).collect() == []
    assert budget.mixture(spark.createDataFrame([(1, None, None, None), (2, "", "en", "web1")], SCHEMA), mix).collect() == []
