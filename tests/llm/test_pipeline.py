import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from clausula.llm import neardup, simhash  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n)]


def corpus(seed=1):
    rng = random.Random(seed)
    passage = " ".join(words(rng, 60))
    texts = [" ".join(words(rng, rng.randint(60, 200))) for _ in range(60)]
    texts += [f"{' '.join(words(rng, 90))} {passage} {' '.join(words(rng, 40))}" for _ in range(30)]
    base = words(rng, 150)
    for _ in range(60):
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(150)] = words(rng, 1)[0]
        texts.append(" ".join(copy))
    for t in texts[:15]:
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        texts += [t, t.upper().replace(" ", "\n"), " ".join(w)]
    return [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(texts)]


def brute_classes(texts, size=5, similarity=0.8):
    sets = [set(neardup.shingle_set((t or "").encode(), size).tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def test_near_duplicates_match_brute_force(spark):
    docs = corpus()
    n = len(docs)
    docs += [(n, None, None, None, None), (n + 1, "", None, None, None), (n + 2, "two words", None, None, None), (n + 3, "Two  Words", None, None, None), (0, docs[0][1], "en", "src0", 1), (None, docs[20][1] + " x", None, None, None), (n + 4, "long text here " * 20_000, None, None, None)]
    frame = spark.createDataFrame(docs, SCHEMA)
    out = neardup.one_of_each(frame)
    assert out.columns == frame.columns
    classes = brute_classes([d[1] for d in docs])
    found = [(r.doc_id, r.text) for r in out.collect()]
    assert len(found) == len(set(classes))
    by_row = {}
    for (key, text, *_), c in zip(docs, classes):
        by_row.setdefault((key, text), c)
    assert {by_row[f] for f in found} == set(classes)
    for key, text in found:
        ids = [d[0] for d, c in zip(docs, classes) if c == by_row[key, text]]
        assert key == min(ids, key=lambda i: -1 if i is None else i)


def template_corpus(pairs=200, seed=4):
    """Pairs of near-copies on one template: originals are at 0.78, those of a pair at little more than 0.8."""
    rng = random.Random(seed)
    template, texts = words(rng, 186), []
    for _ in range(pairs):
        own = words(rng, 26)
        copy = list(own)
        copy[12] = words(rng, 1)[0]
        texts += [" ".join(template + own), " ".join(template[:1] + words(rng, 1) + template[2:80] + words(rng, 1) + template[81:120] + words(rng, 1) + template[121:150] + words(rng, 1) + template[151:] + copy)]
    return texts


def test_crowded_buckets_lose_no_class(spark):
    texts = template_corpus()
    classes = brute_classes(texts)
    assert len(set(classes)) > 150
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
    keyed = frame.selectExpr("*", "doc_id AS nd__row")
    lowest, found = {}, {r.id: r.root for r in neardup.near_duplicate_classes(keyed, side=40).collect()}
    for i in sorted(found):
        lowest.setdefault(found[i], i)
    assert [lowest[found[i]] for i in range(len(texts))] == classes


def test_helper_names_in_the_input(spark):
    rows = [(i, t, i, "x", "y") for i, (_, t, *_) in enumerate(corpus()[:40])] * 2
    frame = spark.createDataFrame(rows, "doc_id long, text string, nd__row long, root string, nd__0 string")
    out = neardup.one_of_each(frame)
    assert out.columns == frame.columns
    assert sorted(tuple(r) for r in out.collect()) == sorted(set(rows))


def test_equal_prints_are_compared_with_each_other(spark):
    """Few words give many equal fingerprints: each bucket of one print holds texts that are similar to another than its head."""
    rng = random.Random(11)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(250)]
    frame = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, nd__row long")
    lowest, found = {}, {r.id: r.root for r in neardup.near_duplicate_classes(frame, side=20).collect()}
    for i in sorted(found):
        lowest.setdefault(found[i], i)
    assert [lowest[found[i]] for i in range(len(texts))] == brute_classes(texts)


def test_empty(spark):
    assert neardup.one_of_each(spark.createDataFrame([], SCHEMA)).collect() == []


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(9)
    docs = corpus(2)
    labels = []
    for i in range(0, len(docs), 4):
        toxic = i % 8 == 0
        if toxic:
            docs[i] = (i, docs[i][1] + " you zzfool zzclod you zzfool" * 2, *docs[i][2:])
        labels.append((i, 1, int(toxic)))
    n = len(docs)
    docs += [(n, "short text", "en", "src1", 1), (n + 1, "again and again " * 60, "en", "src1", 1), (n + 2, None, None, None, None)]
    rng.shuffle(docs)
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    frame, sizes, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), [len(docs)], []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, str(tmp_path))
        assert out.columns == frame.columns
        out.write.parquet(f"{tmp_path}/{name}")
        frame = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append({r.doc_id: r.text for r in frame.collect()})
        sizes.append(frame.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    assert not any("zzfool" in (t or "") for t in kept[0].values())
    assert not {n, n + 1, n + 2} & set(kept[1]) and n in kept[0]
    assert len(set(brute_classes(list(kept[2].values())))) == len(kept[2])
    assert len(set(brute_classes(list(kept[1].values())))) == len(kept[2])
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in final) == sorted(kept[3])


def test_minima_agree_with_similarity():
    rng = random.Random(0)
    import numpy as np

    multipliers = np.random.default_rng(7).integers(0, 2**63, 400, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    base = words(rng, 400)
    other = base[:360] + words(rng, 40)
    a, b = (neardup.shingle_set(" ".join(x).encode(), 5) for x in (base, other))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((neardup.minima(a, multipliers) == neardup.minima(b, multipliers)).mean() - true) < 0.08
    assert simhash.shingle_digests(b"", 5) == b""
