"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

Features: densities of a learned lexicon (words, and word beginnings for inflected languages), the share of hits close to
a second person, capitals, punctuation and obfuscation rates, and lengths. Words are compared in lower case, with look-
alike symbols turned into letters and other symbols dropped.

Fitting uses a bounded sample of labelled rows, `sample` rows of the lowest hashes of their id outside the held-out
bucket: two fifths give the lexicon (document frequencies by label, counted in the executors), two fifths the trees, one
fifth the calibration (trees and calibration share rows where labels are few). Only the lexicon (`lexicon_terms`) and dense features of the sample come to the driver. Scoring
reads every whole text in one narrow pass. Language, source and id are never inputs.

Defined results: null or empty text: the features of no words, scored like any other. Labels that are null count for
nothing; of an id's several labels the largest counts. Labels of one kind only, or none: the same score for all, the
share of label 1 (0 without labels). Null ids: held_out null. Repeated rows score alike. Empty table: no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausula.llm.common import blobs, chunks, crc_bucket, lean, small_batches, written


@dataclass(frozen=True)
class Settings:
    sample: int = 30_000
    lexicon_terms: int = 2000
    least_documents: int = 4
    least_ratio: float = 8.0
    prefixes: tuple[int, ...] = (4, 5, 6, 7)
    proximity: int = 5
    trees: int = 120
    depth: int = 3
    rate: float = 0.1
    bins: int = 48
    threshold: float = 0.3


#: Second-person words of the languages at hand, and look-alikes.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deiner ihr euch euer tu te toi ton ta tes vous votre vos ti tuyo usted ustedes vosotros vuestro".split())
LOOKALIKE = str.maketrans("@4301$5!7+", "aaeoissitt")
FEATURES = ["log_words", "log_hits", "density", "weight_density", "max_weight", "mean_weight", "near_second", "second_density", "capitals", "caps_words", "exclaims", "questions", "punctuation", "obfuscated", "digits", "mean_length"]


def plain(word: str) -> str:
    """Lower case, look-alikes as letters (if the word has a letter), other symbols dropped."""
    word = word.lower()
    if word.isalpha():
        return word
    if any(c.isalpha() for c in word):
        word = word.rstrip(".,;:!?").translate(LOOKALIKE)
    return "".join(c for c in word if c.isalpha())


def terms(word: str, prefixes: tuple[int, ...]) -> list[str]:
    """A plain word and its beginnings, marked by a star."""
    return [word] + [word[:n] + "*" for n in prefixes if len(word) > n]


class _Words(dict):
    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


class Features:
    """Dense features of many texts; remembers about cache_words distinct words."""

    def __init__(self, lexicon: dict[str, float], settings: Settings, cache_words: int = 150_000):
        self.lexicon, self.settings, self.cache_words = lexicon, settings, cache_words
        self._forget()

    def _forget(self) -> None:
        self.numbers, self.known = _Words(), np.zeros((0, 4), np.float32)

    def _about(self, raw: bytes) -> tuple[float, bool, bool, bool]:
        """Weight, second person, capitals, obfuscation."""
        word = raw.decode("utf-8", "replace")
        bare = plain(word)
        weight = max((self.lexicon.get(t, 0.0) for t in terms(bare, self.settings.prefixes)), default=0.0) if bare else 0.0
        inner = word.strip(".,;:!?\"'()")
        return weight, bare in SECOND_PERSON, len(inner) > 1 and inner.isupper(), bool(inner) and any(c.isalpha() for c in inner) and not inner.replace("'", "").replace("-", "").isalpha()

    def matrix(self, texts: list[bytes | None]) -> np.ndarray:
        texts = [t or b"" for t in texts]
        if len(self.numbers) > self.cache_words:
            self._forget()
        rows, counts = [], []
        for text in texts:
            words = text.split()
            rows.append(np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words)))
            counts.append(len(words))
        fresh, self.numbers.new = self.numbers.new, []
        if fresh:
            self.known = np.concatenate([self.known, np.array([self._about(w) for w in fresh], np.float32)])
        n = len(texts)
        about = self.known[np.concatenate(rows)] if rows else np.zeros((0, 4), np.float32)
        owner = np.repeat(np.arange(n), counts)
        weight, second = about[:, 0], about[:, 1] > 0
        hits = np.flatnonzero(weight > 0)
        marks = np.flatnonzero(second)
        near = np.zeros(len(hits), bool)
        if len(marks):
            for shift in (0, -1):
                at = np.clip(np.searchsorted(marks, hits) + shift, 0, len(marks) - 1)
                near |= (np.abs(marks[at] - hits) <= self.settings.proximity) & (owner[marks[at]] == owner[hits])
        per = lambda rows, values=None: np.bincount(rows, values, minlength=n).astype(float)
        words = np.array(counts, float)
        some = np.maximum(words, 1)
        n_hits, total = per(owner[hits]), per(owner[hits], weight[hits])
        top = np.zeros(n)
        np.maximum.at(top, owner[hits], weight[hits])
        raw = np.frombuffer(b"".join(texts), np.uint8)
        edges = np.r_[0, np.cumsum([len(t) for t in texts])]

        def share(flags: np.ndarray) -> np.ndarray:
            run = np.r_[0, np.cumsum(flags)]
            return run[edges[1:]] - run[edges[:-1]]

        size = np.maximum(np.diff(edges), 1)
        upper, digit = (raw >= 65) & (raw <= 90), (raw >= 48) & (raw <= 57)
        letter = upper | (raw >= 97) & (raw <= 122) | (raw >= 192)
        mark = (raw > 32) & (raw < 127) & ~letter & ~digit
        return np.stack([
            np.log1p(words), np.log1p(n_hits), n_hits / some, total / some, top, total / np.maximum(n_hits, 1), per(owner[hits], near) / np.maximum(n_hits, 1), per(owner[marks]) / some,
            share(upper) / np.maximum(share(letter), 1), per(owner, about[:, 2]) / some, share(raw == 33) / size, share(raw == 63) / size, share(mark) / size, per(owner, about[:, 3]) / some, share(digit) / size, size / some,
        ], axis=1)


class Trees:
    """Boosted regression trees for the logistic loss over binned features."""

    def __init__(self, start: float, edges: list[np.ndarray], trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]], depth: int):
        self.start, self.edges, self.trees, self.depth = start, edges, trees, depth

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, s: Settings, smooth: float = 5.0) -> Trees:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, s.bins + 1)[1:-1])) for j in range(x.shape[1])]
        rate = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        model = cls(float(np.log(rate / (1 - rate))), edges, [], s.depth)
        bins, width = model._binned(x), s.bins + 1
        value = np.full(len(y), model.start)
        for _ in range(s.trees):
            p = 1 / (1 + np.exp(-value))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            feature, cut, leaf = np.zeros(2**s.depth - 1, np.int64), np.full(2**s.depth - 1, width, np.int64), np.zeros(2**s.depth)
            for level in range(s.depth):
                first, count = 2**level - 1, 2**level
                best = np.full(count, 1e-6)
                for j in range(x.shape[1]):
                    key = node * width + bins[:, j]
                    gs, hs = (np.cumsum(np.bincount(key, v, minlength=count * width).reshape(count, width), axis=1) for v in (g, h))
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + smooth) + (gt - gs) ** 2 / (ht - hs + smooth) - gt**2 / (ht + smooth)
                    at = gain.argmax(axis=1)
                    top = gain[np.arange(count), at]
                    better = np.flatnonzero(top > best)
                    best[better] = top[better]
                    feature[first + better], cut[first + better] = j, at[better]
                node = 2 * node + (bins[np.arange(len(y)), feature[first + node]] > cut[first + node])
            gs, hs = (np.bincount(node, v, minlength=2**s.depth) for v in (g, h))
            leaf = s.rate * gs / (hs + smooth)
            value = value + leaf[node]
            model.trees.append((feature, cut, leaf))
        return model

    def score(self, x: np.ndarray) -> np.ndarray:
        bins, value, row = self._binned(x), np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = 2 * node + (bins[row, feature[at]] > cut[at])
            value += leaf[node]
        return 1 / (1 + np.exp(-value))


def isotonic(scores: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the blocks' mean scores and rates, both ascending."""
    order = np.argsort(scores, kind="stable")
    blocks: list[list[float]] = []
    for s, v in zip(scores[order], y[order].astype(float)):
        blocks.append([s, v, 1.0])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


class Model:
    def __init__(self, lexicon: dict[str, float], trees: Trees | None, steps: tuple[np.ndarray, np.ndarray] | None, base: float, settings: Settings):
        self.lexicon, self.trees, self.steps, self.base, self.settings = lexicon, trees, steps, base, settings

    def calibrated(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.base)
        raw = self.trees.score(x)
        return np.clip(0.999 * np.interp(raw, *self.steps) + 0.001 * raw, 0, 1)  # the second term only orders what a step holds


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out: Column | None = None, settings: Settings = Settings()) -> Model:
    """held_out: a condition on the id column; rows for which it holds are never learned from."""
    small_batches(docs.sparkSession)
    s = settings
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where("id IS NOT NULL AND label IN (0, 1)").groupBy("id").agg(F.max("label").cast("int").alias("label"))
    if held_out is not None:
        known = known.withColumn(id_col, F.col("id")).where(~held_out).drop(id_col)
    known = known.orderBy(F.xxhash64("id"), "id").limit(s.sample).withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "id"), F.lit(5)).cast("int"))
    # at most `sample` rows of 16 bytes: small enough to send to every executor
    sample = written(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).dropna(subset=["id"]).join(F.broadcast(known), "id").select("text", "label", "fold"), "sample")
    folds = {(r.fold, r.label): r["count"] for r in sample.groupBy("fold", "label").count().collect()}
    ones, total = sum(n for (_, y), n in folds.items() if y), sum(folds.values())
    if not ones or ones == total:
        return Model({}, None, None, ones / total if total else 0.0, s)
    # few labels: trees and calibration share rows, and with hardly any all rows do everything
    shares = [((0, 1), (2, 3), (4,)), ((0, 1, 2), (3, 4), (3, 4)), ((0, 1, 2, 3, 4),) * 3]
    enough = [share for share, least in zip(shares, (20, 5, 0)) if all(sum(folds.get((f, y), 0) for f in part) >= least for part in share for y in (0, 1))][0]
    parts = dict(zip(("lexicon", "trees", "steps"), map(list, enough)))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for text, label in zip(blobs(batch.column(0)), batch.column(1).to_pylist()):
                words = {plain(w) for w in set((text or b"").decode("utf-8", "replace").split())} - {""}
                seen[label].update({t for w in words for t in terms(w, s.prefixes)})
            found = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([seen[0][t] for t in found], pa.int64()), pa.array([seen[1][t] for t in found], pa.int64())], ["term", "zeros", "ones"])

    inside = lambda part: F.col("fold").isin(parts[part])
    n = {y: sum(folds.get((f, y), 0) for f in parts["lexicon"]) for y in (0, 1)}
    counts = sample.where(inside("lexicon")).select("text", "label").mapInArrow(lean(counted), "term string, zeros long, ones long").groupBy("term").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"))
    ratio = (F.col("ones") / (n[1] + 1.0)) / ((F.col("zeros") + 0.5) / (n[0] + 1.0))
    best = counts.where(F.col("ones") >= s.least_documents).withColumn("ratio", ratio).where(F.col("ratio") >= s.least_ratio).orderBy((F.log("ratio") * F.sqrt("ones")).desc(), "term").limit(s.lexicon_terms)
    lexicon = {r.term: math.log(r.ratio) for r in best.select("term", "ratio").collect()}

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(lexicon, s)
        for batch in batches:
            texts = blobs(batch.column(0))
            for a, b in chunks(texts, 2 << 20):
                yield pa.RecordBatch.from_arrays([pa.array(features.matrix(texts[a:b]).tolist(), pa.list_(pa.float64())), batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a)], ["x", "label", "fold"])

    rows = sample.where(inside("trees") | inside("steps")).select("text", "label", "fold").mapInArrow(lean(dense), "x array<double>, label int, fold int").collect()
    x, y, fold = np.array([r.x for r in rows]), np.array([r.label for r in rows]), np.array([r.fold for r in rows])
    order = np.lexsort((*x.T, y, fold))  # the same model whatever order the rows arrive in
    x, y, fold = x[order], y[order], fold[order]
    own = np.isin(fold, parts["trees"])
    trees = Trees.fit(x[own], y[own], s)
    own = np.isin(fold, parts["steps"])
    return Model(lexicon, trees, isotonic(trees.score(x[own]), y[own]), ones / total, s)


def _scored(model: Model, texts: list[bytes | None], features: Features) -> np.ndarray:
    found = [model.calibrated(features.matrix(texts[a:b])) for a, b in chunks(texts, 2 << 20)]
    return np.concatenate(found) if found else np.zeros(0)


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score and predicted of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(model.lexicon, model.settings)
        for batch in batches:
            score = _scored(model, blobs(batch.column(1)), features)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= model.settings.threshold).astype(np.int32))], ["id", "score", "predicted"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(lean(run), f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(model.lexicon, model.settings)
        for batch in batches:
            yield batch.filter(pa.array(_scored(model, blobs(batch.column(at)), features) < model.settings.threshold))

    return docs.mapInArrow(lean(run), docs.schema)


def toxic_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", settings: Settings = Settings()) -> DataFrame:
    """id, held_out (crc32 of the id modulo 4 is 2), score, predicted."""
    held_out = crc_bucket(id_col, 4) == 2
    model = fit(docs, labels, id_col, text_col, label_col, held_out, settings)
    return score_documents(docs, model, id_col, text_col).select(id_col, held_out.alias("held_out"), "score", "predicted")
