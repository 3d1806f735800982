"""Approximate nearest neighbours: inverted file with product-quantised residuals, exact reranking.

The index is fitted on a bounded sample (`sample` vectors of the lowest hashes): k-means centroids, and for each of
`subspaces` slices of the residuals a codebook of up to 256 words. Every vector is then indexed: its list is the nearest
centroid's, its code the nearest codebook words of the residual, beside the length of what the code misses. A query
first looks exactly through its `first_probes` best lists; the k-th best score found is its threshold. Then it looks into
the `probes` best lists with asymmetric distance tables (the query's products with centroid and codebook words): every
vector whose table score, plus `margin` standard deviations of its code's error, reaches the threshold is ranked
exactly, by the inner product of the original vectors in double precision, ties to the smaller id. So a crowd of near
copies, whose codes cannot tell them apart, is ranked exactly as a whole, while elsewhere few rows are.

Lists are dealt in blocks of about `block_rows` rows, so a list that holds a third of all vectors is many tasks, each of
which sees its list's queries and returns at most k rows for a query; the k best of a query's blocks are merged last.
Only the model (bounded by its parameters) and the list sizes come to the driver.

Defined results: vectors that are null, zero, of another length than most of the sample's, or hold null or non-finite
components take no part. Repeated rows of one id count once for each score; a query's own id never is. Fewer candidates than
k: all that are found. Empty table: no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausula.llm.common import written


@dataclass(frozen=True)
class Settings:
    """probe_share: of the lists; at least min_probes of them. margin: standard deviations of the codes' error that count as near."""

    sample: int = 16_384
    max_lists: int = 1024
    subspaces: int = 16
    codewords: int = 256
    rounds: int = 8
    first_probes: int = 2
    min_probes: int = 12
    probe_share: float = 0.7
    margin: float = 2.5
    block_rows: int = 4096
    seed: int = 11


class Model:
    """Centroids and codebooks."""

    def __init__(self, centroids: np.ndarray, books: list[np.ndarray]):
        self.centroids, self.books = centroids, books
        self.edges = np.r_[0, np.cumsum([b.shape[1] for b in books])]

    @property
    def width(self) -> int:
        return self.centroids.shape[1]

    @classmethod
    def fit(cls, vectors: np.ndarray, lists: int, settings: Settings) -> Model:
        rng = np.random.default_rng(settings.seed)
        centroids = kmeans(vectors, lists, settings.rounds, rng)
        rest = vectors - centroids[nearest(vectors, centroids)]
        slices = np.array_split(np.arange(vectors.shape[1]), min(settings.subspaces, vectors.shape[1]))
        return cls(centroids, [kmeans(rest[:, s], settings.codewords, settings.rounds, rng) for s in slices])

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lists = nearest(vectors, self.centroids)
        rest = vectors - self.centroids[lists]
        codes = np.stack([nearest(rest[:, a:b], book) for a, b, book in zip(self.edges[:-1], self.edges[1:], self.books)], axis=1)
        return lists, codes.astype(np.uint8)

    def decode(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return self.centroids[lists] + np.concatenate([book[codes[:, s]] for s, book in enumerate(self.books)], axis=1)

    def tables(self, queries: np.ndarray) -> list[np.ndarray]:
        return [queries[:, a:b] @ book.T for a, b, book in zip(self.edges[:-1], self.edges[1:], self.books)]


def nearest(vectors: np.ndarray, centres: np.ndarray, block: int = 8192) -> np.ndarray:
    """The nearest centre (Euclidean) of each vector; ties to the first."""
    norms, found = (centres**2).sum(1), np.zeros(len(vectors), np.int64)
    for i in range(0, len(vectors), block):
        found[i : i + block] = np.argmin(norms - 2 * (vectors[i : i + block] @ centres.T), axis=1)
    return found


def kmeans(vectors: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    distinct = np.unique(vectors, axis=0)
    if len(distinct) <= k:
        return distinct
    centres = distinct[rng.choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        own = nearest(vectors, centres)
        sizes = np.bincount(own, minlength=k)
        order = np.argsort(own, kind="stable")
        used = np.flatnonzero(sizes)
        centres = centres.copy()
        centres[used] = np.add.reduceat(vectors[order], (np.cumsum(sizes) - sizes)[used], axis=0) / sizes[used, None]
        empty = np.flatnonzero(sizes == 0)
        centres[empty] = distinct[rng.choice(len(distinct), len(empty), replace=False)]
    return centres


def usable(vector: str, width: int | None = None) -> Column:
    """No null, non-finite or missing component, and not zero throughout."""
    v = F.col(vector)
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return good if width is None else good & (F.size(v) == width)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def best_in_block(ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, errors: np.ndarray, centroid: np.ndarray, model: Model, query_ids: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int, margin: float, cells: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query ids, ids, exact scores) of the best k of one block for each query, among those that may reach its least score."""
    step = max(1, cells // len(ids))
    spread = margin * errors / math.sqrt(vectors.shape[1])
    for begin in range(0, len(query_ids), step):
        asking, some = query_ids[begin : begin + step], queries[begin : begin + step]
        score = np.repeat((some @ centroid)[:, None], len(ids), axis=1)
        for s, table in enumerate(model.tables(some)):
            score += table[:, codes[:, s]]
        score += np.linalg.norm(some, axis=1)[:, None] * spread[None, :]
        near = (score >= least[begin : begin + step, None]) & (ids[None, :] != asking[:, None])
        query, row = np.nonzero(near)
        exact = np.empty(len(row))
        for i in range(0, len(row), 1 << 16):
            exact[i : i + (1 << 16)] = (vectors[row[i : i + (1 << 16)]] * some[query[i : i + (1 << 16)]]).sum(axis=1)
        order = np.lexsort((ids[row], -exact, query))
        query, row, exact = query[order], row[order], exact[order]
        first = np.searchsorted(query, query)
        top = np.arange(len(query)) - first < k
        yield asking[query[top]], ids[row[top]], exact[top]


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """query_id, rank, id, score: the k nearest found of every row for which is_query holds."""
    spark = vectors.sparkSession
    out_kind = "query_id long, id long, score double"
    rows = vectors.where(usable(vector_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), is_query.alias("asks"))
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(settings.sample).select("vector").collect()
    if not picked:
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    widths = np.bincount([len(r.vector) for r in picked])
    width = int(widths.argmax())
    rows = rows.where(F.size("vector") == width)
    total = rows.count()
    lists = max(1, min(settings.max_lists, int(math.sqrt(total) / 2), len(picked) // 8))
    model = Model.fit(np.array([r.vector for r in picked if len(r.vector) == width], np.float64), lists, settings)
    lists = len(model.centroids)
    probes = min(lists, max(settings.min_probes, math.ceil(lists * settings.probe_share)))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, codes = model.encode(_matrix(batch.column(1), width))
            missed = np.linalg.norm(_matrix(batch.column(1), width) - model.decode(own, codes), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(missed)], ["id", "vector", "asks", "list", "code", "missed"])

    element = vectors.schema[vector_col].dataType.simpleString()
    index = written(rows.mapInArrow(encoded, f"id long, vector {element}, asks boolean, list int, code binary, missed double"), "ivf")
    sizes = {r.list: r["count"] for r in index.groupBy("list").count().collect()}
    blocks = [max(1, math.ceil(sizes.get(i, 0) / settings.block_rows)) for i in range(lists)]
    block = F.pmod(F.xxhash64("id"), F.element_at(F.array(*[F.lit(b) for b in blocks]), F.col("list") + 1)).cast("int")

    filled = np.array([sizes.get(i, 0) > 0 for i in range(lists)])

    def probed(most: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                near = _matrix(batch.column(1), width) @ model.centroids.T
                near[:, ~filled] = -np.inf
                chosen = np.argsort(-near, axis=1, kind="stable")[:, :most]
                which, lists_of, blocks_of = [], [], []
                for i, row in enumerate(chosen.tolist()):
                    for own in row:
                        which += [i] * blocks[own]
                        lists_of += [own] * blocks[own]
                        blocks_of += range(blocks[own])
                rows_of = pa.array(which, pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows_of) for c in range(3)), pa.array(lists_of, pa.int32()), pa.array(blocks_of, pa.int32())], ["id", "vector", "least", "list", "block"])

        return run

    def compared(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], names)
        left = left.sort_by("id")
        codes = np.frombuffer(b"".join(left.column("code").to_pylist()), np.uint8).reshape(left.num_rows, -1)
        block_vectors, asked_vectors = (_matrix(t.column("vector").combine_chunks(), width) for t in (left, right))
        found = list(best_in_block(left.column("id").to_numpy(), block_vectors, codes, left.column("missed").to_numpy(), model.centroids[left.column("list")[0].as_py()], model, right.column("id").to_numpy(), asked_vectors, right.column("least").to_numpy(), k, settings.margin))
        return pa.table([np.concatenate([f[i] for f in found]) for i in range(3)], names)

    def pairs(asking: DataFrame, most: int) -> DataFrame:
        asked = asking.mapInArrow(probed(most), f"id long, vector {element}, least double, list int, block int")
        kept = index.select("id", "vector", "code", "missed", "list", block.alias("block"))
        return kept.groupBy("list", "block").cogroup(asked.groupBy("list", "block")).applyInArrow(compared, out_kind)

    asking = index.where("asks").select("id", "vector").distinct()
    worst = F.lit(float("-inf"))
    first = written(pairs(asking.select("id", "vector", worst.alias("least")), min(settings.first_probes, probes)), "first")
    nth = Window.partitionBy("query_id").orderBy(F.col("score").desc())
    least = first.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"))
    second = pairs(written(asking.join(least, "id", "left").select("id", "vector", F.coalesce("least", worst).alias("least")), "asking"), probes)
    found = first.unionByName(second).distinct()
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
