"""SimHash near-duplicates by anchor-point covering.

A text's fingerprint has 64 bits: the majority, bit by bit, of the XXH64 (seed 42) of its word shingles. Fingerprints
link at `distance` or fewer differing bits. The anchors are the words of a covering code: the product of two perfect
binary Golay codes of length 23 over the fingerprint's lowest 46 bits. Each block's covering radius is 3, so every
fingerprint has one home anchor within 3 bits in either block, and whatever lies within `distance` bits of it lies
within 3 + d1 and 3 + d2 bits of that anchor, d1 + d2 <= distance. Each distinct fingerprint is therefore replicated to
all anchors within that reach (about 68 of 2**24 for distance 2), and compared there with those at home. No link is lost.

Equal fingerprints are one node from the start. An anchor at home to more than `crowd` fingerprints is not compared
pair by pair: two words are within 2 bits exactly if they share a word within 1 bit of both, so the fingerprints that
reach a crowded anchor are grouped by these midpoints instead, at most 65 to a group, and each group gives a star.
Both give the same links' components; the number of rows stays proportional to the number of fingerprints.

Defined results: null or wordless text: fingerprint zero, linked like any other. Null ids keep their row and count for
nothing in component_id, which is null where a component has null ids only. Repeated rows: each is returned. Empty
table: no rows. Only the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausula.llm.common import blobs, lean, written
from clausula.llm.components import components

SEED = 42
#: Fixed value: a generator polynomial of the binary Golay code of length 23, dimension 12, covering radius 3.
GOLAY, LENGTH, RADIUS, BLOCKS = 0b110001110101, 23, 3, 2


def shingle_digests(text: bytes | None, size: int) -> bytes:
    """The big-endian XXH64 digests of a text's word shingles one after the other; of the whole sequence if it has fewer words."""
    words = (text or b"").lower().split()
    if not words:
        return b""
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    if len(words) <= size:
        return digest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    return b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[: 1 - size].tolist(), ends[size - 1 :].tolist())])


def fingerprint(digests: bytes, block: int = 1 << 16) -> bytes:
    """The 8 big-endian bytes of the bitwise majority (over half)."""
    words = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(words), block):
        ones += np.unpackbits(words[i : i + block], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(words)).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """id and fp (the fingerprint as a signed long) of each row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = b"".join(fingerprint(shingle_digests(t, shingle)) for t in blobs(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.frombuffer(found, ">i8").astype(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(lean(run), f"id {kind}, fp long")


def _remainder(words: np.ndarray) -> np.ndarray:
    words = words.copy()
    for bit in range(LENGTH - 1, LENGTH - 12 - 1, -1):
        words ^= np.where(words >> bit & 1, GOLAY << bit - 11, 0)
    return words


@lru_cache(maxsize=4)
def offsets(distance: int) -> list[np.ndarray]:
    """By e from 0 to distance: for each syndrome, what to add to a word to get the code's words at 3 + e bits (for 0: at 3 or fewer); padded with -1."""
    words = np.array([sum(1 << b for b in bits) for k in range(RADIUS + distance + 1) for bits in combinations(range(LENGTH), k)], np.int64)
    syndromes, extra = _remainder(words), np.maximum(np.bitwise_count(words).astype(np.int64) - RADIUS, 0)
    found = []
    for e in range(distance + 1):
        rows = [words[(extra == e)][syndromes[extra == e] == s] for s in range(1 << 11)]
        table = np.full((1 << 11, max(map(len, rows))), -1, np.int64)
        for s, row in enumerate(rows):
            table[s, : len(row)] = row
        found.append(table)
    return found


def anchors(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For int64 fingerprints: anchor, index into fps, and whether it is the home, for every anchor within reach."""
    tables, mask = offsets(distance), (1 << LENGTH) - 1
    blocks = [fps >> LENGTH * b & mask for b in range(BLOCKS)]
    near = [[np.where((p := t[_remainder(x)]) >= 0, x[:, None] ^ p, -1) for t in tables] for x in blocks]
    keys, rows, homes = [], [], []
    for low in range(distance + 1):
        for high in range(distance + 1 - low):
            both = np.where((near[0][low][:, :, None] >= 0) & (near[1][high][:, None, :] >= 0), near[0][low][:, :, None] | near[1][high][:, None, :] << LENGTH, -1).reshape(len(fps), -1)
            row, column = np.nonzero(both >= 0)
            keys.append(both[row, column])
            rows.append(row)
            homes.append(np.full(len(row), low + high == 0))
    return np.concatenate(keys), np.concatenate(rows), np.concatenate(homes)


def _replicated(nodes: DataFrame, distance: int, home_only: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(fps), 4096):
                part = fps[i : i + 4096]
                key, row, _ = anchors(part, 0 if home_only else distance)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row])], ["anchor", "fp"])

    return nodes.select("fp").mapInArrow(lean(run), "anchor long, fp long")


def _near(nodes: DataFrame, distance: int, crowd: int) -> tuple[DataFrame, DataFrame | None]:
    """Pairs (a, b) of distinct fingerprints within distance bits, but for those that meet at crowded anchors only; of the latter (fp, middle) for every middle within 1 bit."""
    if distance != 2:
        raise ValueError("midpoints within 1 bit stand for a distance of 2 bits")
    homes = _replicated(nodes, distance, True)
    crowded = written(homes.groupBy("anchor").count().where(F.col("count") > crowd).select("anchor"), "crowded")
    visits = _replicated(nodes, distance, False)
    quiet, any_crowd = homes, not crowded.isEmpty()
    if any_crowd:
        quiet = homes.join(crowded, "anchor", "left_anti")
    home = quiet.select("anchor", F.col("fp").alias("b"))
    found = visits.select("anchor", F.col("fp").alias("a")).join(home, "anchor").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)).select("a", "b").distinct()
    if not any_crowd:
        return found, None
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    inside = visits.join(crowded, "anchor", "left_semi").select("fp").distinct().select("fp", F.explode(flips).alias("flip"))
    return found, inside.select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("middle"))


def links(nodes: DataFrame, distance: int = 2, crowd: int = 64) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp of nodes) whose components are those of all links within distance (2) bits."""
    found, middle = _near(nodes, distance, crowd)
    if middle is not None:
        star = middle.groupBy("middle").agg(F.sort_array(F.collect_list("fp")).alias("fps")).where(F.size("fps") > 1)
        found = found.unionByName(star.select(F.explode(F.expr("slice(fps, 2, size(fps))")).alias("a"), F.col("fps")[0].alias("b")).distinct())
    return found


def shared_keys(nodes: DataFrame, distance: int = 2, crowd: int = 64) -> DataFrame:
    """fp, key: every two distinct fingerprints within distance (2) bits have a key in common, for operators that compare all members of a key."""
    found, middle = _near(nodes, distance, crowd)
    keys = found.select(F.explode(F.array("a", "b")).alias("fp"), F.xxhash64(F.lit("pair"), "a", "b").alias("key"))
    return keys if middle is None else keys.unionByName(middle.select("fp", F.xxhash64(F.lit("middle"), "middle").alias("key")))


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 2) -> DataFrame:
    """Each row's id, fingerprint (16 hex digits) and component_id, the smallest id that links lead to."""
    prints = written(fingerprints(docs, id_col, text_col, shingle), "prints")
    nodes = written(prints.groupBy("fp").agg(F.min("id").alias("first")), "nodes")
    roots = components(links(nodes, distance)).withColumnRenamed("node", "fp")
    linked = nodes.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    named = written(linked.join(lowest, "root").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
