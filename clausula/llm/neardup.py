"""Near-duplicate classes by SimHash and shingle similarity, for the pipeline.

Two texts are near-duplicates if the Jaccard similarity of their sets of word shingles (five words) is 0.8 or more;
classes are the components of these links. The SimHash operator gives keys that texts within its distance share, by anchor
points (`simhash.shared_keys`), and so does an equal fingerprint. At a similarity of 0.8 the fingerprints of typical texts differ in about 8 to 14 of 64 bits,
up to 29 for short ones, where no covering code is selective, so further candidates share one of `bands` keys, each of
`rows` minima of the shingles under random permutations: of pairs at 0.8 less than one in ten thousand meet in no band.
All these keys are treated alike: a key's texts are its bucket. Candidates are compared by all minima first, and, unless these are far below, exactly by their whole shingle sets.

Equal shingle sets are one node from the start, whatever the number of copies. In a bucket each node is first compared
with the bucket's most central one, which meets the most others over all buckets: an original among its edited copies.
Then nodes that are still in different classes are compared with each other: all of a bucket up to four times `small`
nodes, and in larger ones those that meet in hashed parts of about `small`, which differ from bucket to bucket. This leaves
few classes in most crowded buckets. What is still apart there is compared in full: every node outside the bucket's
largest class meets every node of another class, in blocks of about `side` by `side` nodes, so no task has a whole
bucket. So every two texts that share a bucket end in one class or have been compared. The work of the last step grows
with the product of a bucket's nodes and those outside its largest class; no pair is left out to bound it.

Defined results: null and wordless texts are one class of their own; texts of fewer words than a shingle compare as
whole sequences. Rows are told apart by their place in a written table, so null ids and repeated rows are fine; of a
class the row with the smallest id stays (null ids first). Empty table: no rows. Columns of the input keep their names,
whatever these are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausula.llm import simhash
from clausula.llm.common import blobs, lean, marked_rows, small_batches, written
from clausula.llm.components import components

BANDS, ROWS, SLACK = 24, 5, 0.2


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """The distinct digests of a text's shingles, ascending."""
    return np.unique(np.frombuffer(simhash.shingle_digests(text, size), ">u8").astype(np.uint64))


def minima(shingles: np.ndarray, multipliers: np.ndarray, block: int = 4096) -> np.ndarray:
    """The smallest of the shingles times each multiplier (modulo 2**64)."""
    least = np.full(len(multipliers), np.uint64(2**64 - 1))
    for i in range(0, len(shingles), block):
        least = np.minimum(least, (multipliers[:, None] * shingles[None, i : i + block]).min(axis=1))
    return least


def _sketches(keyed: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    kind = keyed.schema[id_col].dataType.simpleString()
    multipliers = np.random.default_rng(7).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same, fps, bands, sketches = [], [], [], []
            for text in blobs(batch.column(2)):
                digests = simhash.shingle_digests(text, shingle)
                shingles = np.unique(np.frombuffer(digests, ">u8").astype(np.uint64))
                least = minima(shingles, multipliers)
                same.append(xxhash.xxh3_128_hexdigest(shingles.tobytes()))
                fps.append(simhash.fingerprint(digests))
                bands.append([xxhash.xxh64_intdigest(least[b * ROWS : (b + 1) * ROWS].tobytes(), b) - (1 << 63) for b in range(BANDS)])
                sketches.append((least >> np.uint64(16) & np.uint64(0xFFFF)).astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same, pa.string()), pa.array(np.frombuffer(b"".join(fps), ">i8").astype(np.int64)), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], ["node", "id", "same", "fp", "bands", "sketch"])

    return keyed.select("nd__row", id_col, text_col).mapInArrow(lean(run), f"node long, id {kind}, same string, fp long, bands array<long>, sketch binary")


def _alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    if min(len(x), len(y)) < similarity * max(len(x), len(y)):
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common >= similarity * (len(x) + len(y) - common)


def _set_rows(shingle: int) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t, shingle).tobytes() for t in blobs(batch.column(1))], pa.binary())], ["node", "shingles"])

    return sets


def _similar(pairs: DataFrame, nodes: DataFrame, keyed: DataFrame, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """Those of pairs (a, b) whose shingle sets are similar enough."""

    def roughly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, BANDS * ROWS) for i in (2, 3))
            yield batch.filter(pa.array((left == right).mean(axis=1) >= similarity - SLACK)).select(["a", "b"])

    sketch = nodes.select("node", "sketch")
    both = pairs.join(sketch.toDF("a", "left"), "a").join(sketch.toDF("b", "right"), "b").select("a", "b", "left", "right")
    likely = written(both.mapInArrow(lean(roughly), "a long, b long"), "likely")

    asked = likely.select(F.explode(F.array("a", "b")).alias("nd__row")).distinct()
    known = written(marked_rows(keyed.select("nd__row", text_col), asked, True, then=_set_rows(shingle), schema="node long, shingles binary"), "sets")

    def exactly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                kept.append(_alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), similarity))
            yield batch.filter(pa.array(kept, pa.bool_())).select(["a", "b"])

    return likely.join(known.toDF("a", "left"), "a").join(known.toDF("b", "right"), "b").select("a", "b", "left", "right").mapInArrow(lean(exactly), "a long, b long")


def _crossed(apart: DataFrame, nodes: DataFrame, keyed: DataFrame, text_col: str, shingle: int, similarity: float, side: int) -> DataFrame:
    """Links (a, b) between nodes of different classes (root) in one crowded bucket (key); of links that a block's other links imply, not all.

    Every node outside a bucket's largest class meets every node of another class, in blocks. A pair of nodes is looked
    at in one bucket only, that of the first band they share (if that is a small bucket, they have been compared there);
    it leaves its block only if it is a link, so rows do not grow with the pairs.
    """
    counts = apart.groupBy("key", "root").agg(F.count("*").alias("c"))
    sizes = counts.groupBy("key").agg(F.sum("c").alias("n"), F.max(F.struct("c", "root")).alias("top")).where("top.c < n")
    sizes = sizes.select("key", F.col("top.root").alias("largest"), F.ceil(F.col("n") / side).alias("parts"), F.ceil((F.col("n") - F.col("top.c")) / side).alias("outer_parts"))
    dealt = written(apart.join(sizes, "key").withColumn("outer", F.col("root") != F.col("largest")).withColumn("hash", F.xxhash64("node", "key")), "dealt")
    asked = dealt.select(F.col("node").alias("nd__row")).distinct()
    sets = written(marked_rows(keyed.select("nd__row", text_col), asked, True, then=_set_rows(shingle), schema="node long, shingles binary"), "sets")
    placed = dealt.join(nodes.select("node", "sketch", "bands"), "node").join(sets, "node")
    part, outer_part = F.pmod("hash", "parts"), F.pmod("hash", "outer_parts")
    columns = ["key", "node", "root", "sketch", "bands", "shingles", "outer"]
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    inner = placed.select(*columns, F.lit(False).alias("asks"), part.alias("v"), upto("outer_parts").alias("u"))
    asking = placed.where("outer").select(*columns, F.lit(True).alias("asks"), outer_part.alias("u"), upto("parts").alias("v"))

    def block(group: pa.Table) -> pa.Table:
        key = group.column("key")[0].as_py()
        asks, outer, node, root = (group.column(c).to_numpy() for c in ("asks", "outer", "node", "root"))
        sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint16).reshape(-1, BANDS * ROWS)
        bands = np.array(group.column("bands").to_pylist(), np.int64).reshape(-1, BANDS)
        shingles = group.column("shingles")
        others = np.flatnonzero(~asks)
        above: dict[int, int] = {}

        def top(x: int) -> int:
            while above.get(x, x) != x:
                x = above[x]
            return x

        left, right = [], []
        for i in np.flatnonzero(asks).tolist():
            # two nodes outside the largest class meet twice, once as each side
            at = others[(root[others] != root[i]) & (~outer[others] | (node[others] > node[i]))]
            at = at[(sketch[at] == sketch[i]).mean(axis=1) >= similarity - SLACK]
            shared = bands[at] == bands[i]
            first = np.where(shared.any(axis=1), bands[at, shared.argmax(axis=1)], key)
            own = None
            for j in at[first == key].tolist():
                x, y = top(int(root[i])), top(int(root[j]))
                if x == y:
                    continue
                own = np.frombuffer(shingles[i].as_py(), np.uint64) if own is None else own
                if _alike(own, np.frombuffer(shingles[j].as_py(), np.uint64), similarity):
                    above[max(x, y)] = min(x, y)
                    left.append(int(node[i]))
                    right.append(int(node[j]))
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return inner.unionByName(asking).groupBy("key", "u", "v").applyInArrow(block, "a long, b long")


def near_duplicate_classes(keyed: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, small: int = 8, side: int = 512) -> DataFrame:
    """keyed has a unique nd__row. Returns node (nd__row), id and root (one node of the class) of every row."""
    rows = written(_sketches(keyed, id_col, text_col, shingle), "sketches")
    leads = written(rows.groupBy("same").agg(F.min(F.struct("id", "node")).alias("lead")).select("same", F.col("lead.node").alias("lead")), "leads")
    nodes = written(rows.join(leads.select(F.col("lead").alias("node")), "node", "left_semi"), "nodes")
    by_fp = written(nodes.groupBy("fp").agg(F.count("*").alias("n")), "prints")
    same_print = nodes.select("node", "fp").join(by_fp.where("n > 1").select("fp"), "fp", "left_semi").select("node", F.xxhash64(F.lit("print"), "fp").alias("key"))
    near_print = nodes.select("node", "fp").join(written(simhash.shared_keys(by_fp), "shared"), "fp").select("node", "key")
    keys = nodes.select("node", F.explode("bands").alias("key")).unionByName(same_print).unionByName(near_print)
    crowds = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = written(keys.join(crowds, "key"), "met")
    central = met.groupBy("node").agg(F.sum("n").alias("score"))
    heads = met.join(central, "node").groupBy("key").agg(F.max(F.struct("score", (-F.col("node")).alias("minus"))).alias("top")).select("key", (-F.col("top").getField("minus")).alias("lead"))
    members = written(met.join(heads, "key"), "members")
    first = members.where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    ordered = lambda pairs: pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    found = written(_similar(ordered(first), nodes, keyed, text_col, shingle, similarity), "similar")
    roots = written(components(found), "roots")
    parts = F.ceil(F.col("n") / small)
    dealt = F.when(F.col("n") <= 4 * small, F.lit(0)).otherwise(F.pmod(F.xxhash64("node", "key"), parts))
    apart = written(members.join(roots, "node", "left").select("key", dealt.alias("part"), "node", F.coalesce("root", "node").alias("root")), "apart")
    # parts whose nodes are one class already have nothing left to compare
    mixed = apart.groupBy("key", "part").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key", "part")
    apart = apart.join(mixed, ["key", "part"])
    rest = apart.alias("l").join(apart.alias("r"), ["key", "part"]).where("l.node < r.node AND l.root <> r.root").select(F.col("l.node").alias("a"), F.col("r.node").alias("b"))
    more = _similar(ordered(rest).join(ordered(first), ["a", "b"], "left_anti"), nodes, keyed, text_col, shingle, similarity)
    found = written(found.unionByName(more), "similar")
    roots = written(components(found), "roots")
    crowded = members.where(F.col("n") > 4 * small).join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    crossed = written(_crossed(crowded, nodes, keyed, text_col, shingle, similarity, side), "crossed")
    if not crossed.isEmpty():
        roots = written(components(found.unionByName(crossed)), "roots")
    lead = rows.join(leads, "same").select("node", "id", "lead")
    return lead.join(roots.withColumnRenamed("node", "lead"), "lead", "left").select("node", "id", F.coalesce("root", "lead").alias("root"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs without all but one of each near-duplicate class."""
    small_batches(docs.sparkSession)
    names = docs.columns
    inner = [f"nd__{i}" for i in range(len(names))]  # whatever the input's names are, helper columns have others
    keyed = written(docs.toDF(*inner).withColumn("nd__row", F.monotonically_increasing_id()), "keyed")
    classes = near_duplicate_classes(keyed, inner[names.index(id_col)], inner[names.index(text_col)], shingle, similarity)
    stays = classes.groupBy("root").agg(F.min(F.struct("id", "node")).alias("stays")).select(F.col("stays.node").alias("nd__row"))
    return marked_rows(keyed, stays, True).select(*inner).toDF(*names)
