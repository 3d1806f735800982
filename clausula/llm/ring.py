"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard has `virtual` points on a ring of 64-bit hashes; a key goes to the shard of the first point clockwise of its
own hash. Shards are filled in the order of a second hash of the key, its ticket; where the first shard is full, the key
goes on clockwise to the next shard that is not. Shard capacities are the row count divided by the shards, rounded so
that they add up, so counts are at most one apart, and only the keys that meet a full shard leave their place.

Filling one key after the other would be a loop over all rows. But full shards are all that it has to know: there are as
many events as shards, so the outcome is `cut` for each shard, the ticket that filled it, and a row's shard is the first
one clockwise whose cut is not before its ticket: a narrow expression. The cuts are found on the driver from histograms
of (ticket range x arc of the ring), whose size depends on the ring alone: a range where a shard fills up is counted
again in 1024 narrower ones until it holds few enough rows (`few`) to look at one by one.

Slots are numbered in ticket order within (shard, ticket range) and offset by the counts of the ranges before, so no
task sorts a whole shard.

Defined results: null ids hash to one place; null text has size 1 and a null checksum. Tickets are of id and text, and
equal rows' ties are broken by their place in the written table. Empty table: no rows.
"""

from __future__ import annotations

from bisect import bisect_left

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausula.llm.common import written


class Ring:
    """shards points on the ring; arcs[i] begins at bounds[i - 1] (0 before all points) and has the shards in clockwise order."""

    def __init__(self, shards: int, virtual: int = 32, seed: int = 0):
        points = sorted((xxhash.xxh64_intdigest(f"{shard}/{v}", seed) - (1 << 63), shard) for shard in range(shards) for v in range(virtual))
        self.bounds = [p for p, _ in points]
        self.arcs = []
        for i in range(len(points)):
            order = dict.fromkeys(points[(i + k) % len(points)][1] for k in range(len(points)))
            self.arcs.append(list(order))

    def arc(self, position: int) -> int:
        return bisect_left(self.bounds, position) % len(self.bounds)

    def arc_column(self, position: Column) -> Column:
        """The same as a binary search over a literal array, unrolled as nested conditions."""

        def search(low: int, high: int) -> Column:
            if low == high:
                return F.lit(low % len(self.bounds))
            middle = (low + high) // 2
            return F.when(position <= self.bounds[middle], search(low, middle)).otherwise(search(middle + 1, high))

        return search(0, len(self.bounds))


def capacities(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


#: A row's place in the filling order, as ranges of ever narrower width: 1024 of the ticket, then of the row's number.
_LEVELS = [("ticket", 54), ("ticket", 44), ("ticket", 34), ("ticket", 24), ("ticket", 14), ("ticket", 4), ("row", 53), ("row", 43), ("row", 33), ("row", 23), ("row", 13), ("row", 3)]


def _range(level: int) -> Column:
    name, shift = _LEVELS[level]
    return F.shiftrightunsigned(F.col(name), shift).bitwiseAND(F.lit(1023))


class _Filling:
    """Fills the shards from histograms; cuts[s]: (ticket, row) that filled shard s, in unsigned order of the ticket."""

    def __init__(self, keys: DataFrame, ring: Ring, room: list[int], few: int):
        self.keys, self.ring, self.room, self.few = keys, ring, list(room), few
        self.cuts: dict[int, tuple[int, int]] = {}
        for s, capacity in enumerate(room):
            if not capacity:
                self.cuts[s] = (-1, -1)

    def target(self, arc: int) -> int:
        return next((s for s in self.ring.arcs[arc] if s not in self.cuts), -1)

    def run(self, level: int = 0, within: DataFrame | None = None) -> None:
        rows = self.keys if within is None else within
        counted: dict[int, dict[int, int]] = {}
        for bucket, arc, n in rows.groupBy(_range(level).alias("range"), "arc").count().collect():
            counted.setdefault(bucket, {})[arc] = n
        for bucket in sorted(counted):
            load: dict[int, int] = {}
            for arc, n in counted[bucket].items():
                load[self.target(arc)] = load.get(self.target(arc), 0) + n
            if all(n < self.room[s] for s, n in load.items() if s >= 0):
                for s, n in load.items():
                    if s >= 0:
                        self.room[s] -= n
                continue
            inner = rows.where(_range(level) == bucket)
            if level + 1 < len(_LEVELS) and sum(counted[bucket].values()) > self.few:
                self.run(level + 1, inner)
                continue
            for arc, ticket, row in sorted(inner.select("arc", "ticket", "row").collect(), key=lambda x: (x[1] % (1 << 64), x[2])):
                s = self.target(arc)
                if s >= 0:
                    self.room[s] -= 1
                    if not self.room[s]:
                        self.cuts[s] = (ticket % (1 << 64), row)


def shard_rows(docs: DataFrame, shards: int = 8, virtual: int = 32, id_col: str = "doc_id", text_col: str = "text", few: int = 50_000) -> DataFrame:
    """Each row's id, size (UTF-8 bytes and 1), text_crc32, law, shard, slot (gapless from 0 within a shard) and grown_shard (null)."""
    ring = Ring(shards, virtual)
    raw = F.col(text_col).cast("binary")
    keys = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(raw), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.xxhash64(F.lit("ticket"), F.col(id_col), F.col(text_col)).alias("ticket"),
        ring.arc_column(F.xxhash64(F.lit("place"), F.col(id_col))).alias("arc"),
        F.monotonically_increasing_id().alias("row"),
    )
    keys = written(keys, "keys")
    filling = _Filling(keys, ring, capacities(keys.count(), shards), few)
    filling.run()
    order = F.col("ticket").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))  # unsigned order as signed
    before = {}
    for s in range(shards):
        ticket, row = filling.cuts.get(s, (2**64 - 1, 2**63 - 1))
        limit = F.lit(ticket - (1 << 63)).cast("long") if ticket >= 0 else None
        before[s] = F.lit(False) if limit is None else (order < limit) | ((order == limit) & (F.col("row") <= row))
    table = F.array(*[F.array(*[F.lit(s) for s in arc]) for arc in ring.arcs])
    free = F.array(*[before[s] for s in range(shards)])
    placed = keys.withColumn("free", free).withColumn("shard", F.element_at(F.filter(F.element_at(table, F.col("arc") + 1), lambda s: F.element_at("free", s + 1)), 1))
    placed = placed.withColumn("range", F.shiftrightunsigned("ticket", 52)).drop("free", "arc")
    inner = Window.partitionBy("shard", "range").orderBy("ticket", "row")
    outer = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("shard", "range").count().withColumn("ahead", F.coalesce(F.sum("count").over(outer), F.lit(0))).drop("count")
    numbered = placed.withColumn("nth", F.row_number().over(inner)).join(counts, ["shard", "range"])
    return numbered.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("ahead") + F.col("nth") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
