"""Language-model scoring with an Elias-Fano n-gram trie.

Level 1 is the vocabulary: word hashes in ascending order with each word's id (its rank by falling count, so ids of
common words are small) and count. On the levels for pairs and triples a context's successors lie in a row in ascending
order of id; where each context's row begins is a monotone sequence of pointers in Elias-Fano code, 2 bits or little
more for each context. Beside each n-gram is its smoothed (discounted) log probability in 16 bits, beside each context
the weight of the distribution of one word less in 16 bits. A lookup decodes two neighbouring pointers and searches the
successor within its context; the n-gram's place is the context of the next level.

Smoothing is interpolated absolute discounting over all n-grams, those seen once included: of an n-gram's count `discount`
is taken off; what is left over of a context goes to the distribution of one word less, which for single words is
(c + 0.1) / (N + 0.1 (V + 1)). A document's first word follows its boundary, which is the end token.

Texts are cut into words once: each batch becomes one file, with its distinct word hashes and its tokens as numbers of
these. Counting reads these files, and so do the scores. Each batch sends its distinct pairs with what follows them, counted
and packed, to the segment of the pair; ranges of pairs come from the words' counts, so that segments are of about equal
size, and a very frequent first word spreads over many. A task merges one segment and writes both levels of it.

Scoring goes the same way: each batch sends what it asks for to the segments, a task opens one segment, looks all of that up
in its trie, and sends codes back to the batches. So a segment is read once in each of at most `ROUNDS` rounds, whatever the
number of batches, and no batch visits segments; rounds bound what questions and answers take of the disk.

Defined results: null text: as empty, so the end token alone. Null ids: held_out null, not learned from. Repeated rows
count and score each. No training rows: N and V are 0. Empty table: no rows. Words are told apart by 64-bit hashes;
2**31 different words or more are an error. Only the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import json
import math
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausula.llm.common import Batches, blobs, chunks, discard, lean, mixed_keys, padded, parts, place, shared_dir, small_batches, span_keys, written

LEAST, OPEN_BYTES, ROUNDS = 1e-12, 256 << 20, 3
#: In questions: a word that the model does not know.
NONE = 0xFFFFFFFF


@dataclass(frozen=True)
class Settings:
    order: int = 3
    discount: float = 0.75
    chunk_bytes: int = 8 << 20
    tokens_per_part: int = 2_000_000
    words_per_part: int = 1_000_000


# ---------------------------------------------------------------- Elias-Fano


def _select(words: np.ndarray, before: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """Positions of the nth (from 0) set bits; before: set bits before each block of 8 words."""
    block = np.searchsorted(before, nth, "right") - 1
    left = nth - before[block]
    at = block * 8
    word = words[at]
    for _ in range(7):
        ones = np.bitwise_count(word).astype(np.int64)
        on = left >= ones
        if not on.any():
            break
        left = np.where(on, left - ones, left)
        at = at + on
        word = words[np.minimum(at, len(words) - 1)]
    bit = np.zeros(len(nth), np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        low = word & np.uint64((1 << width) - 1)
        ones = np.bitwise_count(low).astype(np.int64)
        on = left >= ones
        left = np.where(on, left - ones, left)
        word = np.where(on, word >> np.uint64(width), low)
        bit += np.where(on, width, 0)
    return at * 64 + bit


class EliasFano:
    """A monotone sequence of non-negative integers."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, words: np.ndarray, before: np.ndarray):
        self.n, self.low_bits, self.low, self.words, self.before = n, low_bits, low, words, before

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, int(math.log2(max(top, 1) / max(n, 1)))) if top > n else 0
        high = (values >> low_bits).astype(np.int64) + np.arange(n)
        size = -(-(int(high[-1]) + 1 if n else 1) // 512) * 8
        bits = np.zeros(size * 64, np.uint8)
        bits[high] = 1
        words = np.packbits(bits, bitorder="little").view("<u8")
        ones = np.bitwise_count(words).reshape(-1, 8).sum(axis=1, dtype=np.int64)
        kind = np.uint16 if low_bits <= 16 else np.uint64
        return cls(n, low_bits, (values & ((1 << low_bits) - 1)).astype(kind) if low_bits else np.zeros(0, kind), words, np.cumsum(ones) - ones)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        high = _select(self.words, self.before, i) - i
        return (high << self.low_bits) + self.low[i].astype(np.int64) if self.low_bits else high

    def parts(self, name: str) -> tuple[dict, dict[str, np.ndarray]]:
        """Meta and arrays for a file, under keys that begin with name."""
        return {f"{name}_n": self.n, f"{name}_bits": self.low_bits}, {f"{name}_low": self.low, f"{name}_words": self.words, f"{name}_before": self.before}

    @classmethod
    def of(cls, name: str, meta: dict, arrays: dict[str, np.ndarray]) -> EliasFano:
        return cls(meta[f"{name}_n"], meta[f"{name}_bits"], arrays[f"{name}_low"], arrays[f"{name}_words"], arrays[f"{name}_before"])


class Codes:
    """Probabilities as logarithms in 16 bits."""

    def __init__(self, codes: np.ndarray, low: float, step: float):
        self.codes, self.low, self.step = codes, low, step

    @classmethod
    def pack(cls, probabilities: np.ndarray) -> Codes:
        logs = np.log10(np.clip(probabilities, LEAST, 1))
        low, high = (float(logs.min()), float(logs.max())) if len(logs) else (0.0, 0.0)
        step = (high - low) / 65535 or 1.0
        return cls(np.rint((logs - low) / step).astype(np.uint16), low, step)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        return 10 ** (self.codes[i] * self.step + self.low)


# ---------------------------------------------------------------- files


def _write(folder: str, name: str, meta: dict, arrays: dict[str, np.ndarray]) -> None:
    """One file: a line of JSON padded to 8 bytes, then the arrays, each padded to 8 bytes."""
    files, base = pa.fs.FileSystem.from_uri(folder)
    files.create_dir(base, recursive=True)
    at, about = 0, {}
    for key, array in arrays.items():
        about[key] = [array.dtype.str, len(array), at]
        at += -(-array.nbytes // 8) * 8
    head = json.dumps(meta | {"arrays": about}).encode()
    head += b" " * (-(len(head) + 1) % 8) + b"\n"
    draft = f"{base}/.{name}-{uuid.uuid4().hex}"
    with files.open_output_stream(draft, compression=None) as out:
        out.write(head)
        for array in arrays.values():
            out.write(array.tobytes() + b"\0" * (-array.nbytes % 8))
    place(files, draft, f"{base}/{name}")


def _read(folder: str, name: str) -> tuple[dict, dict[str, np.ndarray]]:
    files, base = pa.fs.FileSystem.from_uri(folder)
    if isinstance(files, pa.fs.LocalFileSystem):
        raw = np.memmap(f"{base}/{name}", np.uint8, "r")
    else:
        with files.open_input_file(f"{base}/{name}") as source:
            raw = np.frombuffer(source.read(), np.uint8)
    end = next(i for i in range(4096, 1 << 24, 4096) if b"\n" in raw[:i].tobytes() or i >= len(raw))
    end = raw[:end].tobytes().index(b"\n") + 1
    meta = json.loads(raw[:end].tobytes())
    return meta, {k: raw[end + at : end + at + n * np.dtype(d).itemsize].view(d) for k, (d, n, at) in meta["arrays"].items()}


@dataclass(frozen=True)
class Manifest:
    """All that a task needs to open the model; bounded by the number of its files."""

    folder: str
    order: int
    total: int = 0
    size: int = 0
    end: int = -1  # the end token's id
    words: list[tuple[str, int]] = field(default_factory=list)  # file and first hash
    counts: list[tuple[str, int]] = field(default_factory=list)  # file and first id
    bounds: list[int] = field(default_factory=list)  # of pairs (first id << 32 | second id), between segments
    segments: list[int] = field(default_factory=list)  # those that have pairs
    shared: list[tuple[int, int]] = field(default_factory=list)  # first words at a segment's edges: id, different successors in all segments


class Files:
    """Files of a model, opened when asked for; what is not memory-mapped is closed again beyond OPEN_BYTES."""

    def __init__(self, folder: str):
        self.folder, self.open, self.bytes = folder, OrderedDict(), 0

    def __call__(self, name: str, make=lambda meta, arrays: (meta, arrays)):
        if name in self.open:
            self.open.move_to_end(name)
            return self.open[name][0]
        meta, arrays = _read(self.folder, name)
        size = sum(a.nbytes for a in arrays.values() if not isinstance(a, np.memmap))
        while self.open and self.bytes + size > OPEN_BYTES:
            self.bytes -= self.open.popitem(last=False)[1][1]
        self.open[name] = made, _ = make(meta, arrays), size
        self.bytes += size
        return made


def _by_segment(segment: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The indices of each segment that occurs."""
    order = np.argsort(segment, kind="stable")
    found, edges = np.unique(segment[order], return_index=True)
    for s, own in zip(found.tolist(), np.split(order, edges[1:])):
        yield s, own


def _search(successors: np.ndarray, low: np.ndarray, high: np.ndarray, sought: np.ndarray) -> np.ndarray:
    """Where each sought one is among successors[low:high]; -1 if it is not. Halving steps of equal size for contexts of like sizes."""
    found, size = np.full(len(sought), -1, np.int64), high - low
    for least, most in ((1, 1), (2, 8), (9, 256), (257, 1 << 62)):
        own = np.flatnonzero((size >= least) & (size <= most))
        if not len(own):
            continue
        at, end, want = low[own], high[own], sought[own]
        step = (1 << int(size[own].max()).bit_length()) >> 1 if least > 1 else 0
        while step:
            to = at + step
            inside = to < end
            at = np.where(inside & (successors[np.where(inside, to, at)] <= want), to, at)
            step >>= 1
        hit = successors[at] == want
        found[own[hit]] = at[hit]
    return found


class Segment:
    """Pairs of one range with their successors: the levels for pairs and triples."""

    def __init__(self, meta: dict, arrays: dict[str, np.ndarray]):
        self.first, self.order = meta["first"], meta["order"]
        self.second, self.pairs = arrays["second"], EliasFano.of("pairs", meta, arrays)
        self.value, self.weight = (Codes(arrays[k], *meta[k]) for k in ("pair_value", "word_weight"))
        if self.order > 2:
            self.third, self.triples = arrays["third"], EliasFano.of("triples", meta, arrays)
            self.deep_value, self.deep_weight = (Codes(arrays[k], *meta[k]) for k in ("triple_value", "pair_weight"))

    def find_pairs(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Places, -1 where absent."""
        context = first - self.first
        inside = np.flatnonzero((context >= 0) & (context < self.pairs.n - 1))
        found, context = np.full(len(first), -1, np.int64), context[inside]
        # contexts come again and again, and one's end is the next one's beginning
        known, which = np.unique(context, return_inverse=True)
        found[inside] = _search(self.second, self.pairs[known][which], self.pairs[known + 1][which], second[inside].astype(np.uint32))
        return found

    def find_triples(self, pair: np.ndarray, third: np.ndarray) -> np.ndarray:
        """Places, -1 where absent. pair: places of pairs."""
        known, which = np.unique(pair, return_inverse=True)
        return _search(self.third, self.triples[known][which], self.triples[known + 1][which], third.astype(np.uint32))


class Trie:
    def __init__(self, manifest: Manifest):
        self.manifest, self.files = manifest, Files(manifest.folder)
        self.hash_starts = np.array([h for _, h in manifest.words], np.int64)
        self.id_starts = np.array([i for _, i in manifest.counts], np.int64)
        self.bounds, self.segments = np.array(manifest.bounds, np.int64), np.array(manifest.segments, np.int64)
        self.shared = np.array(sorted(manifest.shared), np.int64).reshape(-1, 2)

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and counts of distinct words."""
        order = np.argsort(hashes)
        ids, counts, ascending = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64), hashes[order]
        for s, own in _by_segment(np.searchsorted(self.hash_starts, ascending, "right") - 1):
            if s >= 0:
                _, file = self.files(self.manifest.words[s][0])
                at = np.minimum(np.searchsorted(file["hash"], ascending[own]), len(file["hash"]) - 1)
                hit = file["hash"][at] == ascending[own]
                ids[order[own[hit]]], counts[order[own[hit]]] = file["id"][at[hit]], file["count"][at[hit]]
        return ids, counts

    def counts(self, ids: np.ndarray) -> np.ndarray:
        found = np.zeros(len(ids), np.int64)
        for s, own in _by_segment(np.searchsorted(self.id_starts, ids, "right") - 1):
            found[own] = self.files(self.manifest.counts[s][0])[1]["count"][ids[own] - self.id_starts[s]]
        return found

    def single(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.1) / (self.manifest.total + 0.1 * (self.manifest.size + 1))

    def segment(self, part: int) -> Segment:
        return self.files(f"grams-{part:06d}", Segment)

    def edge_weights(self, ids: np.ndarray, counts: np.ndarray, discount: float) -> np.ndarray:
        """What is left over after words whose pairs may lie in several segments; nan for all others."""
        weight = np.full(len(ids), np.nan)
        if len(self.shared):
            at = np.minimum(np.searchsorted(self.shared[:, 0], ids), len(self.shared) - 1)
            own = np.flatnonzero(self.shared[at, 0] == ids)
            weight[own] = discount * self.shared[at[own], 1] / counts[own]
        return weight


_OPEN: dict[str, Trie] = {}


def _opened(manifest: Manifest) -> Trie:
    """One model at a time for each worker."""
    key = f"{manifest.folder}/{len(manifest.words)}/{len(manifest.segments)}"
    if key not in _OPEN:
        _OPEN.clear()
        _OPEN[key] = Trie(manifest)
    return _OPEN[key]


# ---------------------------------------------------------------- tokens

_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_SPACE = np.isin(np.arange(256), [*range(9, 14), 32])


def _hashes(first: np.ndarray, second: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return (mixed_keys(first, second) ^ lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


#: No word is a line end.
END = int(_hashes(np.array([10], np.uint64), np.zeros(1, np.uint64), np.ones(1, np.int64))[0])


def token_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes (the more frequent the earlier), each token's number among them, and the number of tokens of each text (its end token included)."""
    texts = [t or b"" for t in texts]
    data = _LOWER[padded(b"\n".join(texts))]
    data[-16:] = 32
    space = _SPACE[data]
    starts = np.flatnonzero(~space & np.r_[True, space[:-1]])
    lengths = np.flatnonzero(space & np.r_[False, ~space[:-1]]) - starts
    edges = np.r_[0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)]
    ends = np.searchsorted(starts, edges)
    hashes = np.insert(_hashes(*span_keys(data, starts, lengths), lengths), ends[1:], END)
    known, which, n = np.unique(hashes, return_inverse=True, return_counts=True)
    order = np.argsort(-n, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return known[order], rank[which], np.diff(ends) + 1


def _planes(values: np.ndarray) -> bytes:
    """Numbers of 32 bits as their lowest bytes, then the next ones, and so on: these compress."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4")[:, 0]


def _first_flags(counts: np.ndarray) -> np.ndarray:
    flags = np.zeros(int(counts.sum()), bool)
    flags[np.cumsum(counts) - counts] = True
    return flags


@dataclass(frozen=True)
class Texts:
    """Batches of tokens: a file for each, with one row of ids, held, counts (numbers of tokens), hashes, seen (their counts in texts to learn from) and tokens."""

    spark: SparkSession
    folder: str
    names: list[str]
    kind: str  # of the ids

    def batches(self, names: list[str] | None = None) -> DataFrame:
        names = self.names if names is None else names
        return self.spark.createDataFrame([(n,) for n in names], "batch string").repartition(max(1, len(names)))


def _load(folder: str, name: str, *columns: str) -> list[pa.Scalar]:
    files, base = pa.fs.FileSystem.from_uri(folder)
    with files.open_input_file(f"{base}/{name}") as source, pa.ipc.open_file(source) as reader:
        only = [reader.schema.get_field_index(c) for c in columns]
    with files.open_input_file(f"{base}/{name}") as source, pa.ipc.open_file(source, options=pa.ipc.IpcReadOptions(included_fields=only)) as reader:
        batch = reader.get_batch(0)
    return [batch.column(c)[0] for c in columns]


def tokenised(docs: DataFrame, id_col: str, text_col: str, settings: Settings, held_out: Column | None = None) -> Texts:
    """The texts cut into words, in files below a new shared folder."""
    spark = docs.sparkSession
    small_batches(spark)
    kind, folder = docs.schema[id_col].dataType.simpleString(), shared_dir(spark, "tokens")
    files, base = pa.fs.FileSystem.from_uri(folder)
    files.create_dir(base, recursive=True)

    def put(pieces: list[tuple[pa.RecordBatch, list[bytes | None]]]) -> pa.RecordBatch:
        files, base = pa.fs.FileSystem.from_uri(folder)
        keys, held = (pa.concat_arrays([rows.column(i) for rows, _ in pieces]) for i in (0, 1))
        hashes, tokens, counts = token_hashes([t for _, texts in pieces for t in texts])
        learned = np.array([x is False for x in held.to_pylist()])
        seen = np.bincount(tokens[np.repeat(learned, counts)], minlength=len(hashes))
        lists = [pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), x) for x in (keys, held, pa.array(counts))]
        packed = [pa.array([x], pa.large_binary()) for x in (hashes.astype("<i8").tobytes(), _planes(seen), _planes(tokens))]
        row = pa.RecordBatch.from_arrays([*lists, *packed], ["ids", "held", "counts", "hashes", "seen", "tokens"])
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"  # a repeated task has files of its own
        with files.open_output_stream(f"{base}/{name}", compression=None) as out, pa.ipc.new_file(out, row.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_batch(row)
        return pa.RecordBatch.from_pydict({"batch": [name]})

    def run(batches: Batches) -> Batches:
        pieces, size = [], 0
        for batch in batches:
            texts = blobs(batch.column(2))
            for a, b in chunks(texts, settings.chunk_bytes):
                pieces.append((batch.slice(a, b - a), texts[a:b]))
                size += sum(len(t or b"") for t in texts[a:b])
                if size >= settings.chunk_bytes:
                    yield put(pieces)
                    pieces, size = [], 0
        if sum(rows.num_rows for rows, _ in pieces):
            yield put(pieces)

    flag = F.lit(False) if held_out is None else held_out
    rows = docs.select(F.col(id_col).alias("id"), flag.cast("boolean").alias("held"), F.col(text_col).alias("text"))
    return Texts(spark, folder, sorted(r.batch for r in rows.mapInArrow(lean(run), "batch string").collect()), kind)


# ---------------------------------------------------------------- fitting


@contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """Files of a shuffle go as soon as what is run here has ended; each frame is run once only."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _tasks(spark: SparkSession) -> int:
    """Enough for the cores: what the size of the input asks for beyond that is up to the settings."""
    return min(parts(spark), 4 * spark.sparkContext.defaultParallelism)


def _all(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray] | None:
    found = [b for b in batches if b.num_rows]
    return {k: np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in found]) for i, k in enumerate(found[0].schema.names)} if found else None


def _narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in 32 bits where these will do."""
    return counts.astype(np.uint32) if len(counts) and counts.max() < 1 << 32 else counts


def _write_vocabulary(texts: Texts, folder: str, settings: Settings) -> tuple[Manifest, list[tuple[int, int, int]]]:
    """Level 1, and marks (id, count, tokens before it) at about even steps of the tokens in the order of ids."""
    spark, tokens = texts.spark, texts.folder

    def counted(batches: Batches) -> Batches:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                hashes, seen = (x.as_py() for x in _load(tokens, name, "hashes", "seen"))
                n = _unplanes(seen)
                found, n = np.frombuffer(hashes, "<i8")[n > 0], n[n > 0].astype(np.int64)
                for i in range(0, len(n), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(found[i : i + 100_000]), pa.array(n[i : i + 100_000])], ["hash", "n"])

    words = written(texts.batches().mapInArrow(lean(counted), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")), "words")
    size, total = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not size:
        return Manifest(folder, settings.order), []
    if size >= 1 << 31:
        raise ValueError("too many different words for pairs of ids in 64 bits")
    n_parts = max(1, min(_tasks(spark), math.ceil(size / 10_000)), math.ceil(size / settings.words_per_part))
    step = max(1, total // (16 * _n_segments(spark, total, settings)))

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), _all(batches)
        if held:
            ends = np.cumsum(held["n"])
            before = ends - held["n"]
            marks = np.flatnonzero(ends // step != before // step)
            _write(folder, f"counts-{part:06d}", {}, {"count": _narrow(held["n"])})
            _write(folder, f"marks-{part:06d}", {"total": int(ends[-1]), "marks": [[int(i), int(held["n"][i]), int(before[i])] for i in marks]}, {})
            for i in range(0, len(ends), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(held["hash"][i : i + 100_000]), pa.array(held["n"][i : i + 100_000]), pa.array(np.full(len(ends[i : i + 100_000]), part, np.int32)), pa.array(np.arange(i, min(i + 100_000, len(ends))))], ["hash", "n", "part", "row"])

    order = [F.desc("n"), "hash"]
    ranks = written(words.repartitionByRange(n_parts, *order).sortWithinPartitions(*order).mapInArrow(ranked, "hash long, n long, part int, row long"), "ranks")
    discard(words)
    starts, marks, ahead, behind = {}, [], 0, 0
    for part, n in sorted(tuple(r) for r in ranks.groupBy("part").count().collect()):
        about, _ = _read(folder, f"marks-{part:06d}")
        starts[part] = ahead
        marks += [(ahead + i, c, behind + b) for i, c, b in about["marks"]]
        ahead, behind = ahead + n, behind + about["total"]

    def by_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), _all(batches)
        if held:
            base = np.array([starts.get(p, 0) for p in range(max(starts) + 1)], np.int64)
            ids = base[held["part"]] + held["row"]
            _write(folder, f"words-{part:06d}", {}, {"hash": held["hash"], "id": ids.astype(np.uint32), "count": _narrow(held["n"])})
            at = np.flatnonzero(held["hash"] == END)
            yield pa.RecordBatch.from_pydict({"name": [f"words-{part:06d}"], "first": [int(held["hash"][0])], "end": [int(ids[at[0]]) if len(at) else -1]})

    named = ranks.repartitionByRange(n_parts, "hash").sortWithinPartitions("hash").mapInArrow(by_hash, "name string, first long, end long").collect()
    discard(ranks)
    names = sorted(((r.name, r.first) for r in named), key=lambda x: x[1])
    return Manifest(folder, settings.order, total, size, max(r.end for r in named), names, [(f"counts-{p:06d}", s) for p, s in sorted(starts.items())]), marks


def _n_segments(spark: SparkSession, total: int, settings: Settings) -> int:
    return max(1, min(_tasks(spark), math.ceil(total / 1000)), math.ceil(total / settings.tokens_per_part))


def _bounds(marks: list[tuple[int, int, int]], total: int, size: int, n: int) -> list[int]:
    """Between about n ranges of pairs of about equal numbers of tokens; a word with more than a range's share is cut by its successors, in the proportions of all words."""
    share, found, next_at = total / n, set(), 0.0
    ids, before = [0, *(m[0] for m in marks), size], [0, *(m[2] for m in marks), total]
    for word, count, ahead in marks:
        if count > share:
            pieces = math.ceil(count / share)
            found |= {word << 32, (word + 1) << 32} | {word << 32 | int(x) for x in np.interp(total / pieces * np.arange(1, pieces), before, ids)}
            next_at = ahead + count + share
        elif ahead + count > next_at:
            found.add(word << 32)
            next_at = ahead + share
    return sorted(found - {0})


def _distinct(columns: list[np.ndarray], size: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Different rows of numbers from 0 to size - 1, which of them each row is, and how many rows each is."""
    bits = max(1, (size - 1).bit_length())
    if bits * len(columns) <= 63:
        key = columns[0].astype(np.int64)
        for c in columns[1:]:
            key = key << bits | c
        key, which, n = np.unique(key, return_inverse=True, return_counts=True)
        return [key >> bits * (len(columns) - 1 - i) & (1 << bits) - 1 for i in range(len(columns))], which, n
    rows, inner, _ = _distinct(columns[1:], size)
    key, which, n = np.unique(columns[0].astype(np.int64) << 32 | inner, return_inverse=True, return_counts=True)
    return [key >> 32, *(r[key & 0xFFFFFFFF] for r in rows)], which, n


def _grams(trie: Trie, hashes: np.ndarray, tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Different (word before, word, word after) of texts in the order of the first two's ids: key of the pair (negative if the first is unknown), id after it, how many, and numbers of the words before; the place of each token's own among these; ids and counts of words."""
    ids, seen = trie.lookup(hashes)
    first, end = _first_flags(counts), int(np.flatnonzero(hashes == END)[0])
    before = np.where(first, end, np.r_[end, tokens[:-1]])
    # after the end token nothing follows: itself stands for that
    after = np.where(tokens == end, end, np.r_[tokens[1:], end]) if trie.manifest.order > 2 else np.zeros(len(tokens), np.int64)
    (one, two, three), which, n = _distinct([before, tokens, after], len(hashes))
    key = ids[one] << 32 | ids[two] & NONE
    order = np.argsort(key, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return key[order], (ids[three] & NONE)[order], n[order], one[order], place[which], ids, seen


def _packed(key: np.ndarray, cuts: np.ndarray, columns: list[np.ndarray], only: np.ndarray | None = None) -> Iterator[tuple[int, int, bytes]]:
    """Segment, number of rows and packed columns, for each segment (or those of `only`) that keys in ascending order fall in."""
    codec, edges = pa.Codec("zstd", 1), _edges(key, cuts)
    some = np.flatnonzero(np.diff(edges))
    for p in some if only is None else some[np.isin(some, only)]:
        a, b = edges[p], edges[p + 1]
        yield int(p), int(b - a), codec.compress(b"".join(_planes(x[a:b]) for x in columns), asbytes=True)


def _edges(key: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Where segments begin in ascending keys; negative ones are in none."""
    return np.r_[np.searchsorted(key, 0), np.searchsorted(key, cuts), len(key)]


def _unpacked(packs: list[bytes], sizes: list[int], n: int) -> list[np.ndarray]:
    """The n columns of packs, one after the other."""
    codec = pa.Codec("zstd")
    raw = [np.frombuffer(codec.decompress(p, 4 * n * size, asbytes=True), np.uint8).reshape(n, -1) for p, size in zip(packs, sizes)]
    return [np.concatenate([_unplanes(r[i]) for r in raw]) for i in range(n)]


def _write_segments(texts: Texts, manifest: Manifest, marks: list[tuple[int, int, int]], settings: Settings) -> Manifest:
    spark, tokens_at = texts.spark, texts.folder
    bounds = _bounds(marks, manifest.total, manifest.size, _n_segments(spark, manifest.total, settings))
    discount, deep = settings.discount, settings.order > 2

    def grams(batches: Batches) -> Batches:
        trie, cuts = _opened(manifest), np.array(bounds, np.int64)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                held, counts, hashes, tokens = _load(tokens_at, name, "held", "counts", "hashes", "tokens")
                counts, learned = counts.values.to_numpy(), np.array([x is False for x in held.as_py()])
                if not learned.any():
                    continue
                tokens = _unplanes(tokens.as_py())[np.repeat(learned, counts)].astype(np.int64)
                key, third, n, *_ = _grams(trie, np.frombuffer(hashes.as_py(), "<i8"), tokens, counts[learned])
                some, sizes, packs = zip(*_packed(key, cuts, [key >> 32, key & NONE, third, n]))
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(sizes, pa.int64()), pa.array(packs, pa.binary())], ["part", "n", "pack"])

    def segment(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        one, two, third, n = _unpacked(group.column("pack").to_pylist(), group.column("n").to_pylist(), 4)
        key = one.astype(np.int64) << 32 | two
        order = np.lexsort((third, key))
        key, third, n = key[order], third[order], n[order].astype(np.int64)
        new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (third[1:] != third[:-1])])
        key, third, n = key[new], third[new], np.add.reduceat(n, new)
        fresh = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        pair_n, pairs = np.add.reduceat(n, fresh), key[fresh]
        first = pairs >> 32
        lowest, highest = int(first[0]), int(first[-1])
        trie = _opened(manifest)
        words = np.arange(lowest, highest + 1)
        word_n = trie.counts(words)
        edges = np.searchsorted(first, np.arange(lowest, highest + 2))
        pointers = EliasFano.build(edges)
        meta, arrays = pointers.parts("pairs")
        meta |= {"first": lowest, "order": settings.order}
        arrays["second"] = (pairs & 0xFFFFFFFF).astype(np.uint32)
        codes = {"pair_value": Codes.pack((pair_n - discount) / word_n[first - lowest]), "word_weight": Codes.pack(discount * np.diff(edges) / word_n)}
        if deep:
            going = (key & 0xFFFFFFFF) != manifest.end
            deep_edges = np.r_[0, np.cumsum(going)][np.r_[fresh, len(key)]]
            pair_of = np.repeat(np.arange(len(pairs)), np.diff(np.r_[fresh, len(key)]))[going]
            more, packed = EliasFano.build(deep_edges).parts("triples")
            meta, arrays = meta | more, arrays | packed | {"third": third[going].astype(np.uint32)}
            codes |= {"triple_value": Codes.pack((n[going] - discount) / pair_n[pair_of]), "pair_weight": Codes.pack(discount * np.diff(deep_edges) / pair_n)}
        meta |= {k: [c.low, c.step] for k, c in codes.items()}
        _write(manifest.folder, f"grams-{part:06d}", meta, arrays | {k: c.codes for k, c in codes.items()})
        ends = {lowest: int(edges[1]), highest: int(edges[-1] - edges[-2])}
        return pa.table({"part": pa.array([part], pa.int32()), "word": [list(ends)], "successors": [list(ends.values())]})

    packed = texts.batches().mapInArrow(lean(grams), "part int, n long, pack binary")
    made = packed.groupBy("part").applyInArrow(segment, "part int, word array<long>, successors array<long>").collect()
    shared: dict[int, int] = {}
    for r in made:
        for word, n in zip(r.word, r.successors):
            shared[word] = shared.get(word, 0) + n
    return Manifest(manifest.folder, settings.order, manifest.total, manifest.size, manifest.end, manifest.words, manifest.counts, bounds, sorted(r.part for r in made), sorted(shared.items()))


def fit_tokens(texts: Texts, settings: Settings = Settings()) -> Manifest:
    """The trie of those of tokenised() texts that are to be learned from, below a new shared folder."""
    if not 1 <= settings.order <= 3:
        raise ValueError("order is 1, 2 or 3")
    with _tidy(texts.spark):
        manifest, marks = _write_vocabulary(texts, shared_dir(texts.spark, "trie"), settings)
        return _write_segments(texts, manifest, marks, settings) if settings.order > 1 and manifest.total else manifest


def fit(train: DataFrame, text_col: str = "text", settings: Settings = Settings()) -> Manifest:
    """The trie of all texts of train."""
    rows = train.select(F.lit(0).alias("id"), F.col(text_col).alias("text"))
    return fit_tokens(tokenised(rows, "id", "text", settings), settings)


# ---------------------------------------------------------------- scoring


def _questions(texts: Texts, manifest: Manifest) -> Callable[[Batches], Batches]:
    """Of batches, what they ask each segment: pairs with what follows them."""
    tokens_at = texts.folder

    def run(batches: Batches) -> Batches:
        trie = _opened(manifest)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                counts, hashes, tokens = _load(tokens_at, name, "counts", "hashes", "tokens")
                key, third, *_ = _grams(trie, np.frombuffer(hashes.as_py(), "<i8"), _unplanes(tokens.as_py()).astype(np.int64), counts.values.to_numpy())
                asked = list(_packed(key, trie.bounds, [key >> 32, key & NONE, third], trie.segments))
                if asked:
                    some, sizes, packs = zip(*asked)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(some)), pa.array(some, pa.int32()), pa.array(sizes, pa.int64()), pa.array(packs, pa.binary())], ["batch", "part", "n", "pack"])

    return lean(run)


def _answers(manifest: Manifest) -> Callable[[pa.Table], pa.Table]:
    """Of one segment's questions: scales of the four codes, codes (plus 1; 0: absent) of each triple's value, of each pair's value and weight, and of the first word's weight."""

    def run(group: pa.Table) -> pa.Table:
        sizes, codec = group.column("n").to_numpy(), pa.Codec("zstd", 1)
        one, two, third = _unpacked(group.column("pack").to_pylist(), sizes.tolist(), 3)
        held = _opened(manifest).segment(group.column("part")[0].as_py())
        new = np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])]
        new[np.cumsum(sizes) - sizes] = True
        begin = np.flatnonzero(new)
        first, second = one[begin].astype(np.int64), two[begin].astype(np.int64)
        found = held.find_pairs(first, second)
        context = first - held.first
        inside = (context >= 0) & (context < len(held.weight.codes))
        coded = lambda codes, at, there: np.where(there, codes.codes[np.where(there, at, 0)].astype(np.uint32) + np.uint32(1), np.uint32(0))
        pairs = [coded(held.value, found, found >= 0), np.zeros(len(begin), np.uint32), coded(held.weight, context, inside)]
        triples, scales = np.zeros(len(one), np.uint32), [(0.0, 0.0), (held.value.low, held.value.step), (0.0, 0.0), (held.weight.low, held.weight.step)]
        if held.order > 2:
            pairs[1] = coded(held.deep_weight, found, found >= 0)
            scales[0], scales[2] = ((c.low, c.step) for c in (held.deep_value, held.deep_weight))
            pair = np.repeat(found, np.diff(np.r_[begin, len(one)]))
            own = np.flatnonzero(pair >= 0)
            spot = held.find_triples(pair[own], third[own].astype(np.int64))
            triples[own[spot >= 0]] = held.deep_value.codes[spot[spot >= 0]].astype(np.uint32) + np.uint32(1)
        ends = np.cumsum(sizes)
        edges, scale, packs = np.searchsorted(begin, np.r_[0, ends]), np.array(scales, "<f8").tobytes(), []
        for i, (a, b) in enumerate(zip(ends - sizes, ends)):
            packs.append(scale + codec.compress(b"".join([_planes(triples[a:b]), *(_planes(x[edges[i] : edges[i + 1]]) for x in pairs)]), asbytes=True))
        return pa.table({"batch": group.column("batch"), "part": group.column("part"), "pack": pa.array(packs, pa.binary())})

    return run


def _scored(texts: Texts, manifest: Manifest, discount: float) -> Callable[[pa.Table], pa.Table]:
    """Of one batch's answers (and a row without one): its texts with their scores."""
    tokens_at = texts.folder

    def run(group: pa.Table) -> pa.Table:
        trie, codec = _opened(manifest), pa.Codec("zstd")
        keys, held, counts, hashes, tokens = _load(tokens_at, group.column("batch")[0].as_py(), "ids", "held", "counts", "hashes", "tokens")
        counts, hashes, tokens = counts.values.to_numpy(), np.frombuffer(hashes.as_py(), "<i8"), _unplanes(tokens.as_py()).astype(np.int64)
        begin = np.cumsum(counts) - counts
        if manifest.order == 1 or not manifest.total:
            ids, seen = trie.lookup(hashes)
            value = trie.single(seen)[tokens]
        else:
            key, third, _, one, place, ids, seen = _grams(trie, hashes, tokens, counts)
            new = np.r_[True, key[1:] != key[:-1]]
            pair_of, edges, deep = np.cumsum(new) - 1, _edges(key, trie.bounds), np.zeros(len(key))
            pair, weight, left = np.zeros(pair_of[-1] + 1), np.ones(pair_of[-1] + 1), np.ones(pair_of[-1] + 1)
            for part, pack in zip(group.column("part").to_pylist(), group.column("pack").to_pylist()):
                if pack is None:
                    continue
                a, b = edges[part], edges[part + 1]
                u, v = pair_of[a], pair_of[b - 1] + 1
                raw, at = np.frombuffer(codec.decompress(pack[64:], 4 * (b - a + 3 * (v - u)), asbytes=True), np.uint8), 0
                for (low, step), into, i, j in zip(np.frombuffer(pack[:64], "<f8").reshape(4, 2), (deep, pair, weight, left), (a, u, u, u), (b, v, v, v)):
                    codes, at = _unplanes(raw[at : at + 4 * (j - i)]), at + 4 * (j - i)
                    there = np.flatnonzero(codes)
                    into[i + there] = 10 ** ((codes[there].astype(np.float64) - 1) * step + low)
            words = one[new]
            edge = trie.edge_weights(ids[words], seen[words], discount)
            left = np.where(np.isnan(edge), left, edge)
            value = pair[pair_of][place] + left[pair_of][place] * trie.single(seen)[tokens]
            if manifest.order > 2:
                on = np.flatnonzero(~_first_flags(counts))
                context = place[on - 1]
                value[on] = deep[context] + weight[pair_of[context]] * value[on]
        sums = [np.add.reduceat(x, begin) for x in ((ids >= 0).astype(np.int64)[tokens], np.log10(trie.single(seen))[tokens], np.log10(value))]
        return pa.Table.from_arrays([keys.values, held.values, pa.array(counts), pa.array(sums[0]), pa.array(np.full(len(counts), manifest.total, np.int64)), pa.array(sums[1]), pa.array(sums[2])], ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score_tokens(texts: Texts, manifest: Manifest, id_col: str = "doc_id", settings: Settings = Settings()) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score of every one of tokenised() texts, in a written table."""
    spark, path = texts.spark, shared_dir(texts.spark, "scores")
    schema = f"id {texts.kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    step = max(8, math.ceil(len(texts.names) / ROUNDS))
    with _tidy(spark):
        for at in range(0, max(1, len(texts.names)), step):
            batches = texts.batches(texts.names[at : at + step])
            # a batch that asks nothing has this row alone
            rows = batches.select("batch", F.lit(None).cast("int").alias("part"), F.lit(None).cast("binary").alias("pack"))
            if manifest.segments:
                asked = batches.mapInArrow(_questions(texts, manifest), "batch string, part int, n long, pack binary")
                rows = rows.union(asked.groupBy("part").applyInArrow(_answers(manifest), "batch string, part int, pack binary"))
            rows.groupBy("batch").applyInArrow(_scored(texts, manifest, settings.discount), schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path).withColumnRenamed("id", id_col)


def score_documents(docs: DataFrame, manifest: Manifest, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score and score of every row."""
    return score_tokens(tokenised(docs, id_col, text_col, settings), manifest, id_col, settings).drop("held_out")


def model_scores(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Learns from the rows for which held_out is false, scores all."""
    texts = tokenised(docs, id_col, text_col, settings, held_out)
    out = score_tokens(texts, fit_tokens(texts, settings), id_col, settings)
    files, base = pa.fs.FileSystem.from_uri(texts.folder)
    files.delete_dir(base)
    return out
