"""Token ids as binary files with a minimal perfect hash index.

Writing: documents are dealt into ranges of their id, so that file after file, row after row, ids ascend. Each task
encodes its rows and appends the raw ids (little-endian, 2 bytes each where the vocabulary allows it, else 4) to one
file after a 16-byte header. The index is dealt by a hash of the key into files of about `keys_per_index` keys: a
minimal perfect hash function (levels of bit arrays; a key sits in the first level where no other key met it, its slot
is the number of set bits before), and by slot a 32-bit fingerprint of the key, file, offset and length. A lookup takes
one index file, a few bit tests, one fingerprint comparison and one ranged read. The manifest names the files and how
many ids come before each. Files get their names by a rename, after they are whole, so a task that runs again is harmless.

Plain texts are cut into the tokenizer's own pieces by array operations; distinct pieces are encoded once and remembered
(up to about `cache_pieces` for each Python worker). This suits tokenizers whose lower-casing, pattern and word ends are
those of the file used here, which a probe text finds out; texts go whole to any other tokenizer, as do texts with other characters.

Defined results: null text: as empty, so the end id alone; bytes that are not UTF-8 become U+FFFD; a null id sorts first;
rows of equal ids are kept as their 1st, 2nd, ... occurrence, ordered by a hash of the text. Empty table: no rows.
"""

from __future__ import annotations

import json
import math
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from clausula.llm.common import blobs, chunks, mixed_keys, padded, parts, place, shared_dir, small_batches, span_keys, written

HEADER = "<4sHHQ"
HEADER_BYTES = struct.calcsize(HEADER)
MAGIC = b"CLTK"


class _Rows:
    """Rows of ids of different lengths, one after the other."""

    def __init__(self):
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.uint32)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.used += len(ids)

    def joined(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some rows in a row, and the edges between them."""
        sizes = self.sizes[rows]
        ends = np.r_[0, np.cumsum(sizes)]
        return self.flat[np.repeat(self.starts[rows] - ends[:-1], sizes) + np.arange(ends[-1])], ends


#: Kinds of bytes in plain text.
SPACE, LETTER, DIGIT, OTHER, ODD = range(5)
LEAD = 0xC3  # of the letters and signs from U+00C0 to U+00FF


def _kinds() -> np.ndarray:
    kinds = np.full(256, ODD, np.uint8)
    for c in range(0x21, 0x7F):
        kinds[c] = LETTER if chr(c).isalpha() else DIGIT if chr(c).isdigit() else OTHER
    kinds[[*range(9, 14), 32]] = SPACE
    return kinds


KINDS = _kinds()
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


def plain_pieces(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cuts text as the word tokenizer's normaliser and pattern do, by array operations.

    Letters of ASCII and Latin-1 in runs, digits one by one, other signs in runs, and the contractions 's 't 're 've 'm
    'll 'd, whose apostrophe begins a run. Returns the padded lower-cased bytes, the pieces' starts and lengths, and flags
    of bytes that this does not hold for (any other character, control characters, bytes that are not UTF-8).
    """
    data = padded(text)
    low, kind = LOWER[data], KINDS[data]
    kind[-16:] = SPACE
    lead = np.flatnonzero(data[:-16] == LEAD)
    if len(lead):
        tail = data[lead + 1]
        good = (tail >= 0x80) & (tail < 0xC0)
        lead, tail = lead[good], tail[good]
        kind[lead] = kind[lead + 1] = np.where((tail == 0x97) | (tail == 0xB7), OTHER, LETTER)
        upper = lead[(tail < 0x9F) & (tail != 0x97)]
        low[upper + 1] += 0x20
    before = np.r_[np.uint8(SPACE), kind[:-1]]
    edge = kind != before
    edge |= kind == DIGIT
    quote = np.flatnonzero((low[:-2] == 0x27) & (before[:-2] != OTHER))
    if len(quote):
        one, two = low[quote + 1], low[quote + 2]
        size = np.where(np.isin(one, np.frombuffer(b"stmd", np.uint8)), 2, np.where((((one == 0x72) | (one == 0x76)) & (two == 0x65)) | ((one == 0x6C) & (two == 0x6C)), 3, 0))
        quote, size = quote[size > 0], size[size > 0]
        edge[quote + 1] = False
        edge[quote + size] = True
    at = np.flatnonzero(edge)
    lengths = np.diff(np.r_[at, len(data)])
    own = kind[at] != SPACE
    return low, at[own], lengths[own], kind[:-16] == ODD


class WordEncoder:
    """Ids of many texts at once, by way of the distinct pieces that the tokenizer cuts them into.

    Plain texts are cut here by array operations and their new pieces encoded by the tokenizer's model, many in one call;
    texts with other characters or special tokens go to the tokenizer whole. Whether this gives the same ids with the given file is
    tried out on a probe text first: if not, every text goes to the tokenizer whole.
    """

    WORD_END = "</w>"
    PROBE = "It's we'll THEY'RE 'tis o'clock, 'S'd'M!'t isn't; a1b22 (x)... --Ünïté Straße ÀÞ×÷ß ÿ\n\t4.5% #tag_x \"quoted.\" I've 'RE"

    def __init__(self, tokenizer_file: str, cache_pieces: int = 1_000_000, words: bool = True):
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.vocabulary = max(vocabulary.values()) + 1
        self.cache_pieces = cache_pieces
        self.ends = np.zeros(self.vocabulary, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(self.WORD_END)]] = True
        specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special_start = os.path.commonprefix(specials).encode() if specials else None
        self._forget()
        self.pieces = words and self._pieces_will_do(tokenizer_file)

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.rows, self.first, self.second = _Rows(), np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def _pieces_will_do(self, tokenizer_file: str) -> bool:
        # the model and its bytes alone: pieces are normalised and cut already
        with open(tokenizer_file, encoding="utf-8") as source:
            about = json.load(source)
        if about.get("model", {}).get("end_of_word_suffix") != self.WORD_END:
            return False
        steps = [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
        about |= {"normalizer": None, "added_tokens": [], "post_processor": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": steps}}
        self.bare = Tokenizer.from_str(json.dumps(about))
        found = self._cut([self.PROBE.encode()])
        return found is not None and found[0].tolist() == self._one(self.PROBE.encode()).tolist()

    def _one(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)

    def _learn(self, pieces: list[bytes], first: np.ndarray, second: np.ndarray) -> None:
        """New pieces are encoded at white space, many in a text; each ends with a token that ends a word."""
        for i in range(0, len(pieces), 4096):
            part = b" ".join(pieces[i : i + 4096]).decode()
            ids = np.array(self.bare.encode_batch_fast([part], add_special_tokens=False)[0].ids, np.uint32)
            last = np.flatnonzero(self.ends[ids])
            if len(last) != len(pieces[i : i + 4096]) or last[-1] + 1 != len(ids):
                rows = [self.bare.encode(p.decode(), add_special_tokens=False).ids for p in pieces[i : i + 4096]]
                ids, last = np.array([x for row in rows for x in row], np.uint32), np.cumsum([len(r) for r in rows]) - 1
            self.rows.add(ids, np.diff(np.r_[-1, last]))
        self.first, self.second = np.concatenate([self.first, first]), np.concatenate([self.second, second])

    def _cut(self, texts: list[bytes], pieces: tuple[np.ndarray, ...] | None = None) -> tuple[np.ndarray, np.ndarray] | None:
        """All ids in a row and how many each text has; None if two pieces share a hash. The texts are plain; pieces: of them joined by line ends."""
        low, starts, lengths, _ = pieces or plain_pieces(b"\n".join(texts))
        if len(self.known) > self.cache_pieces:
            self._forget()
        first, second = span_keys(low, starts, lengths)
        keys, some, which = np.unique(mixed_keys(first, second), return_index=True, return_inverse=True)
        row = np.array([self.known.get(k, -1) for k in keys.tolist()], np.int64)
        fresh = np.flatnonzero(row < 0)
        if len(fresh):
            row[fresh] = len(self.known) + np.arange(len(fresh))
            at = some[fresh]
            flat = low.tobytes()
            self._learn([flat[a:b] for a, b in zip(starts[at].tolist(), (starts[at] + lengths[at]).tolist())], first[at], second[at])
            self.known.update(zip(keys[fresh].tolist(), row[fresh].tolist()))
        rows = row[which]
        if (self.first[rows] != first).any() or (self.second[rows] != second).any():
            return None
        ids, ends = self.rows.joined(rows)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        edges = ends[np.searchsorted(starts, np.r_[0, np.cumsum(sizes)])]
        return ids, np.diff(edges)

    def encode(self, texts: list[bytes | None], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in a row, and how many each text has."""
        texts = [t or b"" for t in texts]
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        cut = None
        if self.pieces:
            pieces = plain_pieces(b"\n".join(texts))
            edges = np.r_[0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)]
            count = np.r_[0, np.cumsum(pieces[3])]
            count = count[np.minimum(edges, len(count) - 1)]
            plain = [i for i, (t, n) in enumerate(zip(texts, np.diff(count).tolist())) if not n and (self.special_start is None or self.special_start not in t)]
            cut = self._cut([texts[i] for i in plain], pieces if len(plain) == len(texts) else None) if plain else None
        if cut and len(plain) == len(texts):
            ids, lengths = cut
        else:
            found: list[np.ndarray | None] = [None] * len(texts)
            if cut:
                for i, part in zip(plain, np.split(cut[0], np.cumsum(cut[1])[:-1])):
                    found[i] = part
            found = [self._one(t) if x is None else x for t, x in zip(texts, found)]
            ids, lengths = np.concatenate(found), np.array([len(x) for x in found], np.int64)
        if end_id is not None:
            ids, lengths = np.insert(ids, np.cumsum(lengths), end_id), lengths + 1
        return ids, lengths


@lru_cache(maxsize=2)
def encoder(tokenizer_file: str, words: bool = True) -> WordEncoder:
    return WordEncoder(tokenizer_file, words=words)


def _mixed(hashes: np.ndarray, level: int) -> np.ndarray:
    x = hashes ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % 2**64)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class PerfectHash:
    """A minimal perfect hash function over distinct pairs of 64-bit hashes."""

    GAMMA, LEVELS = 1.5, 40

    def __init__(self, words: list[np.ndarray], rest: np.ndarray):
        """words: the levels' bit arrays; rest: sorted pairs that no level could place."""
        self.words, self.rest = words, rest
        ones = [np.bitwise_count(w).astype(np.int64) for w in words]
        self.before, total = [], 0
        for n in ones:
            self.before.append(total + np.cumsum(n) - n)
            total += int(n.sum())
        self.placed = total

    @classmethod
    def build(cls, first: np.ndarray, second: np.ndarray) -> PerfectHash:
        words = []
        for level in range(cls.LEVELS):
            if not len(first):
                break
            size = max(64, math.ceil(len(first) * cls.GAMMA / 64) * 64)
            at = (_mixed(first, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            first, second = first[~alone[at]], second[~alone[at]]
        rest = np.array(sorted(zip(first.tolist(), second.tolist())), np.uint64).reshape(-1, 2)
        return cls(words, rest)

    def slots(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The slot of each key that was built in; some slot or -1 for others."""
        found = np.full(len(first), -1, np.int64)
        open_ = np.arange(len(first))
        for level, (words, before) in enumerate(zip(self.words, self.before)):
            at = _mixed(first[open_], level) % np.uint64(64 * len(words))
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            hit = (words[word] >> bit & np.uint64(1)).astype(bool)
            below = words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            found[open_[hit]] = (before[word] + np.bitwise_count(below))[hit]
            open_ = open_[~hit]
        if len(self.rest):
            known = {tuple(x): i for i, x in enumerate(self.rest.tolist())}
            for i in open_:
                found[i] = self.placed + known[k] if (k := (int(first[i]), int(second[i]))) in known else -1
        return found

    def dump(self) -> bytes:
        sizes = [len(w) for w in self.words]
        return struct.pack("<II", len(sizes), len(self.rest)) + struct.pack(f"<{len(sizes)}I", *sizes) + b"".join(w.tobytes() for w in self.words) + self.rest.astype("<u8").tobytes()

    @classmethod
    def load(cls, raw: memoryview) -> tuple[PerfectHash, int]:
        """The function, and where its bytes end."""
        n, rest = struct.unpack_from("<II", raw)
        sizes, at, words = struct.unpack_from(f"<{n}I", raw, 8), 8 + 4 * n, []
        for size in sizes:
            words.append(np.frombuffer(raw, "<u8", size, at))
            at += 8 * size
        return cls(words, np.frombuffer(raw, "<u8", 2 * rest, at).reshape(-1, 2)), at + 16 * rest


#: What the index has for each slot.
ENTRY = np.dtype([("fingerprint", "<u4"), ("file", "<u4"), ("offset", "<u8"), ("length", "<u8")])


def _put(files: pa.fs.FileSystem, path: str, data: bytes) -> None:
    draft = f"{path}.{uuid.uuid4().hex}"
    with files.open_output_stream(draft, compression=None) as out:
        out.write(data)
    place(files, draft, path)


def _keyed(rows: DataFrame, indexes: int) -> DataFrame:
    """id and nth to two hashes of the key and the index file it belongs to."""
    key = F.concat(F.coalesce(F.concat(F.lit("="), F.col("id").cast("string")), F.lit("null")), F.lit("#"), F.col("nth").cast("string"))
    rows = rows.withColumn("first", F.xxhash64(key)).withColumn("second", F.xxhash64(F.lit("fingerprint"), key))
    return rows.withColumn("part", F.pmod(F.xxhash64(F.lit("part"), key), F.lit(indexes)).cast("int"))


def write_store(docs: DataFrame, folder: str, tokenizer_file: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text", keys_per_index: int = 1 << 16, words: bool = True) -> DataFrame:
    """Writes payload, index and manifest below folder; returns the keys (id, nth) as a written table."""
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    n_files = max(1, parts(spark))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).repartitionByRange(n_files, "id").sortWithinPartitions("id", F.xxhash64("text"))

    def payload(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pa.fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        encode = encoder(tokenizer_file, words)
        item = np.dtype("<u2" if max(encode.vocabulary, end_id or 0) < 1 << 16 else "<u4")
        number = TaskContext.get().partitionId()
        path = f"{base}/ids-{number:06d}.bin"
        draft, offset, last, nth = f"{path}.{uuid.uuid4().hex}", 0, object(), 0
        with files.open_output_stream(draft, compression=None) as out:
            out.write(struct.pack(HEADER, MAGIC, 1, item.itemsize, number))
            for batch in batches:
                keys, texts = batch.column(0), blobs(batch.column(1))
                values = keys.to_pylist()
                for a, b in chunks(texts, 2 << 20):
                    ids, lengths = encode.encode(texts[a:b], end_id)
                    out.write(ids.astype(item).tobytes())
                    order = []
                    for value in values[a:b]:
                        nth = nth + 1 if value == last else 0
                        last = value
                        order.append(nth)
                    ends = offset + np.cumsum(lengths)
                    yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), pa.array(order, pa.int64()), pa.array(np.full(b - a, number, np.int32)), pa.array(ends - lengths), pa.array(lengths)], ["id", "nth", "file", "offset", "length"])
                    offset = int(ends[-1])
        place(files, draft, path)

    entries = written(rows.mapInArrow(payload, f"id {kind}, nth long, file int, offset long, length long"), "entries")
    totals = {r.file: (r.ids, r.keys) for r in entries.groupBy("file").agg(F.sum("length").alias("ids"), F.count("*").alias("keys")).collect()}
    starts, ahead = {}, 0
    for number in sorted(totals):
        starts[number] = ahead
        ahead += totals[number][0]
    indexes = max(1, math.ceil(sum(n for _, n in totals.values()) / keys_per_index))

    def index(group: pa.Table) -> pa.Table:
        files, base = pa.fs.FileSystem.from_uri(folder)
        column = {k: group.column(k).to_numpy() for k in ("first", "second", "file", "offset", "length")}
        first, second = column["first"].view(np.uint64), column["second"].view(np.uint64)
        function = PerfectHash.build(first, second)
        table = np.zeros(len(first), ENTRY)
        at = function.slots(first, second)
        for name, values in (("fingerprint", second & np.uint64(0xFFFFFFFF)), ("file", column["file"]), ("offset", column["offset"]), ("length", column["length"])):
            table[name][at] = values
        part = group.column("part")[0].as_py()
        _put(files, f"{base}/index-{part:06d}.mph", function.dump() + table.tobytes())
        return pa.table({"part": pa.array([part], pa.int32()), "keys": pa.array([len(first)], pa.int64())})

    made = _keyed(entries, indexes).select("part", "first", "second", "file", "offset", "length").groupBy("part").applyInArrow(index, "part int, keys long")
    made.agg(F.sum("keys")).collect()
    files, base = pa.fs.FileSystem.from_uri(folder)
    files.create_dir(base, recursive=True)
    _put(files, f"{base}/manifest.json", json.dumps({"version": 1, "indexes": indexes, "starts": {str(k): v for k, v in starts.items()}}).encode())
    return entries.select("id", "nth")


def read_manifest(folder: str) -> dict:
    files, base = pa.fs.FileSystem.from_uri(folder)
    with files.open_input_stream(f"{base}/manifest.json") as source:
        return json.loads(source.read())


def lookup(keys: DataFrame, folder: str) -> DataFrame:
    """id, nth, file, offset and length (null where the store has no such key) by the index alone."""
    kind = keys.schema["id"].dataType.simpleString()

    def find(group: pa.Table) -> pa.Table:
        files, base = pa.fs.FileSystem.from_uri(folder)
        with files.open_input_file(f"{base}/index-{group.column('part')[0].as_py():06d}.mph") as source:
            raw = memoryview(source.read())
        function, end = PerfectHash.load(raw)
        table = np.frombuffer(raw, ENTRY, -1, end)
        first, second = (group.column(k).to_numpy().view(np.uint64) for k in ("first", "second"))
        slot = function.slots(first, second)
        row = table[np.maximum(slot, 0)]
        absent = (slot < 0) | (row["fingerprint"] != (second & np.uint64(0xFFFFFFFF)))
        return pa.table({"id": group.column("id"), "nth": group.column("nth"), "file": pa.array(row["file"].astype(np.int32), mask=absent), "offset": pa.array(row["offset"].astype(np.int64), mask=absent), "length": pa.array(row["length"].astype(np.int64), mask=absent)})

    return _keyed(keys, read_manifest(folder)["indexes"]).groupBy("part").applyInArrow(find, f"id {kind}, nth long, file int, offset long, length long")


def read_store(found: DataFrame, folder: str) -> DataFrame:
    """For what lookup() found: id, start (ids of all files and rows before), n_tokens, ids_crc32, read from the payload in file order."""
    kind = found.schema["id"].dataType.simpleString()
    starts = {int(k): v for k, v in read_manifest(folder)["starts"].items()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pa.fs.FileSystem.from_uri(folder)
        number = source = item = None
        for batch in batches:
            begin, sums = [], []
            for file, offset, length in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                if file != number:
                    if source:
                        source.close()
                    source, number = files.open_input_file(f"{base}/ids-{file:06d}.bin"), file
                    magic, _, size, _ = struct.unpack(HEADER, source.read_at(HEADER_BYTES, 0))
                    if magic != MAGIC:
                        raise ValueError(f"ids-{file:06d}.bin is no token file")
                    item = np.dtype(f"<u{size}")
                raw = source.read_at(length * item.itemsize, HEADER_BYTES + offset * item.itemsize)
                sums.append(zlib.crc32(np.frombuffer(raw, item).astype("<u4").tobytes()))
                begin.append(starts[file] + offset)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(begin, pa.int64()), batch.column(3), pa.array(sums, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])

    rows = found.where("file IS NOT NULL").select("id", "file", "offset", "length").repartition(max(1, parts(found.sparkSession)), "file").sortWithinPartitions("file", "offset")
    return rows.mapInArrow(read, f"id {kind}, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer_file: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    folder = shared_dir(docs.sparkSession, "tokens")
    keys = write_store(docs, folder, tokenizer_file, end_id, id_col, text_col)
    return read_store(lookup(keys, folder), folder).withColumnRenamed("id", id_col)
