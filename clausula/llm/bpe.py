"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are split before encoding where the pattern always ends a match: after a letter, digit or mark of ASCII and
before a space or newline. No alternative of the pattern holds a character that is not white space followed by white
space, and none looks behind, so the pieces' ids joined are the whole text's ids. A single match that is too long for
the library's quadratic merge (a wordless run of `long_match` bytes or more) is merged here with a heap instead, by the
same rule: the pair of lowest rank first, leftmost first.

Everything is local to a row: no shuffle. Defined results: null text: as empty, no ids; bytes that are not UTF-8 are
replaced by U+FFFD first; repeated rows and ties: each row alone; empty table: no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausula.llm.common import blobs, lean, small_batches

PIECE_CHARS, LONG_MATCH = 1 << 16, 2048
_BOUNDARY = re.compile(r"(?<=[!-~])(?=[ \n])")


class ByteBpe:
    """Encoder and decoder of one rank file; pattern splits the text before the merges."""

    def __init__(self, rank_file: str, pattern: str, piece_chars: int = PIECE_CHARS, long_match: int = LONG_MATCH):
        with open(rank_file, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.library = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.matches = regex.compile(pattern)
        self.piece_chars, self.long_match = piece_chars, long_match
        self.long_run = re.compile(r"\S{%d}|\s{%d}" % (long_match // 4, long_match // 4))

    def pieces(self, text: str) -> Iterator[str]:
        """The text in pieces of about piece_chars, cut at safe boundaries only."""
        begin = 0
        while len(text) - begin > self.piece_chars:
            found = _BOUNDARY.search(text, begin + self.piece_chars)
            if not found:
                break
            yield text[begin : found.start()]
            begin = found.start()
        yield text[begin:]

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for piece in self.pieces(text):
            if self.long_run.search(piece):
                for match in self.matches.finditer(piece):
                    raw = match[0].encode()
                    ids += self.merge(raw) if len(raw) >= self.long_match else self.library.encode_ordinary(match[0])
            else:
                ids += self.library.encode_ordinary(piece)
        return ids

    def merge(self, raw: bytes) -> list[int]:
        """One match's ids in n log n steps."""
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        n = len(raw)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n

        def rank(i: int) -> int | None:
            return self.ranks.get(raw[i : end[end[i]]]) if end[i] < n else None

        heap = [(r, i, end[end[i]]) for i in range(n - 1) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop or rank(i) != r:
                continue
            j = end[i]
            alive[j] = False
            end[i] = end[j]
            if end[i] < n:
                before[end[i]] = i
            for k in (before[i], i):
                if k >= 0 and (r := rank(k)) is not None:
                    heapq.heappush(heap, (r, k, end[end[k]]))
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[raw[i : end[i]]])
            i = end[i]
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return self.library.decode_bytes(ids)


@lru_cache(maxsize=4)
def codec(rank_file: str, pattern: str) -> ByteBpe:
    """One for each Python worker and rank file."""
    return ByteBpe(rank_file, pattern)


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 8 << 20) -> DataFrame:
    """Each row's id, its token ids, and their number."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(rank_file, pattern)
        for batch in batches:
            keys, ids, size, begin = batch.column(0), [], 0, 0
            texts = blobs(batch.column(1))
            for i, text in enumerate(texts):
                ids.append(bpe.encode((text or b"").decode("utf-8", "replace")))
                size += len(text or b"")
                if size >= batch_bytes or i + 1 == len(texts):
                    yield pa.RecordBatch.from_arrays([keys.slice(begin, len(ids)), pa.array(ids, pa.list_(pa.int32())), pa.array(map(len, ids), pa.int64())], ["id", "token_ids", "n_tokens"])
                    begin, ids, size = i + 1, [], 0

    return docs.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(lean(run), f"id {kind}, token_ids array<int>, n_tokens long").withColumnRenamed("id", id_col)


def digest_documents(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Round trip in one pass: each row's number of ids, SHA-256 of the ids and of the bytes they decode to."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(rank_file, pattern)
        names = [str(i) for i in range(max(bpe.ranks.values()) + 1)]
        for batch in batches:
            counts, id_hashes, byte_hashes = [], [], []
            for text in blobs(batch.column(1)):
                ids = bpe.encode((text or b"").decode("utf-8", "replace"))
                counts.append(len(ids))
                id_hashes.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                byte_hashes.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(id_hashes, pa.string()), pa.array(byte_hashes, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(lean(run), f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
