"""Quality rules over a suffix array: how much of a text repeats itself.

A text is a sequence of words. A word-level suffix array, built by prefix doubling for many texts at once, gives the
longest-common-prefix (LCP) intervals; those that cannot be extended to the left are the maximal repeated substrings.
The union of their occurrences gives the covered fraction, and the deepest interval the longest repeat.

Everything is local to a row, so there is no shuffle: one pass over the text column, in Arrow batches that are worked
off in chunks of `chunk_bytes`, so memory depends on the chunk and on the longest single text only.

Defined results: null or empty text: no words, base_failed. Repeated rows: each is judged alone. Empty table: no rows.
Other columns are never read by `quality_report` and pass through `quality_filter` untouched.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausula.llm.common import blobs, chunks, lean, small_batches

#: Fixed values of the contract.
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS, MOST_REPEAT_PERCENT, WINDOW = 50, 50, 3
REPORT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, covered_words long, longest_repeat long, kept boolean"


@dataclass(frozen=True)
class RepeatLimits:
    """A text goes if repeats of at least min_words cover more than max_covered of it, or one is longer than max_longest words."""

    min_words: int = 8
    max_covered: float = 0.3
    max_longest: int = 150
    chunk_bytes: int = 1 << 20


def deepest_repeats(tokens: np.ndarray) -> np.ndarray:
    """For each position, the length of the longest substring that starts there and occurs elsewhere too (1 and 0 may be given as 0)."""
    n = len(tokens)
    deepest = np.zeros(n, np.int64)
    if n < 2:
        return deepest
    suffixes = np.argsort(tokens, kind="stable")
    ordered = tokens[suffixes]
    first = np.r_[True, ordered[1:] != ordered[:-1]]
    place = np.arange(n)
    start = np.maximum.accumulate(np.where(first, place, 0))
    rank = np.empty(n, np.int64)
    rank[suffixes] = start
    single = first & np.r_[first[1:], True]
    open_ = suffixes[~single]
    levels = [(1, rank.astype(np.int32))]
    width = 1
    while len(open_):
        after = open_ + width
        follow = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        old = rank[open_]
        key = old * (n + 1) + follow
        order = np.argsort(key)
        at, key, old = open_[order], key[order], old[order]
        place = np.arange(len(at))
        fresh = np.r_[True, key[1:] != key[:-1]]
        group = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], place, 0))
        start = np.maximum.accumulate(np.where(fresh, place, 0))
        new = old + start - group
        rank[at] = new
        suffixes[new + place - start] = at
        open_ = at[~(fresh & np.r_[fresh[1:], True])]
        width *= 2
        if len(open_):
            levels.append((width, rank.astype(np.int32)))
    left, right = suffixes[:-1], suffixes[1:]
    pair = levels[min(1, len(levels) - 1)][1]
    near = np.flatnonzero(pair[left] == pair[right])
    a, b = left[near].copy(), right[near].copy()
    common = np.zeros(len(near), np.int64)
    for size, ranks in reversed(levels):
        same = (np.maximum(a, b) < n) & (ranks[np.minimum(a, n - 1)] == ranks[np.minimum(b, n - 1)])
        step = np.where(same, size, 0)
        common += step
        a += step
        b += step
    np.maximum.at(deepest, left[near], common)
    np.maximum.at(deepest, right[near], common)
    return deepest


def maximal_spans(deepest: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of occurrences of maximal repeats of at least `least` words: those that no longer one to the left contains."""
    inner = np.r_[False, deepest[:-1] >= deepest[1:] + 1] if len(deepest) else np.zeros(0, bool)
    starts = np.flatnonzero((deepest >= least) & ~inner)
    return starts, deepest[starts]


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions the union of the spans covers."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + lengths, n), -1)
    return np.cumsum(edge[:n]) > 0


_KIND = np.zeros(256, np.uint8)
_KIND[:128] = 1
_KIND[192:] = 1
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_IS_SYMBOL = np.zeros(256, np.uint8)
_IS_SYMBOL[list(SYMBOLS)] = 1


def measure(texts: list[bytes | None], limits: RepeatLimits) -> dict[str, np.ndarray]:
    """The report's columns for some texts."""
    texts = [t or b"" for t in texts]
    number: dict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    ids, sizes, duplicates = [], [], []
    for text in texts:
        words = text.split()
        ids.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
        sizes.append(len(words))
        seen: set[bytes] = set()
        lines = [x for x in text.split(b"\n") if x and not x.isspace()]
        duplicates.append(len(lines) - len(set(lines)))
        del seen
    n_words = np.array(sizes, np.int64)
    begin = np.r_[0, np.cumsum(n_words)]
    tokens = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    tokens += np.repeat(np.arange(len(texts)), n_words) * (len(number) + 1)
    deepest = deepest_repeats(tokens)

    def per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(flags, dtype=np.int64)]
        return total[at[1:]] - total[at[:-1]]

    windows = np.flatnonzero(deepest >= WINDOW)
    n_repeat = per_text(covered(windows, np.full(len(windows), WINDOW), len(tokens)), begin)
    starts, lengths = maximal_spans(deepest, limits.min_words)
    n_covered = per_text(covered(starts, lengths, len(tokens)), begin)
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, np.searchsorted(begin, starts, "right") - 1, lengths)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    edges = np.r_[0, np.cumsum([len(t) for t in texts], dtype=np.int64)] if texts else np.zeros(1, np.int64)
    failed = (n_words < LEAST_WORDS) | (100 * n_repeat > MOST_REPEAT_PERCENT * n_words)
    return {
        "n_words": n_words,
        "word_chars": per_text(_KIND[raw], edges),
        "n_symbols": per_text(_IS_SYMBOL[raw], edges),
        "n_dup_lines": np.array(duplicates, np.int64),
        "n_repeat_words": n_repeat,
        "base_failed": failed,
        "covered_words": n_covered,
        "longest_repeat": longest,
        "kept": ~failed & (n_covered <= limits.max_covered * n_words) & (longest <= limits.max_longest),
    }


def _measured(texts: list[bytes | None], limits: RepeatLimits) -> dict[str, np.ndarray]:
    found = [measure(texts[a:b], limits) for a, b in chunks(texts, limits.chunk_bytes)] or [measure([], limits)]
    return {k: np.concatenate([x[k] for x in found]) for k in found[0]}


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: RepeatLimits = RepeatLimits()) -> DataFrame:
    """One row for each row of docs: its id and the report's columns."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({id_col: batch.column(0)} | {k: pa.array(v) for k, v in _measured(blobs(batch.column(1)), limits).items()})

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(lean(run), f"`{id_col}` {kind}, {REPORT}")


def quality_filter(docs: DataFrame, text_col: str = "text", limits: RepeatLimits = RepeatLimits()) -> DataFrame:
    """The rows of docs whose text is kept, with all their columns."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_measured(blobs(batch.column(at)), limits)["kept"]))

    return docs.mapInArrow(lean(run), docs.schema)
