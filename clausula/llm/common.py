"""What several operators share: the shared folder, written intermediate tables, words of a text."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that ends a word (space, and U+0009 to U+000D), as a regular expression of what a word holds.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new folder's URI below spark.checkpoint.dir, which the driver and all executors share.

    Where the session names none, a temporary folder becomes it on a single machine (local master); on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="clausula-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def place(files: pa.fs.FileSystem, draft: str, path: str) -> None:
    """Gives a whole file its name. Where a store refuses to replace a file that an earlier try of the task left, that one stays: it is the same."""
    try:
        files.move(draft, path)
    except OSError:
        if files.get_file_info(path).type != pa.fs.FileType.File:
            raise
        files.delete_file(draft)


def written(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends here, and the loss of an executor costs nothing."""
    spark = df.sparkSession
    path = shared_dir(spark, tag)
    df.write.option("compression", compression).parquet(path)
    frame = spark.read.schema(df.schema).parquet(path)
    frame._written_at = path
    return frame


def discard(*frames: DataFrame) -> None:
    """Deletes the files of written() tables that nothing reads any more: what came of them is itself in files, or with the driver."""
    for frame in frames:
        files, base = pa.fs.FileSystem.from_uri(frame._written_at)
        files.delete_dir(base)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Fewer rows in an Arrow batch than Spark's 10,000 by default: whole texts make 30 MB and more of these, several times over."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


Batches = Iterator[pa.RecordBatch]


def lean(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """run, with what a task has freed given back to the system at its end: Python workers serve one stage after the other."""

    @wraps(run)
    def wrapped(batches: Batches) -> Batches:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_bucket(id_col: str, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def blobs(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string or binary column."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def chunks(texts: list[bytes | None], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes together; a longer text is alone."""
    begin = size = 0
    for i, text in enumerate(texts):
        size += len(text or b"")
        if size >= most:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def padded(data: bytes) -> np.ndarray:
    """The bytes and 16 zeros, as span_keys wants them."""
    return np.frombuffer(data + bytes(16), np.uint8)


def span_keys(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers for each span of padded data: the bytes themselves up to 16 (free of zero bytes, so exact), else their XXH3 of 128 bits."""
    eights = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    first = eights[starts] & _MASKS[np.minimum(lengths, 8)]
    second = eights[np.minimum(starts + 8, len(data) - 8)] & _MASKS[np.clip(lengths - 8, 0, 8)]
    for i in np.flatnonzero(lengths > 16).tolist():
        digest = xxhash.xxh3_128_intdigest(data[starts[i] : starts[i] + lengths[i]].tobytes())
        first[i], second[i] = digest >> 64, digest & 2**64 - 1
    return first, second


def mixed_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One 64-bit hash of each pair of span_keys."""
    x = first * np.uint64(0x9E3779B97F4A7C15) ^ (second + np.uint64(0x165667B19E3779F9)) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(29)


def marked_rows(rows: DataFrame, ids: DataFrame, keep: bool, row_col: str = "nd__row", then: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, schema: str | None = None) -> DataFrame:
    """The rows whose row_col (from monotonically_increasing_id) is among ids (one column), or is not; or what `then` makes of them, by schema, in the same Python worker.

    ids are dealt by the partition that row_col names and lie in one small file for each; a task that reads rows opens
    the files of their partitions. So neither the rows nor all ids move: only ids are shuffled, once.
    """
    spark = rows.sparkSession
    folder = shared_dir(spark, "marks")
    at = rows.columns.index(row_col)
    files, base = pa.fs.FileSystem.from_uri(folder)
    files.create_dir(base, recursive=True)

    def put(group: pa.Table) -> pa.Table:
        files, base = pa.fs.FileSystem.from_uri(folder)
        part = group.column("part")[0].as_py()
        draft = f"{base}/.{part}-{uuid.uuid4().hex}"
        with files.open_output_stream(draft, compression=None) as out:
            out.write(np.sort(group.column("row").to_numpy()).astype("<i8").tobytes())
        place(files, draft, f"{base}/{part}.ids")
        return pa.table({"part": pa.array([part], pa.int64())})

    row = ids.columns[0]
    dealt = ids.select(ids[row].alias("row")).select("row", F.shiftright("row", 33).alias("part"))
    dealt.groupBy("part").applyInArrow(put, "part long").count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pa.fs.FileSystem.from_uri(folder)
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            own = batch.column(at).to_numpy(zero_copy_only=False)
            inside = np.zeros(len(own), bool)
            for part in np.unique(own >> 33).tolist():
                if part not in known:
                    known.clear()
                    path = f"{base}/{part}.ids"
                    there = files.get_file_info(path).type == pa.fs.FileType.File
                    known[part] = np.frombuffer(files.open_input_stream(path, compression=None).read(), "<i8") if there else np.zeros(0, np.int64)
                inside |= np.isin(own, known[part])
            kept = batch.filter(pc.equal(pa.array(inside), keep))
            yield then(kept) if then else kept

    return rows.mapInArrow(lean(run), schema or rows.schema)
