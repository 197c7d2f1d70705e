"""Helpers that every operator of the subpackage shares."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as every contract of this subpackage counts it: no ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WORD_BYTES = re.compile(rb"[^\x20\x09-\x0D]+")


#: Bytes of an Arrow batch between Spark and a Python worker, where the session sets none (Spark's default is 64 MB): a batch is held several times over, in either process.
BATCH_BYTES = 4 << 20


def bounded(spark: SparkSession) -> None:
    """See that Arrow batches of long texts stay small; a session's own setting is left alone."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "1") in ("1", "1b"):  # the given default comes back where nothing is set
        spark.conf.set(key, str(BATCH_BYTES))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The table by Spark's own reader, so that any store that Spark knows will do."""
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none and runs on this machine alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='verdigris-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it again.

    Cuts the lineage in such a way that the loss of an executor costs only the tasks of the later plan:
    the files stay with the shared store.
    """
    spark = df.sparkSession
    bounded(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    if compression:
        writer = writer.option("compression", compression)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by ``written`` that no later plan reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    with contextlib.suppress(Exception):
        for file in df.inputFiles()[:1]:
            folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def held_out(modulus: int, column: str = "doc_id"):
    """True where crc32 of the id as decimal text leaves no remainder."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus == 0


def utf8(values: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes of a string or binary column one after the other, n + 1 offsets); null is empty."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if values.null_count:
        values = values.fill_null("" if pa.types.is_string(values.type) or pa.types.is_large_string(values.type) else b"")
    wide = pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = values.buffers()
    n = len(values)
    if offsets is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, kind)[values.offset : values.offset + n + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, at - at[0]


def strings(values: pa.Array) -> list[str]:
    """The column as Python strings, null as the empty one."""
    return [x or "" for x in values.to_pylist()]


def id_bounds(docs: DataFrame, parts: int, column: str = "doc_id") -> list[int]:
    """At most parts - 1 ascending cut points that deal the ids into ranges of about equal size.

    An approximate quantile sketch, so what reaches the driver is as long as ``parts``, whatever the input.
    """
    if parts < 2:
        return []
    got = docs.where(F.col(column).isNotNull()).select(F.percentile_approx(column, [i / parts for i in range(1, parts)], 10_000).alias("q")).first()
    return sorted(set(got["q"] or [])) if got else []


def bucket_of(bounds: list[int], column: str = "doc_id"):
    """Number of bounds that the id exceeds, by binary search as a nested CASE; null ids come after all."""

    def tree(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(column) <= bounds[mid], tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return F.when(F.col(column).isNull(), F.lit(len(bounds))).otherwise(tree(0, len(bounds)))


def partitions_for(spark: SparkSession, least: int = 12) -> int:
    """The session's number of shuffle partitions."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def given_back() -> None:
    """Return what this process has freed but holds on to: a worker outlives its task, and the next one's need comes on top of the most that an earlier one took."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def batches(it: Iterator[pa.RecordBatch], rows: int = 256, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice with very long texts stays small; what earlier tasks of the worker have left goes back first."""
    given_back()
    for batch in it:
        start = 0
        while start < batch.num_rows:
            n = min(rows, batch.num_rows - start)
            while n > 1 and batch.slice(start, n).nbytes > size:
                n //= 2
            yield batch.slice(start, n)
            start += n


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def nfkc(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFKC", text)


#: Rows of ids, 16 bytes each or so in memory, up to which a counted id table is broadcast instead of shuffling texts.
BROADCAST_IDS = 1_000_000


def by_ids(docs: DataFrame, ids: DataFrame, how: str = "left_semi", column: str = "doc_id", bound: int = BROADCAST_IDS) -> DataFrame:
    """docs whose id is (left_semi) or isn't (left_anti) in a written table of distinct ids.

    The table is counted first: up to ``bound`` rows it is broadcast, so that texts stay where they are; beyond, both sides are shuffled.
    """
    if ids.columns != [column]:
        ids = ids.toDF(column)
    small = ids.limit(bound + 1).count() <= bound
    return docs.join(F.broadcast(ids) if small else ids.hint("merge"), column, how)


def word_runs(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end, text) of every word in texts laid one after the other; words never cross texts."""
    if not len(body):
        none = np.zeros(0, np.int64)
        return none, none, none
    white = (body == 32) | ((body >= 9) & (body <= 13))
    size = np.diff(at)
    edge = np.empty(len(body), bool)
    edge[0] = True
    edge[1:] = white[:-1]
    edge[at[:-1][size > 0]] = True
    first = np.flatnonzero(edge & ~white)
    edge[-1] = True
    edge[:-1] = white[1:]
    edge[at[1:][size > 0] - 1] = True
    end = np.flatnonzero(edge & ~white) + 1
    return first, end, np.searchsorted(at, first, "right") - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalised 64-bit mix of an array of 64-bit numbers, as a new array."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Bytes whose hashes are computed at a time: each takes some 50 bytes of temporary arrays.
AT_ONCE = 1 << 19


def hash_runs(body: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes, the mixed sum of its mixed (byte, place) pairs; runs of AT_ONCE bytes together at a time, or one longer run."""
    out = np.zeros(len(first), np.uint64)
    upto = np.cumsum(end - first)
    low = 0
    while low < len(first):
        high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + AT_ONCE, "right")))
        out[low:high] = _hashed(body, first[low:high], end[low:high])
        low = high
    return out


def _hashed(body: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    length = end - first
    ends = np.cumsum(length)
    place = np.arange(int(ends[-1])) - np.repeat(ends - length, length)
    x = mixed(body[np.repeat(first, length) + place].astype(np.uint64) + (place.astype(np.uint64) << np.uint64(8)) + np.uint64(1))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
    return mixed(total[ends] - total[ends - length] + length.astype(np.uint64))


_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def pair_keys(body: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first 16 bytes of each run as two numbers; the body has 16 bytes more than the runs.  Runs of up to 16 bytes without a zero have keys of their own."""
    last = len(body) - 8
    words = np.ndarray(last + 1, "<u8", body, 0, (1,))  # the eight bytes from any place on
    return words[first] & _KEEP[np.minimum(size, 8)], words[np.minimum(first + 8, last)] & _KEEP[np.clip(size - 8, 0, 8)]


def pair_slots(one: np.ndarray, two: np.ndarray, bits: int) -> np.ndarray:
    """A number of so many bits from each pair."""
    h = one * np.uint64(0x9E3779B97F4A7C15)
    h += two * np.uint64(0xD1342543DE82EF95)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h >>= np.uint64(64 - bits)
    return h.view(np.int64)


@contextlib.contextmanager
def uncollected() -> Iterator[None]:
    """No search for cycles while many small lists without any are made: it would look through the dictionary over and over."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


class Remembered(dict):
    """What a task has worked out for words, in two generations: when the younger one is full it becomes the older, and what is asked for again comes back, so frequent words stay
    and rare ones go.  It holds at most twice ``most`` entries, and one batch's."""

    def __init__(self, most: int) -> None:
        super().__init__()
        self.most, self.old = most, {}

    def missing(self, words: set) -> set:
        """The words that neither generation has; all others are in the younger one from here on."""
        # word by word: set methods would walk through the whole dictionary, as it is no plain one
        new = {w for w in words if w not in self}
        if len(self) + len(new) > self.most and len(self):
            self.old = dict(self)
            self.clear()
            new = words
        old = self.old
        kept = {w: old[w] for w in new if w in old}
        self.update(kept)
        return new.difference(kept)

    def forget(self) -> None:
        self.clear()
        self.old = {}
