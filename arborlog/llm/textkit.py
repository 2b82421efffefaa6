"""Vectorised text kernels over Arrow batches, and helpers for tables in the shared folder.

Texts of a batch are read as one byte buffer, in chunks of about ``CHUNK`` bytes (one text never
crosses two chunks; a longer text is a chunk of its own).  Word, shingle and line features come out
of whole-buffer numpy passes, so cost per byte is flat and memory is a small multiple of the chunk.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNK = 1 << 20
#: Word separators: the bytes 0x20 and 0x09-0x0D.  All are ASCII, so they never cut a UTF-8 code point.
SEPARATORS = (9, 10, 11, 12, 13, 32)
_P = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1

IS_WORD = np.ones(256, dtype=bool)
IS_WORD[list(SEPARATORS)] = False
#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: One random 64-bit value for each byte.
BYTE_VALUE = np.random.default_rng(20240607).integers(1, _MASK, 256, dtype=np.uint64, endpoint=True)

_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i modulo 2^64 for i below n at least."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        out = []
        for base in (_P, pow(_P, -1, 1 << 64)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[:] = out
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, a bijection."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def text_buffer(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the n+1 offsets; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = texts.cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def chunks(buf: np.ndarray, off: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last) document, bytes and offsets of each chunk of whole texts."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + size, side="right")) - 1)
        b = min(b, n)
        yield a, b, buf[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def word_spans(buf: np.ndarray, off: np.ndarray, is_word: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the n+1 offsets of each document's words."""
    n = len(buf)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(off), np.int64)
    inside = is_word[buf]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    cut = off[(off > 0) & (off < n)]
    before[cut] = False
    after[cut - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word's bytes."""
    if len(starts) == 0:
        return np.empty(0, np.uint64)
    pw, inv = powers(len(buf) + 1)
    c = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[buf] * pw[: len(buf)], out=c[1:])
    h = (c[ends] - c[starts]) * inv[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k words from each position on that has k words after it."""
    m = len(words) - k + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    h = words[:m].copy()
    for j in range(1, k):
        h *= np.uint64(_P)
        h += words[j : j + m]
    return mix(h)


def fold(words: np.ndarray) -> int:
    """A hash of a whole sequence of words."""
    h = len(words)
    for w in words.tolist():
        h = (h * _P + w) & _MASK
    return int(mix(np.array([h], np.uint64))[0])


def code_point_offsets(buf: np.ndarray) -> np.ndarray:
    """Number of code points before each byte, and in all."""
    out = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=out[1:])
    return out


def per_document(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of values by document, for offsets into values."""
    c = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=c[1:])
    return c[off[1:]] - c[off[:-1]]


#: Rows of an Arrow batch: texts of ordinary length are a few MB then, on either side of the socket.
BATCH_ROWS = 2000


#: Bytes of an Arrow batch: a batch of very long texts is closed before its rows are full.
BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df, with the session's Arrow batches limited in rows and bytes; a lower limit of the session's stays."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            conf.set(key, str(most))
    return df


def give_back() -> None:
    """Returns a worker's free memory to the system, as idle workers stay beside the busy ones."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def map_batches(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with ``f(batch) -> batches``, from batch to batch."""

    def run(it):
        for batch in it:
            if batch.num_rows:
                yield from f(batch)
        give_back()

    return small_batches(df).mapInArrow(run, schema)


#: Rows in a broadcast table that is known to be no larger; beyond it the join shuffles.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; where unset, a temporary one."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not known:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="arborlog-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


@contextlib.contextmanager
def lean(spark: SparkSession):
    """Within it, the shuffle files of an execution go when it ends, not when the driver happens to collect garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _file_system(spark: SparkSession, path: str):
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm_path


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: its lineage ends there.  ``release`` deletes it, or the session's end."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/arborlog-{uuid.uuid4().hex}"
    with lean(spark):
        df.write.parquet(path)
    fs, jvm_path = _file_system(spark, path)
    fs.deleteOnExit(jvm_path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made and that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_written", None):
            fs, jvm_path = _file_system(df.sparkSession, path)
            fs.delete(jvm_path, True)


def lighten(spark: SparkSession) -> None:
    """Lets the JVMs collect what finished steps left, so that heaps shrink again before the next step.

    The driver's collection lets go of broadcast tables that no plan uses any more; then about two tasks an
    executor collect theirs.  Nothing depends on it but memory.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    n = 2 * max(1, spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1)
    spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')").alias("done")).write.format("noop").mode("overwrite").save()


def small(df: DataFrame, rows: int, bound: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for a broadcast if its counted rows are within the bound."""
    return F.broadcast(df) if rows <= bound else df


def sample_keys(rows: DataFrame, n: int, by: str | None = None) -> DataFrame:
    """(by, __h): the n smallest distinct hashes of (doc_id, text), of each value of ``by`` if given; never more.

    Repeated rows have one hash, and a null id counts by its text, so neither adds to the sample.  Only
    hashes below a bound that leaves about twice n are put in order, so no group is one task's.
    """
    rows = rows.select(*([by] if by else []), row_hash().alias("__h"))
    keys = [by] if by else []
    count = {r[by] if by else None: r["c"] for r in rows.groupBy(*keys).agg(F.count("*").alias("c")).collect()}
    below = lambda c: min((1 << 63) - 1, int(-(1 << 63) + (1 << 64) * min(1.0, (2 * n + 100) / max(1, c))))
    if by is None:
        return rows.where(F.col("__h") <= below(count.get(None, 0))).distinct().orderBy("__h").limit(n)
    bound = F.create_map(*(x for k, c in count.items() if k is not None for x in (F.lit(k), F.lit(below(c))))) if count else None
    some = rows.where(F.col("__h") <= bound[F.col(by)]).distinct() if count else rows.distinct()
    return some.withColumn("__i", F.row_number().over(Window.partitionBy(by).orderBy("__h"))).where(F.col("__i") <= n).drop("__i")


def row_hash() -> Column:
    return F.xxhash64(F.lit(29), "doc_id", "text")


def word_count_column(text: str = "text") -> Column:
    """Number of words of a text as a Column; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def crc_remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo a small number; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % modulus
