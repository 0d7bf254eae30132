"""Shared pieces: scratch storage, Arrow helpers, bounded word caches, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts handed to Python at once; keeps a worker's memory flat whatever the length of a text.
ARROW_BATCH_BYTES = 16 << 20
#: Entries of a word cache; it is emptied beyond, which costs time but never changes a result.
CACHE_ENTRIES = 400_000
#: Words longer than this are computed anew each time, so that a cache's bytes are bounded too.
CACHE_WORD_CHARS = 64

_own_scratch: dict[str, str] = {}


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def tune(spark: SparkSession) -> None:
    """Bounds the bytes of an Arrow batch (rows alone do not bound them)."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))


def scratch_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only for a local master that names none."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_scratch:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _own_scratch[app] = "file://" + tempfile.mkdtemp(prefix="vaultframe-")
    return _own_scratch[app]


def scratch(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/vaultframe/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes df to shared storage and reads it back: the lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, label)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # lets Spark delete the shuffle files that this step is done with
    return spark.read.schema(schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files that nothing refers to any more, before a step that needs much disk."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)


def discard(df: DataFrame) -> None:
    """Deletes what ``materialise`` wrote, once nothing reads it any more."""
    files = df.inputFiles()
    if files:
        _delete(df.sparkSession, files[0].rpartition("/")[0])


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def wide(spark: SparkSession, least: int = 1) -> int:
    """Partitions for a repartition by key."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_slot: dict[object, object] = {}


def loaded(key: object, make: Callable[[], object]):
    """The one thing (a vocabulary with its cache) that this worker keeps; another one takes its place."""
    if key not in _slot:
        unload()
        _slot[key] = make()
    return _slot[key]


def unload() -> None:
    """Gives a worker's memory back: idle workers of earlier steps live on beside busy ones."""
    _slot.clear()
    trim()


def trim() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_batches(df: DataFrame, columns: list[str], fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, keeps: bool = False) -> DataFrame:
    """mapInArrow over the named columns only, one output batch for each input batch.

    keeps: fn uses what ``loaded`` keeps; else that is dropped first.
    """
    tune(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            unload()
        for b in batches:
            if b.num_rows:
                yield fn(b)
        trim()

    return df.select(*columns).mapInArrow(run, schema)


def utf8_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide_type = pa.types.is_large_string(column.type)
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], np.int64 if wide_type else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None and raw[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


#: Bytes of text that numpy takes apart at once.
PART_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_power_cache: list[tuple[np.ndarray, np.ndarray]] = []


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of an odd base modulo 2^64, and of its inverse; a table for a usual part of text is kept."""
    if _power_cache and len(_power_cache[0][0]) >= n:
        return _power_cache[0]
    out = []
    for base in (_BASE, pow(_BASE, -1, 2**64)):
        table = np.full(max(n, PART_BYTES), base, np.uint64)
        table[0] = 1
        np.multiply.accumulate(table, out=table)
        out.append(table)
    if n <= PART_BYTES:
        _power_cache[:] = [(out[0], out[1])]
    return out[0], out[1]

_PLACES = 32
_PLACE_VALUES = (np.random.default_rng(20240521).integers(1, 2**63, _PLACES * 256, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_LETTER_VALUES = _PLACE_VALUES[:256]


def mix64(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E6C63D0876A9A47)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


#: White space that separates words: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE_BYTES = np.zeros(256, bool)
SPACE_BYTES[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, first byte) of each word of a batch of texts, in order."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    letter = ~SPACE_BYTES[data]
    edge = np.empty(len(data) + 1, bool)  # a word may begin or end before this byte
    edge[0] = edge[-1] = True
    np.not_equal(letter[1:], letter[:-1], out=edge[1:-1])
    edge[offsets] = True
    starts = np.flatnonzero(edge[:-1] & letter)
    ends = np.flatnonzero(edge[1:] & letter) + 1
    pw, ip = power_tables(len(data))
    prefix = np.empty(len(data) + 1, np.uint64)
    prefix[0] = 0
    value = _LETTER_VALUES[data]
    value *= pw[: len(data)]
    np.cumsum(value, out=prefix[1:])
    h = prefix[ends]
    h -= prefix[starts]
    h *= ip[starts]
    return mix64(h), starts


#: Rows whose hashes are broadcast: 1.6 MB.
FEW_ROWS = 200_000
#: Hash buckets that mark rows: half a megabyte as bits, 16 MB at most on the driver.
MARKS = 1 << 22


def marks_of(longs: DataFrame, column: str) -> np.ndarray:
    """Bits of the hash buckets of a column of hashes; bounded by MARKS whatever the number of rows."""
    rows = longs.select(F.col(column).bitwiseAND(F.lit(MARKS - 1)).cast("int").alias("k")).distinct().toArrow()
    flags = np.zeros(MARKS, bool)
    flags[rows.column("k").to_numpy()] = True
    return np.packbits(flags)


def marked(marks: np.ndarray, longs: np.ndarray) -> np.ndarray:
    """Flags of the longs whose bucket is marked."""
    k = longs & (MARKS - 1)
    return ((marks[k >> 3] >> (7 - (k & 7)).astype(np.uint8)) & 1).astype(bool)


def row_hash(key: str, text: str) -> Column:
    """What stands for a row in joins: a hash of its id and text, null text as empty."""
    return F.xxhash64(F.lit("row"), F.col(key), F.coalesce(F.col(text), F.lit(""))).alias("__row")


def packed_texts(docs: DataFrame, row: Column, text: str, rows: DataFrame | None = None) -> DataFrame:
    """(row, packed): compressed UTF-8 texts, for joins that have to move them; null counts as empty.

    rows: those that are asked for, read from storage; others are left out before they are packed,
    by a broadcast of up to FEW_ROWS counted hashes, or most of them by marks beyond that.
    """
    source, shared = docs.select(row.alias("__row"), F.col(text).alias("__text")), None
    if rows is not None and rows.count() <= FEW_ROWS:
        source = source.join(F.broadcast(rows.select(F.col("row").alias("__row")).distinct()), "__row", "left_semi")
    elif rows is not None:
        shared = docs.sparkSession.sparkContext.broadcast(marks_of(rows, "row"))

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        from zstandard import ZstdCompressor

        if shared is not None:
            b = b.filter(pa.array(marked(shared.value, b.column(0).to_numpy(zero_copy_only=False))))
        data, offsets = utf8_buffers(b.column(1))
        pack = ZstdCompressor(level=1).compress
        view = memoryview(np.ascontiguousarray(data))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([pack(view[s:e]) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.binary())], ["row", "packed"])

    return map_batches(source, ["__row", "__text"], batch, "row long, packed binary")


def unpacked(packed: pa.Array) -> Iterator[bytes]:
    from zstandard import ZstdDecompressor

    unpack = ZstdDecompressor().decompress
    return (unpack(p) for p in packed.to_pylist())


def segment_hashes(data: np.ndarray, starts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """64-bit hash of each segment of bytes. starts: ascending, the first is 0; first: their flags."""
    segment = np.cumsum(first, dtype=np.int32)
    segment -= 1
    place = np.arange(len(data), dtype=np.int32) - starts.astype(np.int32)[segment]
    value = _PLACE_VALUES[((place & (_PLACES - 1)) << 8) | data]
    far = np.flatnonzero(place >= _PLACES)
    if len(far):
        value[far] *= mix64((place[far] // _PLACES).astype(np.uint64)) | np.uint64(1)
    return mix64(np.add.reduceat(value, starts))


def text_parts(data: np.ndarray, offsets: np.ndarray, size: int = PART_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of texts of about so many bytes: (number of the first text, bytes, offsets)."""
    lo, last = 0, len(offsets) - 1
    while lo < last:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


class WordCache(dict):
    """word -> value, computed on a miss; bounded in entries and in word length.

    When full, its content becomes the older generation, from which words still in use return.
    """

    def __init__(self, compute: Callable[[object], object], entries: int = CACHE_ENTRIES):
        super().__init__()
        self.compute, self.entries, self.older = compute, entries // 2, {}

    def __missing__(self, word):
        value = self.older.get(word)
        if value is None:
            value = self.compute(word)
        if len(word) <= CACHE_WORD_CHARS:
            if len(self) >= self.entries:
                self.older = dict(self)
                self.clear()
            self[word] = value
        return value


def connected_components(edges: DataFrame, label: str = "components", max_rounds: int = 64) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; root is the smallest node it reaches.

    Alternates large-star and small-star steps. Each step is a grouped minimum (combined
    before the shuffle) and a join on the node, so a hub is never gathered into one task;
    each round is written to shared storage. An empty edge table gives an empty result.
    """
    both = edges.where("a <> b")
    current = materialise(both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    for _ in range(max_rounds):
        # large star: every neighbour above u points to the least of u and its neighbours
        sym = current.union(current.select("b", "a"))
        least = sym.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = sym.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: every neighbour below u, and u itself, points to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        following = materialise(small, label)
        # a star forest: nobody that is pointed to points on, and one parent each
        state = following.groupBy("a").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()["most"]
        current = following
        if state <= 1:
            if not current.join(current.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1).count():
                break
    else:
        raise RuntimeError("components did not settle")
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
