"""Token ids in Arrow files of fixed-size-list batches, for zero-copy random access.

A store is a folder of Arrow IPC files (shards) and an index. A shard holds equal-length
sequences: ``ids`` (fixed-size list of unsigned 16- or 32-bit ids, the narrower if the
vocabulary fits) and ``mask`` (fixed-size list of bits, unset in the last sequence's padding).
All buffers of a shard are plain, so a reader maps the file and slices ids in place.

Documents are dealt out by ranges of the key and written in ascending key order, each followed
by the end id; shard k holds smaller keys than shard k + 1. A shard's file name carries an
attempt's own mark and the index names only files of finished attempts, so a lost executor
leaves at most an orphan. The index (key, shard, file, local start, tokens) is written once.

Cases: null or empty text: the end id alone. Null keys come first; rows with equal keys are
ordered by text. Other columns are not stored. An empty table gives an empty index.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vaultframe.llm.common import scratch, tune, utf8_buffers, wide
from vaultframe.llm.tokenizers_cached import crc32_of, encoder

SEQUENCE = 2048
#: Sequences of one record batch in a shard: 2 MB of 16-bit ids.
BATCH_SEQUENCES = 512


class ShardWriter:
    """Writes ids as they come into one shard of equal-length sequences."""

    def __init__(self, uri: str, dtype: str, sequence: int):
        from pyarrow import fs

        self.fs, path = fs.FileSystem.from_uri(uri)
        self.dtype, self.sequence = np.dtype(dtype), sequence
        ids = pa.uint16() if self.dtype.itemsize == 2 else pa.uint32()
        self.schema = pa.schema([("ids", pa.list_(ids, sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
        self.value = ids
        self.sink = self.fs.open_output_stream(path)
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.waiting = bytearray()

    def add(self, ids: bytes) -> None:
        self.waiting += ids
        if len(self.waiting) >= BATCH_SEQUENCES * self.sequence * self.dtype.itemsize:
            self._flush()

    def _flush(self) -> None:
        """Batches of one size; what is left waits for more or for close()."""
        step = BATCH_SEQUENCES * self.sequence * self.dtype.itemsize
        while len(self.waiting) >= step:
            self._write(bytes(self.waiting[:step]), BATCH_SEQUENCES * self.sequence)
            del self.waiting[:step]

    def _write(self, raw: bytes, real: int) -> None:
        n = len(raw) // self.dtype.itemsize
        mask = np.ones(n, bool)
        mask[real:] = False
        arrays = [pa.FixedSizeListArray.from_arrays(pa.array(np.frombuffer(raw, self.dtype), self.value), self.sequence), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.sequence)]
        self.writer.write_batch(pa.record_batch(arrays, schema=self.schema))

    def close(self) -> None:
        if self.waiting:
            real = len(self.waiting) // self.dtype.itemsize
            self.waiting += bytes(-len(self.waiting) % (self.sequence * self.dtype.itemsize))
            self._write(bytes(self.waiting), real)
            self.waiting = bytearray()
        self.writer.close()
        self.sink.close()


class ShardReader:
    """Random access to one shard: ids(start, n) touches only the batches that hold them."""

    def __init__(self, uri: str):
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(uri)
        source = pa.memory_map(path) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(path)
        self.file = pa.ipc.open_file(source)
        kind = self.file.schema.field("ids").type
        self.sequence = kind.list_size
        self.per_batch = BATCH_SEQUENCES * self.sequence

    def _batch(self, k: int) -> np.ndarray:
        return self.file.get_batch(k).column(0).flatten().to_numpy()

    def ids(self, start: int, n: int) -> np.ndarray:
        parts = []
        while n:
            k, at = divmod(start, self.per_batch)
            part = self._batch(k)[at : at + n]
            if not len(part):
                raise EOFError(f"no ids at {start}")
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return np.concatenate(parts) if len(parts) != 1 else parts[0]

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, mask) of sequence i."""
        batch = self.file.get_batch(i // BATCH_SEQUENCES)
        i %= BATCH_SEQUENCES
        return batch.column(0)[i].values.to_numpy(), batch.column(1)[i].values.to_numpy(zero_copy_only=False)


def write_store(docs: DataFrame, key: str, text: str, tokenizer: str, end_id: int, keeps_space: bool = False, dtype: str = "<u2", sequence: int = SEQUENCE, root: str | None = None) -> str:
    """Writes the store and returns its folder."""
    spark = docs.sparkSession
    tune(spark)
    root = root or scratch(spark, "tokens")
    _make_folder(spark, root)
    kind = docs.schema[key].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.arrow"
        encode = encoder(tokenizer, keeps_space, dtype).encode
        out, at = None, 0
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            out = out or ShardWriter(f"{root}/{name}", dtype, sequence)
            ids, bounds = encode(*utf8_buffers(b.column(1)))
            out.add(np.insert(ids, bounds[1:], end_id).tobytes())
            counts = np.diff(bounds) + 1
            starts = at + np.cumsum(counts) - counts
            at += int(counts.sum())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shard] * n, pa.int32()), pa.array([name] * n), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], [key, "shard", "file", "local_start", "n_tokens"])
        if out:
            out.close()

    ordered = docs.select(key, text).repartitionByRange(wide(spark), key).sortWithinPartitions(key, text)
    index = ordered.mapInArrow(write, f"`{key}` {kind}, shard int, file string, local_start long, n_tokens long")
    index.write.option("compression", "zstd").parquet(f"{root}/index")
    return root


def _make_folder(spark: SparkSession, root: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)


def shard_bases(spark: SparkSession, root: str) -> DataFrame:
    """(shard, base): ids in all shards before. One row per shard is summed up, never documents."""
    totals = spark.read.parquet(f"{root}/index").groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))


def read_index(spark: SparkSession, root: str) -> DataFrame:
    """The index with start: ids of all documents before it."""
    index = spark.read.parquet(f"{root}/index")
    return index.join(shard_bases(spark, root), "shard").withColumn("start", F.col("base") + F.col("local_start")).drop("base")


def read_digest(spark: SparkSession, root: str, key: str) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) per document, the checksum from the files."""
    index = spark.read.parquet(f"{root}/index")
    kind = index.schema[key].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, shard = None, None
        for b in batches:
            crcs = []
            for file, start, n in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                if file != name:
                    name, shard = file, ShardReader(f"{root}/{file}")
                crcs.append(crc32_of(shard.ids(start, n).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), b.column(4), pa.array(crcs, pa.int64())], [key, "shard", "local_start", "n_tokens", "ids_crc32"])

    # no shuffle here: the index lies in the files' own order, so a task opens each shard once
    digest = index.select(key, "shard", "file", "local_start", "n_tokens").mapInArrow(read, f"`{key}` {kind}, shard int, local_start long, n_tokens long, ids_crc32 long")
    return digest.join(shard_bases(spark, root), "shard").select(key, (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
