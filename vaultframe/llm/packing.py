"""Packing by shortest-pack-first over the length histogram.

Documents become token ids, each document's end marked, and are cut into pieces of at most
``capacity`` ids. Only the histogram of piece lengths, at most ``capacity`` rows, comes to the
driver. There lengths are placed longest first: each goes to the open packs with the most room
left (the shortest packs), all equal packs at once, so the state is a count for each packing
pattern and never a document. Patterns then meet the pieces by rank: the r-th piece of a length
takes the r-th place for that length in the patterns.

The rank is dealt out by (length, salt), so that a length that many pieces share is split.

Cases: a null or empty text has the end id alone. Repeated rows are packed each on its own. An
empty table gives an empty result. Other columns are dropped; the key's name must differ from
those of the results.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vaultframe.llm.common import map_batches, materialise, utf8_buffers
from vaultframe.llm.tokenizers_cached import crc32_of, encoder

#: Each length's pieces are ranked in so many parts.
SALTS = 256


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a pack, number of such packs); all packs together hold the histogram."""
    open_packs: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    done: list[tuple[tuple[int, ...], int]] = []

    def keep(pack: tuple[int, ...], room: int, n: int) -> None:
        (open_packs[room] if room else done).append((pack, n))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        if not 0 < length <= capacity:
            raise ValueError(f"length {length}")
        while left:
            room = max((r for r, packs in open_packs.items() if packs), default=0)
            if room >= length:  # the shortest packs have the most room
                pack, n = open_packs[room].pop()
                if n > left:
                    open_packs[room].append((pack, n - left))
                    n = left
                left -= n
                keep((*pack, length), room - length, n)
                continue
            per = capacity // length  # new packs, each with as many of this length as go in
            whole, rest = divmod(left, per)
            if whole:
                keep((length,) * per, capacity - per * length, whole)
            if rest:
                keep((length,) * rest, capacity - rest * length, 1)
            left = 0
    return done + [p for packs in open_packs.values() for p in packs]


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """length -> rows (first rank, first sequence, offset), by first rank; ranks and sequences run on."""
    rows: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    rank: dict[int, int] = defaultdict(int)
    sequence = 0
    for pack, n in patterns:
        offset = 0
        for length in pack:
            rows[length].append((rank[length], sequence, offset))
            rank[length] += n
            offset += length
        sequence += n
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def pieces(docs: DataFrame, key: str, text: str, tokenizer: str, end_id: int, capacity: int, keeps_space: bool = True) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens): each document's pieces in order."""
    kind = docs.schema[key].dataType.simpleString()

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, bounds = encoder(tokenizer, keeps_space, "<u4").encode(*utf8_buffers(b.column(1)))
        raw = memoryview(np.insert(ids, bounds[1:], end_id)).cast("B")
        tokens = np.diff(bounds) + 1
        n = -(-tokens // capacity)
        at = np.repeat(np.arange(len(n)), n)
        start = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * capacity
        length = np.minimum(tokens[at] - start, capacity)
        first = (np.cumsum(tokens) - tokens)[at] + start
        crc = [crc32_of(raw[4 * a : 4 * b]) for a, b in zip(first.tolist(), (first + length).tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), *(pa.array(x, pa.int64()) for x in (start, length, crc, tokens[at]))], [key, "start", "length", "ids_crc32", "doc_tokens"])

    return map_batches(docs, [key, text], batch, f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long", keeps=True)


def assign(cut: DataFrame, key: str, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to pieces(key, start, length, ...), which must be stored already."""
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    table = places(plan(histogram, capacity))
    shared = cut.sparkSession.sparkContext.broadcast(table)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64(key, "start", "ids_crc32"), F.lit(SALTS)))
    parts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    base = parts.select("length", "salt", (F.sum("n").over(W.partitionBy("length").orderBy("salt")) - F.col("n")).alias("base"))
    ranked = salted.join(base, ["length", "salt"]).withColumn("rank", F.col("base") + F.row_number().over(W.partitionBy("length", "salt").orderBy(key, "start")) - 1)

    names = cut.columns

    def place(b: pa.RecordBatch) -> pa.RecordBatch:
        length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
        sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
        for n in np.unique(length):
            own = np.flatnonzero(length == n)
            rows = shared.value[int(n)]
            k = np.searchsorted(rows[:, 0], rank[own], "right") - 1
            sequence[own] = rows[k, 1] + rank[own] - rows[k, 0]
            offset[own] = rows[k, 2]
        kept = [b.column(c) for c in names]
        return pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields) + ", sequence_id long, offset long"
    return map_batches(ranked, [*names, "rank"], place, schema)


def pack_documents(docs: DataFrame, key: str, text: str, tokenizer: str, end_id: int = 0, capacity: int = 1024) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return assign(materialise(pieces(docs, key, text, tokenizer, end_id, capacity), "pieces"), key, capacity)
