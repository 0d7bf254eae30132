"""Nearest neighbours by Euclidean distance: a block matrix join over int8 product tiles.

Queries come in blocks, vectors in shards, and shards in lanes; a (block, lane) cell gets the
block's queries once and then the lane's shards one after another. In a tile every vector v is
read as s * q, with q in -127..127 and s its own scale; the length of v - s * q is known exactly.
The product of two tiles of q is a matrix of exact integers, from which the distances between the
rounded vectors follow. By the triangle inequality a true distance differs from such a one by the
lengths of the two remainders at most. A pair whose lower bound is above the query's k-th upper
bound, or above its k-th distance so far, is out. Those that survive are recomputed in double
precision on the original vectors and merged into the query's heap of k.

So nothing is lost to rounding: the search is exact whatever the data, and rounding decides only
how many pairs are recomputed. Copies of one vector, or vectors closer to each other than their
remainders, can't be told apart by tiles; all of those in a tile are recomputed there, which costs
what a plain matrix join costs, and no pair but the k best of a cell ever leaves its task.

Cases: null ids, null vectors, vectors of zeros only (empty ones too) and vectors with null or
non-finite components take no part, neither as query nor candidate. Vectors may be of any length;
a component that one of two vectors lacks counts as zero. A query's own id is no candidate; other
rows with equal vectors are. Rows that share an id are one candidate, and one query, with the
least distance of any of them. Distances beyond the range of double are infinite, and equal.
Fewer candidates than k give fewer rows. An empty table gives an empty result. Other columns are
not carried.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from vaultframe.llm.common import discard, materialise, tune, wide

#: Components in a shard and in a block of queries; a worker holds one of each at a time.
SHARD_COMPONENTS = 1 << 19
BLOCK_COMPONENTS = 1 << 21
#: Shards that a block goes through in one task, carrying its thresholds, once tasks are plenty.
LANE_SHARDS = 8
#: Entries of a tile's matrix, and components of pairs recomputed at once.
TILE_ENTRIES = 1 << 20
PAIR_COMPONENTS = 1 << 20
#: Dimensions whose int8 products add up exactly in single precision: 127 * 127 * 1024 < 2^24.
EXACT_DIMS = 1024


def finite(vector: str) -> Column:
    """Whether a vector is there and all its components are finite."""
    x = F.col(vector)
    return F.coalesce(x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))), F.lit(False))


def usable(embeddings: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the vectors that take part; float or double as they came."""
    kind = embeddings.schema[vector].dataType.elementType
    kept = kind if isinstance(kind, FloatType) else DoubleType()
    wanted = F.col(key).isNotNull() & finite(vector) & F.coalesce(F.exists(vector, lambda c: c != 0), F.lit(False))
    return embeddings.where(wanted).select(F.col(key).cast("long").alias("id"), F.col(vector).cast(ArrayType(kept)).alias("v"))


def padded(flat: np.ndarray, sizes: np.ndarray, dims: int) -> np.ndarray:
    """Rows of one length, zeros behind."""
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), flat.dtype)
    out[np.arange(dims)[None, :] < sizes[:, None]] = flat
    return out


class Rounded:
    """Vectors as scale * int8, with the lengths of what is left over."""

    def __init__(self, vectors: np.ndarray):
        v = vectors.astype(np.float64)
        most = np.abs(v).max(axis=1, initial=0)
        scale = most / 127
        with np.errstate(all="ignore"):
            self.q = np.where(scale[:, None] > 0, np.rint(v / scale[:, None]), 0).clip(-127, 127).astype(np.int8)
            left = v - self.q * scale[:, None]
            #: The remainder's length, a little above what rounding of this very sum could hide.
            self.rest = np.sqrt((left**2).sum(axis=1)) * (1 + 1e-9) + 1e-13 * most * v.shape[1]
            self.scale = scale
            self.square = scale**2 * (self.q.astype(np.int64) ** 2).sum(axis=1)

    def bounds(self, other: Rounded, own: slice) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) bounds of the distances of rows ``own`` to all rows of ``other``."""
        dots = np.zeros((own.stop - own.start, len(other.q)))
        for d in range(0, self.q.shape[1], EXACT_DIMS):
            dots += self.q[own, d : d + EXACT_DIMS].astype(np.float32) @ other.q[:, d : d + EXACT_DIMS].astype(np.float32).T
        with np.errstate(all="ignore"):
            both = self.square[own, None] + other.square[None, :]
            square = both - 2 * (self.scale[own, None] * other.scale[None, :]) * dots
            error = 1e-14 * both
            rest = self.rest[own, None] + other.rest[None, :]
            lower = (np.sqrt((square - error).clip(0)) - rest) * (1 - 1e-12)
            upper = (np.sqrt((square + error).clip(0)) + rest) * (1 + 1e-12)
        return lower, upper


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, in double precision, components added up one by one in order."""
    out = np.empty(len(a))
    step = max(1, PAIR_COMPONENTS // max(1, a.shape[1]))
    with np.errstate(over="ignore"):
        for i in range(0, len(a), step):
            d = a[i : i + step].astype(np.float64) - b[i : i + step].astype(np.float64)
            out[i : i + step] = np.sqrt(np.cumsum(d * d, axis=1)[:, -1])
    return out


class Asking:
    """A block of queries with the heaps of their nearest so far."""

    def __init__(self, ids: np.ndarray, flat: np.ndarray, sizes: np.ndarray, k: int):
        self.ids, self.flat, self.sizes, self.k = ids, flat, sizes, k
        self.best: list[list[tuple[float, int]]] = [[] for _ in ids]
        self.worst = np.full(len(ids), np.inf)
        #: Pairs, and those that were recomputed.
        self.pairs = self.again = 0

    def meet(self, ids: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> None:
        dims = int(max(sizes.max(initial=1), self.sizes.max(initial=1)))
        asked, vectors = padded(self.flat, self.sizes, dims), padded(flat, sizes, dims)
        left, right = Rounded(asked), Rounded(vectors)
        first = np.zeros(len(ids), bool)
        first[np.unique(ids, return_index=True)[1]] = True  # thresholds count each id once
        step = max(1, TILE_ENTRIES // len(ids))
        for start in range(0, len(self.ids), step):
            own = slice(start, min(start + step, len(self.ids)))
            lower, upper = left.bounds(right, own)
            same = self.ids[own, None] == ids[None, :]
            limit = self.worst[own].copy()
            if first.sum() > self.k:
                counted = np.where(same | ~first[None, :] | np.isnan(upper), np.inf, upper)
                np.minimum(limit, np.partition(counted, self.k - 1, axis=1)[:, self.k - 1], out=limit)
            asking, found = np.nonzero(~(lower > limit[:, None]) & ~same)
            self.pairs += same.size
            self.again += len(asking)
            self._merge(asking + start, ids, found, asked, vectors)

    def _merge(self, asking: np.ndarray, ids: np.ndarray, found: np.ndarray, asked: np.ndarray, vectors: np.ndarray) -> None:
        step = max(1, PAIR_COMPONENTS // vectors.shape[1])
        for i in range(0, len(asking), step):
            q, c = asking[i : i + step], found[i : i + step]
            d = distances(asked[q], vectors[c])
            fits = ~(d > self.worst[q])
            q, c, d = q[fits], c[fits], d[fits]
            order = np.lexsort((ids[c], d, q))
            q, c, d = q[order], ids[c[order]], d[order]
            cuts = np.flatnonzero(np.diff(q)) + 1
            for s, e in zip([0, *cut_list(cuts)], [*cut_list(cuts), len(q)], strict=True):
                if s == e:
                    continue
                n, mine, seen = int(q[s]), [], set()
                for pair in heapq.merge(self.best[n], zip(d[s:e].tolist(), c[s:e].tolist(), strict=True)):
                    if pair[1] not in seen:  # an id's least distance comes first
                        seen.add(pair[1])
                        mine.append(pair)
                        if len(mine) == self.k:
                            break
                self.best[n] = mine
                if len(mine) == self.k:
                    self.worst[n] = mine[-1][0]

    def results(self) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(self.ids), 8192):
            out = [(int(q), c, d) for q, pairs in zip(self.ids[i : i + 8192], self.best[i : i + 8192], strict=True) for d, c in pairs]
            if out:
                q, c, d = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.float64())], ["query_id", "id", "score"])


def cut_list(cuts: np.ndarray) -> list[int]:
    return [int(x) for x in cuts]


def nearest(embeddings: DataFrame, key: str, vector: str, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, id, score): each query's k nearest candidates, nearest first, ties to smaller ids."""
    spark = embeddings.sparkSession
    tune(spark)
    rows = materialise(usable(embeddings, key, vector), "neighbour-vectors")
    asked = materialise(usable(queries, key, vector), "neighbour-queries")
    size = lambda df: df.agg(F.sum(F.size("v").cast("long"))).first()[0] or 0
    shards, blocks = max(1, -(-size(rows) // SHARD_COMPONENTS)), max(1, -(-size(asked) // BLOCK_COMPONENTS))
    lanes = max(-(-shards // LANE_SHARDS), -(-wide(spark) // blocks))
    shards = max(shards, lanes)
    cell = lambda df, n, name: df.withColumn(name, F.pmod(F.xxhash64("id", F.lit(name)), F.lit(n)).cast("int"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = cell(asked, blocks, "block").withColumn("lane", each(lanes)).withColumn("shard", F.lit(-1))
    right = cell(rows, shards, "shard").withColumn("lane", F.pmod("shard", F.lit(lanes))).withColumn("block", each(blocks))
    columns = ["block", "lane", "shard", "id", "v"]
    dealt = left.select(columns).unionByName(right.select(columns)).repartition(wide(spark, min(lanes * blocks, 20_000)), "block", "lane").sortWithinPartitions("block", "lane", "shard")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        asking: list[Asking] = []
        now = None

        def close() -> None:
            ids, flat, sizes = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            if now[2] < 0:
                asking.append(Asking(ids, flat, sizes, k))
            elif asking:
                asking[0].meet(ids, flat, sizes)

        for b in batches:
            if not b.num_rows:
                continue
            block, lane, shard, ids = (b.column(i).to_numpy() for i in range(4))
            sizes, flat = b.column(4).value_lengths().to_numpy(), b.column(4).flatten().to_numpy()
            at = np.concatenate([[0], np.cumsum(sizes)])
            cuts = cut_list(np.flatnonzero((np.diff(block) != 0) | (np.diff(lane) != 0) | (np.diff(shard) != 0)) + 1)
            for s, e in zip([0, *cuts], [*cuts, len(ids)], strict=True):
                here = (block[s], lane[s], shard[s])
                if now is not None and now != here:
                    close()
                    if now[:2] != here[:2] and asking:
                        yield from asking.pop().results()
                now = here
                held.append((ids[s:e], flat[at[s] : at[e]], sizes[s:e]))
        if now is not None:
            close()
        if asking:
            yield from asking.pop().results()

    # rows that share an id may have been asked apart; the least distance of each pair counts
    local = dealt.mapInArrow(scan, "query_id long, id long, score double").groupBy("query_id", "id").agg(F.min("score").alias("score"))
    order = W.partitionBy("query_id").orderBy("score", "id")
    out = local.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
    found = materialise(out, "neighbours")
    for part in (rows, asked):
        discard(part)
    return found
