"""Exact top-k by inner product over an impact-ordered index, score at a time.

Vectors become integers, floor(scale * x). The index is cut into shards by the hash of the id,
each of a bounded number of components. A shard holds posting segments: for each dimension and
impact level (the octave of a component's absolute value below the shard's largest) the rows and
components of that level. Zeros have no posting. For each row it also holds the length of what
lies at or below each level.

A query walks the segments in descending order of quantised impact, which is the level's bound
times the query's weight, in octaves. Of the dimensions whose levels are done down to p, what is
left of a row's score is at most (length of the query there) x (length of the row from p on), by
Cauchy and Schwarz; these bounds add up over the groups of dimensions. A row whose upper bound is
below the k-th best lower bound, or below the k-th best score of the shards before, cannot be a
member. Once few possible members are left, or all segments are done, the scan stops and the
possible members are scored again exactly in integers. So a result never depends on the
quantisation, and ties are broken exactly by the smaller id.

Queries come in blocks, shards in lanes: a block meets a lane once, and carries its thresholds
from shard to shard. Queries are replicated once a lane, vectors once a block.

Cases: null ids, null vectors and vectors with null or non-finite components take no part,
neither as query nor candidate. Vectors may be of any length; a component that one of two vectors
lacks counts as zero, so an empty vector scores zero with all. Components and scores beyond 64
bits are held at the bounds of a 64-bit integer. A query's own id is no candidate; other rows
with equal vectors are. Rows that share an id are one candidate, and one query, with the best
score of any of them. Fewer candidates than k give fewer rows. An empty table gives an empty
result. Other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vaultframe.llm.common import discard, materialise, tune, wide

#: Components in a shard; a worker holds one shard and one block of queries at a time.
SHARD_COMPONENTS = 1 << 19
BLOCK_COMPONENTS = 1 << 16
LEVELS = 8
#: Shards that a block goes through in one task, carrying its thresholds, once tasks are plenty.
LANE_SHARDS = 8
#: The scan of a query stops when a shard has so few possible members left.
FEW = 64
#: Scores beyond are held here.
MOST = 2**63 - 1


def quantised(embeddings: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(id, v): integer components; unusable vectors are left out."""
    usable = F.col(key).isNotNull() & F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))
    return embeddings.where(F.coalesce(usable, F.lit(False))).select(F.col(key).cast("long").alias("id"), F.transform(vector, whole).alias("v"))


class ImpactShard:
    """Posting segments of one shard, by dimension and impact level. Vector i is flat[at[i] : at[i + 1]]."""

    def __init__(self, ids: np.ndarray, flat: np.ndarray, at: np.ndarray, levels: int = LEVELS):
        self.ids, self.flat, self.at, self.levels = ids, flat, at, levels
        sizes = np.diff(at)
        row = np.repeat(np.arange(len(ids)), sizes)
        dim = np.arange(len(flat)) - np.repeat(at[:-1], sizes)
        value = flat.astype(np.float64)
        size = np.abs(value)
        self.top = size.max(initial=1.0)
        there = np.flatnonzero(size)
        row, dim, value, size = row[there], dim[there], value[there], size[there]
        level = np.minimum(np.floor(np.log2(self.top / size)).astype(np.int64), levels - 1).clip(0)
        #: rest[p][i]: length of row i's components at level p or below; bounds hold for any division into levels.
        squares = np.zeros((levels + 1, len(ids)))
        for p in range(levels):
            own = level == p
            squares[p] = np.bincount(row[own], size[own] ** 2, len(ids))
        self.rest = np.sqrt(np.cumsum(squares[::-1], axis=0)[::-1])
        self.dims = int(dim.max(initial=-1)) + 1
        order = np.argsort(dim * levels + level, kind="stable")
        self.rows, self.values = row[order], value[order]
        self.cuts = np.searchsorted((dim * levels + level)[order], np.arange(self.dims * levels + 1))
        #: Repeated ids: thresholds count each id once.
        _, first = np.unique(ids, return_index=True)
        self.again = np.ones(len(ids), bool)
        self.again[first] = False
        #: Postings read, and those that a full scan would read.
        self.read = self.full = 0

    def _exact(self, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        most = float(np.abs(query.astype(np.float64)).max(initial=0)) * self.top * max(1, len(query))
        vectors = [self.flat[self.at[i] : self.at[i + 1]][: len(query)] for i in rows]
        if most < 2**62:
            if vectors and all(len(v) == len(query) for v in vectors):
                return np.stack(vectors) @ query
            return np.array([int(v @ query[: len(v)]) for v in vectors], np.int64)
        sums = (sum(int(a) * int(b) for a, b in zip(v, query, strict=False)) for v in vectors)
        return np.array([min(max(s, -MOST), MOST) for s in sums], np.int64)

    def search(self, query_id: int, query: np.ndarray, k: int, floor: int | None = None, few: int = FEW) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the query's k best here, but none below ``floor``; best first, ties to smaller ids."""
        weight = np.zeros(self.dims)
        n = min(self.dims, len(query))
        weight[:n] = query[:n]
        length = np.abs(weight)
        own = self.ids == query_id
        so_far = np.zeros(len(self.ids))
        error = 1e-9 * float(np.sqrt((length**2).sum())) * self.rest[0]  # far above what rounding can do
        heavy = np.flatnonzero(length)
        octave = np.floor(np.log2(length[heavy].max(initial=1) / length[heavy])).astype(np.int64)
        octave = np.minimum(octave, self.levels)
        done = np.zeros(len(heavy), np.int64)  # levels done in each dimension
        possible = ~own
        self.full += int(sum(self.cuts[(d + 1) * self.levels] - self.cuts[d * self.levels] for d in heavy))
        for impact in range(self.levels + int(octave.max(initial=0))):
            turn = np.flatnonzero((impact - octave >= 0) & (impact - octave < self.levels))
            for t in turn[np.argsort(-length[heavy[turn]], kind="stable")]:
                d = heavy[t]
                s, e = self.cuts[d * self.levels + impact - octave[t]], self.cuts[d * self.levels + impact - octave[t] + 1]
                so_far[self.rows[s:e]] += weight[d] * self.values[s:e]  # a row is there once in a segment
                self.read += int(e - s)
                done[t] = impact - octave[t] + 1
            slack = error.copy()
            for p in np.unique(done):
                slack += np.sqrt((length[heavy[done == p]] ** 2).sum()) * self.rest[p]
            low = np.where(own | self.again, -np.inf, so_far - slack)
            threshold = np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else -np.inf
            if floor is not None:
                threshold = max(threshold, float(floor) * (1 - np.sign(floor) * 1e-12))
            held = float(MOST) * (1 - 1e-12)  # scores beyond are equal, so none of them rules out another
            threshold = -np.inf if threshold < -held else min(threshold, held)
            possible = ~own & (so_far + slack >= threshold)
            if possible.sum() <= few:
                break
        rows = np.flatnonzero(possible)
        score = self._exact(query, rows)
        order = np.lexsort((self.ids[rows], -score))
        ids, score = self.ids[rows[order]], score[order]
        _, first = np.unique(ids, return_index=True)
        first = np.sort(first)[:k]  # an id's best row comes first
        ids, score = ids[first], score[first]
        if floor is not None:
            ids, score = ids[score >= floor], score[score >= floor]
        return ids, score


def top_k(embeddings: DataFrame, key: str, vector: str, queries: DataFrame, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, id, score): each query's k candidates of the highest scores, ties to smaller ids."""
    spark = embeddings.sparkSession
    tune(spark)
    rows = materialise(quantised(embeddings, key, vector, scale), "vectors")
    asked = materialise(quantised(queries, key, vector, scale).dropDuplicates(), "queries")
    size = lambda df: df.agg(F.sum(F.greatest(F.size("v"), F.lit(1)))).first()[0] or 0
    shards, blocks = max(1, -(-size(rows) // SHARD_COMPONENTS)), max(1, -(-size(asked) // BLOCK_COMPONENTS))
    lanes = min(shards, max(-(-shards // LANE_SHARDS), -(-wide(spark) // blocks)))
    cell = lambda df, n, name: df.withColumn(name, F.pmod(F.xxhash64("id", F.lit(name)), F.lit(n)).cast("int"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # every (block, lane) cell gets the block's queries, then the lane's shards one after another
    left = cell(asked, blocks, "block").withColumn("lane", each(lanes)).withColumn("shard", F.lit(-1))
    right = cell(rows, shards, "shard").withColumn("lane", F.pmod("shard", F.lit(lanes))).withColumn("block", each(blocks))
    columns = ["block", "lane", "shard", "id", "v"]
    dealt = left.select(columns).unionByName(right.select(columns)).repartition(wide(spark, min(lanes * blocks, 20_000)), "block", "lane").sortWithinPartitions("block", "lane", "shard")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        asking: list[tuple[int, np.ndarray]] = []
        best: list[list[tuple[int, int]]] = []

        def close(shard: int) -> None:
            ids, flat, sizes = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            at = np.concatenate([[0], np.cumsum(sizes)])
            if shard < 0:
                asking[:] = [(int(i), flat[s:e]) for i, s, e in zip(ids, at[:-1], at[1:], strict=True)]
                best[:] = [[] for _ in asking]
            elif asking:
                index = ImpactShard(ids, flat, at)
                for n, (i, q) in enumerate(asking):
                    found, score = index.search(i, q, k, -best[n][-1][0] if len(best[n]) == k else None)
                    best[n] = sorted([*best[n], *((-int(s), int(c)) for c, s in zip(found, score, strict=True))])[:k]

        def give() -> Iterator[pa.RecordBatch]:
            out = [(i, c, -s) for (i, _), pairs in zip(asking, best, strict=True) for s, c in pairs]
            asking.clear()
            best.clear()
            for i in range(0, len(out), 65536):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out[i : i + 65536], strict=True)], ["query_id", "id", "score"])

        now = None
        for b in batches:
            if not b.num_rows:
                continue
            block, lane, shard, ids = (b.column(i).to_numpy() for i in range(4))
            sizes, flat = b.column(4).value_lengths().to_numpy(), b.column(4).flatten().to_numpy()
            at = np.concatenate([[0], np.cumsum(sizes)])
            cut = np.flatnonzero((np.diff(block) != 0) | (np.diff(lane) != 0) | (np.diff(shard) != 0)) + 1
            for s, e in zip([0, *cut], [*cut, len(ids)], strict=True):
                here = (block[s], lane[s], shard[s])
                if now is not None and now != here:
                    close(now[2])
                    if now[:2] != here[:2]:
                        yield from give()
                now = here
                held.append((ids[s:e], flat[at[s] : at[e]], sizes[s:e]))
        if now is not None:
            close(now[2])
            yield from give()

    local = dealt.mapInArrow(scan, "query_id long, id long, score long").groupBy("query_id", "id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    out = local.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
    found = materialise(out, "top-k")
    for part in (rows, asked):
        discard(part)
    return found
