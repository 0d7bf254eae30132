"""Summaries: recall statistics, vault and lifecycle counts, usage, health and themes."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaultframe.functions.text import spaced
from vaultframe.functions.temporal import days_between
from vaultframe.sources.scratch import written


def recall_stats(events: DataFrame) -> DataFrame:
    """Per document: counts, distinct queries and UTC days, scores, negatives, diversity and spacing."""
    day = F.to_date("surfaced_at")
    g = events.groupBy("doc_id").agg(
        F.count("*").alias("recall_count"),
        F.countDistinct("query_hash").alias("unique_queries"),
        F.countDistinct(day).alias("recall_days"),
        F.sum("search_score").alias("total_score"),
        F.max("search_score").alias("max_score"),
        F.sum((~F.col("was_referenced")).cast("long")).alias("negatives"),
        F.min("surfaced_at").alias("first_at"),
        F.max("surfaced_at").alias("last_at"),
        F.concat_ws(",", F.sort_array(F.collect_set(F.date_format(day, "yyyy-MM-dd")))).alias("days"),
    )
    span = F.datediff(F.to_date("last_at"), F.to_date("first_at"))
    spread = 0.55 * F.least(F.lit(1.0), F.log1p(F.col("recall_days") - 1) / F.log1p(F.lit(4.0))) + 0.45 * F.least(F.lit(1.0), span / 7)
    return g.withColumn("diversity", F.least(F.lit(1.0), F.greatest("unique_queries", "recall_days") / 5)).withColumn("spacing", F.when(F.col("recall_days") <= 1, 0.2).otherwise(F.least(F.lit(1.0), spread)))


def memory_stats(meta: DataFrame, now: Column) -> DataFrame:
    on = F.col("active")
    age = days_between(now, F.col("modified_at"))
    return meta.groupBy("collection").agg(
        F.count("*").alias("total"),
        F.sum(on.cast("long")).alias("active"),
        F.sum((~on).cast("long")).alias("inactive"),
        F.sum((on & F.col("pinned")).cast("long")).alias("pinned"),
        F.sum((on & (age <= 7)).cast("long")).alias("last_7d"),
        F.sum((on & (age <= 30)).cast("long")).alias("last_30d"),
        F.min(F.when(on, F.col("modified_at"))).alias("oldest"),
        F.max(F.when(on, F.col("modified_at"))).alias("newest"),
        F.avg(F.when(on, F.col("confidence"))).alias("avg_confidence"),
        F.avg(F.when(on, F.col("access_count"))).alias("avg_access"),
    )


def median_by(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.percentile(value, 0.5).alias("median"))


def nearest_rank(df: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """The value at rank ceil(share * n), by a window rather than a collected list."""
    by = Window.partitionBy(*keys)
    ranked = df.where(F.col(value).isNotNull()).withColumn("r", F.row_number().over(by.orderBy(value))).withColumn("n", F.count("*").over(by))
    return ranked.where(F.col("r") == F.greatest(F.lit(1), F.ceil(F.col("n") * share))).select(*keys, F.col(value).alias("value"))


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def lifecycle_stats(meta: DataFrame, now: Column) -> DataFrame:
    on = F.col("active")
    age, idle = days_between(now, F.col("modified_at")), days_between(now, F.col("last_accessed_at"))
    n = lambda c: F.sum(c.cast("long"))
    return meta.agg(
        F.count("*").alias("total"),
        n(on).alias("active"),
        n(~on).alias("archived"),
        n(on & F.col("pinned")).alias("pinned"),
        n(on & (F.col("access_count") == 0)).alias("never_accessed"),
        n(on & (age > 30)).alias("stale_30d"),
        n(on & (age > 90)).alias("stale_90d"),
        n(on & (idle > 90)).alias("idle_90d"),
        n(on & (F.col("confidence") > 0.5)).alias("confident"),
        F.min(F.when(on, F.col("modified_at"))).alias("oldest_active"),
    )


def co_activation(events: DataFrame, session: str, doc: str, at: str) -> DataFrame:
    """(a, b, n, last_seen) of documents in the same session's set."""
    left = events.groupBy(session, F.col(doc).alias("a")).agg(F.max(at).alias("at_a"))
    right = events.groupBy(session, F.col(doc).alias("b")).agg(F.max(at).alias("at_b"))
    return left.join(right, session).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.max(F.greatest("at_a", "at_b")).alias("last_seen"))


def usage_budget(events: DataFrame) -> DataFrame:
    return events.groupBy("session_id").agg(F.count("*").alias("n"), F.sum(F.ceil(F.col("search_score") * 100)).alias("tokens"), F.sum(F.col("was_referenced").cast("long")).alias("referenced"), F.max("surfaced_at").alias("last_at"))


def recent_rate(events: DataFrame, at: str, now: Column, minutes: int) -> DataFrame:
    return events.where((F.col(at) <= now) & (F.col(at) > now - F.make_dt_interval(mins=F.lit(minutes)))).agg(F.count("*").alias("n"))


#: Buckets that phrases are counted in first, the fullest ones whose phrases are then counted, and phrases that a task holds.
BUCKETS, FULLEST, HELD = 1 << 20, 2000, 400_000


class _Codes(dict):
    """A number of each word, the same in all tasks; those of the first HELD words are kept."""

    def __missing__(self, word: str) -> int:
        code = zlib.crc32(word.encode())
        if len(self) < HELD:
            self[word] = code
        return code


def _phrases(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[tuple[list[str], list[tuple[int, np.ndarray]]]]:
    """Of each text its words and, for two and three words, the buckets of the phrases in order."""
    codes = _Codes()
    for b in batches:
        for t in b.column(0):
            words = [w for w in (t.as_py() or "").split() if len(w) > 3]
            h = np.array([codes[w] for w in words], dtype=np.uint64)
            two = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
            three = (two[:-1] * np.uint64(0xD6E8FEB86659FD93)) ^ (h[2:] * np.uint64(0x165667B19E3779F9))
            yield words, [(n, ((x * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(40)).astype(np.int64) % buckets) for n, x in ((2, two), (3, three))]


def phrase_themes(df: DataFrame, text: str, least: int = 3, top: int = 20) -> DataFrame:
    """(phrase, n): two- and three-word phrases of words longer than three letters; longer first on ties.

    Phrases are first counted in buckets: none has more than its bucket. Those of the fullest buckets are then counted themselves;
    should the ``top`` of them not have more than any other bucket, so are those of all buckets with as many.
    """
    texts = df.select(spaced(text).alias("t"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, waiting, size = np.zeros(BUCKETS, dtype=np.int64), [], 0
        for _, found in _phrases(batches, BUCKETS):
            waiting += [b for _, b in found]
            size += sum(len(b) for _, b in found)
            if size >= HELD:
                counts += np.bincount(np.concatenate(waiting), minlength=BUCKETS)
                waiting, size = [], 0
        if waiting:
            counts += np.bincount(np.concatenate(waiting), minlength=BUCKETS)
        full = np.flatnonzero(counts)
        for k in range(0, len(full), 100_000):
            part = full[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(counts[part], pa.int64())], ["bucket", "n"])

    filled = written(texts.mapInArrow(fill, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "buckets")

    def counted(buckets: DataFrame) -> DataFrame:
        chosen = df.sparkSession.sparkContext.broadcast(np.array([r[0] for r in buckets.select("bucket").collect()], dtype=np.int64))  # BUCKETS at most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wanted, n = np.zeros(BUCKETS, dtype=bool), Counter()
            wanted[chosen.value] = True
            give = lambda: pa.RecordBatch.from_pydict({"phrase": pa.array(n.keys(), pa.string()), "n": pa.array(n.values(), pa.int64())})
            for words, found in _phrases(batches, BUCKETS):
                for size, b in found:
                    n.update(" ".join(words[i : i + size]) for i in np.flatnonzero(wanted[b]).tolist())
                if len(n) >= HELD:
                    yield give()
                    n.clear()
            yield give()

        return written(texts.mapInArrow(run, "phrase string, n long").groupBy("phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "phrases")

    best = lambda found: found.orderBy(F.desc("n"), F.desc(F.length("phrase")), "phrase").limit(top)
    fullest = filled.orderBy(F.desc("n"), "bucket").limit(FULLEST)
    found = counted(fullest)
    have = best(found).agg(F.count("*").alias("rows"), F.min("n").alias("n")).first()
    enough = have["n"] if have["rows"] == top else least
    if filled.where(F.col("n") >= enough).count() > FULLEST:
        found = counted(filled.where(F.col("n") >= enough))
    return best(found)


def weekly_histogram(df: DataFrame, at: str, now: Column, weeks: int = 10) -> DataFrame:
    """(week, n) of future times, zero-filled."""
    week = F.floor(days_between(F.col(at), now) / 7).cast("int")
    n = df.where(F.col(at) >= now).groupBy(week.alias("week")).agg(F.count("*").alias("n"))
    return df.sparkSession.range(weeks).select(F.col("id").cast("int").alias("week")).join(n, "week", "left").select("week", F.coalesce("n", F.lit(0)).alias("n"))


def queue_next_due(df: DataFrame, queue: str, due: str, now: Column) -> DataFrame:
    return df.groupBy(queue).agg(F.sum((F.col(due) <= now).cast("long")).alias("due_now"), F.min(F.when(F.col(due) > now, F.col(due))).alias("next_due"))
