"""Retrieval pipelines as logical plans: keyword, vector, temporal and entity lists, fused and ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultframe.functions.scoring import DEFAULT_WEIGHTS, composite
from vaultframe.operators import fts, fusion
from vaultframe.operators.windows import top_per


def eligible(meta: DataFrame, collections: list[str] | None = None, exclude: list[str] | None = None, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """The universal candidate predicate, before any limit."""
    keep = F.col("active")
    if "invalidated_at" in meta.columns:
        keep = keep & F.col("invalidated_at").isNull()
    if collections:
        keep = keep & F.col("collection").isin(*collections)
    if exclude:
        keep = keep & ~F.col("collection").isin(*exclude)
    if start is not None:
        keep = keep & (F.col("effective_at") >= start)
    if end is not None:
        keep = keep & (F.col("effective_at") <= end)
    return meta.where(keep)


def ranked_with_metadata(found: DataFrame, meta: DataFrame, now: Column, weights=DEFAULT_WEIGHTS, top: int | None = 10) -> DataFrame:
    """found(qid, id, score) with metadata, all factors, and the rank by composite."""
    scored = composite(found.join(meta, "id"), now, weights)
    return top_per(scored, ["qid"], [F.desc(F.round("composite", 9)), F.col("id")], top, "composite_rank")


def search_composite(docs: DataFrame, meta: DataFrame, queries: DataFrame, now: Column, top: int = 10) -> DataFrame:
    """Keyword search, metadata and composite rank. Bodies are read and cut once (``fts.search``); no body is carried further."""
    found = fts.search(docs, queries, 20, eligible(meta)).select("qid", "id", "score")
    return ranked_with_metadata(found, meta.withColumn("quality_score", F.lit(0.5)), now, top=top)


def temporal_list(meta: DataFrame, spans: DataFrame, top: int = 30) -> DataFrame:
    """(qid, id, rank): eligible documents in each query's span(start_at, end_at), newest first."""
    hits = eligible(meta).join(F.broadcast(spans), (F.col("effective_at") >= F.col("start_at")) & (F.col("effective_at") <= F.col("end_at")))
    return top_per(hits.select("qid", "id", "effective_at"), ["qid"], [F.desc("effective_at"), F.col("id")], top).select("qid", "id", "rank")


def fuse(lists: list[tuple[DataFrame, float]], top: int = 30) -> DataFrame:
    """Ranked lists(qid, id, rank) with weights into (qid, id, fused, rank)."""
    union = None
    for df, w in lists:
        one = df.select("qid", "id", F.col("rank").cast("int").alias("rank"), F.lit(float(w)).alias("weight"))
        union = one if union is None else union.unionByName(one)
    return top_per(fusion.reciprocal_ranks(union), ["qid"], [F.desc(F.round("fused", 9)), F.col("id")], top)


def execute_clauses(clauses: list[tuple[DataFrame, int]], top: int = 30) -> DataFrame:
    """Query plan: each clause's list weighs 6 - priority."""
    return fuse([(df, 6 - p) for df, p in clauses], top)
