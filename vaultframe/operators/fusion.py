"""Combining ranked lists: reciprocal ranks, rerank blends, admission, tiers and diversity."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaultframe.functions.text import jaccard, let
from vaultframe.operators.windows import top_per


def reciprocal_ranks(lists: DataFrame, k: int = 60, weight_bonuses: bool = False) -> DataFrame:
    """(qid, id, fused) of lists(qid, id, rank from 1, weight); weight 0 lists are skipped, invalid weights are 1."""
    w = F.when(F.col("weight").isNull() | F.isnan("weight") | (F.col("weight") < 0), 1.0).otherwise(F.col("weight"))
    bonus = F.when(F.col("rank") == 1, 0.05).when(F.col("rank") <= 3, 0.02).otherwise(0.0)
    part = w / (k + F.col("rank")) + (bonus * w if weight_bonuses else bonus)
    return lists.where(w != 0).groupBy("qid", "id").agg(F.sum(part).alias("fused"))


def blend_rerank(df: DataFrame, rerank_weight: float = 0.9, floor: float = 1e-4) -> DataFrame:
    """Adds ``blended`` from fused and rerank; without a usable rerank score the normalised fusion alone."""
    by = Window.partitionBy("qid")
    top = F.max("fused").over(by)
    norm = F.col("fused") / F.when(top > 0, top).otherwise(1.0)
    usable = F.coalesce(F.max(F.nanvl("rerank", F.lit(None).cast("double"))).over(by) > floor, F.lit(False))
    return df.withColumn("blended", F.when(~usable, norm).otherwise((1 - rerank_weight) * norm + rerank_weight * F.coalesce(F.nanvl("rerank", F.lit(0.0)), F.lit(0.0))))


def blend_by_rank(df: DataFrame) -> DataFrame:
    """Adds ``blended``: the upstream score weighs .75, .60 or .40 by rank up to 3, up to 10 and beyond."""
    w = F.when(F.col("rank") <= 3, 0.75).when(F.col("rank") <= 10, 0.60).otherwise(0.40)
    return df.withColumn("blended", w * F.col("score") + (1 - w) * F.coalesce(F.col("rerank"), F.lit(0.0)))


def raw_primary(df: DataFrame) -> DataFrame:
    """Adds ``rank``: raw score, then pinned, then composite, then path."""
    return top_per(df, ["qid"], [F.desc(F.round("score", 9)), F.desc("pinned"), F.desc(F.round("composite", 9)), F.col("path")], None)


def admission(df: DataFrame, ratio: float = 0.5) -> DataFrame:
    """Adds ``admitted`` to (qid, band, mass, current_mass): at least half the best mass of band 0;
    band 1 only where band 0 is empty and nothing current supports it."""
    by = Window.partitionBy("qid")
    top = F.max(F.when(F.col("band") == 0, F.col("mass"))).over(by)
    current = F.sum("current_mass").over(by)
    return df.withColumn("admitted", F.when(F.col("band") == 0, F.col("mass") >= ratio * top).otherwise(top.isNull() & (current == 0)))


def adaptive_threshold(df: DataFrame, activation: float, ratio: float, floor: float) -> DataFrame:
    """Adds ``admitted``: nothing if the best composite is below activation, else max(best * ratio, floor)."""
    best = F.max("composite").over(Window.partitionBy("qid"))
    return df.withColumn("admitted", (best >= activation) & (F.col("composite") >= F.greatest(best * ratio, F.lit(floor))))


def rerank_degeneracy(df: DataFrame, collapse: float = 0.05, spread: float = 0.05) -> DataFrame:
    """(qid, state): invalid without finite scores, collapsed, inert or healthy."""
    finite = F.nanvl("rerank", F.lit(None).cast("double"))
    s = df.groupBy("qid").agg(F.max(finite).alias("hi"), F.min(finite).alias("lo"))
    return s.select("qid", F.when(F.col("hi").isNull(), "invalid").when(F.col("hi") < collapse, "collapsed").when(F.col("hi") - F.col("lo") < spread, "inert").otherwise("healthy").alias("state"))


def tier(score: Column) -> Column:
    return F.when(score > 0.8, "HOT").when(score > 0.6, "WARM").otherwise("COLD")


# Fixed value: characters of a body that a topic is looked for in.
TOPIC_CHARS = 800


def topic_boost(df: DataFrame, topics: DataFrame, boost: float = 1.4, demote: float = 0.75, floor: float = 0.5) -> DataFrame:
    """Adds ``boosted`` to df(qid, title, path, body, score): with a topic of topics(qid, topic), scores of rows that have all its words rise and others fall.

    Words are parts of the title, the path or the body's start, in any case; words of one character don't count. Nothing
    changes for a query without a topic, without such words, or without a row that has them.
    """
    words = F.filter(F.split(F.lower("topic"), r"\s+"), lambda w: F.length(w) >= 2)
    asked = topics.select("qid", words.alias("__words")).where(F.size("__words") > 0)
    shown = F.lower(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in (F.col("title"), F.col("path"), F.substring("body", 1, TOPIC_CHARS)))))
    marked = df.join(asked, "qid", "left").withColumn("__hit", let(shown, lambda text: F.forall("__words", lambda w: F.contains(text, w))))
    found = F.coalesce(F.bool_or("__hit").over(Window.partitionBy("qid")), F.lit(False))
    return marked.withColumn("boosted", F.when(~found, F.col("score")).when(F.col("__hit"), F.col("score") * boost).otherwise(F.col("score") * max(demote, floor))).drop("__words", "__hit")


def co_activation_boost(ranked: DataFrame, pairs: DataFrame) -> DataFrame:
    """Multiplies ``composite`` by 1 + min(count / 10, .15) for partners of the first quarter (by input_rank).

    pairs(a, b, n) has each pair once; the five strongest partners of a top document count.
    """
    n = F.count("*").over(Window.partitionBy("qid"))
    marked = ranked.withColumn("top", F.col("input_rank") <= F.greatest(F.lit(1), F.floor(n * 0.25)))
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("partner"), "n").unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("partner"), "n"))
    strong = top_per(both, ["id"], [F.desc("n"), F.col("partner")], 5, "r")
    tops = marked.where("top").select("qid", "id")
    gain = tops.join(strong, "id").select("qid", F.col("partner").alias("id"), "n").join(tops, ["qid", "id"], "left_anti").groupBy("qid", "id").agg(F.sum("n").alias("co"))
    return marked.join(gain, ["qid", "id"], "left").withColumn("composite", F.col("composite") * (1 + F.when(F.col("co").isNull(), 0.0).otherwise(F.least(F.col("co") / 10, F.lit(0.15))))).drop("top")


def diversify(df: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(qid, id, position): greedy; a row too like a selected one is moved behind the others.

    df(qid, id, rank, grams) holds a query's few results, bounded by the search's limit.
    """

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        selected, deferred = [], []
        rows = list(pdf.sort_values(["rank", "id"])[["id", "grams"]].itertuples(index=False))
        for i, grams in rows:
            own = set(grams)
            alike = len(rows) > 2 and any(len(own & o) > threshold * len(own | o) if own | o else 1.0 > threshold for _, o in selected)
            (deferred if alike else selected).append((i, own))
        return pd.DataFrame({"qid": pdf["qid"].iloc[0], "id": [i for i, _ in selected + deferred], "position": range(1, len(rows) + 1)})

    kinds = dict(df.dtypes)
    return df.select("qid", "id", "rank", "grams").groupBy("qid").applyInPandas(walk, f"qid {kinds['qid']}, id {kinds['id']}, position int")


def near_duplicates(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(a, b, similarity) of rows(id, grams) that share a rare enough gram and are alike by Jaccard.

    Prefix filter: grams are ordered by frequency, and only a row's rarest ones meet, where both rows have enough grams
    left behind for the overlap that the threshold needs. Of what meets, short marks of the grams bound the overlap from
    above; the grams themselves are compared for the rest alone.
    """
    grams = df.select("id", F.size("grams").alias("size"), F.explode("grams").alias("g"))
    df_of = grams.groupBy("g").agg(F.count("*").alias("n"))
    by = Window.partitionBy("id").orderBy("n", "g")
    rare = grams.join(df_of, "g").withColumn("r", F.row_number().over(by)).where(F.col("r") <= F.col("size") - F.ceil(F.col("size") * threshold) + 1).where("n > 1").select("id", "g", "size", "r")
    a, b = rare.alias("a"), rare.alias("b")
    # two alike rows share so many grams, all of them from their first common one on
    need = lambda x, y: (x + y) * (threshold / (1 + threshold)) - 1e-6
    pairs = a.join(b, F.col("a.g") == F.col("b.g")).where("a.id < b.id").where(F.least(F.col("a.size") - F.col("a.r"), F.col("b.size") - F.col("b.r")) + 1 >= need(F.col("a.size"), F.col("b.size"))).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    marks = df.select("id", F.size("grams").alias("size"), F.array_distinct(F.transform("grams", lambda g: F.xxhash64(g).bitwiseAND(0x7FFF).cast("int").cast("short"))).alias("marks"))
    side = lambda x: marks.select(F.col("id").alias(x), F.col("size").alias(f"size_{x}"), F.col("marks").alias(f"marks_{x}"))
    # each mark that the other row lacks is a gram that it lacks
    most = F.col("size_a") - F.size(F.array_except("marks_a", "marks_b"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").where(most >= need(F.col("size_a"), F.col("size_b"))).select("a", "b")
    sets = df.select("id", "grams")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("grams").alias("ga")), "a").join(sets.select(F.col("id").alias("b"), F.col("grams").alias("gb")), "b")
    return both.select("a", "b", jaccard("ga", "gb").alias("similarity")).where(F.col("similarity") >= threshold)


def select_pool(lanes: DataFrame, max_results: int, protected_share: float = 0.6) -> DataFrame:
    """Lane fusion of (qid, lane, weight, is_current, id, rank): mass per document, a pool of max + 5
    with a protected share of places for documents of the current prompt's lanes.

    The discounted lanes' mass of a document that the current lanes also have is capped just
    below its current mass. The walk runs over one query's pool, which its limits bound. A document's best score goes
    along, if lanes have scores.
    """
    score = [F.max("score").alias("score")] if "score" in lanes.columns else []
    part = F.col("weight") / (60 + F.col("rank"))
    mass = lanes.groupBy("qid", "id").agg(F.sum(F.when(F.col("is_current"), part).otherwise(0.0)).alias("current_mass"), F.sum(F.when(F.col("is_current"), 0.0).otherwise(part)).alias("discounted"), *score)
    capped = F.when((F.col("current_mass") > 0) & (F.col("discounted") >= F.col("current_mass")), F.col("current_mass") * 0.999).otherwise(F.col("discounted"))
    mass = mass.withColumn("mass", F.col("current_mass") + capped).withColumn("band", F.when(F.col("current_mass") > 0, 0).otherwise(1))
    pool = top_per(mass, ["qid"], [F.desc(F.round("mass", 12)), F.col("id")], None, "place")
    size, protected = max_results + 5, int((max_results + 5) * protected_share)
    # the first of the current lanes' documents, by the same window as the places
    ordered = top_per(pool, ["qid"], [F.col("band"), F.col("place")], None, "c")
    marked = ordered.withColumn("kept", (F.col("band") == 0) & (F.col("c") <= protected))
    return top_per(marked, ["qid"], [F.desc("kept"), F.col("place")], size, "slot").select("qid", "id", "band", "mass", "current_mass", *(["score"] if score else []))


def first_occurrence(legs: DataFrame) -> DataFrame:
    """Concatenated legs(qid, leg, rank, id): the first occurrence of a document stays."""
    return top_per(legs, ["qid", "id"], [F.col("leg"), F.col("rank")], 1, "seen").drop("seen")




def drop_unarbitrated(pool: DataFrame, candidates: DataFrame) -> DataFrame:
    """The pool without candidates(qid, id, admitted, current_supported, gate_passed) that only earlier turns admitted."""
    drop = candidates.where("admitted and not current_supported and not gate_passed").select("qid", "id")
    return pool.join(drop, ["qid", "id"], "left_anti")


def recency_order(scored: DataFrame, recent: DataFrame) -> DataFrame:
    """scored(qid, id, content_type, composite) with ``place``: for queries of recent(qid) handoffs, decisions and progress first."""
    marked = scored.join(recent.select("qid", F.lit(True).alias("__recent")).distinct(), "qid", "left")
    first = F.coalesce("__recent", F.lit(False)) & F.col("content_type").isin("handoff", "decision", "progress")
    return top_per(marked.withColumn("__first", first), ["qid"], [F.desc("__first"), F.desc(F.round("composite", 9)), F.col("id")], None, "place").drop("__recent", "__first")
