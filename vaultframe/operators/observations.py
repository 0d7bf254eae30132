"""Consolidation and contradiction bookkeeping around what language models return."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vaultframe.functions.guards import placeholder
from vaultframe.functions.scoring import cosine
from vaultframe.functions.text import slug
from vaultframe.operators.windows import top_per


def admit(entries: DataFrame) -> DataFrame:
    """Adds disposition to entries(batch, n, relation, confidence, reasoning, old_idx, new_idx, n_old, n_new):
    rejected with a reason, inconsistent (one pair, several answers), duplicate, or accepted."""
    reason = (
        F.when(F.col("relation").isNull() | ~F.col("relation").isin("same", "update", "contradiction"), "invalid-relation")
        .when(F.col("reasoning").isNull(), "invalid-reasoning")
        .when(placeholder("reasoning"), "placeholder-reasoning")
        .when(F.col("confidence").isNull() | F.isnan("confidence") | ~F.col("confidence").between(0, 1), "invalid-confidence")
        .when(F.col("old_idx").isNull() | (F.col("old_idx") < 0) | (F.col("old_idx") >= F.col("n_old")) | F.col("new_idx").isNull() | (F.col("new_idx") < 0) | (F.col("new_idx") >= F.col("n_new")), "index-out-of-range")
    )
    marked = entries.withColumn("reason", reason)
    pair = Window.partitionBy("batch", "old_idx", "new_idx", F.col("reason").isNull())
    signature = F.struct("relation", "confidence", "reasoning")
    out = marked.withColumn("answers", F.size(F.collect_set(signature).over(pair))).withColumn("k", F.row_number().over(pair.orderBy("n")))
    return out.withColumn("disposition", F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("answers") > 1, "inconsistent").when(F.col("k") > 1, "duplicate").otherwise("accepted")).drop("reason", "answers", "k")


def causal_admission(edges: DataFrame) -> DataFrame:
    """Adds disposition to edges(source, target, confidence, n_facts, n_new): ordinals below n_new are new facts."""
    outside = lambda c: F.col(c).isNull() | (F.col(c) < 0) | (F.col(c) >= F.col("n_facts"))
    return edges.withColumn("disposition", F.when(F.col("confidence").isNull() | (F.col("confidence") < 0.6) | (F.col("confidence") > 1), "low-confidence").when(outside("source") | outside("target"), "out-of-range").when(F.col("source") == F.col("target"), "self").when((F.col("source") >= F.col("n_new")) & (F.col("target") >= F.col("n_new")), "no-new-endpoint").otherwise("accepted"))


def evidence(drafts: DataFrame, sources: DataFrame) -> DataFrame:
    """(draft_id, doc_id, n, sentence) of drafts(draft_id, doc_id, text) whose source has a sentence with two of the draft's longer words."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: F.length(w) > 3))
    s = sources.select("doc_id", F.posexplode(F.split("body", r"[.!?\n]+")).alias("n", "sentence")).withColumn("sentence", F.trim("sentence")).where("sentence <> ''")
    d = drafts.select("draft_id", "doc_id", words(F.col("text")).alias("words"))
    return d.join(s, "doc_id").where(F.size(F.array_intersect("words", words(F.col("sentence")))) >= 2).select("draft_id", "doc_id", "n", "sentence")


def unconsolidated(observations: DataFrame, consolidated: DataFrame) -> DataFrame:
    """Observations that no consolidation names in its source ids."""
    used = consolidated.select(F.explode("source_doc_ids").alias("id")).distinct()
    return observations.join(used, "id", "left_anti")


def merge_sources(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Source ids united, proofs counted anew, for (id, source_doc_ids)."""
    both = existing.select("id", "source_doc_ids").join(new.select("id", F.col("source_doc_ids").alias("more")), "id", "left")
    ids = F.array_sort(F.array_union("source_doc_ids", F.coalesce("more", F.array().cast("array<bigint>"))))
    return both.select("id", ids.alias("source_doc_ids"), F.size(ids).cast("long").alias("proof_count"))


def links(mentions: DataFrame, titles: DataFrame) -> DataFrame:
    """(mention, id) for mentions whose normalised title belongs to exactly one document of titles(id, title)."""
    keyed = titles.select(slug("title").alias("k"), "id").groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1")
    return mentions.select("mention", slug("mention").alias("k")).join(keyed, "k", "left").select("mention", "id")


def canary(vectors: DataFrame, baseline: DataFrame) -> DataFrame:
    """(anchor, margin, drift) of vectors(anchor, kind in probe, similar, different, embedding): similar minus different, and similarity to the baseline."""
    p = lambda k: vectors.where(F.col("kind") == k).select("anchor", F.col("embedding").alias(k))
    j = p("probe").join(p("similar"), "anchor").join(p("different"), "anchor").join(baseline.select("anchor", F.col("embedding").alias("base")), "anchor", "left")
    return j.select("anchor", (cosine("probe", "similar") - cosine("probe", "different")).alias("margin"), cosine("probe", "base").alias("drift"))


def fact_window(facts: DataFrame, most: int = 40, chars: int = 300) -> DataFrame:
    """(doc_id, ordinal, fact, place) of facts(doc_id, is_new, facts): new documents first, ordinals kept, cut to size."""
    flat = facts.select("doc_id", "is_new", F.posexplode("facts").alias("ordinal", "fact"))
    ranked = top_per(flat.withColumn("g", F.lit(1)), ["g"], [F.desc("is_new"), F.col("doc_id"), F.col("ordinal")], most, "place")
    return ranked.select("doc_id", "ordinal", F.substring("fact", 1, chars).alias("fact"), "place")


def recovered_assertions(bodies: DataFrame) -> DataFrame:
    """(key, occurrences, first_seen, last_seen): each line counts once per body."""
    lines = bodies.select("id", "at", F.explode(F.array_distinct(F.transform(F.split("body", "\n"), lambda s: F.lower(F.trim(s))))).alias("key")).where("key <> ''")
    return lines.groupBy("key").agg(F.count("*").alias("occurrences"), F.min("at").alias("first_seen"), F.max("at").alias("last_seen")).orderBy(F.desc("occurrences"), "first_seen", "key")


def group_equal(bodies: DataFrame) -> DataFrame:
    """Equal bodies as one row with the union of their triples."""
    return bodies.groupBy(F.sha2("body", 256).alias("hash")).agg(F.min("id").alias("id"), F.count("*").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("triples")))).alias("triples"))


def undecided(pairs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Pairs without a verdict for the same fact, document, document hash and contract."""
    key = ["fact", "doc_id", "doc_hash", "contract"]
    return pairs.join(verdicts.select(*key), key, "left_anti")
