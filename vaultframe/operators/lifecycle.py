"""Snapshot transforms: saving with deduplication, archiving, merging and contradiction outcomes.

A table is never changed in place; each function returns the next snapshot.
"""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from vaultframe.functions.temporal import days_between
from vaultframe.functions.text import anchors, contradiction, gram_text, normalized_hash
from vaultframe.operators.alike import alike
from vaultframe.operators.windows import fixed_windows, top_per

# Days without change and access before a type is archived; types not listed are exempt.
ARCHIVE_DAYS = {"handoff": 45, "progress": 60, "conversation": 60, "note": 120, "problem": 120, "milestone": 120, "research": 180, "project": 180}
MERGE_NORMAL, MERGE_STRICT = 0.93, 0.98


def archive_candidates(meta: DataFrame, now: Column, policy: dict[str, int] | None = None) -> DataFrame:
    """Active documents, neither pinned nor exempt, that were neither changed nor accessed for their type's days."""
    days = F.element_at(F.create_map(*(F.lit(x) for kv in (policy or ARCHIVE_DAYS).items() for x in kv)), F.col("content_type"))
    stale = lambda c: days_between(now, F.col(c)) > days
    return meta.where(F.col("active") & ~F.col("pinned") & days.isNotNull() & stale("modified_at") & (F.col("last_accessed_at").isNull() | stale("last_accessed_at")))


def archive(meta: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    hit = meta.join(ids.select("id", F.lit(True).alias("hit")).distinct(), "id", "left")
    return hit.withColumn("archived_at", F.when(F.coalesce("hit", F.lit(False)) & F.col("active"), now).otherwise(F.col("archived_at") if "archived_at" in meta.columns else F.lit(None).cast("timestamp_ntz"))).withColumn("active", F.col("active") & ~F.coalesce("hit", F.lit(False))).drop("hit")


def restore(meta: DataFrame, where: Column) -> DataFrame:
    hit = where & F.col("archived_at").isNotNull()
    return meta.withColumn("active", F.col("active") | hit).withColumn("archived_at", F.when(~hit, F.col("archived_at")))


def save(existing_and_new: DataFrame, minutes: int = 30) -> DataFrame:
    """One row per saved memory of rows(collection, content_type, body, at, id): repeats within a fixed
    window from the first one raise duplicate_count instead of adding a row."""
    marked = fixed_windows(existing_and_new.withColumn("h", normalized_hash("body")), ["collection", "content_type", "h"], "at", "id", minutes * 60)
    return marked.groupBy("collection", "content_type", "h", "opened_at").agg(F.min(F.when(F.col("opens"), F.col("id"))).alias("id"), F.count("*").alias("duplicate_count"), F.max("at").alias("last_seen_at"))


def save_batch(documents: DataFrame, rows: DataFrame, now: Column, minutes: int = 30) -> tuple[DataFrame, DataFrame]:
    """(outcomes, changed) of saving memories rows(seq, collection, path, title, body, content_type) at one time.

    Optional columns of rows: confidence, quality_score, semantic_payload, topic_key, authored_at. Rows count in order of seq.

    - A path of an active document that files own, or of any inactive document, is refused.
    - A row whose normalised payload an active document of its collection and type has, created within the window and not
      owned by files, raises that document's duplicate_count; so does a row that repeats an earlier one of the batch.
    - Else the row is inserted, or updates the document at its path and raises its revision_count; of several rows for
      one path the last one's text stays. Authorship only moves forward. Whatever is written belongs to the api.

    outcomes: (seq, action, reason, collection, path, id, duplicate_count, revision_count); path is that of the document
    counted on or written; id is null for documents that are new. changed: rows of documents, id null if new, with body
    where a text is written.
    """
    optional = {"confidence": "double", "quality_score": "double", "semantic_payload": "string", "topic_key": "string", "authored_at": "timestamp_ntz"}
    r = rows.withColumns({c: F.lit(None).cast(t) for c, t in optional.items() if c not in rows.columns}).withColumn("h", normalized_hash(F.coalesce(F.when(F.col("semantic_payload") != "", F.col("semantic_payload")), F.col("body"))))
    here = documents.select("collection", "path", F.col("id").alias("path_id"), F.col("active").alias("path_active"), F.col("origin").alias("path_origin"), F.col("deactivated_reason").alias("path_reason"), F.col("revision_count").alias("path_revision"))
    recent = documents.where(F.col("active") & (F.col("origin").isNull() | (F.col("origin") == "api")) & (F.col("created_at") >= now - F.make_dt_interval(mins=F.lit(minutes))))
    twins = top_per(recent, ["collection", "content_type", "normalized_hash"], [F.desc("created_at"), F.desc("id")], 1, "recent").select("collection", "content_type", F.col("normalized_hash").alias("h"), F.col("id").alias("twin_id"), F.col("path").alias("twin_path"), F.col("duplicate_count").alias("twin_count"))
    r = r.join(here, ["collection", "path"], "left").join(twins, ["collection", "content_type", "h"], "left")
    refused = F.when(F.col("path_active") & (F.col("path_origin") == "fs"), "owned by files").when(~F.col("path_active"), F.concat(F.lit("inactive: "), F.coalesce("path_reason", F.lit("null"))))
    r = r.withColumn("reason", refused)
    good, bad = r.where("reason is null"), r.where("reason is not null")
    same = Window.partitionBy("collection", "content_type", "h").orderBy("seq")
    good = good.withColumn("nth", F.row_number().over(same)).withColumn("head_path", F.first("path").over(same))
    counted = good.where(F.col("twin_id").isNotNull() | (F.col("nth") > 1))
    writers = good.where(F.col("twin_id").isNull() & (F.col("nth") == 1))
    at_path = Window.partitionBy("collection", "path").orderBy("seq")
    writers = writers.withColumn("k", F.row_number().over(at_path)).withColumn("last", F.lead("seq").over(at_path).isNull())
    on_twin = F.col("twin_id").isNotNull()
    none = lambda t: F.lit(None).cast(t)
    outcomes = (
        bad.select("seq", F.lit("refused").alias("action"), "reason", "collection", "path", F.col("path_id").alias("id"), none("long").alias("duplicate_count"), none("long").alias("revision_count"))
        .unionByName(counted.join(here.select("collection", F.col("path").alias("head_path"), F.col("path_id").alias("head_id")), ["collection", "head_path"], "left").select("seq", F.lit("deduplicated").alias("action"), "reason", "collection", F.when(on_twin, F.col("twin_path")).otherwise(F.col("head_path")).alias("path"), F.when(on_twin, F.col("twin_id")).otherwise(F.col("head_id")).alias("id"), F.when(on_twin, F.col("twin_count") + F.col("nth")).otherwise(F.col("nth")).cast("long").alias("duplicate_count"), none("long").alias("revision_count")))
        .unionByName(writers.select("seq", F.when(F.col("path_id").isNull() & (F.col("k") == 1), "inserted").otherwise("updated").alias("action"), "reason", "collection", "path", F.col("path_id").alias("id"), none("long").alias("duplicate_count"), (F.coalesce("path_revision", F.lit(0)) + F.col("k")).cast("long").alias("revision_count")))
    )
    # what counts on documents that are there, and on those that this batch writes
    seen = counted.where(on_twin).groupBy(F.col("twin_id").alias("id")).agg(F.count("*").alias("more"), F.max("authored_at").alias("seen_authored"))
    repeats = counted.where(~on_twin).groupBy("collection", F.col("head_path").alias("path")).agg(F.count("*").alias("again"), F.max("authored_at").alias("again_authored"))
    total = writers.groupBy("collection", "path").agg(F.count("*").alias("writes"), F.max("authored_at").alias("write_authored"))
    final = writers.where("last").join(total, ["collection", "path"]).join(repeats, ["collection", "path"], "left")
    written = final.select("path_id", "collection", "path", "title", "body", F.sha2("body", 256).alias("hash"), F.length("body").alias("body_length"), "content_type", F.coalesce("confidence", F.lit(0.5)).alias("confidence"), F.coalesce("quality_score", F.lit(0.5)).alias("quality_score"), "h", "topic_key", F.greatest("write_authored", "again_authored").alias("authored_at"), "writes", F.coalesce("again", F.lit(0)).alias("again"))
    w = written.where("path_id is not null").select(F.col("path_id").alias("id"), F.struct(*[c for c in written.columns if c != "path_id"]).alias("w"))
    old = documents.join(seen.join(w, "id", "full_outer"), "id")
    put, twin = F.col("w").isNotNull(), F.col("more").isNotNull()
    new_values = {
        **{c: F.when(put, F.col(f"w.{c}")).otherwise(F.col(c)) for c in ("title", "hash", "body_length", "content_type", "confidence", "quality_score")},
        "normalized_hash": F.when(put, F.col("w.h")).otherwise(F.col("normalized_hash")),
        "modified_at": F.when(put, now).otherwise(F.col("modified_at")),
        "revision_count": F.col("revision_count") + F.when(put, F.col("w.writes")).otherwise(0),
        "duplicate_count": F.col("duplicate_count") + F.when(twin, F.col("more")).otherwise(0) + F.when(put, F.col("w.again")).otherwise(0),
        "authored_at": F.greatest("authored_at", "seen_authored", "w.authored_at"),
        "last_seen_at": now,
        "origin": F.lit("api"),
    }
    types = {f.name: f.dataType for f in documents.schema.fields}
    kept = lambda df, values: df.select(*((values[c] if c in values else F.col(c)).cast(types[c]).alias(c) for c in documents.columns), F.col("body"))
    touched = kept(old.withColumn("body", F.col("w.body")), new_values)
    fresh = written.where("path_id is null")
    first = {c: F.lit(None) for c in documents.columns} | {c: F.col(c) for c in ("collection", "path", "title", "hash", "body_length", "content_type", "confidence", "quality_score", "topic_key", "authored_at") if c in documents.columns}
    first |= {"created_at": now, "modified_at": now, "last_seen_at": now, "active": F.lit(True), "origin": F.lit("api"), "normalized_hash": F.col("h"), "duplicate_count": F.col("again") + 1, "revision_count": F.col("writes"), "pinned": F.lit(False), "access_count": F.lit(0)}
    return outcomes, touched.unionByName(kept(fresh, first))


@F.pandas_udf(DoubleType())
def _gram_cosine(a: pd.Series, b: pd.Series) -> pd.Series:
    """Cosine of the trigram counts of two ``gram_text``s, each counted in one pass; 0 if either is empty."""

    def counts(s: str) -> Counter:
        return Counter(s[i : i + 3] for i in range(max(len(s) - 2, 1))) if s else Counter()

    def one(x: str | None, y: str | None) -> float | None:
        if x is None or y is None:
            return None
        cx, cy = counts(x), counts(y)
        norm = math.sqrt(sum(n * n for n in cx.values())) * math.sqrt(sum(n * n for n in cy.values()))
        return sum(n * cy[g] for g, n in cx.items() if g in cy) / norm if norm else 0.0

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64" if a.notna().all() and b.notna().all() else "object")


def merge_gate(pairs: DataFrame) -> DataFrame:
    """Adds similarity and accepted to pairs(a_text, b_text): trigram cosine .93, or .98 without anchors;
    materially different anchors are rejected."""
    out = pairs.withColumns({"similarity": _gram_cosine(gram_text("a_text"), gram_text("b_text")), "aa": anchors("a_text"), "ab": anchors("b_text")})
    common, smaller = F.size(F.array_intersect("aa", "ab")), F.least(F.size("aa"), F.size("ab"))
    different = (smaller > 0) & (common < smaller) & (common <= smaller / 2)
    none = (F.size("aa") == 0) & (F.size("ab") == 0)
    one_sided = (smaller == 0) & ~none
    return out.withColumn("accepted", F.when(different | one_sided, False).when(none, F.col("similarity") >= MERGE_STRICT).otherwise(F.col("similarity") >= MERGE_NORMAL)).drop("aa", "ab")


def contradictions(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("c", contradiction("a_text", "b_text")).select("*", "c.contradictory", "c.confidence", "c.reason").drop("c")


def apply_contradictions(meta: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Lowers confidence by outcomes(id, kind, confidence): contradiction .25 down to .2, update .15 down to .3."""
    strong = outcomes.where("confidence >= 0.7")
    drop = strong.groupBy("id").agg(F.max(F.col("kind") == "contradiction").alias("against"), F.max(F.col("kind") == "update").alias("updated"))
    lower = F.when(F.col("against"), F.greatest(F.lit(0.2), F.col("confidence") - 0.25)).when(F.col("updated"), F.greatest(F.lit(0.3), F.col("confidence") - 0.15)).otherwise(F.col("confidence"))
    return meta.join(drop, "id", "left").withColumn("confidence", lower).drop("against", "updated")


def similar_observation(new: DataFrame, old: DataFrame, shortlist: float = 0.5) -> DataFrame:
    """(new_id, old_id, similarity): the best other old observation in the collection by word overlap above the shortlist.

    Pairs meet as in ``alike``. Ids tell observations apart in both tables.
    """
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: F.length(w) > 2))
    sets = lambda d: d.select("id", "collection", words.alias("grams"))
    both = sets(new) if new is old else sets(new).unionByName(sets(old).join(new.select("id"), "id", "left_anti"))
    pairs = alike(both, shortlist, "collection").where(F.col("similarity") > shortlist)
    ways = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("new_id"), F.col("b").alias("old_id")), F.struct(F.col("b").alias("new_id"), F.col("a").alias("old_id")))).alias("p"), "similarity").select("p.*", "similarity")
    if new is not old:
        ways = ways.join(new.select(F.col("id").alias("new_id")), "new_id", "left_semi").join(old.select(F.col("id").alias("old_id")), "old_id", "left_semi")
    return top_per(ways, ["new_id"], [F.desc(F.round("similarity", 9)), F.col("old_id")], 1, "r").select("new_id", "old_id", "similarity")


def needing_vectors(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    return docs.where("active").join(vectors.select("id"), "id", "left_anti")


def stale_vectors(vectors: DataFrame, docs: DataFrame) -> DataFrame:
    return vectors.join(docs.where("active").select("id"), "id", "left_anti")


def retain_newest(df: DataFrame, keys: list[str], at: str, tie: str, n: int) -> DataFrame:
    return top_per(df, keys, [F.desc(at), F.desc(tie)], n, "age_rank").drop("age_rank")


def next_retry(failed_at: Column, attempts: Column) -> Column:
    """1 m, 5 m, 30 m, 2 h, 12 h after the failure, then 12 h again."""
    minutes = F.element_at(F.array(*map(F.lit, [1, 5, 30, 120, 720])), F.least(F.greatest(attempts, F.lit(1)), F.lit(5)).cast("int"))
    return failed_at + F.make_dt_interval(mins=minutes)
