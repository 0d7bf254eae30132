"""Worklists and audits over a vault's tables: fragments, orphans, witnesses, taint, counters, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaultframe.operators.windows import top_per

# Fixed values.
ATTEMPTS, NUDGE_AFTER = 3, 15
LIFECYCLE_ACTIONS = ["memory_pin", "memory_forget", "memory_snooze", "lifecycle-archive"]
OBSERVATION_LANE = "collection = '_internal' and path like 'observations/%' and observation_type is not null"


def observation_lane(docs: DataFrame) -> DataFrame:
    """Documents(collection, path, observation_type) that hold observations."""
    return docs.where(OBSERVATION_LANE)


def needing_fragments(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(hash, collection, path, title) of contents without any or without their first fragment, or left
    pending or failed, tried fewer than three times. The alias is the least collection/path of the active
    documents that qualify; one aggregate finds it, so nothing is joined back.
    """
    have = vectors.groupBy("hash").agg(F.max((F.col("seq") == 0).cast("int")).alias("first"), F.max(F.col("fragment_type").isNotNull().cast("int")).alias("any"))
    due = (F.coalesce("first", F.lit(0)) == 0) | (F.coalesce("any", F.lit(0)) == 0) | F.col("embed_state").isin("pending", "failed")
    todo = docs.where(F.col("active") & (F.coalesce("embed_attempts", F.lit(0)) < ATTEMPTS)).join(have, "hash", "left").where(due)
    alias = F.min(F.struct(F.concat("collection", F.lit("/"), "path").alias("key"), "collection", "path", "title")).alias("d")
    return todo.groupBy("hash").agg(alias).select("hash", "d.collection", "d.path", "d.title")


def orphans(content: DataFrame, docs: DataFrame) -> DataFrame:
    """Contents that no document names."""
    return content.join(docs.select("hash"), "hash", "left_anti")


def unwitnessed(relations: DataFrame, docs: DataFrame, sightings: DataFrame) -> DataFrame:
    """Causal edges inside the observation lane without a sighting, with a fingerprint of the edge."""
    lane = observation_lane(docs).select("id")
    ends = relations.where("relation_type = 'causal'")
    for end in ("source_id", "target_id"):
        ends = ends.join(lane.withColumnRenamed("id", end), end, "left_semi")
    print_of = F.sha2(F.concat_ws("|", F.lit("v1"), F.round("weight", 6).cast("string")), 256)
    return ends.join(sightings.select("source_id", "target_id"), ["source_id", "target_id"], "left_anti").select("source_id", "target_id", "weight", print_of.alias("fingerprint"))


def tainted_notes(docs: DataFrame, evolution: DataFrame, floor: int) -> DataFrame:
    """(id) of active ordinary documents with a suspect evolution entry that no later reset cleared.

    Suspect: triggered by a legacy document, or written by nobody known after entry ``floor``. The latest
    reset of a note is one aggregate, which replaces the comparison with every later entry.
    """
    legacy = docs.where("legacy").select(F.col("id").alias("triggered_by"))
    suspects = evolution.join(legacy, "triggered_by", "left_semi").select("memory_id", "id").unionByName(evolution.where(F.col("writer").isNull() & (F.col("id") > floor)).select("memory_id", "id"))
    resets = evolution.where("is_reset").groupBy("memory_id").agg(F.max("id").alias("reset_id"))
    open_ = suspects.groupBy("memory_id").agg(F.max("id").alias("id")).join(resets, "memory_id", "left").where("reset_id is null or reset_id <= id")
    return docs.where("active and not legacy").join(open_.select(F.col("memory_id").alias("id")), "id", "left_semi").select("id")


def embed_stats(docs: DataFrame) -> DataFrame:
    """(pending, synced, failed) of active documents; no state counts as pending."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    s = F.col("embed_state")
    return docs.where("active").agg(n(s.isNull() | (s == "pending")).alias("pending"), n(F.coalesce(s == "synced", F.lit(False))).alias("synced"), n(F.coalesce(s == "failed", F.lit(False))).alias("failed"))


def index_health(docs: DataFrame, vectors: DataFrame, now: Column) -> DataFrame:
    """(needs_embedding, total_docs, days_stale): contents without a first vector, active documents, whole days
    since the newest change (null without documents)."""
    first = vectors.where("seq = 0").select("hash", F.lit(1).alias("has")).distinct()
    active = docs.where("active").join(first, "hash", "left")
    newest = F.max("modified_at")
    seconds = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(newest.cast("timestamp"))
    return active.agg(F.countDistinct(F.when(F.col("has").isNull(), F.col("hash"))).alias("needs_embedding"), F.count("*").alias("total_docs"), F.floor(seconds / 86400).alias("days_stale"))


def embed_states(docs: DataFrame, steps: DataFrame) -> DataFrame:
    """(hash, embed_state, embed_attempts, embed_error) after steps(hash, at, step, error) in order of ``at``.

    start: pending, one attempt more. synced: no attempts any more. failed: the error stays.
    """
    by = Window.partitionBy("hash")
    marked = steps.withColumn("synced_at", F.max(F.when(F.col("step") == "synced", F.col("at"))).over(by))
    since = (F.col("step") == "start") & (F.col("synced_at").isNull() | (F.col("at") > F.col("synced_at")))
    last = marked.groupBy("hash").agg(F.max_by("step", "at").alias("step"), F.max_by("error", "at").alias("error"), F.sum(since.cast("long")).alias("starts"), F.max("synced_at").alias("synced_at"))
    both = docs.where("active").select("hash", "embed_state", "embed_attempts", "embed_error").join(last, "hash", "left")
    state = F.when(F.col("step") == "start", "pending").when(F.col("step").isNotNull(), F.col("step")).otherwise(F.col("embed_state"))
    tries = F.when(F.col("synced_at").isNull(), F.coalesce("embed_attempts", F.lit(0))).otherwise(0) + F.coalesce("starts", F.lit(0))
    error = F.when(F.col("step").isNull(), F.col("embed_error")).when(F.col("step") == "failed", F.col("error"))
    return both.select("hash", state.alias("embed_state"), tries.alias("embed_attempts"), error.alias("embed_error"))


def usage_since_action(usage: DataFrame, surfacing: str = "context-surfacing", actions: list[str] = LIFECYCLE_ACTIONS) -> DataFrame:
    """(n, nudge): surfacings of usage(id, hook_name) after the last lifecycle action; one row."""
    last = usage.where(F.col("hook_name").isin(*actions)).agg(F.coalesce(F.max("id"), F.lit(0)).alias("last_id"))
    n = usage.where(F.col("hook_name") == surfacing).join(F.broadcast(last), F.col("id") > F.col("last_id")).agg(F.count("*").alias("n"))
    return n.select("n", (F.col("n") >= NUDGE_AFTER).alias("nudge"))


def archived_search(docs: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """(id, collection, path, title, archived_at, score) of archived documents that hold the text in a field."""
    like = lambda c: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(text.lower()))
    found = docs.where(~F.col("active") & F.col("archived_at").isNotNull() & (like("title") | like("path") | like("collection") | like("body")))
    return found.orderBy("id").limit(limit).select("id", "collection", "path", "title", "archived_at", F.lit(1.0).alias("score"))


def stale_batch(docs: DataFrame, recalled: DataFrame, types: list[str], limit: int) -> DataFrame:
    """(id, stale_since) of active documents of the types, the longest not recalled, read or changed first."""
    since = F.coalesce("last_recalled_at", "last_accessed_at", "modified_at")
    d = docs.where(F.col("active") & F.col("content_type").isin(*types)).join(recalled.select("id", "last_recalled_at"), "id", "left")
    return d.withColumn("stale_since", since).orderBy("stale_since", "modified_at", "id").limit(limit).select("id", "stale_since")


def latest_window(docs: DataFrame, new: DataFrame, n: int = 5, at: Column | None = None) -> DataFrame:
    """(id, effective_at) of the n latest active lane documents that are not new(id), all three times up to ``at``."""
    d = observation_lane(docs).where("active and invalidated_at is null").join(new.select("id"), "id", "left_anti")
    d = d.withColumn("effective_at", F.coalesce("authored_at", "modified_at"))
    if at is not None:
        d = d.where((F.col("created_at") <= at) & (F.col("modified_at") <= at) & (F.col("effective_at") <= at))
    return d.orderBy(F.desc("effective_at"), F.desc("id")).limit(n).select("id", "effective_at")


def by_request_terms(rows: DataFrame, requests: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Rows of a key with ``hits`` and ``place``: by how many words (over three letters) of its request they hold, then in order."""
    terms = requests.select(key, F.filter(F.split(F.lower("request"), r"\s+"), lambda t: F.length(t) > 3).alias("__terms"))
    hits = F.size(F.filter(F.coalesce("__terms", F.array().cast("array<string>")), lambda t: F.contains(F.lower(F.col(text)), t)))
    counted = rows.join(terms, key, "left").withColumn("hits", hits).drop("__terms")
    return top_per(counted, [key], [F.desc("hits"), F.col(order)], None, "place")


def counter_repair(docs: DataFrame, ledger: DataFrame) -> DataFrame:
    """(id, before_count, before_at, after_count, after_at) of documents whose counters differ from the ledger's references."""
    refs = ledger.where("referenced_at is not null").groupBy("id").agg(F.count("*").alias("after_count"), F.max("referenced_at").alias("after_at"))
    both = docs.select("id", F.col("access_count").alias("before_count"), F.col("last_accessed_at").alias("before_at")).join(refs, "id", "left")
    both = both.withColumn("after_count", F.coalesce("after_count", F.lit(0)))
    return both.where(~(F.col("before_count").eqNullSafe(F.col("after_count")) & F.col("before_at").eqNullSafe(F.col("after_at"))))


def apply_repair(docs: DataFrame, images: DataFrame, side: str = "after") -> DataFrame:
    """Documents with the images' counters; ``before`` puts the old ones back where the repair's still stand."""
    i = images.select("id", F.lit(True).alias("__hit"), F.col("after_count").alias("__now"), F.col(f"{side}_count").alias("__count"), F.col(f"{side}_at").alias("__at"))
    hit = F.coalesce("__hit", F.lit(False)) & (F.lit(side == "after") | F.col("access_count").eqNullSafe(F.col("__now")))
    d = docs.join(i, "id", "left").withColumn("__hit", hit)
    return d.withColumns({"access_count": F.when(F.col("__hit"), F.col("__count")).otherwise(F.col("access_count")), "last_accessed_at": F.when(F.col("__hit"), F.col("__at")).otherwise(F.col("last_accessed_at"))}).select(docs.columns)


def curator_report(docs: DataFrame, collections: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """One row: active, pinned, archive candidates, weak documents, never read (and their share), documents of no collection."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    known = collections.select("collection", F.lit(True).alias("known")).distinct()
    old = F.greatest("modified_at", F.coalesce("last_accessed_at", "modified_at")) < now - F.make_dt_interval(days=F.lit(days))
    a = docs.where("active").join(known, "collection", "left")
    g = a.agg(F.count("*").alias("active"), n(F.col("pinned")).alias("pinned"), n(old & ~F.col("pinned")).alias("sweep"), n(F.col("confidence") < 0.4).alias("weak"), n(F.col("access_count") == 0).alias("never_read"), n(F.col("known").isNull()).alias("orphaned"))
    return g.withColumn("never_read_pct", F.round(F.coalesce(100 * F.col("never_read") / F.nullif("active", F.lit(0)), F.lit(0.0)), 4))


def escalation(candidates: DataFrame, limit: int = 20, cap: int = 4096) -> DataFrame:
    """(qid, reached, allowed, degraded) of candidates(qid, rank, allowed): how far a search that triples its depth
    from 3 x limit goes until ``limit`` are allowed, the cap or the table's end; degraded if the cap cut it short."""
    steps = [3 * limit * 3**i for i in range(12) if 3 * limit * 3**i < cap] + [cap]
    sums = [F.sum((F.col("allowed") & (F.col("rank") <= s)).cast("long")).alias(f"a{i}") for i, s in enumerate(steps)]
    g = candidates.groupBy("qid").agg(F.count("*").alias("total"), *sums)
    reached, allowed = F.least(F.lit(steps[-1]), F.col("total")), F.col(f"a{len(steps) - 1}")
    for i in reversed(range(len(steps) - 1)):
        stops = (F.col(f"a{i}") >= limit) | (F.col("total") <= steps[i])
        reached, allowed = F.when(stops, F.least(F.lit(steps[i]), F.col("total"))).otherwise(reached), F.when(stops, F.col(f"a{i}")).otherwise(allowed)
    return g.select("qid", reached.cast("long").alias("reached"), allowed.alias("allowed"), ((F.lit(cap) < F.col("total")) & (allowed < limit)).alias("degraded"))
