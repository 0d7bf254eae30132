"""The second part of the catalogue: statistics, windows, graphs, facts, lifecycle, text and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vaultframe.functions import temporal, text
from vaultframe.operators import entities, evaluation, fts, graph, lifecycle, stats, windows
from vaultframe.plans import hybrid
from vaultframe.plans.catalogue import _CAND_FTS, INDEX_SQL, PROMPT_TABLE, fields, prompts, query, rounded, searches
from vaultframe.sources import adapter, conversations
from vaultframe.sources.adapter import MENTION_SQL, META_SQL, NOW, RECALL_SQL, RELATION_SQL, SESSION_SQL, TRIPLE_SQL, now, table
from vaultframe.sources.scratch import written

# statistics


@query("recall_stats", f"WITH {RECALL_SQL}, g AS (SELECT doc_id, count(*) AS recall_count, count(DISTINCT query_hash) AS unique_queries, count(DISTINCT surfaced_at::DATE) AS recall_days, sum(search_score) AS total_score, max(search_score) AS max_score, sum(CASE WHEN was_referenced THEN 0 ELSE 1 END)::BIGINT AS negatives, min(surfaced_at) AS first_at, max(surfaced_at) AS last_at, string_agg(DISTINCT strftime(surfaced_at, '%Y-%m-%d'), ',' ORDER BY strftime(surfaced_at, '%Y-%m-%d')) AS days FROM recall GROUP BY doc_id) SELECT doc_id, recall_count, unique_queries, recall_days, round(total_score, 4) AS total_score, round(max_score, 6) AS max_score, negatives, first_at, last_at, days, round(least(1.0, greatest(unique_queries, recall_days) / 5.0::DOUBLE), 6) AS diversity, round(CASE WHEN recall_days <= 1 THEN 0.2 ELSE least(1.0, 0.55 * least(1.0, ln(recall_days) / ln(5)) + 0.45 * least(1.0, date_diff('day', first_at::DATE, last_at::DATE) / 7.0::DOUBLE)) END::DOUBLE, 6) AS spacing FROM g")
def recall_stats(spark, sf):
    return rounded(rounded(stats.recall_stats(adapter.recall_events(spark, sf)), "max_score", "diversity", "spacing"), "total_score", places=4)


@query("memory_stats", f"WITH {META_SQL} SELECT collection, count(*) AS total, sum(active::INT)::BIGINT AS active, sum((NOT active)::INT)::BIGINT AS inactive, sum((active AND pinned)::INT)::BIGINT AS pinned, sum((active AND modified_at >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY)::INT)::BIGINT AS last_7d, sum((active AND modified_at >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY)::INT)::BIGINT AS last_30d, min(CASE WHEN active THEN modified_at END) AS oldest, max(CASE WHEN active THEN modified_at END) AS newest, round(avg(CASE WHEN active THEN confidence END), 6) AS avg_confidence, round(avg(CASE WHEN active THEN access_count END), 6) AS avg_access FROM meta GROUP BY collection")
def memory_stats(spark, sf):
    return rounded(stats.memory_stats(adapter.metadata(spark, sf), now()), "avg_confidence", "avg_access")


@query("median_by_collection", f"WITH {META_SQL} SELECT collection, median(body_length)::DOUBLE AS median FROM meta WHERE active GROUP BY collection")
def median_by_collection(spark, sf):
    return stats.median_by(adapter.metadata(spark, sf).where("active"), ["collection"], "body_length")


@query("nearest_rank_p95", "SELECT event_type, value FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) WHERE r = greatest(1, ceil(n * 0.95))")
def nearest_rank_p95(spark, sf):
    return stats.nearest_rank(table(spark, sf, "events"), ["event_type"], "value", 0.95)


@query("type_counts", f"WITH {META_SQL} SELECT content_type, active, count(*) AS n FROM meta GROUP BY content_type, active")
def type_counts(spark, sf):
    return stats.counts_by(adapter.metadata(spark, sf), "content_type", "active")


@query("lifecycle_stats", f"WITH {META_SQL} SELECT count(*) AS total, sum(active::INT)::BIGINT AS active, sum((NOT active)::INT)::BIGINT AS archived, sum((active AND pinned)::INT)::BIGINT AS pinned, sum((active AND access_count = 0)::INT)::BIGINT AS never_accessed, sum((active AND modified_at < TIMESTAMP '{NOW}' - INTERVAL 30 DAY)::INT)::BIGINT AS stale_30d, sum((active AND modified_at < TIMESTAMP '{NOW}' - INTERVAL 90 DAY)::INT)::BIGINT AS stale_90d, sum((active AND last_accessed_at < TIMESTAMP '{NOW}' - INTERVAL 90 DAY)::INT)::BIGINT AS idle_90d, sum((active AND confidence > 0.5)::INT)::BIGINT AS confident, min(CASE WHEN active THEN modified_at END) AS oldest_active FROM meta")
def lifecycle_stats(spark, sf):
    return stats.lifecycle_stats(adapter.metadata(spark, sf), now())


@query("collection_status", f"WITH {META_SQL} SELECT collection, count(*) AS n, max(modified_at) AS last_modified FROM meta WHERE active GROUP BY collection")
def collection_status(spark, sf):
    return adapter.metadata(spark, sf).where("active").groupBy("collection").agg(F.count("*").alias("n"), F.max("modified_at").alias("last_modified"))


@query("co_activation_pairs", "WITH m AS (SELECT DISTINCT l_orderkey AS g, l_partkey AS i FROM lineitem) SELECT a.i AS a, b.i AS b, count(*) AS n FROM m a JOIN m b ON a.g = b.g AND a.i < b.i GROUP BY ALL")
def co_activation_pairs(spark, sf):
    return entities.co_occurrence(table(spark, sf, "lineitem"), "l_orderkey", "l_partkey")


@query("session_co_activation", f"WITH {RECALL_SQL}, s AS (SELECT session_id, surfaced_at::DATE AS d, doc_id, max(surfaced_at) AS at FROM recall WHERE was_referenced GROUP BY ALL) SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n, max(greatest(a.at, b.at)) AS last_seen FROM s a JOIN s b ON a.session_id = b.session_id AND a.d = b.d AND a.doc_id < b.doc_id GROUP BY ALL")
def session_co_activation(spark, sf):
    e = adapter.recall_events(spark, sf).where("was_referenced").withColumn("s", F.concat_ws("/", "session_id", F.to_date("surfaced_at").cast("string")))
    return stats.co_activation(e, "s", "doc_id", "surfaced_at")


@query("usage_budget", f"WITH {RECALL_SQL} SELECT session_id, count(*) AS n, sum(ceil(search_score * 100))::BIGINT AS tokens, sum(was_referenced::INT)::BIGINT AS referenced, max(surfaced_at) AS last_at FROM recall GROUP BY session_id")
def usage_budget(spark, sf):
    return stats.usage_budget(adapter.recall_events(spark, sf))


@query("recent_rate", "SELECT count(*) AS n FROM events WHERE ts <= TIMESTAMP '2024-01-15 12:00:00' AND ts > TIMESTAMP '2024-01-15 11:00:00'")
def recent_rate(spark, sf):
    return stats.recent_rate(table(spark, sf, "events"), "ts", F.lit("2024-01-15 12:00:00").cast("timestamp_ntz"), 60)


_T = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: length(t) > 3)"


@query("ngram_themes", f"WITH w AS (SELECT {_T} AS w FROM documents), p AS (SELECT unnest(list_concat([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))], [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)])) AS phrase FROM w WHERE len(w) > 1) SELECT phrase, count(*) AS n FROM p GROUP BY phrase HAVING count(*) >= 3 ORDER BY n DESC, length(phrase) DESC, phrase LIMIT 20")
def ngram_themes(spark, sf):
    return stats.phrase_themes(table(spark, sf, "documents"), "text")


@query("grace_histogram", f"WITH {META_SQL}, w AS (SELECT unnest(range(10))::INTEGER AS week), g AS (SELECT floor(date_diff('second', TIMESTAMP '{NOW}', modified_at + INTERVAL 120 DAY) / 604800.0)::INTEGER AS week, count(*) AS n FROM meta WHERE modified_at + INTERVAL 120 DAY >= TIMESTAMP '{NOW}' GROUP BY 1) SELECT w.week, coalesce(g.n, 0) AS n FROM w LEFT JOIN g ON w.week = g.week")
def grace_histogram(spark, sf):
    m = adapter.metadata(spark, sf).withColumn("until", F.col("modified_at") + F.make_dt_interval(days=F.lit(120)))
    return stats.weekly_histogram(m, "until", now())


@query("queue_next_due", "WITH q AS (SELECT event_type AS queue, ts + to_minutes([1, 5, 30, 120, 720][least(event_id % 7 + 1, 5)]) AS due FROM events) SELECT queue, sum((due <= TIMESTAMP '2024-01-15 00:00:00')::INT)::BIGINT AS due_now, min(CASE WHEN due > TIMESTAMP '2024-01-15 00:00:00' THEN due END) AS next_due FROM q GROUP BY queue")
def queue_next_due(spark, sf):
    q = table(spark, sf, "events").select(F.col("event_type").alias("queue"), lifecycle.next_retry(F.col("ts"), F.col("event_id") % 7 + 1).alias("due"))
    return stats.queue_next_due(q, "queue", "due", F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))


# windows and temporal joins


@query("timeline_neighbors", f"WITH {META_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY modified_at, id) AS rn FROM meta WHERE active) SELECT f.id AS focus_id, r.id, (r.rn - f.rn)::INTEGER AS \"offset\", r.modified_at FROM r JOIN r f ON f.id IN (40, 90) AND abs(r.rn - f.rn) <= 5")
def timeline_neighbors(spark, sf):
    m = adapter.metadata(spark, sf).where("active").select("modified_at", "id")
    return windows.neighbours(m, spark.createDataFrame([(40,), (90,)], "id long"), ["modified_at", "id"], 5).select("focus_id", "id", "offset", "modified_at")


@query("temporal_backbone", f"WITH {META_SQL} SELECT id, next_id FROM (SELECT id, lead(id) OVER (ORDER BY modified_at, id) AS next_id FROM meta WHERE active) WHERE next_id IS NOT NULL")
def temporal_backbone(spark, sf):
    return windows.successors(adapter.metadata(spark, sf).where("active").select("modified_at", "id"), ["modified_at", "id"])


@query("sessions", f"WITH {SESSION_SQL} SELECT * FROM sessions")
def sessions(spark, sf):
    return adapter.sessions(spark, sf)


@query("session_correlation", f"WITH {SESSION_SQL}, c AS (SELECT e.event_id, s.session_id, row_number() OVER (PARTITION BY e.event_id ORDER BY s.started_at DESC, s.session_id) AS r FROM events e JOIN sessions s ON e.user_id = s.user_id AND s.started_at <= e.ts AND e.ts <= s.ended_at WHERE e.event_type = 'click') SELECT event_id, session_id FROM c WHERE r = 1")
def session_correlation(spark, sf):
    e = table(spark, sf, "events").where("event_type = 'click'").select("event_id", "user_id", "ts")
    hit = e.join(adapter.sessions(spark, sf).drop("n_events"), "user_id").where("started_at <= ts and ts <= coalesce(ended_at, ts)")
    return windows.top_per(hit, ["event_id"], [F.desc("started_at"), F.col("session_id")], 1).select("event_id", "session_id")


@query("turn_index", f"WITH {RECALL_SQL} SELECT event_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY surfaced_at, event_id) - 1 AS INTEGER) AS turn_index FROM recall")
def turn_index(spark, sf):
    return windows.top_per(adapter.recall_events(spark, sf), ["session_id"], [F.col("surfaced_at"), F.col("event_id")], None).select("event_id", (F.col("rank") - 1).cast("int").alias("turn_index"))


@query("latest_referenced", f"WITH {RECALL_SQL} SELECT session_id, doc_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id, doc_id ORDER BY surfaced_at DESC, event_id DESC) AS r FROM recall) WHERE r = 1")
def latest_referenced(spark, sf):
    return windows.latest_per(adapter.recall_events(spark, sf), ["session_id", "doc_id"], "surfaced_at", "event_id").select("session_id", "doc_id", "event_id")


@query("prompt_dedupe_refresh", "SELECT event_id, coalesce(ts - lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) < INTERVAL 600 MINUTE, false) AS duplicate FROM events")
def prompt_dedupe_refresh(spark, sf):
    return windows.duplicates_with_refresh(table(spark, sf, "events"), ["user_id", "event_type"], "ts", "event_id", 36000).select("event_id", "duplicate")


@query("dedupe_fixed_window", None)
def dedupe_fixed_window(spark, sf):
    return windows.fixed_windows(table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], "ts", "event_id", 36000).select("event_id", "opens", "opened_at")


@query("prior_queries", f"WITH {RECALL_SQL}, p AS (SELECT a.event_id, b.query_hash, max(b.surfaced_at) AS seen FROM recall a JOIN recall b ON a.session_id = b.session_id AND b.surfaced_at < a.surfaced_at AND b.surfaced_at >= a.surfaced_at - INTERVAL 12 HOUR AND a.query_hash <> b.query_hash WHERE a.was_referenced GROUP BY ALL) SELECT event_id, query_hash, r AS rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY event_id ORDER BY seen DESC, query_hash) AS INTEGER) AS r FROM p) WHERE r <= 2")
def prior_queries(spark, sf):
    e = adapter.recall_events(spark, sf)
    a = e.where("was_referenced").select("event_id", "session_id", F.col("query_hash").alias("own"), F.col("surfaced_at").alias("asked_at"))
    b = e.select("session_id", "query_hash", "surfaced_at")
    hit = a.join(b, "session_id").where("surfaced_at < asked_at and surfaced_at >= asked_at - interval 12 hours and own <> query_hash").groupBy("event_id", "query_hash").agg(F.max("surfaced_at").alias("at"))
    return windows.top_per(hit, ["event_id"], [F.desc("at"), F.col("query_hash")], 2).select("event_id", "query_hash", "rank")


@query("pair_unique_both_ways", "WITH j AS (SELECT a.event_id AS turn_id, b.event_id AS usage_id FROM events a JOIN events b ON a.user_id = b.user_id AND json_extract_string(a.props, '$.k') = json_extract_string(b.props, '$.k') AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 2 DAY AND a.event_type = 'view' AND b.event_type = 'click'), c AS (SELECT *, count(*) OVER (PARTITION BY turn_id) AS nt, count(*) OVER (PARTITION BY usage_id) AS nu FROM j) SELECT turn_id, usage_id FROM c WHERE nt = 1 AND nu = 1")
def pair_unique_both_ways(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts", F.get_json_object("props", "$.k").alias("k"))
    a = e.where("event_type = 'view'").select(F.col("event_id").alias("turn_id"), "user_id", "k", F.col("ts").alias("at"))
    b = e.where("event_type = 'click'").select(F.col("event_id").alias("usage_id"), "user_id", "k", "ts")
    j = a.join(b, ["user_id", "k"]).where("ts >= at and ts <= at + interval 2 days")
    counted = j.withColumn("nt", F.count("*").over(Window.partitionBy("turn_id"))).withColumn("nu", F.count("*").over(Window.partitionBy("usage_id")))
    return counted.where("nt = 1 and nu = 1").select("turn_id", "usage_id")


@query("context_budget", f"WITH {META_SQL}, {INDEX_SQL}, {_CAND_FTS}, r AS (SELECT c.qid, c.id, row_number() OVER w AS rn, sum(ceil(m.body_length / 4.0)) OVER (PARTITION BY c.qid ORDER BY round(c.score, 9) DESC, c.id ROWS UNBOUNDED PRECEDING)::BIGINT AS spent FROM cand c JOIN meta m ON m.id = c.id WINDOW w AS (PARTITION BY c.qid ORDER BY round(c.score, 9) DESC, c.id)) SELECT qid, id, spent FROM r WHERE spent <= 3000 OR rn = 1")
def context_budget(spark, sf):
    meta = adapter.metadata(spark, sf)
    found = written(fts.search(fields(spark, sf), searches(spark), 20, hybrid.eligible(meta)).select("qid", "id", "score"), "found")
    sized = found.join(adapter.metadata(spark, sf, found).select("id", "body_length"), "id")
    return windows.within_budget(sized, ["qid"], [F.desc(F.round("score", 9)), F.col("id")], F.ceil(F.col("body_length") / 4), 3000).select("qid", "id", "spent")


# graph


_ELIG = "elig AS (SELECT id FROM meta WHERE active)"


def _typed(kind: str) -> str:
    both = f"UNION ALL SELECT target_id, source_id, weight FROM rel WHERE relation_type = '{kind}'" if kind in graph.SYMMETRIC else ""
    return f"e_{kind} AS (SELECT node, next, weight / sum(weight) OVER (PARTITION BY node) AS share FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY round(weight, 9) DESC, next) AS r FROM (SELECT source_id AS node, target_id AS next, weight FROM rel WHERE relation_type = '{kind}' {both}) WHERE next IN (SELECT id FROM elig)) WHERE r <= 10)"


def _meta_sql(intent: str) -> str:
    kinds = sorted({k for p in graph.META_PATHS[intent] for k in p})
    parts, outs = [_typed(k) for k in kinds], []
    for n, (a, b) in enumerate(graph.META_PATHS[intent]):
        parts.append(f"h{n}a AS (SELECT next AS id, sum(score * 0.85 * share) AS mass FROM anchors JOIN e_{a} ON id = node WHERE score > 1e-4 GROUP BY next)")
        parts.append(f"h{n}b AS (SELECT next AS id, sum(mass * 0.85 * share) AS mass FROM h{n}a JOIN e_{b} ON id = node WHERE mass > 1e-4 GROUP BY next)")
        outs.append(f"SELECT id, sum(p) AS score FROM (SELECT id, score * 0.15 AS p FROM anchors UNION ALL SELECT id, mass * 0.15 FROM h{n}a UNION ALL SELECT id, mass * 0.15 FROM h{n}b) GROUP BY id HAVING sum(p) > 1e-4")
    return f"WITH {META_SQL}, {RELATION_SQL}, {_ELIG}, anchors AS (SELECT doc_id AS id, 1.0::DOUBLE / (1 + doc_id % 5) AS score FROM documents WHERE doc_id % 20 = 0), {', '.join(parts)} SELECT id, round(max(score), 6) AS score FROM ({' UNION ALL '.join(outs)}) GROUP BY id ORDER BY round(max(score), 9) DESC, id LIMIT 30"


def _anchors(spark, sf):
    i = F.col("doc_id")
    return table(spark, sf, "documents").where("doc_id % 20 = 0").select(i.alias("id"), (1.0 / (1 + i % 5)).alias("score"))


def _add_meta_path(intent: str) -> None:
    @query(f"mpfp_{intent.lower()}", _meta_sql(intent))
    def run(spark, sf):
        return rounded(graph.meta_path_search(adapter.relations(spark, sf), _anchors(spark, sf), intent, hybrid.eligible(adapter.metadata(spark, sf))), "score")


for _intent in graph.META_PATHS:
    _add_meta_path(_intent)


@query("beam_traversal", None)
def beam_traversal(spark, sf):
    return rounded(graph.beam(adapter.relations(spark, sf), _anchors(spark, sf), "WHY", hybrid.eligible(adapter.metadata(spark, sf))), "score")


@query("one_hop_causal", f"WITH {META_SQL}, {RELATION_SQL}, {_ELIG}, a AS (SELECT doc_id AS anchor, doc_id AS rank FROM documents WHERE doc_id % 20 = 0), h AS (SELECT anchor, rank, target_id AS id, weight, 'effect' AS d FROM a JOIN rel ON anchor = source_id WHERE relation_type = 'causal' UNION ALL SELECT anchor, rank, source_id, weight, 'cause' FROM a JOIN rel ON anchor = target_id WHERE relation_type = 'causal'), c AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY round(weight, 9) DESC, id, d) AS r FROM h WHERE id IN (SELECT id FROM elig)) SELECT id, min(rank) AS best_rank, round(max(weight), 6) AS best_weight, string_agg(DISTINCT d, ',' ORDER BY d) AS directions FROM c WHERE r <= 3 GROUP BY id ORDER BY best_rank, round(max(weight), 9) DESC, id LIMIT 10")
def one_hop_causal(spark, sf):
    a = table(spark, sf, "documents").where("doc_id % 20 = 0").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("rank"))
    return rounded(graph.one_hop_causal(adapter.relations(spark, sf), a, hybrid.eligible(adapter.metadata(spark, sf))), "best_weight")


@query("causal_chain", f"WITH RECURSIVE {RELATION_SQL}, f(depth, node) AS (SELECT 0, 3::BIGINT UNION ALL SELECT depth + 1, target_id FROM f JOIN rel ON node = source_id AND relation_type = 'causal' WHERE depth < 5), b(depth, node) AS (SELECT 0, 3::BIGINT UNION ALL SELECT depth + 1, source_id FROM b JOIN rel ON node = target_id AND relation_type = 'causal' WHERE depth < 5) SELECT *, false AS truncated FROM (SELECT (f.depth + 1)::INTEGER AS depth, source_id, target_id, round(weight, 6) AS weight, 'effect' AS direction FROM f JOIN rel ON node = source_id AND relation_type = 'causal' WHERE f.depth < 5 UNION ALL SELECT (b.depth + 1)::INTEGER, source_id, target_id, round(weight, 6), 'cause' FROM b JOIN rel ON node = target_id AND relation_type = 'causal' WHERE b.depth < 5)")
def causal_chain(spark, sf):
    return rounded(graph.causal_chain(adapter.relations(spark, sf), 3), "weight")


@query("relation_upsert", f"WITH {RELATION_SQL}, u AS (SELECT * FROM rel UNION ALL SELECT source_id, target_id, relation_type, weight * 1.5 FROM rel WHERE source_id % 2 = 0) SELECT source_id, target_id, relation_type, round(least(1.0, max(least(1.0, greatest(0.0, weight)))), 6)::DOUBLE AS weight FROM u WHERE source_id <> target_id GROUP BY ALL")
def relation_upsert(spark, sf):
    r = adapter.relations(spark, sf)
    return rounded(graph.upsert(r, r.where("source_id % 2 = 0").withColumn("weight", F.col("weight") * 1.5)), "weight")


@query("merge_traversal", "WITH o AS (SELECT doc_id AS id, (doc_id % 10) / 10.0::DOUBLE AS score FROM documents WHERE doc_id % 5 <> 0), t AS (SELECT doc_id AS id, (doc_id % 7 + 1)::DOUBLE AS score FROM documents WHERE doc_id % 3 <> 0), n AS (SELECT id, score / (SELECT max(score) FROM t) AS norm FROM t) SELECT coalesce(o.id, n.id) AS id, round(CASE WHEN norm IS NULL THEN score WHEN score IS NULL THEN 0.8 * norm ELSE greatest(score, 1.1 * norm) END, 6)::DOUBLE AS score FROM o FULL OUTER JOIN n ON o.id = n.id")
def merge_traversal(spark, sf):
    d = table(spark, sf, "documents")
    a = d.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 10 / 10).alias("score"))
    b = d.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 7 + 1).cast("double").alias("score"))
    return rounded(graph.merge_traversal(a, b), "score")


@query("active_relations", f"WITH {META_SQL}, {RELATION_SQL} SELECT relation_type, count(*) AS n FROM rel WHERE source_id IN (SELECT id FROM meta WHERE active) AND target_id IN (SELECT id FROM meta WHERE active) GROUP BY relation_type")
def active_relations(spark, sf):
    return graph.edges_within(adapter.relations(spark, sf), hybrid.eligible(adapter.metadata(spark, sf)).select("id")).groupBy("relation_type").agg(F.count("*").alias("n"))


# entities and facts


def _n_docs(spark, sf):
    return table(spark, sf, "orders").agg(F.count("*").alias("n_docs"))


_IDF = "idf AS (SELECT entity_id, count(DISTINCT doc_id) AS df, ln(((SELECT count(*) FROM orders) + 1)::DOUBLE / (count(DISTINCT doc_id) + 1)) AS idf FROM mentions GROUP BY entity_id)"


@query("entity_idf_edges", f"WITH {MENTION_SQL}, {_IDF}, h AS (SELECT s.doc_id AS source_id, t.doc_id AS target_id, s.entity_id, row_number() OVER (PARTITION BY s.doc_id, s.entity_id ORDER BY t.doc_id) AS r FROM mentions s JOIN mentions t ON s.entity_id = t.entity_id AND s.doc_id <> t.doc_id WHERE s.doc_id % 20 = 0), g AS (SELECT source_id, target_id, max(idf) AS best, count(*) AS shared FROM h JOIN idf USING (entity_id) WHERE r <= 20 GROUP BY ALL) SELECT source_id, target_id, round(least(1.0, 0.3 + 0.12 * best + least(0.15, 0.05 * (shared - 1))), 6)::DOUBLE AS weight, shared FROM g WHERE best >= 3")
def entity_idf_edges(spark, sf):
    m = adapter.mentions(spark, sf)
    return rounded(entities.specific_edges(m, m.where("doc_id % 20 = 0").select("doc_id").distinct(), _n_docs(spark, sf)), "weight")


@query("entity_neighbors", f"WITH {MENTION_SQL}, {_IDF}, own AS (SELECT DISTINCT entity_id FROM mentions WHERE doc_id IN (1, 2, 3)), p AS (SELECT a.entity_id AS a, b.entity_id AS b, count(*) AS n FROM mentions a JOIN mentions b ON a.doc_id = b.doc_id AND a.entity_id < b.entity_id GROUP BY ALL), nb AS (SELECT CASE WHEN a IN (SELECT entity_id FROM own) THEN b ELSE a END AS entity_id, max(n) AS n FROM p WHERE a IN (SELECT entity_id FROM own) OR b IN (SELECT entity_id FROM own) GROUP BY 1), sc AS (SELECT entity_id, least(1.0, ln(1 + n) / 5) * greatest(0, least(1.0, idf / 3)) AS score FROM nb JOIN idf USING (entity_id) ORDER BY round(least(1.0, ln(1 + n) / 5) * greatest(0, least(1.0, idf / 3)), 9) DESC, entity_id LIMIT 30), d AS (SELECT m.doc_id, sc.score, sc.entity_id, row_number() OVER (PARTITION BY sc.entity_id ORDER BY m.doc_id) AS r FROM mentions m JOIN sc USING (entity_id)), f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, entity_id) AS k FROM d WHERE r <= 10 AND doc_id NOT IN (1, 2, 3)) SELECT doc_id, round(score, 6)::DOUBLE AS score, entity_id AS via FROM f WHERE k = 1 ORDER BY round(score, 9) DESC, doc_id LIMIT 20")
def entity_neighbors(spark, sf):
    m = adapter.mentions(spark, sf)
    seeds = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    return rounded(entities.neighbours(m, entities.pairs_near(m, seeds), seeds, _n_docs(spark, sf)), "score")


_RATIO = "1 - levenshtein(lower(n.name), lower(e.name))::DOUBLE / greatest(length(n.name), length(e.name))"


@query("entity_fuzzy_resolve", rf"WITH e AS (SELECT p_partkey AS id, p_name AS name FROM part), n AS (SELECT DISTINCT substr(p_name, 1, length(p_name) - 1) || 'x' AS name FROM part), tk AS (SELECT name, unnest(list_distinct({r"list_filter(regexp_split_to_array(lower(name), '[^\p{L}\p{N}]+'), lambda t: t <> '')"})) AS w FROM n), te AS (SELECT id, name, unnest(list_distinct({r"list_filter(regexp_split_to_array(lower(name), '[^\p{L}\p{N}]+'), lambda t: t <> '')"})) AS w FROM e), c AS (SELECT DISTINCT tk.name AS nn, te.id FROM tk JOIN te USING (w)), s AS (SELECT n.name, e.id AS entity_id, e.name AS entity_name, {_RATIO} AS ratio FROM c JOIN n ON n.name = c.nn JOIN e ON e.id = c.id WHERE regexp_extract_all(n.name, '\d+') = regexp_extract_all(e.name, '\d+')) SELECT name, entity_id, entity_name, round(ratio, 6) AS ratio FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY round(ratio, 9) DESC, entity_id) AS r FROM s WHERE ratio >= 0.75) WHERE r = 1")
def entity_fuzzy_resolve(spark, sf):
    p = table(spark, sf, "part")
    names = p.select(F.concat(F.expr("substr(p_name, 1, length(p_name) - 1)"), F.lit("x")).alias("name"))
    return rounded(entities.resolve(names, p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))), "ratio")


@query("kg_asof", f"WITH {TRIPLE_SQL} SELECT id, subject, object, valid_from, valid_to FROM triples WHERE (valid_from IS NULL OR valid_from <= TIMESTAMP '1996-06-01') AND (valid_to IS NULL OR valid_to >= TIMESTAMP '1996-06-01')")
def kg_asof(spark, sf):
    return entities.as_of(adapter.triples(spark, sf), F.lit("1996-06-01 00:00:00").cast("timestamp_ntz")).select("id", "subject", "object", "valid_from", "valid_to")


@query("kg_latest_evidence", f"WITH {TRIPLE_SQL} SELECT subject, object, id FROM (SELECT *, row_number() OVER (PARTITION BY subject, object ORDER BY valid_from DESC, id DESC) AS r FROM triples) WHERE r <= 2")
def kg_latest_evidence(spark, sf):
    return windows.latest_per(adapter.triples(spark, sf), ["subject", "object"], "valid_from", "id", 2).select("subject", "object", "id")


@query("kg_stats", f"WITH {TRIPLE_SQL} SELECT count(*) AS total, sum((valid_to IS NULL OR valid_to >= TIMESTAMP '1997-01-01')::INT)::BIGINT AS open, sum((valid_to < TIMESTAMP '1997-01-01')::INT)::BIGINT AS expired, count(DISTINCT predicate) AS predicates FROM triples")
def kg_stats(spark, sf):
    return entities.triple_stats(adapter.triples(spark, sf), F.lit("1997-01-01 00:00:00").cast("timestamp_ntz"))


@query("kg_names", "SELECT o.o_orderkey AS id, coalesce(c.c_name, o.o_custkey::VARCHAR) AS subject_name, n.n_name AS nation FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey")
def kg_names(spark, sf):
    o, c, n = table(spark, sf, "orders"), table(spark, sf, "customer"), table(spark, sf, "nation")
    return o.join(c, o.o_custkey == c.c_custkey, "left").join(n, c.c_nationkey == n.n_nationkey, "left").select(F.col("o_orderkey").alias("id"), F.coalesce("c_name", F.col("o_custkey").cast("string")).alias("subject_name"), F.col("n_name").alias("nation"))


@query("witness_projection", f"WITH {TRIPLE_SQL}, a AS (SELECT *, row_number() OVER (PARTITION BY subject, object ORDER BY confidence DESC, valid_from DESC, id DESC) AS rn, max(valid_from) OVER (PARTITION BY subject, object) AS newest FROM triples), b AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY confidence DESC, newest DESC, object) AS pair_rank, count(*) OVER (PARTITION BY subject) AS pairs FROM a WHERE rn = 1) SELECT subject, object, id, CAST(pair_rank AS INTEGER) AS pair_rank, pairs FROM b WHERE pair_rank <= 3")
def witness_projection(spark, sf):
    pair = Window.partitionBy("subject", "object")
    a = adapter.triples(spark, sf).withColumn("newest", F.max("valid_from").over(pair)).withColumn("rn", F.row_number().over(pair.orderBy(F.desc("confidence"), F.desc("valid_from"), F.desc("id")))).where("rn = 1")
    b = a.withColumn("pairs", F.count("*").over(Window.partitionBy("subject")))
    return windows.top_per(b, ["subject"], [F.desc("confidence"), F.desc("newest"), F.col("object")], 3, "pair_rank").select("subject", "object", "id", "pair_rank", "pairs")


@query("verified_pairs", "WITH l AS (SELECT DISTINCT user_id, event_id % 50 AS doc FROM events WHERE event_type = 'click') SELECT a.doc AS a, b.doc AS b, count(*) AS n FROM l a JOIN l b ON a.user_id = b.user_id AND a.doc < b.doc GROUP BY ALL")
def verified_pairs(spark, sf):
    ledger = table(spark, sf, "events").where("event_type = 'click'").select("user_id", (F.col("event_id") % 50).alias("doc"))
    return entities.co_occurrence(ledger, "user_id", "doc")


# lifecycle and similarity


_ARCHIVE = "CASE content_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in lifecycle.ARCHIVE_DAYS.items()) + " END"


@query("archive_candidates", f"WITH {META_SQL} SELECT id, content_type, modified_at FROM meta WHERE active AND NOT pinned AND {_ARCHIVE} IS NOT NULL AND modified_at < TIMESTAMP '{NOW}' - to_days({_ARCHIVE}) AND last_accessed_at < TIMESTAMP '{NOW}' - to_days({_ARCHIVE})")
def archive_candidates(spark, sf):
    return lifecycle.archive_candidates(adapter.metadata(spark, sf), now()).select("id", "content_type", "modified_at")


@query("archive_apply", f"WITH {META_SQL} SELECT id, active AND NOT ({_ARCHIVE} IS NOT NULL AND NOT pinned AND modified_at < TIMESTAMP '{NOW}' - to_days({_ARCHIVE}) AND last_accessed_at < TIMESTAMP '{NOW}' - to_days({_ARCHIVE})) IS TRUE AS active FROM meta")
def archive_apply(spark, sf):
    m = adapter.metadata(spark, sf)
    return lifecycle.archive(m, lifecycle.archive_candidates(m, now()), now()).select("id", "active")


@query("apply_contradictions", f"WITH {META_SQL}, o AS (SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'contradiction' ELSE 'update' END AS kind, (doc_id % 10) / 10.0::DOUBLE AS c FROM documents WHERE doc_id % 3 = 0), d AS (SELECT id, bool_or(kind = 'contradiction') AS against, bool_or(kind = 'update') AS updated FROM o WHERE c >= 0.7 GROUP BY id) SELECT meta.id, round(CASE WHEN against THEN greatest(0.2, confidence - 0.25) WHEN updated THEN greatest(0.3, confidence - 0.15) ELSE confidence END, 6)::DOUBLE AS confidence FROM meta LEFT JOIN d ON d.id = meta.id")
def apply_contradictions(spark, sf):
    i = F.col("doc_id")
    o = table(spark, sf, "documents").where("doc_id % 3 = 0").select(i.alias("id"), F.when(i % 2 == 0, "contradiction").otherwise("update").alias("kind"), (i % 10 / 10).alias("confidence"))
    return rounded(lifecycle.apply_contradictions(adapter.metadata(spark, sf), o).select("id", "confidence"), "confidence")


@query("trend_labels", f"WITH {META_SQL}, t AS (SELECT id, date_diff('day', modified_at, TIMESTAMP '{NOW}') AS age, date_diff('day', last_accessed_at, TIMESTAMP '{NOW}') AS idle, access_count FROM meta) SELECT id, CASE WHEN age < 7 THEN 'NEW' WHEN idle > 60 THEN 'STALE' WHEN idle > 30 THEN 'WEAKENING' WHEN access_count >= 4 AND idle < 14 THEN 'STRENGTHENING' ELSE 'STABLE' END AS trend FROM t")
def trend_labels(spark, sf):
    at = lambda c: temporal.days_between(now(), F.col(c))
    return adapter.metadata(spark, sf).select("id", temporal.trend(at("modified_at"), at("last_accessed_at"), F.col("access_count")).alias("trend"))


_GRAM = "[s[i:i + 2] FOR i IN range(1, length(s) - 1)]"
_NORM = "trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("trigram_cosine_pairs", f"WITH l AS (SELECT n_nationkey AS id, {_NORM.format("n_name || ' ' || n_name || ' nation'")} AS s FROM nation), g AS (SELECT id, unnest({_GRAM}) AS x FROM l), c AS (SELECT id, x, count(*) AS n FROM g GROUP BY ALL), m AS (SELECT id, sqrt(sum(n * n)) AS m FROM c GROUP BY id), d AS (SELECT a.id AS a, b.id AS b, sum(a.n * b.n)::DOUBLE AS dot FROM c a JOIN c b ON a.x = b.x AND a.id < b.id GROUP BY ALL) SELECT d.a, d.b, round(dot / (x.m * y.m), 6) AS similarity FROM d JOIN m x ON x.id = d.a JOIN m y ON y.id = d.b")
def trigram_cosine_pairs(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.explode(text.trigrams(F.concat("n_name", F.lit(" "), "n_name", F.lit(" nation")))).alias("x")).groupBy("id", "x").agg(F.count("*").alias("n"))
    m = n.groupBy("id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("m"))
    d = n.select(F.col("id").alias("a"), "x", F.col("n").alias("na")).join(n.select(F.col("id").alias("b"), "x", F.col("n").alias("nb")), "x").where("a < b").groupBy("a", "b").agg(F.sum(F.col("na") * F.col("nb")).alias("dot"))
    out = d.join(m.select(F.col("id").alias("a"), F.col("m").alias("ma")), "a").join(m.select(F.col("id").alias("b"), F.col("m").alias("mb")), "b")
    return rounded(out.select("a", "b", (F.col("dot") / (F.col("ma") * F.col("mb"))).alias("similarity")), "similarity")


@query("merge_gate", None)
def merge_gate(spark, sf):
    t = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    pairs = t.select("conv_id", "turn", F.col("text").alias("a_text")).join(t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b_text")), ["conv_id", "turn"])
    return rounded(lifecycle.merge_gate(pairs).select("conv_id", "turn", "similarity", "accepted"), "similarity")


_ALIKE = r"""w AS (SELECT source AS collection, doc_id AS id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: length(x) > 2))) AS w FROM documents),
n AS (SELECT id, count(*) AS n FROM w GROUP BY id), p AS (SELECT a.id AS new_id, b.id AS old_id, count(*) AS k FROM w a JOIN w b ON a.collection = b.collection AND a.w = b.w AND a.id <> b.id GROUP BY ALL),
s AS (SELECT new_id, old_id, k::DOUBLE / (x.n + y.n - k) AS similarity FROM p JOIN n x ON new_id = x.id JOIN n y ON old_id = y.id)"""


def _observations(spark, sf):
    return table(spark, sf, "documents").select(F.col("source").alias("collection"), F.col("doc_id").alias("id"), "text")


@query("similar_observation", f"WITH {_ALIKE} SELECT new_id, old_id, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY round(similarity, 9) DESC, old_id) AS r FROM s WHERE similarity > 0.5) WHERE r = 1")
def similar_observation(spark, sf):
    d = _observations(spark, sf)
    return rounded(lifecycle.similar_observation(d, d), "similarity")


@query("save_memory", None)
def save_memory(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("collection"), F.col("event_type").alias("content_type"), F.col("props").alias("body"), F.col("ts").alias("at"), F.col("event_id").alias("id"))
    return lifecycle.save(e, minutes=600)


@query("retain_newest", "SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 10")
def retain_newest(spark, sf):
    return lifecycle.retain_newest(table(spark, sf, "events"), ["user_id"], "ts", "event_id", 10).select("event_id", "user_id")


# conversations and text


@query("exchange_chunks", "WITH n AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS exchange FROM conversations WHERE role IN ('user', 'assistant')) SELECT conv_id, exchange, min(turn) AS first_turn, string_agg(text, chr(10) ORDER BY turn) AS text FROM n WHERE exchange > 0 GROUP BY conv_id, exchange HAVING length(string_agg(text, chr(10) ORDER BY turn)) >= 30")
def exchange_chunks(spark, sf):
    return conversations.exchanges(table(spark, sf, "conversations"))


@query("turn_segmentation", "SELECT conv_id, turn, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM conversations")
def turn_segmentation(spark, sf):
    return windows.segments(table(spark, sf, "conversations"), ["conv_id"], ["turn"], F.col("role") == "user").select("conv_id", "turn", "segment")


@query("decision_sentences", None)
def decision_sentences(spark, sf):
    return conversations.extract_sentences(table(spark, sf, "conversations"), r"\b(the|und|de)\b")


@query("transcript_priority", "WITH p AS (SELECT conv_id, turn, text, CASE WHEN turn = min(CASE WHEN role = 'user' THEN turn END) OVER w THEN 0 WHEN turn = max(CASE WHEN role = 'assistant' THEN turn END) OVER w THEN 1 WHEN role = 'tool' THEN 2 ELSE 3 END AS priority FROM conversations WINDOW w AS (PARTITION BY conv_id)), s AS (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY priority, turn DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS spent FROM p) SELECT conv_id, turn, priority, spent FROM s WHERE priority <= 1 OR spent <= 800")
def transcript_priority(spark, sf):
    return conversations.priority(table(spark, sf, "conversations"), 800).select("conv_id", "turn", "priority", "spent")


_P = PROMPT_TABLE


def _rx(column: str, *patterns: str) -> str:
    joined = "|".join(f"(?:{p})" for p in patterns).replace("'", "''")
    return f"regexp_matches({column}, '(?i){joined}')"


@query("intent_classify", f"WITH s AS (SELECT pid, CASE WHEN {_rx('lower(prompt)', text.WHY)} THEN 3 ELSE 0 END + CASE WHEN regexp_matches(lower(prompt), '^why\\b') THEN 2 ELSE 0 END AS why, CASE WHEN {_rx('lower(prompt)', text.WHEN)} THEN 3 ELSE 0 END + CASE WHEN {_rx('lower(prompt)', *temporal.ALL_SPANS)} THEN 2 ELSE 0 END + CASE WHEN regexp_matches(lower(prompt), '^when\\b') THEN 2 ELSE 0 END AS whn, CASE WHEN {_rx('lower(prompt)', text.ENTITY)} THEN 3 ELSE 0 END + CASE WHEN regexp_matches(lower(prompt), '^who\\b') THEN 2 ELSE 0 END AS ent FROM {_P}) SELECT pid, CASE WHEN greatest(why, whn, ent) = 0 THEN 'WHAT' WHEN why = greatest(why, whn, ent) THEN 'WHY' WHEN whn = greatest(why, whn, ent) THEN 'WHEN' ELSE 'ENTITY' END AS intent, CASE WHEN greatest(why, whn, ent) = 0 THEN 0.6 ELSE least(95, 60 + greatest(why, whn, ent) * 10) / 100.0 END::DOUBLE AS confidence FROM s")
def intent_classify(spark, sf):
    return prompts(spark, sf).select("pid", text.intent("prompt").alias("i")).select("pid", "i.intent", "i.confidence")


@query("mode_classify", f"SELECT pid, CASE WHEN {_rx('lower(prompt)', text.TIMELINE_SIGNAL)} THEN 'timeline' WHEN {_rx('lower(prompt)', text.CAUSAL_SIGNAL, '^why\\b')} THEN 'causal' WHEN {_rx('lower(prompt)', text.DISCOVERY_SIGNAL)} THEN 'discovery' WHEN {_rx('lower(prompt)', *text.COMPLEX_SIGNALS)} THEN 'complex' WHEN length(prompt) < 50 AND (regexp_matches(prompt, '[A-Z][A-Z0-9_]{{2,}}') OR regexp_matches(lower(prompt), '[\\w-]+\\.\\w{{2,4}}\\b') OR regexp_matches(lower(prompt), '\\b(config|setting|error|path|file|port|url)\\b')) THEN 'keyword' WHEN {_rx('lower(prompt)', text.SEMANTIC_SIGNAL)} THEN 'semantic' ELSE 'hybrid' END AS mode FROM {_P}")
def mode_classify(spark, sf):
    return prompts(spark, sf).select("pid", text.retrieval_mode("prompt").alias("mode"))


_DAY = "DATE '2024-02-01'"


def _first_of(pattern: str) -> str:
    """The first day of the month that the pattern names, this year's if it names none."""
    name = f"substr(regexp_extract(q, '{pattern}', 1), 1, 3)"
    months = "['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec']"
    return f"make_date(coalesce(try_cast(nullif(regexp_extract(q, '{pattern}', 2), '') AS INTEGER), 2024), greatest(1, coalesce(list_position({months}, {name}), 1)), 1)"


def _count_in(pattern: str) -> str:
    return f"coalesce(try_cast(regexp_extract(q, '{pattern}', 1) AS INTEGER), 0)"


_SPANS = [
    (temporal.TODAY, _DAY, _DAY), (temporal.YESTERDAY, f"{_DAY} - 1", f"{_DAY} - 1"), (temporal.THIS_WEEK, f"{_DAY} - 4", _DAY), (temporal.LAST_WEEK, f"{_DAY} - 7", _DAY), (temporal.THIS_MONTH, _DAY, _DAY), (temporal.LAST_MONTH, "DATE '2024-01-01'", _DAY),
    (temporal.DAYS_AGO, f"{_DAY} - {_count_in(temporal.DAYS_AGO)}", _DAY), (temporal.WEEKS_AGO, f"{_DAY} - 7 * {_count_in(temporal.WEEKS_AGO)}", _DAY), (temporal.MONTHS_AGO, f"CAST({_DAY} - to_months({_count_in(temporal.MONTHS_AGO)}) AS DATE)", _DAY),
    (temporal.SINCE_MONTH, _first_of(temporal.SINCE_MONTH), _DAY), (temporal.IN_MONTH, _first_of(temporal.IN_MONTH), f"last_day({_first_of(temporal.IN_MONTH)})"), (temporal.LAST_DAYS, f"{_DAY} - {_count_in(temporal.LAST_DAYS)}", _DAY),
]
_CASE = lambda n: "CASE " + " ".join(f"WHEN regexp_matches(q, '{s[0]}') THEN {s[n]}" for s in _SPANS) + " END"


@query("temporal_constraint", f"WITH l AS (SELECT pid, lower(prompt) AS q FROM {_P}) SELECT pid, {_CASE(1)} AS start_day, {_CASE(2)} AS end_day FROM l")
def temporal_constraint(spark, sf):
    return prompts(spark, sf).select("pid", temporal.temporal_constraint("prompt", now()).alias("c")).select("pid", "c.start_day", "c.end_day")


_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_BARE = _STRIP.format(r"regexp_replace(" + _STRIP.format(r"regexp_replace(" + _STRIP.format(r"regexp_replace(" + _STRIP.format("prompt") + r", '(?im)^(Conversation info|Sender) \(untrusted metadata\):[\s\S]*?\n\s*\n', '', 'g')") + r", '(?i)^\[cron:[^\]]+\]\s*', '', 'g')") + r", '^\[[A-Za-z]{3}\s\d{4}-\d{2}-\d{2}\s\d{2}:\d{2}\s[^\]]+\]\s*', '', 'g')")
_GATES_SQL = f"""
WITH b AS (SELECT pid, prompt, {_BARE} AS t, lower(trim(prompt)) AS h FROM {_P}),
s AS (SELECT *, length(t) < CASE WHEN regexp_matches(t, '[\\x{{4e00}}-\\x{{9fff}}\\x{{3040}}-\\x{{309f}}\\x{{30a0}}-\\x{{30ff}}\\x{{ac00}}-\\x{{d7af}}]') THEN 6 ELSE 15 END AND NOT contains(t, '?') AND NOT contains(t, '？') AS short FROM b)
SELECT pid, CASE WHEN {_rx('t', *text.FORCE_PROMPTS)} THEN false ELSE length(t) < 5 OR {_rx('t', *text.SKIP_PROMPTS)} OR regexp_matches(t, '{text.EMOJI_ONLY}') OR short END AS skip,
  h = '' OR starts_with(h, '/') OR regexp_matches(h, '(^|[^\\p{{L}}\\p{{N}}])(?:{"|".join(text.HEARTBEATS)})($|[^\\p{{L}}\\p{{N}}])') AS heartbeat,
  length(trim(prompt)) < 10 OR {_rx('trim(prompt)', *text.DENIALS)} AS noise, {_rx('prompt', *text.RECENCY_SIGNALS)} AS recency FROM s"""


@query("retrieval_gates", _GATES_SQL)
def retrieval_gates(spark, sf):
    return prompts(spark, sf).select("pid", text.skip_retrieval("prompt").alias("skip"), text.heartbeat("prompt").alias("heartbeat"), text.retrieved_noise("prompt").alias("noise"), text.recency_intent("prompt").alias("recency"))


@query("quality_score", f"SELECT doc_id, greatest(0, least(100, 30 + CASE WHEN length(text) > 200 THEN 10 ELSE 0 END + CASE WHEN length(text) > 500 THEN 10 ELSE 0 END + CASE WHEN regexp_matches(text, '(?m)^##\\s+') THEN 10 ELSE 0 END + CASE WHEN regexp_matches(text, '(?m)^[-*]\\s+') THEN 5 ELSE 0 END + CASE WHEN {_rx('text', text.DECISION_WORDS)} THEN 15 ELSE 0 END + CASE WHEN {_rx('text', text.CORRECTION_WORDS)} THEN 10 ELSE 0 END - CASE WHEN length(text) < 50 THEN 10 ELSE 0 END)) / 100.0::DOUBLE AS quality FROM documents")
def quality_score(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.quality_score("text").alias("quality"))


@query("content_type_infer", "SELECT page_id, CASE WHEN contains(lower(url), 'decision') OR contains(lower(url), 'adr/') OR contains(lower(url), 'adr-') THEN 'decision' WHEN contains(lower(url), 'hub') OR contains(lower(url), 'moc') OR regexp_matches(lower(url), '/index.md$') THEN 'hub' WHEN contains(lower(url), 'research') OR contains(lower(url), 'investigation') OR contains(lower(url), 'analysis') THEN 'research' WHEN contains(lower(url), 'project') OR contains(lower(url), 'epic') OR contains(lower(url), 'initiative') THEN 'project' WHEN contains(lower(url), 'handoff') OR contains(lower(url), 'handover') OR contains(lower(url), 'session') THEN 'handoff' WHEN contains(lower(url), 'conversation') OR contains(lower(url), 'convo') OR contains(lower(url), 'chat') OR contains(lower(url), 'transcript') THEN 'conversation' WHEN contains(lower(url), 'progress') OR contains(lower(url), 'status') OR contains(lower(url), 'standup') OR contains(lower(url), 'changelog') THEN 'progress' ELSE 'note' END AS kind FROM pages")
def content_type_infer(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.content_type("url").alias("kind"))


@query("text_identities", "SELECT doc_id, sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS normalized_hash, substr(sha1(lower(trim(source))), 1, 12) AS query_hash, substr(sha256(source || '/' || lang), 1, 16) AS canonical_id, ceil(length(text) / 4.0)::BIGINT AS tokens FROM documents")
def text_identities(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.normalized_hash("text").alias("normalized_hash"), text.query_hash("source").alias("query_hash"), text.canonical_id("source", "lang").alias("canonical_id"), text.estimate_tokens("text").alias("tokens"))


@query("fuzzy_paths", "SELECT p_partkey, p_name, levenshtein(p_name, 'almond azure') AS distance FROM part ORDER BY distance, p_partkey LIMIT 5")
def fuzzy_paths(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_name", F.levenshtein("p_name", F.lit("almond azure")).cast("long").alias("distance")).orderBy("distance", "p_partkey").limit(5)


_NUMBERS = f"list_distinct([replace(x, ',', '') FOR x IN regexp_extract_all(prompt, '({text.NUMBER})', 1)])"
_CONTRADICTION_SQL = f"""
WITH p AS (SELECT pid, prompt, {_rx('prompt', text.NEGATION)} AS neg, {_NUMBERS} AS n FROM {_P}),
j AS (SELECT a.pid AS a, a.neg <> b.neg AS differ, len(a.n) > 0 AND len(b.n) > 0 AND NOT list_has_any(a.n, b.n) AS disjoint FROM p a JOIN p b ON b.pid - 2 = a.pid)
SELECT a, differ OR disjoint AS contradictory, CASE WHEN differ THEN 0.6 WHEN disjoint THEN 0.5 ELSE 0.0 END::DOUBLE AS confidence, CASE WHEN differ THEN 'negation' WHEN disjoint THEN 'numbers' ELSE 'none' END AS reason FROM j"""


@query("contradiction_heuristic", _CONTRADICTION_SQL)
def contradiction_heuristic(spark, sf):
    p = prompts(spark, sf)
    pairs = p.select(F.col("pid").alias("a"), F.col("prompt").alias("a_text")).join(p.select((F.col("pid") - 2).alias("a"), F.col("prompt").alias("b_text")), "a")
    return lifecycle.contradictions(pairs).select("a", "contradictory", "confidence", "reason")


@query("temporal_proximity", f"WITH {META_SQL} SELECT id, round(1 - least(1.0, abs(epoch(effective_at) - epoch(TIMESTAMP '2024-01-01 00:00:00') - 15 * 86400) / 86400.0 / 30), 6)::DOUBLE AS proximity FROM meta")
def temporal_proximity(spark, sf):
    t = lambda s: F.lit(s).cast("timestamp_ntz")
    return rounded(adapter.metadata(spark, sf).select("id", temporal.proximity(F.col("effective_at"), t("2024-01-01 00:00:00"), t("2024-01-31 00:00:00")).alias("proximity")), "proximity")


@query("quiet_hours", "SELECT event_id, hour(ts) >= 22 OR hour(ts) < 6 AS quiet FROM events")
def quiet_hours(spark, sf):
    return table(spark, sf, "events").select("event_id", temporal.quiet_hours(F.col("ts"), 22, 6).alias("quiet"))


# evaluation


_RANKED = f"ranked AS (SELECT source AS qid, doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents), top AS (SELECT * FROM ranked WHERE rank <= 10), gold AS (SELECT DISTINCT d.source AS qid, l.doc_id AS id FROM {'(SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id)'} l JOIN documents d USING (doc_id) WHERE l.quality = 1)"


def _ranked(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("qid"), F.col("doc_id").alias("id"), "n_chars")
    return windows.top_per(d, ["qid"], [F.desc("n_chars"), F.col("id")], 10)


def _gold(spark, sf):
    labels = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality = 1")
    return table(spark, sf, "documents").join(labels, "doc_id").select(F.col("source").alias("qid"), F.col("doc_id").alias("id"))


@query("eval_doc_metrics", f"WITH {_RANKED}, j AS (SELECT coalesce(t.qid, g.qid) AS qid, t.rank, t.id AS tid, g.id AS gid FROM top t FULL OUTER JOIN gold g ON t.qid = g.qid AND t.id = g.id), a AS (SELECT qid, count(tid) AS f, count(gid) AS w, count(CASE WHEN tid IS NOT NULL AND gid IS NOT NULL THEN 1 END) AS b, min(CASE WHEN gid IS NOT NULL THEN rank END) AS first FROM j GROUP BY qid) SELECT qid, round(coalesce(b::DOUBLE / nullif(f + w - b, 0), 0), 6) AS jaccard, round(coalesce(b::DOUBLE / nullif(f, 0), 0), 6) AS precision, round(coalesce(b::DOUBLE / nullif(w, 0), 0), 6) AS recall, (b > 0)::INTEGER AS hit, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr FROM a")
def eval_doc_metrics(spark, sf):
    return rounded(evaluation.document_metrics(_ranked(spark, sf), _gold(spark, sf)), "jaccard", "precision", "recall", "mrr")


@query("eval_ndcg", f"WITH {_RANKED}, gr AS (SELECT d.source AS qid, d.doc_id AS id, l.quality + 1 - l.toxic AS grade FROM (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l JOIN documents d USING (doc_id)), got AS (SELECT t.qid, sum((pow(2.0, grade) - 1) / log2(rank + 1)) AS dcg FROM top t JOIN gr ON gr.qid = t.qid AND gr.id = t.id GROUP BY t.qid), ir AS (SELECT qid, grade, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, id) AS rank FROM gr WHERE grade > 0), ideal AS (SELECT qid, sum((pow(2.0, grade) - 1) / log2(rank + 1)) AS ideal FROM ir WHERE rank <= 10 GROUP BY qid), q AS (SELECT DISTINCT qid FROM top UNION SELECT qid FROM gr) SELECT q.qid, round(coalesce(dcg, 0) / ideal, 6) AS ndcg FROM q LEFT JOIN got USING (qid) LEFT JOIN ideal USING (qid)")
def eval_ndcg(spark, sf):
    labels = table(spark, sf, "labels").groupBy("doc_id").agg((F.max("quality") + 1 - F.max("toxic")).alias("grade"))
    grades = table(spark, sf, "documents").join(labels, "doc_id").select(F.col("source").alias("qid"), F.col("doc_id").alias("id"), "grade")
    return rounded(evaluation.ndcg(_ranked(spark, sf), grades), "ndcg")


@query("eval_by_tag", None)
def eval_by_tag(spark, sf):
    tags = table(spark, sf, "documents").groupBy(F.col("source").alias("qid")).agg(F.collect_set("lang").alias("tags"))
    m = evaluation.document_metrics(_ranked(spark, sf), _gold(spark, sf))
    return rounded(evaluation.by_tag(m, tags, ["precision", "recall", "mrr"]), "precision", "recall", "mrr")
