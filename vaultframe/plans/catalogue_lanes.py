"""The fourth part of the catalogue: worklists, audits, prompt rules, entity search and hook evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from vaultframe.functions import prompts
from vaultframe.operators import entities, evaluation, fusion, graph, worklists
from vaultframe.plans.catalogue import query, rounded
from vaultframe.sources.adapter import CONTENT_TYPES, MENTION_SQL, NOW, mentions, now, table

# a vault's table with the columns of the write path, derived from documents

_STATES = "[NULL, 'pending', 'synced', 'failed']"
WORK_SQL = f"""work AS (SELECT doc_id AS id, 'h' || doc_id // 2 AS hash, CASE WHEN doc_id % 3 = 0 THEN '_internal' ELSE coalesce(source, 'none') END AS collection,
  CASE WHEN doc_id % 3 = 0 THEN 'observations/' ELSE 'notes/' END || doc_id AS path, 'Title ' || doc_id % 100 AS title, text AS body, CASE WHEN doc_id % 6 = 0 THEN 'fact' END AS observation_type,
  doc_id % 19 <> 0 AS active, {_STATES}[doc_id % 4 + 1] AS embed_state, doc_id % 5 AS embed_attempts, CASE WHEN doc_id % 4 = 3 THEN 'old' END AS embed_error, doc_id % 29 = 0 AS legacy,
  [{", ".join(f"'{t}'" for t in CONTENT_TYPES)}][doc_id % 13 + 1] AS content_type, doc_id % 20 AS access_count, doc_id % 97 = 0 AS pinned, (doc_id % 10) / 10.0::DOUBLE AS confidence,
  TIMESTAMP '{NOW}' - to_days(CAST(doc_id % 365 AS INTEGER)) AS modified_at, TIMESTAMP '{NOW}' - to_days(CAST(doc_id % 365 + 9 AS INTEGER)) AS created_at,
  CASE WHEN doc_id % 7 = 0 THEN TIMESTAMP '{NOW}' - to_days(CAST(doc_id % 365 + 30 AS INTEGER)) END AS authored_at,
  CASE WHEN doc_id % 2 = 0 THEN TIMESTAMP '{NOW}' - to_days(CAST(doc_id % 200 AS INTEGER)) END AS last_accessed_at,
  CASE WHEN doc_id % 19 = 0 AND doc_id % 2 = 0 THEN TIMESTAMP '{NOW}' END AS archived_at, CASE WHEN doc_id % 31 = 0 THEN TIMESTAMP '{NOW}' END AS invalidated_at FROM documents)"""
VECTOR_SQL = "vectors AS (SELECT 'h' || vec_id % 700 AS hash, vec_id % 3 AS seq, CASE WHEN vec_id % 7 <> 0 THEN 'full' END AS fragment_type FROM embeddings)"
LANE_SQL = "collection = '_internal' AND path LIKE 'observations/%' AND observation_type IS NOT NULL"


def work(spark, sf):
    i = F.col("doc_id")
    ago = lambda days: now() - F.make_dt_interval(days=days.cast("int"))
    return table(spark, sf, "documents").select(
        i.alias("id"),
        F.concat(F.lit("h"), F.floor(i / 2).cast("string")).alias("hash"),
        F.when(i % 3 == 0, "_internal").otherwise(F.coalesce("source", F.lit("none"))).alias("collection"),
        F.concat(F.when(i % 3 == 0, "observations/").otherwise("notes/"), i.cast("string")).alias("path"),
        F.concat(F.lit("Title "), (i % 100).cast("string")).alias("title"),
        F.col("text").alias("body"),
        F.when(i % 6 == 0, "fact").alias("observation_type"),
        (i % 19 != 0).alias("active"),
        F.element_at(F.array(F.lit(None).cast("string"), F.lit("pending"), F.lit("synced"), F.lit("failed")), (i % 4 + 1).cast("int")).alias("embed_state"),
        (i % 5).alias("embed_attempts"),
        F.when(i % 4 == 3, "old").alias("embed_error"),
        (i % 29 == 0).alias("legacy"),
        F.element_at(F.array(*map(F.lit, CONTENT_TYPES)), (i % 13 + 1).cast("int")).alias("content_type"),
        (i % 20).alias("access_count"),
        (i % 97 == 0).alias("pinned"),
        (i % 10 / 10).alias("confidence"),
        ago(i % 365).alias("modified_at"),
        ago(i % 365 + 9).alias("created_at"),
        F.when(i % 7 == 0, ago(i % 365 + 30)).alias("authored_at"),
        F.when(i % 2 == 0, ago(i % 200)).alias("last_accessed_at"),
        F.when((i % 19 == 0) & (i % 2 == 0), now()).alias("archived_at"),
        F.when(i % 31 == 0, now()).alias("invalidated_at"),
    )


def vector_rows(spark, sf):
    v = F.col("vec_id")
    return table(spark, sf, "embeddings").select(F.concat(F.lit("h"), (v % 700).cast("string")).alias("hash"), (v % 3).alias("seq"), F.when(v % 7 != 0, "full").alias("fragment_type"))


# worklists and audits


@query("observation_lane", f"WITH {WORK_SQL} SELECT id, path FROM work WHERE {LANE_SQL}")
def observation_lane(spark, sf):
    return worklists.observation_lane(work(spark, sf)).select("id", "path")


@query("needs_fragments", f"WITH {WORK_SQL}, {VECTOR_SQL}, g AS (SELECT d.hash, min(d.collection || '/' || d.path) AS k FROM work d LEFT JOIN (SELECT DISTINCT hash FROM vectors WHERE fragment_type IS NOT NULL) v ON v.hash = d.hash LEFT JOIN (SELECT DISTINCT hash FROM vectors WHERE seq = 0) z ON z.hash = d.hash WHERE active AND embed_attempts < 3 AND (v.hash IS NULL OR z.hash IS NULL OR embed_state IN ('pending', 'failed')) GROUP BY d.hash) SELECT g.hash, d.collection, d.path, d.title FROM g JOIN work d ON d.hash = g.hash AND d.active AND d.collection || '/' || d.path = g.k")
def needs_fragments(spark, sf):
    return worklists.needing_fragments(work(spark, sf), vector_rows(spark, sf))


@query("orphan_content", f"WITH {WORK_SQL}, content AS (SELECT DISTINCT 'h' || page_id * 7 AS hash FROM pages) SELECT hash FROM content WHERE hash NOT IN (SELECT hash FROM work)")
def orphan_content(spark, sf):
    content = table(spark, sf, "pages").select(F.concat(F.lit("h"), (F.col("page_id") * 7).cast("string")).alias("hash")).distinct()
    return worklists.orphans(content, work(spark, sf))


_CAUSAL = "rel AS (SELECT doc_id AS source_id, doc_id + 6 * (doc_id % 3 + 1) AS target_id, (doc_id % 5 + 1) / 5.0::DOUBLE AS weight FROM documents), seen AS (SELECT source_id, target_id FROM rel WHERE source_id % 4 = 0)"


@query("unwitnessed_edges", f"WITH {WORK_SQL}, {_CAUSAL}, lane AS (SELECT id FROM work WHERE {LANE_SQL}) SELECT source_id, target_id, weight FROM rel WHERE source_id IN (SELECT id FROM lane) AND target_id IN (SELECT id FROM lane) AND NOT EXISTS (SELECT 1 FROM seen s WHERE s.source_id = rel.source_id AND s.target_id = rel.target_id)")
def unwitnessed_edges(spark, sf):
    i = F.col("doc_id")
    rel = table(spark, sf, "documents").select(i.alias("source_id"), (i + 6 * (i % 3 + 1)).alias("target_id"), ((i % 5 + 1) / 5).alias("weight"), F.lit("causal").alias("relation_type"))
    return worklists.unwitnessed(rel, work(spark, sf), rel.where("source_id % 4 = 0")).select("source_id", "target_id", "weight")


_EVOLUTION = "evo AS (SELECT event_id AS id, event_id % 997 AS memory_id, event_id * 7 % 997 AS triggered_by, CASE WHEN event_id % 11 <> 0 THEN event_type END AS writer, event_id % 13 = 0 AS is_reset FROM events)"


@query("tainted_notes", f"WITH {WORK_SQL}, {_EVOLUTION}, s AS (SELECT e.memory_id, e.id FROM evo e JOIN work t ON t.id = e.triggered_by AND t.legacy UNION ALL SELECT memory_id, id FROM evo WHERE writer IS NULL AND id > 500) SELECT DISTINCT m.id FROM s JOIN work m ON m.id = s.memory_id WHERE m.active AND NOT m.legacy AND NOT EXISTS (SELECT 1 FROM evo r WHERE r.memory_id = s.memory_id AND r.is_reset AND r.id > s.id)")
def tainted_notes(spark, sf):
    e = F.col("event_id")
    evo = table(spark, sf, "events").select(e.alias("id"), (e % 997).alias("memory_id"), (e * 7 % 997).alias("triggered_by"), F.when(e % 11 != 0, F.col("event_type")).alias("writer"), (e % 13 == 0).alias("is_reset"))
    return worklists.tainted_notes(work(spark, sf), evo, 500)


@query("embed_stats", f"WITH {WORK_SQL} SELECT count(*) FILTER (embed_state IS NULL OR embed_state = 'pending') AS pending, count(*) FILTER (embed_state = 'synced') AS synced, count(*) FILTER (embed_state = 'failed') AS failed FROM work WHERE active")
def embed_stats(spark, sf):
    return worklists.embed_stats(work(spark, sf))


@query("index_health", f"WITH {WORK_SQL}, {VECTOR_SQL} SELECT count(DISTINCT hash) FILTER (hash NOT IN (SELECT hash FROM vectors WHERE seq = 0)) AS needs_embedding, count(*) AS total_docs, floor(date_diff('second', max(modified_at), TIMESTAMP '{NOW}') / 86400)::BIGINT AS days_stale FROM work WHERE active")
def index_health(spark, sf):
    return worklists.index_health(work(spark, sf), vector_rows(spark, sf), now())


_STEPS = "steps AS (SELECT 'h' || event_id % 400 AS hash, event_id AS n, CASE event_type WHEN 'view' THEN 'start' WHEN 'click' THEN 'synced' ELSE 'failed' END AS step, event_type AS error FROM events)"


@query("embed_states", f"WITH {WORK_SQL}, {_STEPS}, m AS (SELECT *, max(CASE WHEN step = 'synced' THEN n END) OVER (PARTITION BY hash) AS sa FROM steps), l AS (SELECT hash, arg_max(step, n) AS step, arg_max(error, n) AS error, max(sa) AS sa, sum((step = 'start' AND (sa IS NULL OR n > sa))::INT)::BIGINT AS starts FROM m GROUP BY hash) SELECT work.hash, CASE WHEN step = 'start' THEN 'pending' ELSE coalesce(step, embed_state) END AS embed_state, (CASE WHEN sa IS NULL THEN embed_attempts ELSE 0 END + coalesce(starts, 0))::BIGINT AS embed_attempts, CASE WHEN step IS NULL THEN embed_error WHEN step = 'failed' THEN error END AS embed_error FROM work LEFT JOIN l ON l.hash = work.hash WHERE active")
def embed_states(spark, sf):
    t = F.col("event_type")
    steps = table(spark, sf, "events").select(F.concat(F.lit("h"), (F.col("event_id") % 400).cast("string")).alias("hash"), F.col("event_id").alias("at"), F.when(t == "view", "start").when(t == "click", "synced").otherwise("failed").alias("step"), t.alias("error"))
    return worklists.embed_states(work(spark, sf), steps)


@query("usage_since_action", "WITH u AS (SELECT event_id AS id, CASE WHEN event_id % 50 = 7 THEN 'memory_pin' WHEN event_id % 2 = 0 THEN 'context-surfacing' ELSE 'other' END AS hook FROM events) SELECT count(*) AS n, count(*) >= 15 AS nudge FROM u WHERE hook = 'context-surfacing' AND id > (SELECT coalesce(max(id), 0) FROM u WHERE hook = 'memory_pin')")
def usage_since_action(spark, sf):
    e = F.col("event_id")
    return worklists.usage_since_action(table(spark, sf, "events").select(e.alias("id"), F.when(e % 50 == 7, "memory_pin").when(e % 2 == 0, "context-surfacing").otherwise("other").alias("hook_name")))


@query("archived_search", f"WITH {WORK_SQL} SELECT id, collection, path, title, archived_at, 1.0::DOUBLE AS score FROM work WHERE NOT active AND archived_at IS NOT NULL AND (lower(title) LIKE '%an%' OR lower(path) LIKE '%an%' OR lower(collection) LIKE '%an%' OR lower(body) LIKE '%an%') ORDER BY id LIMIT 20")
def archived_search(spark, sf):
    return worklists.archived_search(work(spark, sf), "An")


@query("stale_batch", f"WITH {WORK_SQL}, r AS (SELECT event_id % 200 AS id, max(ts) AS t FROM events GROUP BY 1) SELECT work.id, coalesce(t, last_accessed_at, modified_at) AS stale_since FROM work LEFT JOIN r ON r.id = work.id WHERE active AND content_type IN ('decision', 'preference', 'milestone', 'problem') ORDER BY stale_since, modified_at, work.id LIMIT 25")
def stale_batch(spark, sf):
    recalled = table(spark, sf, "events").groupBy((F.col("event_id") % 200).alias("id")).agg(F.max("ts").alias("last_recalled_at"))
    return worklists.stale_batch(work(spark, sf), recalled, ["decision", "preference", "milestone", "problem"], 25)


@query("latest_window", f"WITH {WORK_SQL} SELECT id, coalesce(authored_at, modified_at) AS effective_at FROM work WHERE {LANE_SQL} AND active AND invalidated_at IS NULL AND id % 12 <> 0 AND created_at <= TIMESTAMP '{NOW}' - INTERVAL 20 DAY AND modified_at <= TIMESTAMP '{NOW}' - INTERVAL 20 DAY AND coalesce(authored_at, modified_at) <= TIMESTAMP '{NOW}' - INTERVAL 20 DAY ORDER BY effective_at DESC, id DESC LIMIT 5")
def latest_window(spark, sf):
    w = work(spark, sf)
    return worklists.latest_window(w, w.where("id % 12 = 0"), 5, now() - F.make_dt_interval(days=F.lit(20)))


@query("by_request_terms", r"WITH q AS (SELECT conv_id, list_filter(regexp_split_to_array(lower(arg_max(text, turn)), '\s+'), lambda t: length(t) > 3) AS t FROM conversations WHERE role = 'user' GROUP BY conv_id), h AS (SELECT c.conv_id, turn, len(list_filter(coalesce(t, []), lambda x: contains(lower(text), x))) AS hits FROM conversations c LEFT JOIN q ON q.conv_id = c.conv_id) SELECT conv_id, turn, hits::INTEGER AS hits, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY hits DESC, turn) AS INTEGER) AS place FROM h")
def by_request_terms(spark, sf):
    c = table(spark, sf, "conversations")
    asked = c.where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("request"))
    return worklists.by_request_terms(c, asked, "conv_id", "turn", "text").select("conv_id", "turn", "hits", "place")


@query("counter_repair", f"WITH {WORK_SQL}, r AS (SELECT event_id % 997 AS id, count(*) AS n, max(ts) AS t FROM events WHERE event_type = 'click' GROUP BY 1) SELECT work.id, access_count AS before_count, last_accessed_at AS before_at, coalesce(n, 0) AS after_count, t AS after_at FROM work LEFT JOIN r ON r.id = work.id WHERE access_count IS DISTINCT FROM coalesce(n, 0) OR last_accessed_at IS DISTINCT FROM t")
def counter_repair(spark, sf):
    ledger = table(spark, sf, "events").select((F.col("event_id") % 997).alias("id"), F.when(F.col("event_type") == "click", F.col("ts")).alias("referenced_at"))
    return worklists.counter_repair(work(spark, sf), ledger)


@query("curator_report", f"WITH {WORK_SQL} SELECT count(*) AS active, sum(pinned::INT)::BIGINT AS pinned, sum((greatest(modified_at, coalesce(last_accessed_at, modified_at)) < TIMESTAMP '{NOW}' - INTERVAL 90 DAY AND NOT pinned)::INT)::BIGINT AS sweep, sum((confidence < 0.4)::INT)::BIGINT AS weak, sum((access_count = 0)::INT)::BIGINT AS never_read, sum((collection NOT IN (SELECT source FROM documents WHERE source IS NOT NULL))::INT)::BIGINT AS orphaned, round(100.0::DOUBLE * sum((access_count = 0)::INT) / count(*), 4)::DOUBLE AS never_read_pct FROM work WHERE active")
def curator_report(spark, sf):
    known = table(spark, sf, "documents").where("source is not null").select(F.col("source").alias("collection"))
    return worklists.curator_report(work(spark, sf), known, now())


@query("escalating_top_k", "WITH c AS (SELECT event_id % 40 AS qid, row_number() OVER (PARTITION BY event_id % 40 ORDER BY value DESC, event_id) AS rank, event_id % 6 = 0 AS allowed FROM events), g AS (SELECT qid, count(*) AS total, count(*) FILTER (allowed AND rank <= 9) AS a, count(*) FILTER (allowed AND rank <= 15) AS b FROM c GROUP BY qid) SELECT qid, least(CASE WHEN a >= 3 OR total <= 9 THEN 9 ELSE 15 END, total)::BIGINT AS reached, CASE WHEN a >= 3 OR total <= 9 THEN a ELSE b END AS allowed, total > 15 AND CASE WHEN a >= 3 OR total <= 9 THEN a ELSE b END < 3 AS degraded FROM g")
def escalating_top_k(spark, sf):
    from vaultframe.operators.windows import top_per

    e = table(spark, sf, "events").select((F.col("event_id") % 40).alias("qid"), "value", "event_id", (F.col("event_id") % 6 == 0).alias("allowed"))
    return worklists.escalation(top_per(e, ["qid"], [F.desc("value"), F.col("event_id")], None), 3, 15)


# prompt rules


def _quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _hit(pattern: str, flags: str = "(?i)") -> str:
    return f"regexp_matches(t, '{flags}{pattern}')"


_N = rf"len(list_distinct(list_filter(regexp_split_to_array(lower(t), '[^\p{{L}}\p{{N}}]+'), lambda w: length(w) > 1 AND w NOT IN ({_quoted(prompts.CONTENT_STOPWORDS)}))))"


@query("prior_context", rf"WITH c AS (SELECT conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM conversations), n AS (SELECT *, {_N} AS n FROM c) SELECT conv_id, turn, CASE WHEN {_hit(prompts.BACK_REFERENCE)} THEN 'conversation-backref' WHEN {_hit(prompts.STRONG_MOVE)} AND {_hit(prompts.BACK_OBJECT)} THEN 'continuation-deictic' WHEN {_hit(prompts.OPENERS)} AND n < 8 THEN 'continuation-opener' WHEN {_hit(prompts.ANAPHORA)} AND n < 6 THEN 'anaphora-low-content' WHEN n < 3 THEN 'underspecified' ELSE 'self-sufficient' END AS reason FROM n")
def prior_context(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", prompts.prior_context("text").alias("reason"))


@query("routing_hint", f"WITH c AS (SELECT conv_id, turn, lower(text) AS t FROM conversations) SELECT conv_id, turn, CASE WHEN {_hit(prompts.SESSION_SIGNALS, '')} THEN '{prompts.HINT.format('session_log')}' WHEN {_hit(prompts.CAUSAL_SIGNALS, '')} THEN '{prompts.HINT.format('intent_search')}' WHEN {_hit(prompts.DISCOVERY_SIGNALS, '')} THEN '{prompts.HINT.format('find_similar')}' END AS hint FROM c")
def routing_hint(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", prompts.routing_hint("text").alias("hint"))


_TERMS = rf"list_filter(list_transform(list_filter(regexp_split_to_array(lower(%s), '\s+'), lambda w: length(w) > 1 AND w NOT IN ({_quoted(prompts.INTENT_STOPWORDS)})), lambda w: regexp_replace(w, '[^a-z0-9-]', '', 'g')), lambda w: length(w) > 1)"


@query("intent_terms", f"SELECT conv_id, turn, array_to_string({_TERMS % 'text'}, ' ') AS terms FROM conversations")
def intent_terms(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(prompts.intent_terms("text"), " ").alias("terms"))


@query("smart_truncate", r"""WITH c AS (SELECT doc_id, text, substr(text, 1, 300) AS t FROM documents), p AS (SELECT *, CASE WHEN instr(reverse(t), chr(10) || chr(10)) > 0 THEN length(t) - instr(reverse(t), chr(10) || chr(10)) - 1 ELSE -1 END AS para, regexp_extract(t, '(?s)^(.+[.!?])\s', 1) AS sentence, CASE WHEN instr(reverse(t), chr(10)) > 0 THEN length(t) - instr(reverse(t), chr(10)) ELSE -1 END AS line, CASE WHEN instr(reverse(t), ' ') > 0 THEN length(t) - instr(reverse(t), ' ') ELSE -1 END AS word FROM c)
SELECT doc_id, md5(CASE WHEN length(text) <= 300 THEN text WHEN para > 150 THEN regexp_replace(substr(t, 1, para), '\s+$', '') WHEN length(sentence) > 150 THEN sentence WHEN line > 150 THEN regexp_replace(substr(t, 1, line), '\s+$', '') WHEN word > 150 THEN regexp_replace(substr(t, 1, word), '\s+$', '') || '...' ELSE regexp_replace(t, '\s+$', '') || '...' END) AS cut FROM p""")
def smart_truncate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(prompts.smart_truncate("text").cast("binary")).alias("cut"))


@query("best_window", r"""WITH c AS (SELECT doc_id, text, greatest(1, ceil((length(text) - 50) / 350.0))::BIGINT AS n FROM documents WHERE text IS NOT NULL), w AS (SELECT doc_id, i, substr(text, (i * 350 + 1)::BIGINT, 400) AS w, length(text) AS len FROM (SELECT *, unnest(range(n)) AS i FROM c)), s AS (SELECT *, contains(lower(w), 'an')::INT + contains(lower(w), 'und')::INT + 0.5 * contains(lower(w), 'data')::INT AS score FROM w), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN len > 400 THEN score ELSE 0 END DESC, i) AS r FROM s) SELECT doc_id, md5(w) AS chunk FROM b WHERE r = 1""")
def best_window(spark, sf):
    d = table(spark, sf, "documents").where("text is not null").withColumns({"q": F.array(F.lit("an"), F.lit("und")), "i": F.array(F.lit("data"))})
    return d.select("doc_id", F.md5(prompts.best_window("text", "q", "i", 400, 50).cast("binary")).alias("chunk"))


@query("observation_fragments", r"""WITH f AS (SELECT doc_id, text, list_transform(list_filter(string_split(text, chr(10)), lambda x: length(x) >= 50)[1:499], lambda x: ('fact', x)) AS facts FROM documents WHERE text IS NOT NULL AND doc_id % 6 = 0), a AS (SELECT doc_id, unnest(list_concat([('full', substr(text, 1, 500000))], facts)) AS p FROM f) SELECT doc_id, p[1] AS type, md5(p[2]) AS content, count(*) AS n FROM a GROUP BY ALL""")
def observation_fragments(spark, sf):
    # the observation lane's documents, their lines as the list of facts
    d = table(spark, sf, "documents").where("text is not null and doc_id % 6 = 0").withColumn("facts", F.to_json(F.split("text", "\n")))
    parts = d.select("doc_id", F.explode(prompts.observation_fragments("text", "facts", F.lit(None).cast("string"))).alias("p"))
    return parts.groupBy("doc_id", F.col("p.type").alias("type"), F.md5(F.col("p.content").cast("binary")).alias("content")).agg(F.count("*").alias("n"))


@query("query_gate", rf"WITH d AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower('Title ' || doc_id % 100 || ' ' || substr(coalesce(text, ''), 1, 4000)), '[^\p{{L}}\p{{N}}]+'), lambda w: length(w) > 1)) AS w FROM documents) SELECT doc_id, len(list_filter(w, lambda x: starts_with(x, 'anat') OR starts_with(x, 'zu'))) > 0 AS passes FROM d")
def query_gate(spark, sf):
    d = work(spark, sf).select(F.col("id").alias("doc_id"), prompts.gate_tokens("title", "body").alias("w"))
    return d.select("doc_id", prompts.passes_gate("w", F.array(F.lit("anat"), F.lit("zu"))).alias("passes"))


@query("cache_keys", "SELECT page_id, sha256(coalesce(url, '') || '{\"query\":' || to_json(coalesce(url, ''))::VARCHAR || ',\"n\":' || page_id || '}') AS key FROM pages")
def cache_keys(spark, sf):
    p = table(spark, sf, "pages").withColumn("url", F.coalesce("url", F.lit("")))
    return p.select("page_id", prompts.cache_key("url", F.struct(F.col("url").alias("query"), F.col("page_id").alias("n"))).alias("key"))


# entities, graph, fusion


_NODES = "nodes AS (SELECT p_partkey AS entity_id, p_name AS name, p_size % 9 AS mention_count FROM part)"


def _nodes(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"), (F.col("p_size") % 9).alias("mention_count"))


def _entity_queries(spark, sf):
    """Every name of every twentieth part: whole, its last word, and the start of that word with the digits kept."""
    p = table(spark, sf, "part").where("p_partkey % 20 = 0")
    last = F.element_at(F.split("p_name", " "), -1)
    forms = F.array(F.col("p_name"), F.upper("p_name"), last, F.substring(last, 1, 3), F.col("p_partkey").cast("string"))
    return p.select((F.col("p_partkey") * 10).alias("base"), F.posexplode(forms).alias("n", "query")).select((F.col("base") + F.col("n")).alias("qid"), "query")


_FORMS = "asked AS (SELECT p_partkey * 10 + n AS qid, CASE n WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN split_part(p_name, ' ', -1) WHEN 3 THEN substr(split_part(p_name, ' ', -1), 1, 3) ELSE p_partkey::VARCHAR END AS query FROM part, range(5) r(n) WHERE p_partkey % 20 = 0)"
_CUT = r"list_distinct(list_filter(regexp_split_to_array(lower(%s), '[^\p{L}\p{N}]+'), lambda x: x <> ''))"
_MATCH = f"words AS (SELECT qid, query, unnest({_CUT % 'query'}) AS word FROM asked), terms AS (SELECT entity_id, name, mention_count, unnest({_CUT % 'name'}) AS term FROM nodes), hits AS (SELECT qid, query, entity_id, name, mention_count, max((term = word)::INT) AS whole FROM terms JOIN words ON starts_with(term, word) GROUP BY ALL)"


@query("search_entities", f"WITH {_NODES}, {_FORMS}, {_MATCH}, {MENTION_SQL}, pairs AS (SELECT a.entity_id AS a, b.entity_id AS b, count(*) AS n FROM mentions a JOIN mentions b ON a.doc_id = b.doc_id AND a.entity_id < b.entity_id GROUP BY ALL), tog AS (SELECT id, sum(n)::BIGINT AS n FROM (SELECT a AS id, n FROM pairs UNION ALL SELECT b, n FROM pairs) GROUP BY id), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY whole DESC, mention_count DESC, entity_id) AS INTEGER) AS place FROM hits) SELECT qid, entity_id, mention_count, coalesce(n, 0) AS cooccurrence_count, place FROM r LEFT JOIN tog ON tog.id = entity_id WHERE place <= 10")
def search_entities(spark, sf):
    pairs = entities.co_occurrence(mentions(spark, sf), "doc_id", "entity_id")
    return entities.search_entities(_nodes(spark, sf), pairs, _entity_queries(spark, sf))


@query("resolve_entities", None)
def resolve_entities(spark, sf):
    return entities.resolve_query(_nodes(spark, sf), _entity_queries(spark, sf))


@query("upsert_mentions", "WITH n AS (SELECT p_partkey AS entity_id, p_name AS name, p_brand AS entity_type, (p_size % 9)::BIGINT AS c FROM part WHERE p_partkey % 2 = 0), f AS (SELECT DISTINCT l_partkey AS entity_id, l_orderkey AS doc_id FROM lineitem), g AS (SELECT entity_id, count(*) AS k, min(doc_id) AS d FROM f GROUP BY entity_id) SELECT coalesce(n.entity_id, g.entity_id) AS entity_id, coalesce(name, 'found in ' || d) AS name, coalesce(entity_type, 'part') AS entity_type, coalesce(c, 0) + coalesce(k, 0) AS mention_count FROM n FULL OUTER JOIN g ON n.entity_id = g.entity_id")
def upsert_mentions(spark, sf):
    n = table(spark, sf, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("entity_type"), (F.col("p_size") % 9).cast("long").alias("mention_count"))
    found = mentions(spark, sf).select("entity_id", "doc_id", F.concat(F.lit("found in "), F.col("doc_id").cast("string")).alias("name"), F.lit("part").alias("entity_type"))
    return entities.upsert_mentions(n, found)


@query("meta_path_merge", "WITH o AS (SELECT doc_id AS id, (doc_id % 10) / 10.0::DOUBLE AS score FROM documents WHERE doc_id % 5 <> 0), t AS (SELECT doc_id AS id, (doc_id % 7 + 1)::DOUBLE AS score FROM documents WHERE doc_id % 3 <> 0), n AS (SELECT id, score / (SELECT max(score) FROM t) AS norm FROM t), m AS (SELECT coalesce(o.id, n.id) AS id, CASE WHEN norm IS NULL THEN score WHEN score IS NULL THEN 0.75 * norm ELSE greatest(score, 0.9 * norm) END AS score FROM o FULL OUTER JOIN n ON o.id = n.id) SELECT id, round(score, 6)::DOUBLE AS score FROM m UNION ALL SELECT doc_id, round(0.7 * (doc_id % 4) / 4.0, 6)::DOUBLE FROM documents WHERE doc_id NOT IN (SELECT id FROM m)")
def meta_path_merge(spark, sf):
    i = F.col("doc_id")
    d = table(spark, sf, "documents")
    found = d.where("doc_id % 5 <> 0").select(i.alias("id"), (i % 10 / 10).alias("score"))
    pushed = d.where("doc_id % 3 <> 0").select(i.alias("id"), (i % 7 + 1).cast("double").alias("score"))
    return rounded(graph.meta_path_merge(found, pushed, d.select(i.alias("id"), (i % 4 / 4).alias("score"))), "score")


_POOL = "pool AS (SELECT doc_id % 50 AS qid, doc_id AS id, (doc_id * 37 % 101) / 101.0::DOUBLE AS composite FROM documents)"


def _pool(spark, sf):
    i = F.col("doc_id")
    return table(spark, sf, "documents").select((i % 50).alias("qid"), i.alias("id"), (i * 37 % 101 / 101).alias("composite"))


@query("drop_unarbitrated", f"WITH {_POOL} SELECT qid, id FROM pool WHERE NOT (id % 2 = 0 AND id % 3 <> 0 AND id % 5 <> 0)")
def drop_unarbitrated(spark, sf):
    p = _pool(spark, sf)
    c = p.select("qid", "id", F.expr("id % 2 = 0").alias("admitted"), F.expr("id % 3 = 0").alias("current_supported"), F.expr("id % 5 = 0").alias("gate_passed"))
    return fusion.drop_unarbitrated(p, c).select("qid", "id")


@query("recency_order", f"WITH {_POOL}, {WORK_SQL}, j AS (SELECT qid, pool.id, composite, qid % 2 = 0 AND content_type IN ('handoff', 'decision', 'progress') AS f FROM pool JOIN work ON work.id = pool.id) SELECT qid, id, CAST(row_number() OVER (PARTITION BY qid ORDER BY f DESC, round(composite, 9) DESC, id) AS INTEGER) AS place FROM j")
def recency_order(spark, sf):
    p = _pool(spark, sf).join(work(spark, sf).select("id", "content_type"), "id")
    return fusion.recency_order(p, p.where("qid % 2 = 0").select("qid")).select("qid", "id", "place")


# evaluation of hooks


_CASES = """cases AS (SELECT conv_id AS case_id, list(turn ORDER BY turn) FILTER (role <> 'user') AS injected, list(turn ORDER BY turn) FILTER (turn % 3 = 1) AS must, list(turn ORDER BY turn) FILTER (turn % 4 = 3) AS must_not FROM conversations GROUP BY conv_id),
c AS (SELECT case_id, CASE WHEN case_id % 6 = 0 THEN [] ELSE coalesce(injected, []) END AS injected, coalesce(must, []) AS must, coalesce(must_not, []) AS must_not, case_id % 4 = 0 AS abstain, ['harmless', 'required', 'forbidden'][case_id % 3 + 1] AS prior_leg, case_id % 2 = 0 AS prior_on, case_id % 90 AS ms FROM cases)"""


def _hook_cases(spark, sf):
    i = F.col("conv_id")
    turns = lambda cond: F.sort_array(F.collect_list(F.when(cond, F.col("turn"))))
    g = table(spark, sf, "conversations").groupBy("conv_id").agg(turns(F.col("role") != "user").alias("inj"), turns(F.col("turn") % 3 == 1).alias("must"), turns(F.col("turn") % 4 == 3).alias("must_not"))
    return g.select(
        i.alias("case_id"),
        F.when(i % 6 == 0, F.slice("inj", 1, 0)).otherwise(F.col("inj")).alias("injected"),
        "must",
        "must_not",
        (i % 4 == 0).alias("expect_abstain"),
        F.element_at(F.array(F.lit("harmless"), F.lit("required"), F.lit("forbidden")), (i % 3 + 1).cast("int")).alias("prior_leg"),
        (i % 2 == 0).alias("prior_leg_enabled"),
        (i % 90).alias("elapsed_ms"),
        F.lit(60).alias("budget_ms"),
    )


_METRICS = """m AS (SELECT case_id, len(injected)::INTEGER AS injected, len(list_filter(injected, lambda p: list_contains(must_not, p)))::INTEGER AS must_not_count, CASE WHEN len(injected) > 0 THEN len(list_filter(injected, lambda p: list_contains(must_not, p)))::DOUBLE / len(injected) END AS must_not_rate, CASE WHEN len(must) > 0 THEN len(list_filter(must, lambda p: list_contains(injected, p)))::DOUBLE / len(must) END AS must_recall, CASE WHEN abstain THEN (len(injected) = 0)::INTEGER END AS abstention_correct, CASE WHEN NOT abstain AND len(must) > 0 THEN (len(injected) = 0)::INTEGER END AS false_abstain, CASE WHEN prior_leg = 'required' THEN prior_on::INTEGER WHEN prior_leg <> 'harmless' THEN (NOT prior_on)::INTEGER END AS prior_leg_ok, ms AS elapsed_ms, ms > 60 AS timed_out FROM c)"""


@query("hook_cases", f"WITH {_CASES}, {_METRICS} SELECT * REPLACE (round(must_not_rate, 6) AS must_not_rate, round(must_recall, 6) AS must_recall) FROM m")
def hook_cases(spark, sf):
    return rounded(evaluation.hook_cases(_hook_cases(spark, sf)), "must_not_rate", "must_recall")


@query("hook_summary", f"WITH {_CASES}, {_METRICS} SELECT count(*) AS cases, round(avg((must_not_count > 0)::INT), 6) AS must_not_case_rate, round(sum(must_not_count)::DOUBLE / sum(injected), 6) AS must_not_doc_rate, round(avg(must_recall), 6) AS must_recall, round(avg(abstention_correct), 6) AS abstention_accuracy, round(avg(false_abstain), 6) AS false_abstain_rate, round(avg(prior_leg_ok), 6) AS prior_leg_accuracy, round(avg(timed_out::INT), 6) AS timeout_rate FROM m")
def hook_summary(spark, sf):
    s = evaluation.hook_summary(evaluation.hook_cases(_hook_cases(spark, sf)))
    return rounded(s, *[c for c in s.columns if c != "cases"])
