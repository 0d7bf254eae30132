"""Queries over what a vault stores: the keyword index, the write path, facts with evidence, verdicts, provider scores."""

from __future__ import annotations

import os
import re

from pyspark.sql import functions as F

from vaultframe.functions import text
from vaultframe.operators import consolidation, context, entities, fts, invariants, lifecycle, posting_store, providers, verdicts
from vaultframe.plans import catalogue, hybrid
from vaultframe.plans.catalogue import INDEX_SQL, fields, query, rounded, searches
from vaultframe.sources import adapter, scratch, token_chunks
from vaultframe.sources.adapter import CONTENT_TYPES, META_SQL, NOW, now, table

_KEPT_INDEX_SQL = INDEX_SQL.replace("FROM documents", "FROM documents WHERE doc_id % 50 <> 3")


@query("stored_index_search", f"WITH {META_SQL}, {_KEPT_INDEX_SQL} SELECT qid, id, round(bm25, 6) AS bm25, round(score, 6) AS score, rank FROM (SELECT bm.*, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(bm25, 9), bm.id) AS INTEGER) AS rank FROM bm JOIN meta ON bm.id = meta.id AND meta.active) WHERE rank <= 20")
def stored_index_search(spark, sf):
    """All documents are indexed, a hundredth of them with older texts; then these are indexed again and a fiftieth goes."""
    docs, root = fields(spark, sf), scratch.fresh(spark, "index")
    older = docs.withColumn("body", F.when(F.col("id") % 100 == 7, F.concat(F.lit("und von the and "), F.coalesce("body", F.lit("")))).otherwise(F.col("body")))
    state = posting_store.apply(spark, root, posting_store.empty(), older, None)
    state = posting_store.apply(spark, root, state, docs.where("id % 100 = 7"), docs.where("id % 50 = 3").select("id"))
    found = posting_store.search(spark, state, searches(spark), 20, hybrid.eligible(adapter.metadata(spark, sf)))
    return rounded(found.select("qid", "id", "bm25", "score", "rank"), "bm25", "score")


def stored_documents(spark, sf):
    """documents as a vault holds them, with owners, and created within the last hour."""
    d = table(spark, sf, "documents")
    meta = adapter.metadata(spark, sf).select("id", "content_type", "authored_at", "confidence", "active", "revision_count", "duplicate_count")
    base = d.select(F.col("doc_id").alias("id"), F.col("source").alias("collection"), F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.sha2("text", 256).alias("hash"), text.normalized_hash("text").alias("normalized_hash"), F.col("n_chars").cast("int").alias("body_length"))
    made = now() - F.make_dt_interval(mins=(F.col("id") % 60).cast("int"))
    return base.join(meta, "id").withColumns({"created_at": made, "modified_at": made, "last_seen_at": made, "title": F.lit("t"), "quality_score": F.lit(0.5), "topic_key": F.lit(None).cast("string"), "pinned": F.lit(False), "access_count": F.lit(0).cast("long"), "origin": F.when(F.col("id") % 5 == 0, "fs").when(F.col("id") % 5 == 1, "api"), "deactivated_reason": F.when(~F.col("active"), "forget")})


def memories(spark, sf):
    d = table(spark, sf, "documents")
    path = F.when(F.col("doc_id") % 3 == 0, F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("new/"), (F.col("doc_id") % 200).cast("string"), F.lit(".md"))).otherwise(F.concat(F.lit("new/"), F.col("doc_id").cast("string"), F.lit(".md")))
    body = F.when(F.col("doc_id") % 4 == 0, F.col("text")).otherwise(F.concat("text", F.lit(" again "), (F.col("doc_id") % 7).cast("string")))
    return d.select(F.col("doc_id").alias("seq"), F.col("source").alias("collection"), path.alias("path"), F.lit("m").alias("title"), body.alias("body"), F.element_at(F.array(*map(F.lit, CONTENT_TYPES)), (F.col("doc_id") % 13 + 1).cast("int")).alias("content_type"))


_NORMAL = r"sha256(trim(regexp_replace(lower({0}), '\s+', ' ', 'g')))"
_SAVE_SQL = f"""
WITH {META_SQL},
ex AS (SELECT m.id, m.collection, m.path, m.active, m.content_type, m.duplicate_count, m.revision_count, {_NORMAL.format("d.text")} AS h,
  TIMESTAMP '{NOW}' - to_minutes(CAST(m.id % 60 AS INTEGER)) AS created_at, CASE m.id % 5 WHEN 0 THEN 'fs' WHEN 1 THEN 'api' END AS origin,
  CASE WHEN NOT m.active THEN 'forget' END AS reason FROM meta m JOIN documents d ON d.doc_id = m.id),
rows AS (SELECT doc_id AS seq, source AS collection, CASE doc_id % 3 WHEN 0 THEN lang || '/' || doc_id || '.md' WHEN 1 THEN 'new/' || (doc_id % 200) || '.md' ELSE 'new/' || doc_id || '.md' END AS path,
  [{", ".join(f"'{t}'" for t in CONTENT_TYPES)}][doc_id % 13 + 1] AS content_type, {_NORMAL.format("CASE WHEN doc_id % 4 = 0 THEN text ELSE text || ' again ' || (doc_id % 7) END")} AS h FROM documents),
twin AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY collection, content_type, h ORDER BY created_at DESC, id DESC) AS r FROM ex
  WHERE active AND (origin IS NULL OR origin = 'api') AND created_at >= TIMESTAMP '{NOW}' - INTERVAL 30 MINUTE) WHERE r = 1),
j AS (SELECT r.*, p.id AS path_id, p.revision_count AS path_revision, t.id AS twin_id, t.path AS twin_path, t.duplicate_count AS twin_count,
  CASE WHEN p.active AND p.origin = 'fs' THEN 'owned by files' WHEN NOT p.active THEN 'inactive: ' || p.reason END AS reason
  FROM rows r LEFT JOIN ex p ON p.collection = r.collection AND p.path = r.path LEFT JOIN twin t ON t.collection = r.collection AND t.content_type = r.content_type AND t.h = r.h),
good AS (SELECT *, row_number() OVER w AS nth, first_value(path) OVER w AS head_path FROM j WHERE reason IS NULL WINDOW w AS (PARTITION BY collection, content_type, h ORDER BY seq)),
wr AS (SELECT *, row_number() OVER (PARTITION BY collection, path ORDER BY seq) AS k FROM good WHERE twin_id IS NULL AND nth = 1)
SELECT seq, 'refused' AS action, reason, collection, path, path_id AS id, NULL::BIGINT AS duplicate_count, NULL::BIGINT AS revision_count FROM j WHERE reason IS NOT NULL
UNION ALL SELECT g.seq, 'deduplicated', NULL, g.collection, coalesce(g.twin_path, g.head_path), CASE WHEN g.twin_id IS NOT NULL THEN g.twin_id ELSE e.id END, CAST(coalesce(g.twin_count, 0) + g.nth AS BIGINT), NULL
  FROM good g LEFT JOIN ex e ON e.collection = g.collection AND e.path = g.head_path WHERE g.twin_id IS NOT NULL OR g.nth > 1
UNION ALL SELECT seq, CASE WHEN path_id IS NULL AND k = 1 THEN 'inserted' ELSE 'updated' END, NULL, collection, path, path_id, NULL, CAST(coalesce(path_revision, 0) + k AS BIGINT) FROM wr"""


@query("save_memory_batch", _SAVE_SQL)
def save_memory_batch(spark, sf):
    outcomes, _ = lifecycle.save_batch(stored_documents(spark, sf), memories(spark, sf), now())
    return outcomes


# facts and their evidence


def facts(spark, sf):
    o = table(spark, sf, "orders")
    literal = adapter.triples(spark, sf).select("id", "subject", "predicate", F.lit(None).cast("long").alias("object_entity"), F.col("object").alias("object_literal"), "valid_from", "valid_to", "confidence")
    linked = o.where("o_orderkey % 5 = 0").select((F.col("o_orderkey") + 100_000_000).alias("id"), F.col("o_custkey").alias("subject"), F.lit("refers_to").alias("predicate"), (F.col("o_custkey") % 50).alias("object_entity"), F.lit(None).cast("string").alias("object_literal"), F.col("o_orderdate").alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"), F.lit(1.0).alias("confidence"))
    return literal.unionByName(linked)


def sightings(spark, sf):
    o = table(spark, sf, "orders")
    doc = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey") % 100)
    fact = F.when(F.col("o_orderkey") % 7 != 0, F.concat(F.lit("f"), (F.col("o_orderkey") % 3).cast("string")))
    rows = lambda where, predicate, entity, literal: o.where(where).select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("subject"), F.lit(predicate).alias("predicate"), entity.alias("object_entity"), literal.alias("object_literal"), F.lit(None).cast("timestamp_ntz").alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"), F.lit(None).cast("double").alias("confidence"), doc.alias("doc_id"), fact.alias("fact"))
    return rows("o_orderkey % 4 = 0", "Ordered  Status", F.lit(None).cast("long"), F.col("o_orderstatus")).unionByName(rows("o_orderkey % 6 = 0", "refers to", (F.col("o_custkey") + 1) % 60, F.lit("ignored")))


_FACT_SQL = f"""
{adapter.TRIPLE_SQL.strip()},
old AS (SELECT id, subject, predicate, NULL::BIGINT AS oe, object AS ol, valid_to FROM triples
  UNION ALL SELECT o_orderkey + 100000000, o_custkey, 'refers_to', o_custkey % 50, NULL, NULL FROM orders WHERE o_orderkey % 5 = 0),
oldev AS (SELECT id AS triple_id, id % 200 AS doc_id, 'f' || (id % 4) AS fact, TIMESTAMP '{NOW}' - to_days(1) AS created_at FROM old WHERE id % 3 = 0),
news AS (SELECT o_orderkey AS seq, o_custkey AS subject, 'ordered_status' AS predicate, NULL::BIGINT AS oe, o_orderstatus AS ol, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 100 END AS doc_id, CASE WHEN o_orderkey % 7 <> 0 THEN 'f' || (o_orderkey % 3) END AS fact FROM orders WHERE o_orderkey % 4 = 0
  UNION ALL SELECT o_orderkey, o_custkey, 'refers_to', (o_custkey + 1) % 60, NULL, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 100 END, CASE WHEN o_orderkey % 7 <> 0 THEN 'f' || (o_orderkey % 3) END FROM orders WHERE o_orderkey % 6 = 0),
live AS (SELECT subject, predicate, oe, ol, min(id) AS id FROM old WHERE valid_to IS NULL GROUP BY ALL),
met AS (SELECT n.*, l.id FROM news n LEFT JOIN live l ON l.subject = n.subject AND l.predicate = n.predicate AND l.oe IS NOT DISTINCT FROM n.oe AND l.ol IS NOT DISTINCT FROM n.ol),
firsts AS (SELECT subject, predicate, oe, ol, min(seq) AS seq FROM met WHERE id IS NULL GROUP BY subject, predicate, oe, ol),
fresh AS (SELECT subject, predicate, oe, ol, (SELECT max(id) FROM old) + row_number() OVER (ORDER BY seq, predicate) AS id FROM firsts),
alltriples AS (SELECT id, subject, predicate, oe, ol, valid_to FROM old UNION ALL SELECT id, subject, predicate, oe, ol, NULL FROM fresh),
tied AS (SELECT DISTINCT coalesce(m.id, f.id) AS triple_id, doc_id, fact FROM met m LEFT JOIN fresh f ON f.subject = m.subject AND f.predicate = m.predicate AND f.oe IS NOT DISTINCT FROM m.oe AND f.ol IS NOT DISTINCT FROM m.ol),
ev AS (SELECT * FROM oldev UNION ALL SELECT triple_id, doc_id, fact, TIMESTAMP '{NOW}' FROM tied t WHERE NOT EXISTS (SELECT 1 FROM oldev e WHERE e.triple_id = t.triple_id AND coalesce(e.doc_id, -1) = coalesce(t.doc_id, -1) AND coalesce(e.fact, '') = coalesce(t.fact, ''))),"""


@query(
    "triple_evidence",
    f"""WITH {_FACT_SQL}
ranked AS (SELECT ev.*, d.lang || '/' || d.doc_id || '.md' AS path, row_number() OVER (PARTITION BY triple_id ORDER BY created_at DESC, ev.doc_id DESC NULLS LAST, fact DESC NULLS LAST) AS n FROM ev LEFT JOIN documents d ON d.doc_id = ev.doc_id),
lists AS (SELECT triple_id, count(*) AS evidence_count, string_agg(concat_ws('|', CAST(n AS VARCHAR), coalesce(CAST(doc_id AS VARCHAR), '-'), coalesce(path, '-'), coalesce(fact, '-')), ';' ORDER BY n) FILTER (WHERE n <= 5) AS sources FROM ranked GROUP BY triple_id),
side AS (SELECT subject AS entity_id, 'outgoing' AS direction, * FROM alltriples UNION ALL SELECT oe, 'incoming', * FROM alltriples WHERE oe IS NOT NULL)
SELECT side.entity_id, direction, side.id, coalesce(s.c_name, CAST(subject AS VARCHAR)) AS subject, predicate, coalesce(o.c_name, ol, CAST(oe AS VARCHAR)) AS object, valid_to IS NULL AS current, coalesce(evidence_count, 0) AS evidence_count, sources
FROM side LEFT JOIN customer s ON s.c_custkey = side.subject LEFT JOIN customer o ON o.c_custkey = side.oe LEFT JOIN lists ON lists.triple_id = side.id""",
)
def triple_evidence(spark, sf):
    """Facts seen again gain evidence, others become triples; all are told from either side with their newest sources."""
    old = facts(spark, sf)
    day_before = now() - F.make_dt_interval(days=F.lit(1))
    proofs = old.where("id % 3 = 0").select(F.col("id").alias("triple_id"), (F.col("id") % 200).alias("doc_id"), F.concat(F.lit("f"), (F.col("id") % 4).cast("string")).alias("fact"), day_before.alias("created_at"))
    seen = sightings(spark, sf).withColumn("seq", F.col("seq") * 2 + (F.col("predicate") == "refers to").cast("int"))
    fresh, more = entities.add_facts(old, proofs, seen, now())
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("collection"), F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"))
    names = table(spark, sf, "customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("name"))
    told = entities.with_evidence(old.unionByName(fresh), proofs.unionByName(more), docs, names)
    dash = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    return told.withColumn("sources", F.array_join(F.transform("sources", lambda s: F.concat_ws("|", s.n.cast("string"), dash(s.doc_id), dash(s.path), dash(s.fact))), ";"))


# facts for prompts


def prompt_rows(spark, sf):
    c = table(spark, sf, "conversations").where("role = 'user'")
    named = F.concat("text", F.lit(" default:concept:"), F.lower(F.regexp_extract("text", "([A-Za-z]+)", 1)))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("pid"), F.when(F.col("turn") % 4 == 0, named).otherwise(F.col("text")).alias("prompt"))


def named_nodes(spark, sf):
    """Words, and pairs of words, that documents begin with; some are both a concept and a tool."""
    # only the two words in front are looked for, however long a text is
    pair = r"^[^A-Za-z]*([A-Za-z]+)[^A-Za-z]+([A-Za-z]+)"
    d = table(spark, sf, "documents").select("doc_id", *(F.regexp_extract("text", pair, n).alias(c) for n, c in ((1, "first"), (2, "second"))))
    kind = F.when(F.col("doc_id") % 5 == 0, "tool").otherwise("concept")
    name = F.when(F.col("doc_id") % 2 == 0, F.col("first")).otherwise(F.col("second"))
    names = F.when(F.col("doc_id") % 3 == 0, F.array(name, F.concat_ws(" ", "first", "second"))).otherwise(F.array(name))
    both = d.where("second <> ''").select("doc_id", F.explode(names).alias("name"), kind.alias("kind")).withColumn("entity_id", F.concat(F.lit("default:"), "kind", F.lit(":"), F.regexp_replace(F.lower("name"), " ", "_")))
    return both.groupBy("entity_id").agg(F.min("name").alias("name"), F.min("doc_id").alias("first_doc"))


def node_triples(spark, sf, nodes=None):
    """Each node is in a language; nodes whose first documents follow one another are linked."""
    nodes = named_nodes(spark, sf) if nodes is None else nodes
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("first_doc"), "lang")
    valid_to = F.when(F.col("first_doc") % 4 == 0, now() - F.make_dt_interval(days=F.lit(1))).when(F.col("first_doc") % 9 == 0, now() + F.make_dt_interval(days=F.lit(1)))
    none = lambda t: F.lit(None).cast(t)
    spoken = nodes.join(d, "first_doc").select(F.concat("entity_id", F.lit("#in")).alias("id"), F.col("entity_id").alias("subject"), F.lit("spoken_in").alias("predicate"), none("string").alias("object_entity"), F.col("lang").alias("object_literal"), valid_to.alias("valid_to"))
    following = nodes.select(F.col("entity_id").alias("object_entity"), (F.col("first_doc") - 1).alias("first_doc"))
    linked = nodes.join(following, "first_doc").select(F.concat_ws("#", "entity_id", "object_entity").alias("id"), F.col("entity_id").alias("subject"), F.lit("before").alias("predicate"), "object_entity", none("string").alias("object_literal"), none("timestamp_ntz").alias("valid_to"))
    return spoken.unionByName(linked)


_VAULT_FACTS_SQL = rf"""
WITH prompts AS (SELECT conv_id * 1000 + turn AS pid, CASE WHEN turn % 4 = 0 THEN text || ' default:concept:' || lower(regexp_extract(text, '([A-Za-z]+)', 1)) ELSE text END AS prompt FROM conversations WHERE role = 'user'),
w AS (SELECT doc_id, regexp_extract_all(text, '([A-Za-z]+)', 1) AS w, CASE WHEN doc_id % 5 = 0 THEN 'tool' ELSE 'concept' END AS kind FROM documents),
rawnodes AS (SELECT doc_id, w[CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END] AS name, kind FROM w WHERE len(w) > 1 UNION ALL SELECT doc_id, w[1] || ' ' || w[2], kind FROM w WHERE len(w) > 1 AND doc_id % 3 = 0),
nodes AS (SELECT 'default:' || kind || ':' || replace(lower(name), ' ', '_') AS entity_id, min(name) AS name, min(doc_id) AS first_doc FROM rawnodes GROUP BY 1),
tr AS (SELECT entity_id || '#in' AS id, entity_id AS subject, 'spoken_in' AS predicate, NULL AS oe, lang AS ol, CASE WHEN first_doc % 4 = 0 THEN TIMESTAMP '{NOW}' - to_days(1) WHEN first_doc % 9 = 0 THEN TIMESTAMP '{NOW}' + to_days(1) END AS valid_to FROM nodes JOIN documents ON doc_id = first_doc
  UNION ALL SELECT a.entity_id || '#' || b.entity_id, a.entity_id, 'before', b.entity_id, NULL, NULL FROM nodes a JOIN nodes b ON b.first_doc - 1 = a.first_doc),
named AS (SELECT lower(name) AS key, min(entity_id) AS entity_id FROM nodes GROUP BY 1 HAVING count(DISTINCT entity_id) = 1),
p1 AS (SELECT pid, key, min(pos) AS pos FROM (SELECT pid, unnest(x) AS key, generate_subscripts(x, 1) AS pos FROM (SELECT pid, list_filter(regexp_split_to_array(prompt, '[^a-zA-Z0-9_:-]+'), lambda t: regexp_full_match(t, '[a-z][a-z0-9-]*:[a-z_]+:[a-z0-9_]([a-z0-9_-]*[a-z0-9_])?')) AS x FROM prompts)) GROUP BY ALL),
p2 AS (SELECT pid, lower(key) AS key, min(pos) AS pos FROM (SELECT pid, unnest(x) AS key, generate_subscripts(x, 1) AS pos FROM (SELECT pid, regexp_extract_all(prompt, '\b(?:[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]*)*|[A-Z]{{2,}}[a-z0-9]*)\b') AS x FROM prompts)) GROUP BY ALL),
toks AS (SELECT pid, list_filter([regexp_replace(t, '^[^a-zA-Z0-9\-]+|[^a-zA-Z0-9\-]+$', '', 'g') FOR t IN regexp_split_to_array(prompt, '[\s,;:!?"''`()\[\]{{}}<>]+')], lambda t: t <> '') AS x FROM prompts),
p3 AS (SELECT pid, key, min(-n) AS size, min(pos) AS pos FROM (
  SELECT pid, 1 AS n, unnest([lower(t) FOR t IN x]) AS key, generate_subscripts(x, 1) AS pos FROM toks
  UNION ALL SELECT pid, 2, lower(x[i] || ' ' || x[i + 1]), i FROM (SELECT pid, x, unnest(range(1, len(x))) AS i FROM toks)
  UNION ALL SELECT pid, 3, lower(x[i] || ' ' || x[i + 1] || ' ' || x[i + 2]), i FROM (SELECT pid, x, unnest(range(1, len(x) - 1)) AS i FROM toks)) GROUP BY pid, key),
cand AS (SELECT pid, entity_id, 1 AS a, 0 AS b, pos AS c FROM p1 JOIN nodes ON entity_id = key UNION ALL SELECT pid, entity_id, 2, 0, pos FROM p2 JOIN named USING (key) UNION ALL SELECT pid, entity_id, 3, size, pos FROM p3 JOIN named USING (key)),
placed AS (SELECT pid, entity_id, row_number() OVER (PARTITION BY pid ORDER BY a, b, c, entity_id) AS place FROM (SELECT *, row_number() OVER (PARTITION BY pid, entity_id ORDER BY a, b, c) AS r FROM cand) WHERE r = 1),
ents AS (SELECT * FROM placed WHERE place <= 100),
cur AS (SELECT tr.id, subject, oe, concat_ws(' ', coalesce(s.name, subject), predicate, coalesce(o.name, ol, oe)) AS line FROM tr LEFT JOIN nodes s ON s.entity_id = subject LEFT JOIN nodes o ON o.entity_id = oe WHERE valid_to IS NULL OR valid_to > TIMESTAMP '{NOW}'),
lines AS (SELECT entity_id, line, row_number() OVER (PARTITION BY entity_id ORDER BY side, id) AS nth FROM (SELECT subject AS entity_id, 0 AS side, id, line FROM cur UNION ALL SELECT oe, 1, id, line FROM cur WHERE oe IS NOT NULL)),
once AS (SELECT pid, line, min((place, nth)) AS turn FROM ents JOIN lines USING (entity_id) WHERE nth <= 10 GROUP BY ALL),
fit AS (SELECT *, sum(ceil(length(line) / 4.0) + 1) OVER (PARTITION BY pid ORDER BY turn, line ROWS UNBOUNDED PRECEDING) + 8 AS spent FROM once)
SELECT e.pid, e.entities, f.n_facts, f.block FROM (SELECT pid, count(*) AS entities FROM ents GROUP BY pid) e
JOIN (SELECT pid, count(*) AS n_facts, '<vault-facts>' || chr(10) || string_agg(line, chr(10) ORDER BY turn, line) || chr(10) || '</vault-facts>' AS block FROM fit WHERE spent <= 60 GROUP BY pid) f ON f.pid = e.pid"""


@query("vault_facts", _VAULT_FACTS_SQL)
def vault_facts(spark, sf):
    nodes = scratch.written(named_nodes(spark, sf), "nodes")
    return context.vault_facts(prompt_rows(spark, sf), nodes.select("entity_id", "name"), node_triples(spark, sf, nodes), now(), 60)


# verdicts


def turn_evidence(spark, sf):
    """Prompts as turns a minute apart, answers by their words, a stop after every third answer; each prompt was given words of its own text."""
    c = table(spark, sf, "conversations")
    at = now() + F.make_dt_interval(mins=F.col("turn").cast("int"))
    base = c.select(F.col("conv_id").cast("string").alias("session"), (F.col("turn") * 10).alias("seq"), at.alias("at"), "turn", "role", "conv_id", "text")
    sha, words = F.sha1("text"), F.array_distinct(text.tokens("text"))
    none = lambda t: F.lit(None).cast(t)
    row = lambda where, kind, seq, h, w, usage, shift: base.where(where).select("session", seq.alias("seq"), (F.col("at") + F.make_dt_interval(secs=shift)).alias("at"), F.lit(kind).alias("kind"), h.alias("hash"), w.alias("words"), usage.alias("usage_id"))
    human = row("role = 'user'", "human", F.col("seq"), sha, none("array<string>"), none("long"), F.lit(0))
    assistant = row("role = 'assistant'", "assistant", F.col("seq"), none("string"), words, none("long"), F.lit(0))
    stop = row("role = 'assistant' and turn % 3 = 0", "stop", F.col("seq") + 1, none("string"), none("array<string>"), none("long"), F.lit(0))
    # one prompt in seven was changed on its way, so that no turn has its hash; one in eleven was given long before
    given = F.when(F.col("turn") % 7 == 6, F.sha1(F.concat("text", F.lit("!")))).otherwise(sha)
    usage = row("role = 'user'", "usage", F.col("seq") + 2, given, F.filter(words, lambda w: F.length(w) > 2), F.col("conv_id") * 1000 + F.col("turn"), F.when((F.col("conv_id") + F.col("turn")) % 11 == 0, -5000).otherwise(20))
    return human.unionByName(assistant).unionByName(stop).unionByName(usage)


_TURN_SQL = rf"""
WITH base AS (SELECT CAST(conv_id AS VARCHAR) AS session, turn * 10 AS seq, TIMESTAMP '{NOW}' + to_minutes(CAST(turn AS INTEGER)) AS tm, turn, role, conv_id, text, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')) AS words FROM conversations),
told AS (SELECT session, seq, tm, 'human' AS kind, sha1(text) AS hash, NULL AS words FROM base WHERE role = 'user' UNION ALL SELECT session, seq, tm, 'assistant', NULL, words FROM base WHERE role = 'assistant'
  UNION ALL SELECT session, seq + 1, tm, 'stop', NULL, NULL FROM base WHERE role = 'assistant' AND turn % 3 = 0),
num AS (SELECT *, sum(CASE WHEN kind = 'human' THEN 1 ELSE 0 END) OVER w AS t FROM told WINDOW w AS (PARTITION BY session ORDER BY tm, seq ROWS UNBOUNDED PRECEDING)),
ans AS (SELECT *, max(CASE WHEN kind = 'assistant' THEN t END) OVER (PARTITION BY session ORDER BY tm, seq ROWS UNBOUNDED PRECEDING) AS answered FROM num),
turns AS (SELECT session, t, max(CASE WHEN kind = 'human' THEN hash END) AS hash, min(CASE WHEN kind = 'human' THEN tm END) AS opened, bool_or(coalesce(kind = 'stop' AND answered = t, false)) AS stopped FROM ans WHERE t > 0 GROUP BY ALL),
ov AS (SELECT *, stopped OR lead(t) OVER (PARTITION BY session ORDER BY t) IS NOT NULL AS over, max(opened) OVER (PARTITION BY session) AS newest FROM turns),
us AS (SELECT session, conv_id * 1000 + turn AS usage_id, CASE WHEN turn % 7 = 6 THEN sha1(text || '!') ELSE sha1(text) END AS hash, tm + to_seconds(CASE WHEN (conv_id + turn) % 11 = 0 THEN -5000 ELSE 20 END) AS used, list_filter(words, lambda w: length(w) > 2) AS words FROM base WHERE role = 'user'),
pr AS (SELECT u.session, u.usage_id, count(*) AS n, min(v.t) AS t, bool_or(v.over) AS over FROM us u JOIN ov v ON v.session = u.session AND v.hash = u.hash AND abs(epoch_us(u.used) - epoch_us(v.opened)) <= 600000000 GROUP BY ALL),
said AS (SELECT DISTINCT session, t, unnest(words) AS word FROM num WHERE kind = 'assistant'),
refs AS (SELECT p.session, p.usage_id, string_agg(DISTINCT s.word, ' ' ORDER BY s.word) AS r FROM pr p JOIN (SELECT session, usage_id, unnest(words) AS word FROM us) a ON a.session = p.session AND a.usage_id = p.usage_id JOIN said s ON s.session = p.session AND s.t = p.t AND s.word = a.word WHERE p.n = 1 GROUP BY ALL),
nw AS (SELECT session, max(opened) AS newest FROM turns GROUP BY 1)
SELECT u.session, u.usage_id, CASE WHEN p.n = 1 AND p.over THEN 'final' WHEN p.n = 1 THEN 'provisional' WHEN coalesce(nw.newest > u.used, false) THEN 'unattributable' ELSE 'pending' END AS state,
  CASE WHEN coalesce(p.n, 0) <> 1 AND coalesce(nw.newest > u.used, false) THEN 'no-unique-pair' END AS reason, coalesce(r.r, '') AS "references"
FROM us u LEFT JOIN pr p ON p.session = u.session AND p.usage_id = u.usage_id LEFT JOIN refs r ON r.session = u.session AND r.usage_id = u.usage_id LEFT JOIN nw ON nw.session = u.session"""


@query("turn_verdicts", _TURN_SQL)
def turn_verdicts(spark, sf):
    return verdicts.fold(turn_evidence(spark, sf)).withColumn("references", F.array_join("references", " "))


# a provider's scores


def shared_words(query: str, texts: list[str]) -> list[float]:
    """A deterministic stand-in for a cross-encoder: the share of the query's words that begin a word of the text."""
    words = sorted({w for w in re.split(r"[\W_]+", query.lower()) if w})
    return [sum(any(t.startswith(w) for t in re.split(r"[\W_]+", text.lower())) for w in words) / max(len(words), 1) for text in texts]


_PROVIDER_SQL = f"""WITH {META_SQL}, {INDEX_SQL},
top AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(bm25, 9), id) AS r FROM bm),
cand AS (SELECT t.qid, t.id, s.query, CASE WHEN t.id % 9 = 0 THEN NULL WHEN t.id % 4 = 0 THEN 'the and von' ELSE substr(d.text, 1, 60) END AS text FROM top t JOIN documents d ON d.doc_id = t.id JOIN (VALUES {{searches}}) s(qid, query) ON s.qid = t.qid WHERE r <= 20),
sc AS (SELECT qid, id, text, list_sum([CASE WHEN len(list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda t: starts_with(t, w))) > 0 THEN 1 ELSE 0 END FOR w IN string_split_regex(query, ' ')])::DOUBLE / len(string_split_regex(query, ' ')) AS score FROM cand)
SELECT qid, id, coalesce(score, 0) AS score, text IS NOT NULL AS covered, CAST(row_number() OVER (PARTITION BY qid ORDER BY coalesce(score, 0) DESC, id) AS INTEGER) AS place FROM sc"""


@query("rerank_provider", _PROVIDER_SQL.replace("{searches}", ", ".join(f"({i}, '{q}')" for i, q in catalogue.SEARCHES)))
def rerank_provider(spark, sf):
    """The best documents of each search, scored by a provider; documents with one text share a call, those without text are not covered."""
    found = scratch.written(fts.search(fields(spark, sf), searches(spark), 20).select("qid", "id"), "found")
    start = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 9 == 0, None).when(F.col("doc_id") % 4 == 0, "the and von").otherwise(F.substring("text", 1, 60)).alias("text"))
    few = scratch.written(start.join(found, "id", "left_semi"), "starts")  # few texts are cut, none is shuffled
    ranked, _ = providers.rerank(found.join(searches(spark), "qid").join(few, "id"), shared_words)
    return ranked.drop("error")


# consolidation


def pattern_rows(spark, sf):
    """(patterns, observations): odd and even documents; copies and near copies of each other are what belongs together."""
    d = table(spark, sf, "documents").withColumn("created_at", adapter.modified_at())  # no text is shuffled to meet it
    patterns = d.where("doc_id % 2 = 1").select(F.col("doc_id").alias("id"), F.col("lang").alias("collection"), "text", F.when(F.col("doc_id") % 6 == 1, F.array("doc_id", "doc_id")).otherwise(F.array(F.col("doc_id"), F.col("doc_id") % 10 + 10_000, F.lit(7).cast("long"))).alias("source_doc_ids"))
    observations = d.where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.col("lang").alias("collection"), F.col("text").alias("observation"), F.array(F.col("doc_id"), F.col("doc_id") % 13).alias("source_doc_ids"), F.when(F.col("doc_id") % 8 != 0, "active").otherwise("archived").alias("status"), "created_at")
    return patterns, observations


_CONSOLIDATE_SQL = rf"""
WITH RECURSIVE {META_SQL},
p AS (SELECT doc_id AS id, lang AS collection, text, [doc_id, doc_id % 10 + 10000, 7] AS src FROM documents WHERE doc_id % 2 = 1 AND doc_id % 6 <> 1),
o AS (SELECT doc_id AS id, lang AS collection, text, [doc_id, doc_id % 13] AS src FROM documents WHERE doc_id % 2 = 0),
t AS (SELECT 'p' AS kind, id, collection, text FROM p UNION ALL SELECT 'o', id, collection, text FROM o WHERE id % 8 <> 0),
ws AS (SELECT kind, id, collection, text, list_distinct(list_filter(string_split_regex(lower(text), '[ \t\n\x0b\f\r]+'), lambda w: length(w) > 3)) AS w FROM t),
pr AS (SELECT a.id, b.kind AS bk, b.id AS bid FROM ws a JOIN ws b ON a.kind = 'p' AND a.collection = b.collection AND (b.kind = 'o' OR b.id < a.id)
  AND len(a.w) > 0 AND len(b.w) > 0 AND 2 * len(a.w) > len(b.w) AND 2 * len(b.w) > len(a.w) AND len(list_intersect(a.w, b.w)) > 0.5 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))),
need AS (SELECT 'p' AS kind, id FROM pr UNION SELECT bk, bid FROM pr),
nt AS (SELECT t.kind, t.id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]+', ' ', 'g'), '\s+', ' ', 'g')) AS s,
  list_distinct(list_filter([lower(x) FOR x IN regexp_extract_all(text, '\b([A-Z][a-zA-Z0-9]{{1,}})\b', 1)], lambda x: NOT list_contains([{", ".join(f"'{w}'" for w in text.ANCHOR_STOPWORDS)}], x))) AS names FROM t JOIN need n ON n.kind = t.kind AND n.id = t.id),
g AS (SELECT kind, id, g, count(*) AS n FROM (SELECT kind, id, unnest(CASE WHEN length(s) = 0 THEN [] WHEN length(s) < 3 THEN [s] ELSE [substr(s, i, 3) FOR i IN range(1, length(s) - 1)] END) AS g FROM nt) GROUP BY ALL),
nm AS (SELECT kind, id, sqrt(sum(n * n)::DOUBLE) AS norm FROM g GROUP BY ALL),
dt AS (SELECT pr.id, pr.bk, pr.bid, sum(ga.n * gb.n)::DOUBLE AS dot FROM pr JOIN g ga ON ga.kind = 'p' AND ga.id = pr.id JOIN g gb ON gb.kind = pr.bk AND gb.id = pr.bid AND gb.g = ga.g GROUP BY ALL),
sc AS (SELECT pr.*, coalesce(dot / (na.norm * nb.norm), 0) AS score, a.names AS x, b.names AS y FROM pr LEFT JOIN dt ON dt.id = pr.id AND dt.bk = pr.bk AND dt.bid = pr.bid LEFT JOIN nm na ON na.kind = 'p' AND na.id = pr.id LEFT JOIN nm nb ON nb.kind = pr.bk AND nb.id = pr.bid
  JOIN nt a ON a.kind = 'p' AND a.id = pr.id JOIN nt b ON b.kind = pr.bk AND b.id = pr.bid),
ok AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, bk, bid) AS r FROM sc WHERE NOT ((least(len(x), len(y)) > 0 AND len(list_intersect(x, y)) < least(len(x), len(y)) AND len(list_intersect(x, y)) <= least(len(x), len(y)) / 2.0) OR (least(len(x), len(y)) = 0 AND len(x) + len(y) > 0))
  AND score >= CASE WHEN len(x) = 0 AND len(y) = 0 THEN 0.98 ELSE 0.93 END),
up AS (SELECT p.id, CASE WHEN ok.bk = 'o' THEN ok.bid END AS ends_at, CASE WHEN ok.bk = 'p' THEN ok.bid END AS up FROM p LEFT JOIN ok ON ok.id = p.id AND ok.r = 1),
walk AS (SELECT id, ends_at, id AS at_id, up FROM up UNION ALL SELECT w.id, u.ends_at, u.id, u.up FROM walk w JOIN up u ON u.id = w.up),
root AS (SELECT id, ends_at, CASE WHEN ends_at IS NULL THEN at_id END AS head FROM walk WHERE up IS NULL),
grp AS (SELECT r.ends_at, r.head, max(p.collection) AS collection, arg_max(p.text, p.id) AS observation, flatten(list(p.src)) AS src, count(*) AS members FROM root r JOIN p ON p.id = r.id GROUP BY ALL)
SELECT ends_at AS observation_id, head, grp.collection, sha256(observation) AS observation, array_to_string(list_sort(list_distinct(list_concat(coalesce(o.src, []), grp.src))), ',') AS source_doc_ids,
  CAST(len(list_distinct(list_concat(coalesce(o.src, []), grp.src))) AS BIGINT) AS proof_count, members,
  CASE WHEN ends_at IS NULL OR date_diff('day', m.modified_at, TIMESTAMP '{NOW}') < 7 THEN 'NEW' WHEN len(list_distinct(list_concat(coalesce(o.src, []), grp.src))) >= 4 THEN 'STRENGTHENING' ELSE 'STABLE' END AS trend
FROM grp LEFT JOIN o ON o.id = ends_at LEFT JOIN meta m ON m.id = ends_at"""


@query("consolidate_patterns", _CONSOLIDATE_SQL)
def consolidate_patterns(spark, sf):
    found = consolidation.consolidate(*pattern_rows(spark, sf), now())
    return found.withColumns({"observation": F.sha2("observation", 256), "source_doc_ids": F.array_join(F.transform("source_doc_ids", lambda x: x.cast("string")), ",")})


def conclusion_rows(spark, sf):
    """(drafts, pool, mentions, nodes): every document is a draft of its own words and of its neighbour's first ones; it cites itself and a third."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "text")
    following = d.select((F.col("doc_id") - 1).alias("doc_id"), F.substring_index("text", " ", 6).alias("borrowed"))
    drafts = d.join(following, "doc_id").select(F.col("doc_id").alias("draft_id"), F.col("lang").alias("collection"), F.concat_ws(" ", F.substring_index("text", " ", 12), "borrowed").alias("conclusion"), F.array(F.col("doc_id"), F.col("doc_id") + 2).alias("source_ids"))
    words = d.where("doc_id % 4 <> 3").select("doc_id", F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1)).alias("w")).where("size(w) > 1")
    mentions = words.select("doc_id", F.explode(F.array(F.lower(F.get("w", F.lit(0))), F.lower(F.get("w", F.lit(1))), F.lower(F.concat_ws(" ", F.get("w", F.lit(0)), F.get("w", F.lit(1)))))).alias("entity_id")).distinct()
    return drafts, d.select(F.col("doc_id").alias("id"), F.col("lang").alias("collection"), "text"), mentions, mentions.select("entity_id", F.initcap("entity_id").alias("name")).distinct()


_CONTAMINATION_SQL = rf"""
WITH d AS (SELECT doc_id, lang, text, string_split(text, ' ') AS parts FROM documents),
dr AS (SELECT a.doc_id AS draft_id, a.lang AS collection, array_to_string(a.parts[1:12], ' ') || ' ' || array_to_string(b.parts[1:6], ' ') AS conclusion FROM d a JOIN d b ON b.doc_id = a.doc_id + 1),
src AS (SELECT draft_id, unnest([draft_id, draft_id + 2]) AS id FROM dr),
w AS (SELECT doc_id, regexp_extract_all(text, '([A-Za-z]+)', 1) AS w FROM documents WHERE doc_id % 4 <> 3),
men AS (SELECT DISTINCT doc_id, unnest([lower(w[1]), lower(w[2]), lower(w[1] || ' ' || w[2])]) AS entity_id FROM w WHERE len(w) > 1),
pool AS (SELECT DISTINCT lang AS collection, entity_id FROM men JOIN documents USING (doc_id)),
mine AS (SELECT DISTINCT draft_id, entity_id FROM src JOIN men ON men.doc_id = src.id),
bye AS (SELECT DISTINCT draft_id FROM mine),
eh AS (SELECT dr.draft_id, 'entity' AS method, array_to_string([upper(x[1]) || x[2:] FOR x IN string_split(e.entity_id, ' ')], ' ') AS hit FROM dr JOIN bye ON bye.draft_id = dr.draft_id JOIN pool e ON e.collection = dr.collection AND contains(lower(conclusion), e.entity_id)
  WHERE regexp_matches(lower(conclusion), '(^|[^a-z0-9])' || e.entity_id || '($|[^a-z0-9])') AND NOT EXISTS (SELECT 1 FROM mine m WHERE m.draft_id = dr.draft_id AND m.entity_id = e.entity_id)),
an AS (SELECT doc_id, lang, list_distinct(list_filter([lower(x) FOR x IN regexp_extract_all(text, '\b([A-Z][a-zA-Z0-9]{{1,}})\b', 1)], lambda x: NOT list_contains([{", ".join(f"'{w}'" for w in text.ANCHOR_STOPWORDS)}], x))) AS a FROM documents),
held AS (SELECT doc_id, lang, unnest(a) AS hit FROM an),
sp AS (SELECT draft_id, collection, unnest(list_distinct(list_filter([lower(x) FOR x IN regexp_extract_all(conclusion, '\b([A-Z][a-zA-Z0-9]{{1,}})\b', 1)], lambda x: NOT list_contains([{", ".join(f"'{w}'" for w in text.ANCHOR_STOPWORDS)}], x)))) AS hit FROM dr WHERE draft_id NOT IN (SELECT draft_id FROM bye)),
lh AS (SELECT DISTINCT sp.draft_id, 'lexical' AS method, sp.hit FROM sp JOIN held h ON h.lang = sp.collection AND h.hit = sp.hit WHERE NOT EXISTS (SELECT 1 FROM src JOIN held s ON s.doc_id = src.id WHERE src.draft_id = sp.draft_id AND s.hit = sp.hit))
SELECT DISTINCT * FROM eh UNION ALL SELECT * FROM lh"""


@query("contamination", _CONTAMINATION_SQL)
def contamination(spark, sf):
    return consolidation.contamination(*conclusion_rows(spark, sf))


# traces


def trace_tables(spark, sf):
    """Orders as traces, their lines as candidates; breaches come by arithmetic on the keys."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    m = lambda n: F.col("k") % n
    traces = o.select(
        F.col("k").alias("trace_id"), F.when(m(11) == 0, "empty").when(m(11) != 1, "injected").alias("outcome"), F.when(m(2) == 0, "none").alias("empty_reason"), F.when(m(13) == 0, "composite").otherwise("rrf").alias("ranking_key"),
        (m(29) != 3).alias("has_injection"), (m(31) != 4).alias("has_admission"), (m(4) == 0).alias("prior_certified"), F.when(m(9) != 8, m(7) * 0.125).alias("current_mass"), (m(5) * 0.125).alias("discounted_mass"), (m(3) * 0.125).alias("expansion_contribution"),
        F.lit(2).alias("protected_slots"), m(6).alias("admitted_current"), (m(2) == 0).alias("rerank_attempted"), (m(6) == 0).alias("rerank_failed"), (m(3) != 0).alias("ordering_applied"), (m(5) == 0).alias("gated"), (m(10) == 0).alias("degenerate"), m(700).alias("finalization_ms"),
    )
    x = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("trace_id"), F.col("l_linenumber").alias("ln")).agg((F.min("l_partkey") % 50).cast("string").alias("part"), F.min("l_suppkey").alias("l_suppkey"))
    # the rules read it many times
    x = scratch.written(x.select("trace_id", "ln", F.concat(F.lit("c"), F.col("ln").cast("string"), F.lit("-"), "part").alias("candidate"), F.concat(F.lit("p"), "part").alias("path"), "l_suppkey"), "lines")
    leg = F.element_at(F.array(*map(F.lit, ["bm25", "vec", "expansion-lex", "expansion-vec"])), (F.col("ln") % 4 + 1).cast("int"))
    candidates = x.select("trace_id", "candidate", "path", leg.alias("leg"), (F.col("ln") % 7 != 6).alias("pooled"), (F.col("ln") % 4 < 2).alias("current_supported"), (F.col("l_suppkey") % 2 == 0).alias("gate_passed"), (F.col("l_suppkey") % 3 != 0).alias("covered"), F.when(F.col("l_suppkey") % 5 == 0, "skill").otherwise("general").alias("vault"))
    entries = x.where("ln <= 4 and (trace_id % 11 <> 0 or trace_id % 3 = 0)")
    moved = F.when(F.col("trace_id") % 3 == 0, F.col("ln")).otherwise(F.col("ln") * 3 % 8)
    order = x.where("trace_id % 37 <> 5").select("trace_id", moved.alias("n"), "candidate", F.when(F.col("ln") > 2, 1).otherwise(0).alias("band"), (1.0 / (F.col("ln") % 3 + 1)).alias("key"))
    return traces, candidates, x.where("ln % 6 <> 5").select("trace_id", "path"), x.where("ln % 5 <> 4").select("trace_id", "candidate"), entries.select("trace_id", F.when(F.col("trace_id") % 17 == 0, 5 - F.col("ln")).otherwise(F.col("ln")).alias("n"), "path"), entries.select("trace_id", F.col("ln").alias("n"), "candidate", "path"), order


_TRACE_SQL = """
WITH t AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN 'empty' WHEN o_orderkey % 11 <> 1 THEN 'injected' END AS outcome FROM orders),
x AS (SELECT l_orderkey AS k, l_linenumber AS ln, 'c' || l_linenumber || '-' || (min(l_partkey) % 50) AS c, 'p' || (min(l_partkey) % 50) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY l_orderkey, l_linenumber),
e AS (SELECT * FROM x WHERE ln <= 4 AND (k % 11 <> 0 OR k % 3 = 0)),
fp AS (SELECT k, CASE WHEN k % 17 = 0 THEN 5 - ln ELSE ln END AS n, p FROM e),
fo AS (SELECT k, CASE WHEN k % 3 = 0 THEN ln ELSE ln * 3 % 8 END AS n, c, CASE WHEN ln > 2 THEN 1 ELSE 0 END AS band, 1.0::DOUBLE / (ln % 3 + 1) AS key FROM x WHERE k % 37 <> 5),
inj AS (SELECT k FROM t WHERE outcome = 'injected'),
np AS (SELECT t.k, t.outcome, count(fp.k) AS n FROM t LEFT JOIN fp ON fp.k = t.k GROUP BY ALL),
ej AS (SELECT e.k, e.ln, e.c, f.n AS place, f.band, f.key FROM e JOIN inj ON inj.k = e.k LEFT JOIN fo f ON f.k = e.k AND f.c = e.c WHERE e.k % 29 <> 3 AND e.k IN (SELECT k FROM fo)),
eb AS (SELECT *, place IS NULL OR coalesce(place <= max(place) OVER (PARTITION BY k ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS bad, lag(band) OVER (PARTITION BY k ORDER BY ln) AS pb, lag(key) OVER (PARTITION BY k ORDER BY ln) AS pk FROM ej),
ef AS (SELECT *, bool_or(bad) OVER (PARTITION BY k ORDER BY ln ROWS UNBOUNDED PRECEDING) AS failed FROM eb),
acted AS (SELECT k, coalesce(k % 2 = 0 AND k % 6 <> 0 AND k % 3 <> 0, false) AS a FROM inj),
lg AS (SELECT k, p FROM x WHERE ln % 7 <> 6 GROUP BY k, p HAVING bool_and(ln % 4 >= 2)),
nb AS (SELECT fo.*, lag(band) OVER w AS pb, lag(key) OVER w AS pk, lag(c) OVER w AS pc FROM fo JOIN inj ON inj.k = fo.k WINDOW w AS (PARTITION BY fo.k ORDER BY n)),
v AS (SELECT k, 'trace-complete' AS rule, NULL AS subject, 'no outcome' AS breach FROM t WHERE outcome IS NULL
UNION ALL SELECT k, 'trace-complete', NULL, 'empty without a reason' FROM t WHERE outcome = 'empty' AND k % 2 <> 0
UNION ALL SELECT k, 'trace-complete', NULL, 'empty with paths' FROM np WHERE outcome = 'empty' AND n > 0
UNION ALL SELECT k, 'trace-complete', NULL, 'injected without paths' FROM np WHERE outcome = 'injected' AND n = 0
UNION ALL SELECT fp.k, 'trace-complete', p, 'no pooled candidate' FROM fp JOIN inj ON inj.k = fp.k WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.k = fp.k AND x.p = fp.p AND ln % 7 <> 6)
UNION ALL SELECT fp.k, 'trace-complete', p, 'no composite score' FROM fp JOIN inj ON inj.k = fp.k WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.k = fp.k AND x.p = fp.p AND ln % 6 <> 5)
UNION ALL SELECT k, 'trace-complete', NULL, 'no injection record' FROM inj WHERE k % 29 = 3
UNION ALL SELECT k, 'trace-complete', NULL, 'entries differ from paths' FROM inj WHERE k % 29 <> 3 AND k IN (SELECT coalesce(a.k, b.k) FROM fp a FULL JOIN e b ON a.k = b.k AND a.n = b.ln WHERE a.p IS DISTINCT FROM b.p)
UNION ALL SELECT k, 'trace-complete', NULL, 'no admission record' FROM inj WHERE k % 31 = 4
UNION ALL SELECT e.k, 'admission-honored', c, 'not admitted' FROM e JOIN inj ON inj.k = e.k WHERE e.k % 31 <> 4 AND e.k % 29 <> 3 AND NOT EXISTS (SELECT 1 FROM x WHERE x.k = e.k AND x.c = e.c AND x.ln % 5 <> 4)
UNION ALL SELECT k, 'single-ranking-key', NULL, 'ordered by composite' FROM inj WHERE k % 13 = 0
UNION ALL SELECT k, 'single-ranking-key', NULL, 'no final order' FROM inj WHERE k NOT IN (SELECT k FROM fo)
UNION ALL SELECT k, 'single-ranking-key', NULL, 'no injection record' FROM inj WHERE k % 29 = 3 AND k IN (SELECT k FROM fo)
UNION ALL SELECT k, 'single-ranking-key', c, 'not in the final order' FROM ef WHERE failed
UNION ALL SELECT k, 'single-ranking-key', c, 'below a later band' FROM ef WHERE NOT failed AND band < pb
UNION ALL SELECT k, 'single-ranking-key', c, 'key rises' FROM ef WHERE NOT failed AND band = pb AND key > pk
UNION ALL SELECT k, 'expansion-mass-cap', NULL, 'discounted mass is not below' FROM t WHERE k % 9 <> 8 AND k % 7 > 0 AND k % 5 >= k % 7
UNION ALL SELECT k, 'expansion-mass-cap', NULL, 'discounted mass without certificate' FROM t WHERE k % 9 <> 8 AND k % 7 = 0 AND k % 5 > 0 AND k % 4 <> 0
UNION ALL SELECT k, 'expansion-mass-cap', NULL, 'expansion without current mass' FROM t WHERE k % 9 <> 8 AND k % 7 = 0 AND k % 3 > 0
UNION ALL SELECT k, 'expansion-mass-cap', NULL, 'protected slots' FROM t WHERE k % 9 <> 8 AND k % 6 < 2
UNION ALL SELECT fp.k, 'rerank-coverage-or-fallback', p, 'not covered' FROM fp JOIN acted ON acted.k = fp.k AND a WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.k = fp.k AND x.p = fp.p AND s % 3 <> 0)
UNION ALL SELECT fp.k, 'no-expansion-leak-on-failed-rerank', fp.p, 'not arbitrated' FROM fp JOIN acted ON acted.k = fp.k AND NOT a JOIN lg ON lg.k = fp.k AND lg.p = fp.p WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.k = fp.k AND x.p = fp.p AND s % 5 <> 0 AND (ln % 4 < 2 OR s % 2 = 0))
UNION ALL SELECT k, 'degeneracy-gate-honored', NULL, 'degenerate scores applied' FROM t WHERE k % 10 = 0 AND k % 3 <> 0
UNION ALL SELECT k, 'metadata-band-only', c, 'tie out of order' FROM nb WHERE band = pb AND key = pk AND NOT (pc < c)
UNION ALL SELECT k, 'finalization-fits-reserve', NULL, 'over the reserve' FROM t WHERE k % 700 > 500)
SELECT k AS trace_id, rule, rule NOT IN ('rerank-coverage-or-fallback', 'finalization-fits-reserve') AS enforced, subject, breach FROM v"""


@query("trace_violations", _TRACE_SQL)
def trace_violations(spark, sf):
    return invariants.violations(*trace_tables(spark, sf))


# mirrors of another vault


def mirror_tables(spark, sf):
    """(mirrors, verdicts, references): events as mirrored usages, orders as verdicts of the general vault."""
    e = table(spark, sf, "events")
    mirrors = e.select(F.col("event_id").alias("usage_id"), F.when(F.col("event_id") % 23 != 0, F.col("event_id") % 5000).alias("source_id"), F.element_at(F.array(*map(F.lit, ["pending", "provisional", "attributed"])), (F.col("event_id") % 3 + 1).cast("int")).alias("state"), F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 7).alias("source_revision"), (F.col("event_id") % 4 + 1).alias("revision"))
    o = table(spark, sf, "orders")
    verdicts = o.select(F.col("o_orderkey").alias("source_id"), F.element_at(F.array(*map(F.lit, ["pending", "provisional", "attributed", "unattributable"])), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("state"), (F.col("o_orderkey") % 9).alias("revision"))
    references = table(spark, sf, "lineitem").where("l_linenumber <= 3").select(F.col("l_orderkey").alias("source_id"), F.when(F.col("l_suppkey") % 2 == 0, "skill").otherwise("work").alias("vault"), F.concat(F.lit("p"), (F.col("l_partkey") % 40).cast("string")).alias("path"))
    return mirrors, verdicts, references


_MIRROR_SQL = """
WITH m AS (SELECT event_id AS usage_id, CASE WHEN event_id % 23 <> 0 THEN event_id % 5000 END AS source_id, ['pending', 'provisional', 'attributed'][event_id % 3 + 1] AS state, CASE WHEN event_id % 3 > 0 THEN event_id % 7 END AS src, event_id % 4 + 1 AS revision FROM events),
g AS (SELECT o_orderkey AS source_id, ['pending', 'provisional', 'attributed', 'unattributable'][o_orderkey % 4 + 1] AS state, o_orderkey % 9 AS revision FROM orders),
r AS (SELECT l_orderkey AS source_id, string_agg(DISTINCT 'p' || (l_partkey % 40), ',' ORDER BY 'p' || (l_partkey % 40)) AS paths FROM lineitem WHERE l_linenumber <= 3 AND l_suppkey % 2 = 0 GROUP BY 1),
due AS (SELECT m.usage_id, m.source_id, m.revision + 1 AS revision, CASE WHEN m.source_id IS NULL OR g.state = 'unattributable' THEN 'unattributable' ELSE g.state END AS state, CASE WHEN m.source_id IS NULL THEN 'no-source' WHEN g.state = 'unattributable' THEN 'source-unattributable' END AS reason, CASE WHEN m.source_id IS NULL THEN m.src ELSE g.revision END AS source_revision
  FROM m LEFT JOIN g ON g.source_id = m.source_id WHERE m.state IN ('pending', 'provisional') AND (m.source_id IS NULL OR (g.state IS NOT NULL AND g.state <> 'pending' AND (m.src IS NULL OR m.src < g.revision))))
SELECT usage_id, due.state, reason, source_revision, revision, CASE WHEN due.state <> 'unattributable' THEN coalesce(paths, '') ELSE '' END AS paths FROM due LEFT JOIN r ON r.source_id = due.source_id"""


@query("mirror_slices", _MIRROR_SQL)
def mirror_slices(spark, sf):
    mirrors, verdicts_, references = mirror_tables(spark, sf)
    return verdicts.mirror(mirrors, verdicts_, references, "skill").withColumn("paths", F.array_join("paths", ","))


# chunks of tokens

#: The folder of public vocabulary files; that of the installed package if not set.
VOCABULARIES = os.environ.get("PUBLIC_TOKENIZERS")


@query("token_chunks_800", None)
def token_chunks_800(spark, sf):
    """Chunks of 800 tokens that overlap by 120; a tokenizer is not SQL, tests hold the cuts against the library."""
    if VOCABULARIES:
        path = os.path.join(VOCABULARIES, "byte_bpe_50k.json")
    else:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    found = token_chunks.chunks(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", path)
    return found.select("doc_id", "seq", "pos", "byte_pos", "tokens", F.sha2("chunk", 256).alias("chunk_sha"))
