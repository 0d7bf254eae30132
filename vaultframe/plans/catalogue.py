"""Named queries over the driver's tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vaultframe.functions import scoring, temporal, text
from vaultframe.operators import alike, entities, evaluation, fts, fusion, graph, lifecycle, stats, vectors, windows
from vaultframe.plans import hybrid
from vaultframe.sources import adapter, conversations
from vaultframe.sources.adapter import MENTION_SQL, META_SQL, NOW, RECALL_SQL, RELATION_SQL, SESSION_SQL, TRIPLE_SQL, now, table
from vaultframe.sources.scratch import written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

SEARCHES = [(1, "und von"), (2, "anat"), (3, "reon"), (4, "ones du"), (5, "the and")]
_SEARCH_VALUES = ", ".join(f"({i}, '{q}')" for i, q in SEARCHES)
PROMPTS = [
    "why did we choose Spark", "when was the schema decided last week", "who is on the project team", "what is a vault", "hello there", "ok", "remember the plan",
    "similar to the last design", "explain the concept of fusion", "config.yml error", "what happened in january 2024 and also why", "3 days ago we met", "since march 2023",
    "last 10 days of work", "2 months ago", "status check", "are we scoping this?", "/help", "because we chose DuckDB instead of SQLite?", "yesterday", "this month so far", "npm install fails", "don't do 1,000 or 2024-01-02",
]
_PROMPT_VALUES = ", ".join(f"({i}, '{p.replace(chr(39), chr(39) * 2)}')" for i, p in enumerate(PROMPTS))
#: Every user turn, opened by one of PROMPTS; each third is the opening alone.
PROMPT_TABLE = f"(SELECT c.conv_id * 100 + c.turn AS pid, v.p || CASE WHEN c.turn % 3 = 0 THEN '' ELSE ' ' || c.text END AS prompt FROM conversations c JOIN (VALUES {_PROMPT_VALUES}) v(n, p) ON v.n = (c.conv_id + c.turn) % {len(PROMPTS)} WHERE c.role = 'user') p"
VECTOR_K = 5


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def searches(spark: SparkSession) -> DataFrame:
    return _local(spark, SEARCHES, "qid int, query string")


def opened(spark: SparkSession, sf: str, openings: list[str]) -> DataFrame:
    """(pid, prompt): every user turn, opened by one of the openings; each third is the opening alone."""
    c = table(spark, sf, "conversations").where("role = 'user'")
    opening = F.element_at(F.array(*map(F.lit, openings)), ((F.col("conv_id") + F.col("turn")) % len(openings) + 1).cast("int"))
    return c.select((F.col("conv_id") * 100 + F.col("turn")).alias("pid"), F.concat(opening, F.when(F.col("turn") % 3 == 0, "").otherwise(F.concat(F.lit(" "), "text"))).alias("prompt"))


def prompts(spark: SparkSession, sf: str) -> DataFrame:
    return opened(spark, sf, PROMPTS)


def fields(spark: SparkSession, sf: str) -> DataFrame:
    """(id, path, title, body) as the index reads them."""
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("id"), F.concat("lang", F.lit(" "), F.col("doc_id").cast("string"), F.lit(" md")).alias("path"), F.substring(F.split("text", "\n").getItem(0), 1, 60).alias("title"), F.col("text").alias("body"))


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


_TOK = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"
INDEX_SQL = f"""
post AS (SELECT term, id, count(*) AS tf, sum(w)::DOUBLE AS wtf FROM (
  SELECT doc_id AS id, 10 AS w, unnest({_TOK.format("lang || ' ' || doc_id || ' md'")}) AS term FROM documents
  UNION ALL SELECT doc_id, 1, unnest({_TOK.format("substr(split_part(text, chr(10), 1), 1, 60)")}) FROM documents
  UNION ALL SELECT doc_id, 1, unnest({_TOK.format("text")}) FROM documents) GROUP BY term, id),
dl AS (SELECT id, sum(tf)::BIGINT AS dl FROM post GROUP BY id),
corpus AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM dl),
words AS (SELECT DISTINCT qid, unnest({_TOK.format("query")}) AS word FROM (VALUES {_SEARCH_VALUES}) s(qid, query)),
hits AS (SELECT w.qid, w.word, p.id, sum(p.wtf) AS f FROM post p JOIN words w ON starts_with(p.term, w.word) GROUP BY ALL),
dfq AS (SELECT qid, word, count(*) AS n_hit FROM hits GROUP BY ALL),
scored AS (SELECT h.qid, h.id, -sum(greatest(ln((n_docs - n_hit + 0.5) / (n_hit + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl.dl / avgdl))) AS bm25, count(*) AS matched
  FROM hits h JOIN dfq USING (qid, word) JOIN dl ON dl.id = h.id, corpus GROUP BY h.qid, h.id),
bm AS (SELECT s.qid, s.id, bm25, greatest(-bm25, 0) / (1 + greatest(-bm25, 0)) AS score FROM scored s
  JOIN (SELECT qid, count(*) AS n FROM words GROUP BY qid) n ON s.qid = n.qid AND s.matched = n.n)"""


# keyword search


@query("fts_postings_df", rf"SELECT term, count(*) AS n, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_TOK.format('text')}) AS term FROM documents) GROUP BY term")
def fts_postings_df(spark, sf):
    terms = table(spark, sf, "documents").select("doc_id", F.explode(text.tokens("text")).alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))
    return terms.groupBy("term").agg(F.sum("tf").alias("n"), F.count("*").alias("df"))


@query("fts_bm25_top20", f"WITH {META_SQL}, {INDEX_SQL} SELECT qid, id, round(bm25, 6) AS bm25, round(score, 6) AS score, rank FROM (SELECT bm.*, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(bm25, 9), bm.id) AS INTEGER) AS rank FROM bm JOIN meta ON bm.id = meta.id AND meta.active) WHERE rank <= 20")
def fts_bm25_top20(spark, sf):
    found = fts.search(fields(spark, sf), searches(spark), 20, hybrid.eligible(adapter.metadata(spark, sf)))
    return rounded(found.select("qid", "id", "bm25", "score", "rank"), "bm25", "score")


@query("fts_strong_signal", f"WITH {INDEX_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(bm25, 9), id) AS rank FROM bm) SELECT qid, (max(CASE WHEN rank = 1 THEN score END) >= 0.85 AND max(CASE WHEN rank = 1 THEN score END) - coalesce(max(CASE WHEN rank = 2 THEN score END), 0) >= 0.15) AS strong FROM r GROUP BY qid")
def fts_strong_signal(spark, sf):
    return fts.strong_signal(fts.search(fields(spark, sf), searches(spark), 20))


def _half(kind: str) -> str:
    return "CASE " + kind + " " + " ".join(f"WHEN '{k}' THEN {v}.0" for k, v in scoring.HALF_LIVES.items()) + " ELSE 60.0 END::DOUBLE"


def _base(kind: str) -> str:
    return "CASE " + kind + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in scoring.BASELINES.items()) + " ELSE 0.5 END::DOUBLE"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_AGE = "(epoch(TIMESTAMP '" + NOW + "') - epoch({0})) / 86400.0::DOUBLE"
COMPOSITE_SQL = f"""
f0 AS (SELECT c.qid, c.score, m.*, {_AGE.format("m.effective_at")} AS age, {_AGE.format("m.last_accessed_at")} AS idle, {_half("m.content_type")} AS hl, {_base("m.content_type")} AS baseline FROM cand c JOIN meta m ON m.id = c.id),
f1 AS (SELECT *, CASE WHEN access_count <= 0 THEN hl ELSE least(hl * 3, hl + hl * 0.3 * ln(1 + access_count * greatest(0, 1 - idle / 90))) END AS life FROM f0),
f2 AS (SELECT *, CASE WHEN content_type IN {_in(scoring.EVERGREEN)} OR age <= 0 THEN 1.0 ELSE pow(0.5, age / life) END::DOUBLE AS recency,
  CASE WHEN content_type IN {_in(scoring.EVERGREEN)} OR age <= 0 THEN 1.0 ELSE pow(0.5, age / hl) END::DOUBLE AS plain_recency FROM f1),
f3 AS (SELECT *, least(1.0, baseline * plain_recency * least(1.5, 1 + log2(1 + access_count) * 0.1) *
  CASE WHEN content_type NOT IN {_in(scoring.DECAY_EXEMPT)} AND last_accessed_at <> modified_at AND idle > 0 THEN greatest(0.5, pow(0.95, idle / 7)) ELSE 1.0 END)::DOUBLE AS computed_confidence FROM f2),
f4 AS (SELECT *, CASE WHEN confidence = 0.5 THEN computed_confidence ELSE least(1.0, computed_confidence * (confidence / 0.5) * 0.5 + computed_confidence * 0.5) END AS blended_confidence,
  1.0::DOUBLE AS quality_factor, greatest(0.3, 1 / (1 + 0.5 * log2(greatest(body_length / 500.0::DOUBLE, 1))))::DOUBLE AS length_factor,
  1 + least(0.10, ln(1 + (revision_count - 1) * 2 + duplicate_count - 1) * 0.03) AS frequency_factor FROM f3),
f5 AS (SELECT *, 0.5 * score + 0.25 * recency + 0.25 * blended_confidence AS weighted FROM f4),
f6 AS (SELECT *, weighted * quality_factor * length_factor * frequency_factor AS before_pin FROM f5),
comp AS (SELECT *, CASE WHEN pinned THEN least(1.0, before_pin + 0.3) ELSE before_pin END AS composite FROM f6)"""
_CAND_FTS = "cand AS (SELECT qid, id, score FROM (SELECT bm.*, row_number() OVER (PARTITION BY qid ORDER BY round(bm25, 9), bm.id) AS rank FROM bm JOIN meta ON bm.id = meta.id AND meta.active) WHERE rank <= 20)"


@query("search_composite", f"WITH {META_SQL}, {INDEX_SQL}, {_CAND_FTS}, {COMPOSITE_SQL} SELECT qid, id, round(score, 6) AS score, round(recency, 6) AS recency, round(blended_confidence, 6) AS blended_confidence, round(composite, 6) AS composite, composite_rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(composite, 9) DESC, id) AS INTEGER) AS composite_rank FROM comp) WHERE composite_rank <= 10")
def search_composite(spark, sf):
    out = hybrid.search_composite(fields(spark, sf), adapter.metadata(spark, sf), searches(spark), now())
    return rounded(out.select("qid", "id", "score", "recency", "blended_confidence", "composite", "composite_rank"), "score", "recency", "blended_confidence", "composite")


def _scored(spark, sf):
    # written, so that Spark knows how few they are and sends them to the documents
    found = written(fts.search(fields(spark, sf), searches(spark), 20, hybrid.eligible(adapter.metadata(spark, sf))).select("qid", "id", "score", F.col("rank").alias("input_rank")), "found")
    return scoring.composite(found.join(adapter.metadata(spark, sf, found).withColumn("quality_score", F.lit(0.5)), "id"), now())


@query("rank_explain", f"WITH {META_SQL}, {INDEX_SQL}, {_CAND_FTS}, {COMPOSITE_SQL} SELECT qid, id, round(weighted, 6) AS weighted, round(length_factor, 6) AS length_factor, round(frequency_factor, 6) AS frequency_factor, round(composite - before_pin, 6) AS pin_boost, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS INTEGER) AS raw_rank, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(composite, 9) DESC, id) AS INTEGER) AS composite_rank FROM comp")
def rank_explain(spark, sf):
    s = windows.top_per(_scored(spark, sf), ["qid"], [F.desc(F.round("score", 9)), F.col("id")], None, "raw_rank")
    s = windows.top_per(s, ["qid"], [F.desc(F.round("composite", 9)), F.col("id")], None, "composite_rank")
    return rounded(s.select("qid", "id", "weighted", "length_factor", "frequency_factor", "pin_boost", "raw_rank", "composite_rank"), "weighted", "length_factor", "frequency_factor", "pin_boost")


@query("raw_primary_rank", f"WITH {META_SQL}, {INDEX_SQL}, {_CAND_FTS}, {COMPOSITE_SQL} SELECT qid, id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, pinned DESC, round(composite, 9) DESC, path) AS INTEGER) AS rank FROM comp")
def raw_primary_rank(spark, sf):
    return rounded(fusion.raw_primary(_scored(spark, sf)).select("qid", "id", "score", "rank"), "score")


# vectors


def embedded(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query("vec_topk", f"SELECT qid, id, round(s, 6) AS similarity, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, id) AS INTEGER) AS rank FROM (SELECT a.vec_id AS qid, b.vec_id AS id, {_COS} AS s FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)) WHERE rank <= {VECTOR_K}")
def vec_topk(spark, sf):
    e = embedded(spark, sf)
    return rounded(vectors.nearest(e, e.where("id % 20 = 0"), VECTOR_K), "similarity")


@query("vec_one_query", "SELECT b.vec_id AS id, round(" + _COS + ", 6) AS similarity FROM (SELECT * FROM embeddings WHERE vec_id = 7) a, embeddings b ORDER BY round(" + _COS + ", 9) DESC, b.vec_id LIMIT 10")
def vec_one_query(spark, sf):
    e = embedded(spark, sf)
    q = e.where("id = 7").first()  # one vector
    return rounded(vectors.one_query(e, list(q["embedding"]), 10), "similarity")


@query("vec_best_fragment", f"WITH h AS (SELECT a.vec_id AS qid, b.vec_id // 4 AS doc_id, b.vec_id AS fragment_id, {_COS} AS s FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id), t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, fragment_id) AS r FROM h) WHERE r <= 30) SELECT qid, doc_id, fragment_id, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY round(s, 9) DESC, fragment_id) AS k FROM t) WHERE k = 1")
def vec_best_fragment(spark, sf):
    e = embedded(spark, sf)
    hits = vectors.nearest(e, e.where("id % 20 = 0"), 30).select("qid", (F.col("id") / 4).cast("long").alias("doc_id"), F.col("id").alias("fragment_id"), "similarity")
    return rounded(vectors.best_fragment(hits), "similarity")


_SEM = f"SELECT source_id, target_id, weight, r FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY round(weight, 9) DESC, target_id) AS r FROM (SELECT a.vec_id AS source_id, b.vec_id AS target_id, {_COS} AS weight FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id) WHERE weight > 0.25) WHERE r <= 10"


@query("semantic_graph_t25", f"SELECT source_id, target_id, round(weight, 6) AS weight FROM ({_SEM})")
def semantic_graph_t25(spark, sf):
    return rounded(vectors.semantic_graph(embedded(spark, sf), 0.25, 10), "weight")


@query("surprisal", f"SELECT id, round(avg(d), 6) AS surprisal FROM (SELECT a.vec_id AS id, 1 - {_COS} AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS}, 9) DESC, b.vec_id) AS r FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id AND {_COS} < 0.999) WHERE r <= 5 GROUP BY id HAVING count(*) = 5")
def surprisal(spark, sf):
    e = embedded(spark, sf)
    return rounded(vectors.surprisal(e, e, 5), "surprisal")


@query("set_consistency", "SELECT doc_id AS id, 'no_vector' AS state FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) UNION ALL SELECT vec_id, 'no_document' FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)")
def set_consistency(spark, sf):
    return vectors.consistency(table(spark, sf, "documents").select(F.col("doc_id").alias("id")), embedded(spark, sf))


@query("needs_embedding", f"WITH {META_SQL} SELECT id, path FROM meta WHERE active AND id NOT IN (SELECT vec_id FROM embeddings)")
def needs_embedding(spark, sf):
    return lifecycle.needing_vectors(adapter.metadata(spark, sf), embedded(spark, sf)).select("id", "path")


@query("stale_vectors", f"WITH {META_SQL} SELECT vec_id AS id FROM embeddings WHERE vec_id NOT IN (SELECT id FROM meta WHERE active)")
def stale_vectors(spark, sf):
    return lifecycle.stale_vectors(embedded(spark, sf), adapter.metadata(spark, sf)).select("id")


# fusion


def _lists(spark, sf):
    """Two ranked lists per query id from documents and vectors, by arithmetic alone."""
    ids = table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 50).alias("qid"), F.col("doc_id").alias("id"))
    a = ids.select("qid", "id", (F.col("id") * 7 % 101).alias("k"))
    b = ids.where("id % 3 <> 0").select("qid", "id", (F.col("id") * 13 % 103).alias("k"))
    rank = lambda d: windows.top_per(d, ["qid"], [F.col("k"), F.col("id")], None).select("qid", "id", "rank")
    return rank(a), rank(b)


_LISTS = "la AS (SELECT doc_id // 50 AS qid, doc_id AS id, row_number() OVER (PARTITION BY doc_id // 50 ORDER BY doc_id * 7 % 101, doc_id) AS rank FROM documents), lb AS (SELECT doc_id // 50 AS qid, doc_id AS id, row_number() OVER (PARTITION BY doc_id // 50 ORDER BY doc_id * 13 % 103, doc_id) AS rank FROM documents WHERE doc_id % 3 <> 0)"


def _rrf(w: float, u: float, weighted: bool = False) -> str:
    return f"rrf AS (SELECT qid, id, sum(w / (60 + rank) + CASE WHEN rank = 1 THEN 0.05 WHEN rank <= 3 THEN 0.02 ELSE 0 END{' * w' if weighted else ''})::DOUBLE AS fused FROM (SELECT *, {w}::DOUBLE AS w FROM la UNION ALL SELECT *, {u}::DOUBLE FROM lb) GROUP BY qid, id)"


@query("rrf_fusion_2lists", f"WITH {_LISTS}, {_rrf(1, 1)} SELECT qid, id, round(fused, 6) AS fused, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(fused, 9) DESC, id) AS INTEGER) AS rank FROM rrf")
def rrf_fusion_2lists(spark, sf):
    a, b = _lists(spark, sf)
    return rounded(hybrid.fuse([(a, 1), (b, 1)], 1000).select("qid", "id", "fused", "rank"), "fused")


@query("rrf_fusion_weighted", f"WITH {_LISTS}, {_rrf(2, 0.5, True)} SELECT qid, id, round(fused, 6) AS fused FROM rrf")
def rrf_fusion_weighted(spark, sf):
    a, b = _lists(spark, sf)
    lists = a.withColumn("weight", F.lit(2.0)).unionByName(b.withColumn("weight", F.lit(0.5)))
    return rounded(fusion.reciprocal_ranks(lists, weight_bonuses=True), "fused")


_LABEL = "(SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id)"


@query("rerank_blend", f"WITH {_LISTS}, {_rrf(1, 1)}, j AS (SELECT rrf.*, l.quality::DOUBLE AS rerank FROM rrf LEFT JOIN {_LABEL} l ON l.doc_id = rrf.id) SELECT qid, id, round(CASE WHEN coalesce(max(rerank) OVER w > 1e-4, false) THEN 0.1 * fused / max(fused) OVER w + 0.9 * coalesce(rerank, 0) ELSE fused / max(fused) OVER w END, 6) AS blended FROM j WINDOW w AS (PARTITION BY qid)")
def rerank_blend(spark, sf):
    a, b = _lists(spark, sf)
    labels = table(spark, sf, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").cast("double").alias("rerank"))
    return rounded(fusion.blend_rerank(hybrid.fuse([(a, 1), (b, 1)], 1000).join(labels, "id", "left")).select("qid", "id", "blended"), "blended")


@query("causal_blend", f"WITH {_LISTS}, r AS (SELECT la.qid, la.id, la.rank, 1.0::DOUBLE / la.rank AS score, l.quality::DOUBLE AS rerank FROM la LEFT JOIN {_LABEL} l ON l.doc_id = la.id) SELECT qid, id, round(CASE WHEN rank <= 3 THEN 0.75 WHEN rank <= 10 THEN 0.6 ELSE 0.4 END * score + (1 - CASE WHEN rank <= 3 THEN 0.75 WHEN rank <= 10 THEN 0.6 ELSE 0.4 END) * coalesce(rerank, 0), 6) AS blended FROM r")
def causal_blend(spark, sf):
    a, _ = _lists(spark, sf)
    labels = table(spark, sf, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").cast("double").alias("rerank"))
    return rounded(fusion.blend_by_rank(a.withColumn("score", 1.0 / F.col("rank")).join(labels, "id", "left")).select("qid", "id", "blended"), "blended")


@query("hybrid_with_temporal_entity", None)
def hybrid_with_temporal_entity(spark, sf):
    meta = adapter.metadata(spark, sf)
    keyword = written(fts.search(fields(spark, sf), searches(spark), 20, hybrid.eligible(meta)).select("qid", "id", "rank"), "keyword")
    e = embedded(spark, sf)
    usable = written(hybrid.eligible(adapter.metadata(spark, sf, e.select("id"))).select("id"), "usable")  # before the limit
    vector = written(vectors.nearest(e.join(usable, "id", "left_semi"), e.where("id between 1 and 5"), 20).select(F.col("qid").cast("int").alias("qid"), "id", "rank"), "near")
    spans = searches(spark).select("qid", (now() - F.make_dt_interval(days=F.col("qid") * 7)).alias("start_at"), now().alias("end_at"))
    timed = hybrid.temporal_list(meta, spans)
    starts = keyword.where("rank <= 5").select("qid", F.col("id").alias("node"))
    reached = graph.typed_edges(adapter.relations(spark, sf), "entity", hybrid.eligible(meta), nodes=starts).join(starts, "node").groupBy("qid", F.col("next").alias("id")).agg(F.max("weight").alias("weight"))
    via = windows.top_per(reached, ["qid"], [F.desc(F.round("weight", 9)), F.col("id")], 20).select("qid", "id", "rank")
    return rounded(hybrid.fuse([(keyword, 2), (vector, 2), (timed, 1), (via, 1)]).select("qid", "id", "fused", "rank"), "fused")


@query("temporal_channel", f"WITH {META_SQL}, spans AS (SELECT qid, TIMESTAMP '{NOW}' - to_days(qid * 7) AS a, TIMESTAMP '{NOW}' AS b FROM (VALUES {_SEARCH_VALUES}) s(qid, query)) SELECT qid, id, rank FROM (SELECT qid, id, CAST(row_number() OVER (PARTITION BY qid ORDER BY effective_at DESC, id) AS INTEGER) AS rank FROM meta, spans WHERE active AND effective_at BETWEEN a AND b) WHERE rank <= 30")
def temporal_channel(spark, sf):
    spans = searches(spark).select("qid", (now() - F.make_dt_interval(days=F.col("qid") * 7)).alias("start_at"), now().alias("end_at"))
    return hybrid.temporal_list(adapter.metadata(spark, sf), spans)


@query("relevance_admission", "WITH p AS (SELECT doc_id % 50 AS qid, doc_id AS id, CASE WHEN doc_id % 3 = 0 AND doc_id % 50 < 40 THEN 0 ELSE 1 END AS band, (doc_id % 17) / 17.0::DOUBLE AS mass, CASE WHEN doc_id % 3 = 0 THEN (doc_id % 5)::DOUBLE ELSE 0.0::DOUBLE END AS current_mass FROM documents) SELECT qid, id, CASE WHEN band = 0 THEN mass >= 0.5 * max(CASE WHEN band = 0 THEN mass END) OVER w ELSE max(CASE WHEN band = 0 THEN mass END) OVER w IS NULL AND sum(current_mass) OVER w = 0 END AS admitted FROM p WINDOW w AS (PARTITION BY qid)")
def relevance_admission(spark, sf):
    i = F.col("doc_id")
    p = table(spark, sf, "documents").select((i % 50).alias("qid"), i.alias("id"), F.when((i % 3 == 0) & (i % 50 < 40), 0).otherwise(1).alias("band"), (i % 17 / 17).alias("mass"), F.when(i % 3 == 0, (i % 5).cast("double")).otherwise(0.0).alias("current_mass"))
    return fusion.admission(p).select("qid", "id", "admitted")


@query("adaptive_threshold", f"WITH {META_SQL}, {INDEX_SQL}, {_CAND_FTS}, {COMPOSITE_SQL} SELECT qid, id, max(composite) OVER w >= 0.35 AND composite >= greatest(max(composite) OVER w * 0.7, 0.2) AS admitted FROM comp WINDOW w AS (PARTITION BY qid)")
def adaptive_threshold(spark, sf):
    return fusion.adaptive_threshold(_scored(spark, sf), 0.35, 0.7, 0.2).select("qid", "id", "admitted")


@query("rerank_degeneracy", "SELECT doc_id % 10 AS qid, CASE WHEN max(toxic) IS NULL THEN 'invalid' WHEN max(toxic * 1.0) < 0.05 THEN 'collapsed' WHEN max(toxic) - min(toxic) < 0.05 THEN 'inert' ELSE 'healthy' END AS state FROM labels GROUP BY 1")
def rerank_degeneracy(spark, sf):
    return fusion.rerank_degeneracy(table(spark, sf, "labels").select((F.col("doc_id") % 10).alias("qid"), F.col("toxic").cast("double").alias("rerank")))


@query("mmr_diversity", None)
def mmr_diversity(spark, sf):
    top = _scored(spark, sf)
    ranked = windows.top_per(top, ["qid"], [F.desc(F.round("composite", 9)), F.col("id")], 20, "rank").select("qid", "id", "rank")
    few = fields(spark, sf).join(F.broadcast(ranked), "id")  # only these are cut into shingles, no other text is shuffled
    return fusion.diversify(few.select("qid", "id", "rank", text.shingles(F.concat_ws(" ", "title", "body")).alias("grams")))


@query("shingle_jaccard_neardup", "WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9_\\s]', '', 'g'), '\\s+'), lambda x: x <> '') AS w FROM documents), g AS (SELECT doc_id, list_distinct(list_concat([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))], list_filter(w, lambda x: length(x) > 3))) AS g FROM w), p AS (SELECT DISTINCT doc_id, unnest(g) AS x FROM g), s AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM p a JOIN p b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL) SELECT s.a, s.b, round(n::DOUBLE / (len(x.g) + len(y.g) - n), 6) AS similarity FROM s JOIN g x ON x.doc_id = s.a JOIN g y ON y.doc_id = s.b WHERE n::DOUBLE / (len(x.g) + len(y.g) - n) >= 0.5")
def shingle_jaccard_neardup(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), text.shingles("text").alias("grams"))
    return rounded(alike.alike(d, 0.5), "similarity")
