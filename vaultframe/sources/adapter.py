"""Vault tables derived from the driver's tables, and the same derivation in SQL for oracles.

The clock is fixed (``NOW``); nothing here reads the wall clock. Timestamps stay TIMESTAMP_NTZ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NOW = "2024-02-01 00:00:00"
CONTENT_TYPES = ["note", "decision", "handoff", "progress", "conversation", "problem", "milestone", "research", "project", "preference", "deductive", "hub", "antipattern"]


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _days(n):
    return F.make_dt_interval(days=n)


def modified_at():
    """When a row of documents was changed."""
    return now() - _days((F.col("doc_id") % 365).cast("int"))


def metadata(spark: SparkSession, sf: str, ids: DataFrame | None = None) -> DataFrame:
    """documents without bodies: the ranking operators read no text. With ids(id), of these alone; few are sent to the tables."""
    d, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    if ids is not None:
        few = ids.select(F.col("id").alias("doc_id"))
        d, labels = d.join(few, "doc_id", "left_semi"), labels.join(few, "doc_id", "left_semi")
    quality = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    modified = modified_at()
    return (
        d.join(quality, "doc_id", "left")
        .select(
            F.col("doc_id").alias("id"),
            F.col("source").alias("collection"),
            F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
            F.col("n_chars").alias("body_length"),
            modified.alias("modified_at"),
            F.when(F.col("doc_id") % 7 == 0, modified - _days(F.lit(30))).alias("authored_at"),
            F.element_at(F.array(*map(F.lit, CONTENT_TYPES)), (F.col("doc_id") % 13 + 1).cast("int")).alias("content_type"),
            (F.col("doc_id") % 20).alias("access_count"),
            (modified + _days((F.col("doc_id") % 5).cast("int"))).alias("last_accessed_at"),
            F.when(F.col("quality") == 1, 0.7).otherwise(0.5).alias("confidence"),
            (F.col("doc_id") % 97 == 0).alias("pinned"),
            (F.col("doc_id") % 19 != 0).alias("active"),
            (F.col("doc_id") % 3 + 1).alias("revision_count"),
            (F.col("doc_id") % 4 + 1).alias("duplicate_count"),
            F.col("lang"),
        )
        .withColumn("effective_at", F.coalesce("authored_at", "modified_at"))
    )


def bodies(spark: SparkSession, sf: str) -> DataFrame:
    """(id, title, body, hash) of all documents."""
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("id"), F.substring(F.split("text", "\n").getItem(0), 1, 60).alias("title"), F.col("text").alias("body"), F.sha2("text", 256).alias("hash"))


META_SQL = f"""
meta AS (SELECT d.doc_id AS id, d.source AS collection, d.lang || '/' || d.doc_id || '.md' AS path, d.n_chars AS body_length,
  TIMESTAMP '{NOW}' - to_days(CAST(d.doc_id % 365 AS INTEGER)) AS modified_at,
  CASE WHEN d.doc_id % 7 = 0 THEN TIMESTAMP '{NOW}' - to_days(CAST(d.doc_id % 365 AS INTEGER)) - to_days(30) END AS authored_at,
  [{", ".join(f"'{t}'" for t in CONTENT_TYPES)}][d.doc_id % 13 + 1] AS content_type,
  d.doc_id % 20 AS access_count,
  TIMESTAMP '{NOW}' - to_days(CAST(d.doc_id % 365 AS INTEGER)) + to_days(CAST(d.doc_id % 5 AS INTEGER)) AS last_accessed_at,
  CASE WHEN q.quality = 1 THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS confidence,
  d.doc_id % 97 = 0 AS pinned, d.doc_id % 19 <> 0 AS active, d.doc_id % 3 + 1 AS revision_count, d.doc_id % 4 + 1 AS duplicate_count, d.lang,
  coalesce(CASE WHEN d.doc_id % 7 = 0 THEN TIMESTAMP '{NOW}' - to_days(CAST(d.doc_id % 365 AS INTEGER)) - to_days(30) END, TIMESTAMP '{NOW}' - to_days(CAST(d.doc_id % 365 AS INTEGER))) AS effective_at
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) q ON d.doc_id = q.doc_id)"""


def recall_events(spark: SparkSession, sf: str, n_docs: int = 200) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        F.col("event_id"),
        (F.col("event_id") % n_docs).alias("doc_id"),
        F.get_json_object("props", "$.k").alias("query_hash"),
        (F.col("value") / 500).alias("search_score"),
        F.col("user_id").alias("session_id"),
        F.col("ts").alias("surfaced_at"),
        (F.col("event_type") == "click").alias("was_referenced"),
    )


RECALL_SQL = """
recall AS (SELECT event_id, event_id % 200 AS doc_id, json_extract_string(props, '$.k') AS query_hash, value / 500 AS search_score,
  user_id AS session_id, ts AS surfaced_at, event_type = 'click' AS was_referenced FROM events)"""


def sessions(spark: SparkSession, sf: str, gap_minutes: int = 30) -> DataFrame:
    """(session_id, user_id, started_at, ended_at, n_events): runs of a user's events with gaps up to the limit."""
    e = table(spark, sf, "events").select("user_id", "ts", "event_id")
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    opened = e.withColumn("prev", F.lag("ts").over(by)).withColumn("opens", (F.col("prev").isNull() | (F.col("ts") > F.col("prev") + F.make_dt_interval(mins=F.lit(gap_minutes)))).cast("int"))
    numbered = opened.withColumn("n", F.sum("opens").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("user_id", "n").agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.count("*").alias("n_events")).select(F.concat_ws("-", "user_id", "n").alias("session_id"), "user_id", "started_at", "ended_at", "n_events")


SESSION_SQL = """
opened AS (SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS opens
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM opened),
sessions AS (SELECT user_id || '-' || CAST(n AS BIGINT) AS session_id, user_id, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS n_events FROM numbered GROUP BY user_id, n)"""


def relations(spark: SparkSession, sf: str) -> DataFrame:
    """(source_id, target_id, relation_type, weight): modular successors stand for extracted edges."""
    ids = table(spark, sf, "documents").select(F.col("doc_id").alias("source_id"))
    n = table(spark, sf, "documents").select(F.count("*").alias("n"))
    edges = [("causal", 7, 3), ("semantic", 11, 4), ("semantic", 13, 5), ("entity", 17, 6), ("temporal", 1, 7), ("supporting", 23, 8)]
    kinds = F.array(*(F.struct(F.lit(t).alias("relation_type"), F.lit(step).alias("step"), F.lit(m).alias("m")) for t, step, m in edges))
    return ids.join(F.broadcast(n)).select("source_id", "n", F.explode(kinds).alias("k")).select("source_id", ((F.col("source_id") + F.col("k.step")) % F.col("n")).alias("target_id"), "k.relation_type", ((F.col("source_id") % F.col("k.m") + 1) / F.col("k.m")).alias("weight"))


RELATION_SQL = """
rel AS (SELECT d.doc_id AS source_id, (d.doc_id + k.step) % n.n AS target_id, k.relation_type, (d.doc_id % k.m + 1)::DOUBLE / k.m AS weight
  FROM documents d, (SELECT count(*) AS n FROM documents) n,
  (VALUES ('causal', 7, 3), ('semantic', 11, 4), ('semantic', 13, 5), ('entity', 17, 6), ('temporal', 1, 7), ('supporting', 23, 8)) k(relation_type, step, m))"""


def mentions(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, entity_id): orders stand for documents, parts for entities."""
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("entity_id")).distinct()


MENTION_SQL = "mentions AS (SELECT DISTINCT l_orderkey AS doc_id, l_partkey AS entity_id FROM lineitem)"


def triples(spark: SparkSession, sf: str) -> DataFrame:
    """(id, subject, predicate, object, valid_from, valid_to, confidence): a customer's order status until the next order."""
    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", F.lead("o_orderdate").over(by).alias("valid_to"))
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("subject"), F.lit("ordered_status").alias("predicate"), F.col("o_orderstatus").alias("object"), F.col("o_orderdate").alias("valid_from"), "valid_to", (F.col("o_orderkey") % 10 / 10).alias("confidence"))


TRIPLE_SQL = """
triples AS (SELECT o_orderkey AS id, o_custkey AS subject, 'ordered_status' AS predicate, o_orderstatus AS object, o_orderdate AS valid_from,
  lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to, (o_orderkey % 10) / 10.0::DOUBLE AS confidence FROM orders)"""
